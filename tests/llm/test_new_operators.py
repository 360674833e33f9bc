"""Token counts, whitening and the prefix trie against plain versions, on whole small tables and planted odd cases."""

import hashlib
import random
import threading
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tracewell.llm import prefix_trie, registry, store, token_counts, whitening

SF = brute.SF
JSON = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, data, schema):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(data, schema)
    for name in ("n", "row", "node", "path", "counts", "x", "rest", "part", "score"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


# token counts


def test_every_prefix_has_the_librarys_count(library):
    rng, vocabulary = random.Random(5), token_counts.load(JSON)
    alphabet = ["a", "e", "th", " ", "  ", "\n", "\t", "'re", "'ve", "'", "!", "<|endoftext|>", "<|endof", "1", "23", "é", "漢字", "\xa0", " ", "😀", "՘", "\U0001e5f6", " of", "aaaa", "....", "\x1c", "\r\n", "'s", "ll", "ab" * 30]
    for _ in range(250):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20)))
        assert vocabulary.counts(text).tolist() == [library(text[:i]) for i in range(1, len(text) + 1)], repr(text)


def test_remembered_steps_are_forgotten_without_harm(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    vocabulary = token_counts.Prefixes(JSON)
    text = "The unbelievable hippopotamuses unbelieve whatever, whatsoever hippodromes say. " * 3
    assert vocabulary.counts(text).tolist() == [library(text[:i]) for i in range(1, len(text) + 1)]


def test_token_counts_of_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = registry.op11_token_counts(spark, SF).collect()
    assert len(got) == docs.count()
    for r in got:
        text = texts[r.doc_id]
        n = library(text)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
        assert library(text[: r.fit_chars]) <= 512 and (r.fit_chars == len(text)) == (n <= 512)


def test_token_counts_odd_cases_and_stored_answers(spark, library):
    long = "x" * 200_000
    data = [(1, None), (2, ""), (None, "a b"), (4, "again"), (4, "again"), (5, long), (6, "w " * 600)]
    docs = frame(spark, data, "doc_id long, text string")
    got = sorted(tuple(r) for r in token_counts.count(docs.filter("doc_id is not null"), JSON).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars").collect())
    assert got[:2] == [(1, 0, 0, False, 0), (2, 0, 0, False, 0)] and got[2] == got[3] == (4, 5, library("again"), False, 5)
    assert got[4][1:4] == (200_000, library(long), True) and got[5][2] == library("w " * 600)
    assert token_counts.count(docs.filter("doc_id is null"), JSON).first().n_tokens == 2
    assert token_counts.count(frame(spark, [], "doc_id long, text string"), JSON).count() == 0
    kept = token_counts.stored(docs, JSON)
    asked = kept.filter("doc_id = 6").select(*(token_counts.tokens_at(F.col("counts"), n).alias(f"t{n}") for n in (-1, 0, 1, 7, 9_999)), *(token_counts.fitting(F.col("counts"), b).alias(f"b{b}") for b in (0, 1, 100, 10_000))).first()
    text = "w " * 600
    assert list(asked)[:5] == [0, 0, 1, library(text[:7]), library(text)]
    assert list(asked)[5:] == [0, *(max(i for i in range(1201) if library(text[:i]) <= b) for b in (1, 100)), 1200]
    assert kept.filter("doc_id = 2").select(token_counts.tokens_at(F.col("counts"), 3), token_counts.fitting(F.col("counts"), 3)).first() == (0, 0)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Prefixes(public_tokenizers.path("word_bpe_49k.json"))


# whitening


@pytest.mark.parametrize("kind", ["apart", "close", "equal", "wide", "none"])
def test_eigenvectors_to_double_precision(kind):
    rng, d = np.random.default_rng(3), 24
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    values = np.sort(rng.uniform(1, 10, d))[::-1]
    if kind == "close":
        values[3:9] = 5 + 1e-9 * np.arange(6)[::-1]
    elif kind == "equal":
        values[2:6] = 3
    elif kind == "wide":
        values = np.logspace(0, -9, d)
    elif kind == "none":
        values = np.zeros(d)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    x = x.astype(np.longdouble)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-14 and np.abs(x.T @ x - np.eye(d)).max() < 1e-15
    assert np.abs(a @ x - x * got).max() < 1e-14


def test_float32_alone_would_not_do():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 16))
    a = (m.T @ m / 50).astype(np.longdouble)
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    residual = lambda x: float(np.abs(a @ x - x * np.diag(x.T @ a @ x)).max())
    assert residual(rough) > 1e-8 and residual(whitening.eigenvectors(a)[1].astype(np.longdouble)) < 1e-14


def plain(vectors):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (z @ v)[:, :32] / np.sqrt(e[:32]), e[:32] / e.sum()


def test_whitening_of_whole_table(spark):
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    got = registry.op12_embedding_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    n, deviation, w, share = plain(p.embedding.tolist())
    assert len(got) == n * 32 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert got.vec_id.tolist() == np.repeat(p.vec_id, 32).tolist() and got.deviation.tolist() == np.repeat(deviation, 32).tolist()
    mine = got.whitened.to_numpy().reshape(n, 32)
    assert np.abs(mine * np.sign((mine * w).sum(0)) - w).max() < 1e-8
    assert np.abs(got.explained.to_numpy()[:32] / share - 1).max() < 1e-12


def test_whitening_odd_cases(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    again = [(None, good[0][1]), (0, good[0][1])]
    got = whitening.whiten(frame(spark, good + odd + again, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 42 * 3 and set(got.n) == {42} and set(got.vec_id.dropna()) == set(range(40))
    n, deviation, _, share = plain([v for _, v in good + again])
    assert sorted(got.deviation) == sorted(np.repeat(deviation, 3)) and np.allclose(sorted(set(got.explained)), sorted(share))
    assert whitening.whiten(frame(spark, [], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).count() == 0
    flat = whitening.whiten(frame(spark, [(i, [float(i), 7.0, -2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")).toPandas()
    assert set(flat.component) == {1} and flat.identity_error.max() < 1e-9


def test_sums_stay_exact_for_large_entries(spark):
    rng = random.Random(2)
    x = [[rng.randint(-(1 << 40), 1 << 40) for _ in range(2)] for _ in range(50)]
    df = spark.createDataFrame([(i, [a / 64 for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = whitening._totals(whitening._usable(df).repartition(3), 2, np.full(2, 1_000_000, np.int64), squares=True)
    assert got == {(i, -1): sum(v[i] for v in x) for i in range(2)} | {(i, j): sum(v[i] * v[j] for v in x) for i, j in ((0, 0), (0, 1), (1, 1))}


# prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    said = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), said(r, t), r, t))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len([w for w in brute.re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("height", [None, 2, 50])
def test_trie_of_planted_conversations(spark, height, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rng = random.Random(7)
    rows = []
    for c in range(0, 130):
        if c % 40 == 20 and c != 60:  # conversations whose shared one is absent
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hi there", "so", "", None])))
    rows += [(c, t, "user", "same old words") for c in range(200, 260) for t in range(3)]  # many that end alike
    rows += [(500, t, "bot", f"turn {t % 7}") for t in range(24)]  # a long one
    rows += [(None, 0, "user", "nobody's"), (501, None, "user", "b"), (501, None, "user", "a"), (501, -3, "user", "c"), (501, -3, "user", "c")]
    got = prefix_trie.trie(frame(spark, rows, "conv_id long, turn long, role string, text string"), height)
    assert trie_rows(got) == brute_trie(rows)


def test_trie_of_no_rows_and_of_no_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(frame(spark, [], schema)).count() == 0
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 0, "user", "dropped")]
    assert trie_rows(prefix_trie.trie(frame(spark, rows, schema))) == brute_trie(rows)


# scratch tables


def test_two_jobs_at_once_keep_their_own_tables(spark):
    written, ended, seen = threading.Event(), threading.Event(), []

    def first():
        with store.scratch(spark):
            assert written.wait(60)
        ended.set()

    def second():
        with store.scratch(spark):
            t = store.materialise(spark.range(5), "mine")
            written.set()
            assert ended.wait(60)
            seen.append(t.count())

    jobs = [threading.Thread(target=f) for f in (first, second)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert seen == [5]


def test_the_trie_leaves_its_result_alone(spark):
    folder = Path(store.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    prefix_trie.trie(spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["trie"]


# vectors of extreme size


def test_cosines_of_very_large_and_very_small_vectors(spark):
    from tracewell.llm import vector_join

    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [0.0, 0.0]), (6, [-1e-300, 1e-310]), (7, [-3.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6)}
