"""The pipeline's stages, one by one, against plain versions on the small table."""

import hashlib

import corpus_pipeline as P
import numpy as np
import regex
from tests.llm import brute
from tracewell.llm import bpe, store, suffix_dedup

SF = brute.SF
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = {}
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, SF)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        state[name] = before
        if name != P.STAGES[-1][0]:
            assert docs.columns == COLUMNS
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language ID":
            gone = [t for d, t in before if d not in after]
            assert all(not t or not regex.search(r"\p{L}", t) or len(t) < 2000 for t in gone) and len(gone) < 0.05 * len(before)
        elif name == "n-gram Jaccard join":
            assert sorted(after) == [d for d, _, c in brute.jaccard_groups(before) if c == d]
        elif name == "suffix-array dedup":
            want = brute.repeats(before)
            assert len(after) == len(before)
            for d, n, removed, spans, digest in want:
                if not removed:
                    assert hashlib.sha256(after[d].encode()).hexdigest() == digest
                else:
                    assert n - removed - 6 * spans <= len(after[d].encode()) <= n - removed
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(after) == [r[0] for r in brute.contamination(before, items) if not r[5]]
    import public_tokenizers as T

    own = bpe.load(T.path("byte_bpe_multi_50k.tiktoken"), T.PATTERN)
    got = {r.doc_id: r for r in docs.collect()}
    before = state["byte-level BPE"]
    assert sorted(got) == sorted(d for d, _ in before)
    for d, t in before:
        assert own.decode(np.array(got[d].ids)) == t.encode() and got[d].n_tokens == len(got[d].ids)


def test_pipeline_odd_rows(spark, tmp_path):
    rows = [(1, "the cat sat on the mat", "en", "s", 22), (2, "", "en", "s", 0), (3, None, None, None, None), (1, "the cat sat on the mat", "en", "s", 22), (4, "12 34", "en", "s", 5), (5, "der hund lief weg", "de", "s", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert sorted(r.doc_id for r in docs.collect()) == [1, 5]


def test_pipeline_of_empty_and_long_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    word = lambda k, n: " ".join(f"the{k} cat{i % 97} sat{i}" for i in range(n))
    long_ = word(1, 60_000)
    for k, data in enumerate(([], [(1, long_, "en", "s", len(long_)), (2, long_[:-8] + "end.", "en", "s", len(long_)), (3, word(2, 50), "en", "s", 9)])):
        docs = spark.createDataFrame(data, schema)
        for j, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}-{j}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{j}"))
        assert sorted(r.doc_id for r in docs.collect()) == ([1, 3] if data else [])


def test_pipeline_run_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() and len(list(tmp_path.iterdir())) == 1


def test_pipeline_judges_rows_not_ids(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 20)
    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(8)]
    rows = [(None, text[0]), (5, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (7, text[3]), (7, text[4]), (3, text[4]), (None, item), (9, item), (9, text[5])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = P.near_duplicates(spark, docs, SF)
    assert near.columns == COLUMNS
    got = sorted(((r.doc_id or 0, r.text) for r in near.collect()))
    assert got == sorted([(5, text[0]), (0, text[1]), (0, text[2]), (7, text[3]), (3, text[4]), (9, item), (9, text[5])])
    left = P.contamination(spark, docs, SF)
    assert left.columns == COLUMNS
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted((d or 0, t) for d, t in rows if t != item)


def test_repeated_strings_carries_a_text_once(spark, monkeypatch):
    find, carried = suffix_dedup.find, []
    monkeypatch.setattr(suffix_dedup, "find", lambda docs, carry: carried.append(carry) or find(docs, carry))
    again = "".join(chr(97 + i * i % 23) for i in range(120))
    docs = spark.createDataFrame([(1, again, "en", "s", 120), (2, "\u00e9" + again, None, "s", 121), (3, None, "en", None, None), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.repeated_strings(spark, docs, SF)
    assert got.columns == COLUMNS and carried == [[c for c in COLUMNS if c != "text"]]
    assert sorted(map(tuple, got.collect())) == [(1, again, "en", "s", 120), (2, "\u00e9", None, "s", 1), (3, None, "en", None, None), (4, "", "en", "s", 0)]


def test_texts_reach_python_in_bounded_batches(spark):
    session = spark.newSession()
    docs = session.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat('the cat ', 500) as text", "'en' as lang", "'s' as source", "4000L as n_chars")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    most = lambda: max(r.n for r in docs.mapInArrow(sizes, "n long").collect())
    assert most() > 8_000_000
    P.repeated_strings(session, docs.limit(0), SF)
    assert most() < 5_000_000
    session.conf.set(store.BATCH, "9m")
    P.language(session, docs.limit(0), SF)
    assert session.conf.get(store.BATCH) == "9m"
