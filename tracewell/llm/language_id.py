"""Language identification by multilingual mixture inference.

A document is a bag of words, each drawn from one language; a word's likelihood in a language is the product of that
language's probabilities of its hashed letter trigrams. Expectation-maximisation estimates each document's language
proportions; nested sets of its leading languages are then compared by penalised likelihood, and the largest
proportion within the chosen set is the prediction.

Corpus counts cover every training row and are summed by Spark; what reaches the driver is the model alone
(languages x `buckets`).

Defined results: null text or text without a letter: `und`, score 0. No training row: `und` for all. Repeated rows are
scored alike, one output row each. Null doc_id counts as the empty string for the fold. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import byte_class, chunks, parts

BUCKETS = 1 << 15
ALPHA = 0.05
#: log-likelihood that a further language must gain, times log(1 + words)
PENALTY = 2.0
EM_STEPS = 6
UND = "und"
OUT = "doc_id long, held_out boolean, lang_pred string, score double, languages string"
_LETTER = regex.compile(r"\p{L}")
_LETTERS = byte_class([(0, 0x60), (0x7B, 0x7F)])
_KEEP = np.where(_LETTERS, np.arange(256), 0x20).astype(np.uint8)


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


class _Grams:
    """Trigram buckets of every word of a run of texts, word by word; a word is a run of letter bytes."""

    def __init__(self, encoded: list[bytes], buckets: int) -> None:
        lens = np.fromiter((len(b) + 2 for b in encoded), np.int64, len(encoded))
        b = _KEEP[np.frombuffer(b"".join(b" %b " % x for x in encoded), np.uint8)].astype(np.uint32)
        mid = b[1:-1] != 0x20
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        self.gram = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(12))[mid] & np.uint32(buckets - 1)
        edge = np.diff(np.concatenate(([0], mid.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.word_at = np.concatenate(([0], np.cumsum(ends - starts)[:-1])).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        n_letters = np.concatenate(([0], np.cumsum(mid)))
        bounds = np.concatenate(([0], np.cumsum(lens)))
        #: letters and words before each text
        self.letters = n_letters[np.clip(bounds - 1, 0, len(mid))]
        self.words = np.searchsorted(starts, np.clip(bounds - 1, 0, len(mid)))


def _texts(col: pa.ChunkedArray | pa.Array) -> list[str]:
    return ["" if t is None else t.lower() for t in col.to_pylist()]


def train(docs: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, from rows of (text, lang); buckets x languages, float32."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in parts(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, enc in chunks(_texts(batch.column("text"))):
                g = _Grams(enc, buckets)
                of = langs[at : at + len(enc)]
                for lang in set(of):
                    mask = np.repeat(of == lang, np.diff(g.letters))
                    held[lang] = held.get(lang, 0) + np.bincount(g.gram[mask], minlength=buckets)
        for lang, n in held.items():
            (at,) = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    rows = docs.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(count, "lang string, gram int, n long")
    rows = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.full((buckets, len(langs)), ALPHA)
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        table[rows["gram"].to_numpy(), [at[x] for x in rows["lang"].to_pylist()]] += rows["n"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def _em(rel: np.ndarray, at: np.ndarray, n: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood (relative to each word's best) after some steps, for documents of n words each."""
    for _ in range(steps):
        p = rel * np.repeat(pi, n, axis=0)
        p /= p.sum(1, keepdims=True) + 1e-30
        pi = np.add.reduceat(p, at, axis=0) / n[:, None]
    like = np.log((rel * np.repeat(pi, n, axis=0)).sum(1) + 1e-30)
    return pi, np.add.reduceat(like, at)


def infer(word_like: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(chosen language sets as booleans, proportions within them) from words' log-likelihoods by language.

    n: words of each document, none zero; word_like has their words in order.
    """
    k = word_like.shape[1]
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    log_rel = word_like - word_like.max(1, keepdims=True)
    rel = np.exp(log_rel)
    single = np.add.reduceat(log_rel, at, axis=0)
    best = single.argmax(1)
    rows = np.arange(len(n))
    full, top = _em(rel, at, n, np.full((len(n), k), 1 / k, np.float32), EM_STEPS)
    chosen = np.zeros((len(n), k), bool)
    chosen[rows, best] = True
    pi = chosen.astype(np.float32)
    cost = penalty * np.log1p(n)
    value = single[rows, best].astype(np.float64)
    order = np.argsort(-full, axis=1, kind="stable")
    # no set can gain more than all languages together do: most documents stop here
    open_ = np.flatnonzero(top - value > cost)
    for m in range(2, k + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k), np.float32)
        np.put_along_axis(allowed, order[open_, :m], 1, 1)
        words = np.concatenate([np.arange(a, a + c) for a, c in zip(at[open_], n[open_], strict=True)])
        own = np.concatenate(([0], np.cumsum(n[open_])[:-1]))
        start = full[open_] * allowed + 1e-6 * allowed
        p, like = _em(rel[words], own, n[open_], (start / start.sum(1, keepdims=True)).astype(np.float32), EM_STEPS)
        now = like - (m - 1) * cost[open_]
        better = now > value[open_]
        won = open_[better]
        value[won], chosen[won], pi[won] = now[better], allowed[better] > 0, p[better]
        open_ = open_[(top[open_] - m * cost[open_]) > value[open_]]
    return chosen, pi


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the chosen languages with their proportions, for every row of docs.

    A column `rest` of docs is handed on.
    """
    extra = [c for c in docs.columns if c == "rest"]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = np.array([*langs, UND], object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in parts(batches):
            raw = batch.column("text").to_pylist()
            pred, got, said = np.full(len(raw), len(langs)), np.zeros(len(raw)), [""] * len(raw)
            for at, enc in chunks(["" if t is None else t.lower() for t in raw]) if langs else ():
                g = _Grams(enc, table.shape[0])
                if not len(g.word_at):
                    continue
                like = np.add.reduceat(table[g.gram], g.word_at, axis=0)
                n = np.diff(g.words)
                (some,) = np.nonzero(n)
                chosen, pi = infer(like, n[some], penalty)
                pred[at + some], got[at + some] = pi.argmax(1), pi.max(1)
                for i in np.flatnonzero(chosen.sum(1) > 1):
                    said[at + some[i]] = ",".join(f"{names[k]}:{pi[i, k]:.3f}" for k in np.argsort(-pi[i]) if chosen[i, k])
            for i, t in enumerate(raw):
                if pred[i] < len(langs):
                    if not _LETTER.search(t):
                        pred[i], got[i], said[i] = len(langs), 0.0, ""
                    elif not said[i]:
                        said[i] = f"{names[pred[i]]}:1.000"
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[pred].tolist(), pa.string()), pa.array(np.clip(got, 0, 1)), pa.array(said), *(batch.column(c) for c in extra)], ["doc_id", "held_out", "lang_pred", "score", "languages", *extra])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text", *extra).mapInArrow(score, OUT + kinds)


def identify(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Train on rows of (doc_id, text, lang) outside the held-out third and predict every row's language.

    carry: columns of docs to hand on, in a struct named rest.
    """
    rest = [F.struct(*carry).alias("rest")] if carry else []
    cut = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), *rest)
    return predict(cut, *train(cut.filter("not held_out")))
