"""Toxicity scoring by a factorization machine over hashed terms.

Terms are words and their leading letters, hashed into `SLOTS`. From a bounded sample of labelled rows Spark counts in
how many toxic and clean texts each term stands; the `TERMS` terms with the largest likelihood ratio enter the machine,
which learns a weight for each term and, by `RANK` factors, for each pair of terms that meet in one text.

Only fitting is bounded (`MAX_FIT` labelled rows, those with the smallest hash of doc_id); every text is scored whole.

Defined results: null or empty texts get the machine's bias; no labelled row, or labels of one kind only: the score is
that share of toxic labels (0 if there are none). Null labels and labels without a document are not learned from.
Repeated rows are scored alike. Null doc_id counts as the empty string for the fold. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import fold
from .wordbytes import ALNUM, Words, chunks, parts, span_hash

SLOTS = 1 << 20
TERMS = 1024
RANK = 6
MAX_FIT = 30_000
EPOCHS = 120
PREFIXES = (5, 6)
OUT = "doc_id long, held_out boolean, score double, predicted int"


def _terms(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each distinct term of each text."""
    w = Words(encoded, ALNUM)
    slots, of = [w.hash & np.uint64(SLOTS - 1)], [w.text_of]
    for n in PREFIXES:
        (some,) = np.nonzero(w.ends - w.starts > n)
        h = span_hash(w.buf, w.starts[some], w.starts[some] + n)
        slots.append((h ^ np.uint64(0x5BD1E995 * n)) >> np.uint64(7) & np.uint64(SLOTS - 1))
        of.append(w.text_of[some])
    key = np.unique(np.concatenate(of).astype(np.int64) * SLOTS + np.concatenate(slots).astype(np.int64))
    return key // SLOTS, key % SLOTS


def sample(labels: DataFrame, max_fit: int) -> DataFrame:
    """At most max_fit labelled rows outside the held-out fold, by hash order."""
    rows = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter("toxic in (0, 1) and label_id is not null").filter(fold(F.col("label_id"), 5) != 0)
    return rows.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(max_fit)


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Machine:
    """A machine learned from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    # bounded by max_fit rows of two numbers, hence broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample(labels, max_fit)), F.col("doc_id") == F.col("label_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, SLOTS + 1), np.int64)
        for batch in parts(batches):
            y = batch.column("toxic").to_numpy()
            for at, enc in chunks(batch.column("text").to_pylist()):
                of, slot = _terms(enc)
                own = y[at : at + len(enc)]
                for k in (0, 1):
                    n[k] += np.bincount(slot[own[of] == k], minlength=SLOTS + 1)
                    n[k, SLOTS] += (own == k).sum()
        (at,) = np.nonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["slot", "clean", "toxic"])

    counts = rows.select("text", "toxic").mapInArrow(count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    total = counts.filter(F.col("slot") == SLOTS).first()
    if not total or not total.clean or not total.toxic:
        counts.unpersist()
        return Machine(np.zeros(0, np.int64), float(bool(total and total.toxic)), np.zeros(1), np.zeros((1, RANK)), fixed=True)
    a, b = F.col("toxic") + 0.0, F.col("clean") + 0.0
    pa_, pb = a / total.toxic, b / total.clean
    both = (a + b) / (total.toxic + total.clean)
    # G statistic of a term's presence against the label
    g = F.when(a > 0, a * F.log(pa_ / both)).otherwise(0) + F.when(b > 0, b * F.log(pb / both)).otherwise(0)
    top = counts.filter((F.col("slot") < SLOTS) & (a + b >= 3)).orderBy(F.abs(g).desc(), "slot").select("slot").limit(TERMS).toArrow()
    counts.unpersist()
    terms = np.sort(top["slot"].to_numpy().astype(np.int64))
    known = spark.sparkContext.broadcast(terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            y = batch.column("toxic").to_numpy()
            for at, enc in chunks(batch.column("text").to_pylist()):
                rows = [[] for _ in enc]
                for i, x in zip(*_active(enc, known.value), strict=True):
                    rows[i].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(y[at : at + len(enc)].astype(np.int32)), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "terms"])

    got = rows.select("text", "toxic").mapInArrow(features, "toxic int, terms array<int>").toArrow()  # max_fit rows
    return _learn(terms, got["toxic"].to_numpy(), [np.array(x, np.int64) for x in got["terms"].to_pylist()])


def _active(encoded: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in terms) of the known terms of each text."""
    of, slot = _terms(encoded)
    flag = np.zeros(SLOTS, bool)
    flag[terms] = True
    keep = flag[slot]
    return of[keep], np.searchsorted(terms, slot[keep])


class Machine:
    """bias + sum of weights + sum over pairs of the dot product of their factors; a text's terms each count 1."""

    def __init__(self, terms: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray, fixed: bool = False) -> None:
        self.terms, self.bias, self.weight, self.factor, self.fixed = terms, bias, weight, factor, fixed

    def margin(self, of: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.stack([np.bincount(of, f[at], n) for f in self.factor.T], 1)
        square = np.bincount(of, (self.factor**2).sum(1)[at], n)
        return self.bias + np.bincount(of, self.weight[at], n) + 0.5 * ((total**2).sum(1) - square), total

    def score(self, encoded: list[bytes]) -> np.ndarray:
        if self.fixed:
            return np.full(len(encoded), self.bias)
        z, _ = self.margin(*_active(encoded, self.terms), len(encoded))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _learn(terms: np.ndarray, y: np.ndarray, rows: list[np.ndarray], epochs: int = EPOCHS) -> Machine:
    """Logistic loss with weight decay, full-batch steps with adaptive moments."""
    n, d = len(y), max(1, len(terms))
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    rng = np.random.RandomState(11)
    m = Machine(terms, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(d), rng.normal(0, 0.02, (d, RANK)))
    theta = [np.array([m.bias]), m.weight, m.factor]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, epochs + 1):
        z, total = m.margin(of, at, n)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        eo = e[of]
        cross = np.stack([np.bincount(at, eo * total[of, k], d) for k in range(RANK)], 1)
        own = np.bincount(at, eo, d)
        grads = [np.array([e.sum()]), own + 1e-4 * m.weight, cross - m.factor * own[:, None] + 1e-4 * m.factor]
        for i, (t, g) in enumerate(zip(theta, grads, strict=True)):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            t -= 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
        m.bias = float(theta[0][0])
    return m


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            s = np.concatenate([np.zeros(0), *(shared.value.score(enc) for _, enc in chunks(batch.column("text").to_pylist()))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text").mapInArrow(run, OUT)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
