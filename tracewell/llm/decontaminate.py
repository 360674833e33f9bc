"""Benchmark decontamination with an FM-index for each shard of the training text.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). Words that no item has cannot lie
in a window, so a shard keeps, as symbols, only maximal runs of benchmark words at least as long as the shortest
window. Over these the task builds an FM-index: a suffix array by prefix doubling, the Burrows-Wheeler transform in a
wavelet tree, and suffix positions sampled every `SAMPLE` places. All windows search
backwards together through the tree's ranks; occurrences are located by stepping to the next sampled position, and
their spans are merged into removal spans.

The windows go to every task as one broadcast of at most `BENCH_WORDS` words at a time; a larger benchmark is searched
in that many passes, whose spans are then merged by document.

Defined results: null or wordless texts have no words and no hits; items without words are no windows; the digest of
no items is that of the empty string. Items that repeat an item_id count once. Rows that repeat a doc_id are judged one
by one. Null item_ids are not counted as items, but their windows hit. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import ALNUM, Words, chunks, parts

N = 13
SAMPLE = 16
SHARD = 8 << 20
BENCH_WORDS = 200_000
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


class WaveletTree:
    """Symbols below 2**bits, one bit vector for each bit from the highest, with counts before every position."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones, z = self.ones[level], self.zeros[level]
            a, b = ones[low], ones[high]
            low, high = np.where(bit == 1, z + a, low - a), np.where(bit == 1, z + b, high - b)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros(len(at), np.int64)
        for ones, z in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, z + ones[at], at - ones[at])
        return out


class FmIndex:
    """Backward search over a sequence of symbols from 1 to n_symbols; 0 ends it."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        text = np.append(symbols.astype(np.int64), 0)
        n = len(text)
        # prefix doubling until every suffix has a rank of its own, which the steps of locate() need
        rank, width = np.unique(text, return_inverse=True)[1], 1
        while rank.max() < n - 1:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - width)] = rank[width:] + 1
            _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
            width *= 2
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(n_symbols).bit_length()))
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        marked = order % SAMPLE == 0
        self.mark = np.concatenate(([0], np.cumsum(marked, dtype=np.int32)))
        self.sampled = order[marked]
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each phrase; phrases has one row each, aligned right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            (live,) = np.nonzero((lengths >= k) & (low < high))
            if not len(live):
                break
            c = phrases[live, -k]
            low[live] = self.less[c] + self.tree.rank(c, low[live])
            high[live] = self.less[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order: steps back to a sampled one."""
        out, steps = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        (open_,) = np.nonzero(out < 0)
        at = at.copy()
        while len(open_):
            p = at[open_]
            hit = self.mark[p + 1] > self.mark[p]
            out[open_[hit]] = self.sampled[self.mark[p[hit]]] + steps[open_[hit]]
            open_ = open_[~hit]
            p = at[open_]
            c = self.tree.symbol(p)
            at[open_] = self.less[c] + self.tree.rank(c, p)
            steps[open_] += 1
        return out


class Phrases:
    """Distinct windows of benchmark items, as symbols of the benchmark's vocabulary, and the items that have them."""

    def __init__(self, items: list[tuple[str | None, str | None]]) -> None:
        #: words are hashed under a seed of this job: nobody can write a word that passes for an item's
        self.seed = secrets.randbits(64)
        w = Words([b"" if t is None else t.encode("utf-8", "replace") for _, t in items], ALNUM, seed=self.seed)
        self.vocabulary, symbol = np.unique(w.hash, return_inverse=True)
        symbol = symbol + 1
        rows: dict[tuple[int, ...], set[str]] = {}
        for i, (item, _) in enumerate(items):
            own = symbol[w.word_at[i] : w.word_at[i + 1]].tolist()
            for k in range(max(1, len(own) - N + 1) if own else 0):
                rows.setdefault(tuple(own[k : k + N]), set()).update([] if item is None else [item])
        self.items = [sorted(x) for x in rows.values()]
        self.lengths = np.array([len(x) for x in rows], np.int64)
        self.rows = np.zeros((len(rows), N), np.int64)
        for i, x in enumerate(rows):
            self.rows[i, N - len(x) :] = x
        self.shortest = int(self.lengths.min()) if len(rows) else 0
        #: a quick test before the search in the sorted vocabulary
        self.flag = np.zeros(1 << 20, bool)
        self.flag[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The words' symbols, 0 for words outside the vocabulary."""
        out = np.zeros(len(h), np.int64)
        (maybe,) = np.nonzero(self.flag[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == h[maybe]
        out[maybe[ok]] = at[ok] + 1
        return out


class _Shard:
    """Runs of benchmark words, gathered until there are enough for one index."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.symbols, self.doc, self.place, self.size = phrases, [], [], [], 0
        self.n_words: list[np.ndarray] = []
        self.n_docs = self.n_bytes = 0

    def add(self, encoded: list[bytes]) -> None:
        w = Words(encoded, ALNUM, seed=self.phrases.seed)
        counts = np.diff(w.word_at)
        self.n_words.append(counts)
        if len(w.hash) and len(self.phrases.rows):
            s = self.phrases.symbols(w.hash)
            known = s > 0
            head = known & np.concatenate(([True], ~known[:-1] | (w.text_of[1:] != w.text_of[:-1])))
            run = np.cumsum(head) - 1
            long_ = known.copy()
            long_[known] = np.bincount(run[known])[run[known]] >= self.phrases.shortest
            (at,) = np.nonzero(long_)
            if len(at):
                # a run starts with the separator, a symbol that no phrase has
                cuts = np.flatnonzero(head[at])
                sep = len(self.phrases.vocabulary) + 1
                self.symbols.append(np.insert(s[at], cuts, sep))
                self.doc.append(np.insert(self.n_docs + w.text_of[at], cuts, -1))
                self.place.append(np.insert(at - w.word_at[w.text_of[at]], cuts, -1))
        self.n_docs += len(encoded)
        self.n_bytes += sum(map(len, encoded))

    def result(self) -> tuple[np.ndarray, list[list[list[int]]], list[set[str]]]:
        """Words, merged spans of hit words and items, of each document."""
        n_words = np.concatenate([*self.n_words, np.zeros(0, np.int64)])
        spans, items = [[] for _ in range(self.n_docs)], [set() for _ in range(self.n_docs)]
        if self.symbols:
            p = self.phrases
            doc, place = np.concatenate(self.doc), np.concatenate(self.place)
            index = FmIndex(np.concatenate(self.symbols), len(p.vocabulary) + 1)
            low, high = index.search(p.rows, p.lengths)
            (found,) = np.nonzero(high > low)
            n = (high - low)[found]
            which = np.repeat(found, n)
            at = np.repeat(low[found] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            pos = index.locate(at) if len(at) else at
            order = np.lexsort((place[pos], doc[pos]))
            for d, b, k in zip(doc[pos[order]].tolist(), place[pos[order]].tolist(), which[order].tolist(), strict=True):
                items[d].update(p.items[k])
                e, own = b + int(p.lengths[k]), spans[d]
                if own and b <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], e)
                else:
                    own.append([b, e])
        return n_words, spans, items


def _row(n_words: int, spans: list, items: set[str]) -> tuple:
    n_hit = sum(e - b for b, e in spans)
    names = sorted(items)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def _pass(docs: DataFrame, items: list[tuple[str | None, str | None]], shard_bytes: int) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = _Shard(phrases.value), []

        def flush() -> pa.RecordBatch:
            n_words, spans, items = shard.result()
            cols = list(zip(*(_row(int(a), b, c) for a, b, c in zip(n_words, spans, items, strict=True)), strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            arrays = [pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            arrays.append(pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            arrays.append(pa.array([sorted(x) for x in items], pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])

        for batch in parts(batches):
            col = batch.column("doc_id")
            for at, enc in chunks(batch.column("text").to_pylist()):
                shard.add(enc)
                ids.append(col.slice(at, len(enc)))
                if shard.n_bytes >= shard_bytes:
                    yield flush()
                    shard, ids = _Shard(phrases.value), []
        if shard.n_docs:
            yield flush()

    return docs.mapInArrow(run, _OUT + ", items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, bench_words: int = BENCH_WORDS, shard_bytes: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (word positions), for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = 1 + size // (6 * bench_words)
    if passes == 1:
        return _pass(docs, [tuple(r) for r in items.collect()], shard_bytes).drop("items")
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    found = None
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        got = _pass(docs.select(F.col("row").alias("doc_id"), "text"), [tuple(r) for r in part.collect()], shard_bytes)
        got = got.select(F.col("doc_id").alias("row"), "n_words", "spans", "items")
        found = got if found is None else found.unionByName(got)
    merged = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return docs.select("row", "doc_id").join(merged, "row").mapInArrow(_merged, _OUT)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, merged = [], []
        for r in batch.to_pylist():
            spans: list[list[int]] = []
            for s in r["spans"]:
                if spans and s["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s["end"])
                else:
                    spans.append([s["start"], s["end"]])
            rows.append((r["doc_id"], *_row(r["n_words"], spans, set(r["items"]))))
            merged.append([{"start": a, "end": b} for a, b in spans])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        arrays = [pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)]
        arrays.append(pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])
