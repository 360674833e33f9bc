"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if it lies in a string of `N` bytes that also starts earlier: at a smaller doc_id, or earlier in the same
document. Every N-byte window is filed under its anchor, the `K`-gram within it of the smallest hash (leftmost of
equals), so equal windows have equal anchors at equal places, and only suffixes that start at anchors need sorting: about
two for every N - K bytes. An anchor's context is the stretch of bytes that its windows cover.

1. Anchors whose K-gram occurs once in the corpus are dropped: no window of theirs occurs twice.
2. Equal contexts are put together by 128-bit digest; all but the first occurrence are covered by repeated windows
   throughout.
3. First occurrences whose anchor has other contexts too are cut down to runs of windows that occur in several of them;
   of equal runs, too, all but the first are covered throughout, so that a passage in many documents is one record.
   Each task sorts their suffixes into runs, front-codes them (length of the prefix shared with the suffix before, and
   the rest), and sends each range of the order, cut between K-grams, to one task, which merges the runs with a loser tree that knows all
   common prefixes and compares bytes beyond them only. Neighbours' common prefixes give the intervals of suffixes that
   share their first N - l bytes; with equal l bytes before the anchor, they hold equal windows, the first of which stays.

Which tokens (anchors, windows) occur more than once is counted exactly, on packed tokens, and told to each partition of the
corpus in files of its own (`filed`), like all else that a later scan has to know of its rows: nothing goes to all tasks,
and texts are never moved. What is written grows in step with the corpus, and goes when its step is done. Texts are whole
and treated as UTF-8 bytes; matches never cross documents.

Defined results: null counts as empty; texts under N bytes lose nothing. Rows that share a doc_id are taken in the order
of the table; null doc_ids come last. The table is read several times and must stay the same. Other columns are not
read, unless carried.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filed import Filed, Tokens, by_partition, column, file, numbered, ranges, repeated
from .store import materialise, settled
from .wordbytes import CHUNK, chunks, mix, parts

N, K = 100, 50
RUN = 50_000
#: records of a range, about
RANGE = 50_000
#: occurrences of contexts are packed in runs of about so many, by the first bits of their digests
RUN_FOUND, PART_BITS = 1 << 17, 10
_LAST = (1 << 63) - 1
#: an occurrence of a context: its digest, where it is, its anchor's hash
_OCCURRENCE = np.dtype([("x", "<u8"), ("y", "<u8"), ("doc_id", "<i8"), ("row", "<i8"), ("lo", "<i8"), ("anchor", "<u8")])


#: powers of an odd number and of its inverse, for hashes that only propose: whatever they let pass is compared in full
_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(CHUNK + 2 * N, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on; buf has CHUNK + 2 * N bytes at most."""
    n = len(buf)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _UP[:n], out=s[1:])
    return mix((s[size:] - s[:-size]) * _DOWN[: n - size + 1])


class Anchors:
    """Anchors of a run of texts: the text, the K-gram's hash, its place, and the windows lo..hi filed under it.

    Windows are worked off in blocks of CHUNK; where a block ends within a long text, so does a context.
    """

    def __init__(self, encoded: list[bytes]) -> None:
        lens = np.fromiter((len(b) for b in encoded), np.int64, len(encoded))
        self.at = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else lens
        self.raw = b"".join(encoded)
        self.buf = np.frombuffer(self.raw, np.uint8)
        windows = np.maximum(lens - N + 1, 0)
        got = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
        for a in range(0, len(self.buf) - N + 1, CHUNK):
            got.append(self._block(a, min(a + CHUNK, len(self.buf) - N + 1), self.at, self.at + windows, self.at + lens))
        self.text, self.place, self.lo, self.hi, self.hash = (np.concatenate(x) for x in zip(*got, strict=True))

    def _block(self, a: int, b: int, first: np.ndarray, stop: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors of the windows that start at a..b-1; a text's windows are first..stop-1 and its bytes end at end."""
        span = N - K + 1
        v = rolling(self.buf[a : b + N - 1], K)
        bits = np.uint64(int(len(v)).bit_length())
        low = v >> bits << bits | np.arange(len(v), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        own = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        step = np.zeros(b - a + 1, np.int64)
        some = (stop > first) & (first < b) & (stop > a)
        np.add.at(step, np.maximum(first[some] - a, 0), 1)
        np.add.at(step, np.minimum(stop[some] - a, b - a), -1)
        (window,) = np.nonzero(np.cumsum(step)[: b - a] > 0)
        if not len(window):
            return (window,) * 4 + (np.zeros(0, np.uint64),)
        own = own[window]
        text = np.searchsorted(end, a + window, side="right")
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1]))))
        text, place = text[new], own[new]
        start = self.at[text] - a
        return text, place - start, window[new] - start, window[np.append(new[1:], len(window)) - 1] - start, v[place]

    def bytes_of(self, k: int) -> bytes:
        a = int(self.at[self.text[k]])
        return self.raw[a + int(self.lo[k]) : a + int(self.hi[k]) + N]

    def digests(self, which: np.ndarray) -> list[bytes]:
        """128 bits that stand for the bytes of each context and the anchor's place in it."""
        begin = self.at[self.text[which]]
        a, b, x = begin + self.lo[which], begin + self.hi[which] + N, self.place[which] - self.lo[which]
        return [hashlib.blake2b(self.raw[i:j], digest_size=16, salt=k.to_bytes(8, "little")).digest() for i, j, k in zip(a.tolist(), b.tolist(), x.tolist(), strict=True)]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], list(cols))


def _anchor_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, enc in chunks(batch.column("text").to_pylist()):
        yield Anchors(enc).hash


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)


def _firsts(found: np.ndarray) -> np.ndarray:
    """The first occurrence of each context, in the order in which they stand."""
    order = np.lexsort([found[c] for c in ("lo", "row", "doc_id", "y", "x")])
    new = np.ones(len(order), bool)
    new[1:] = (found["x"][order[1:]] != found["x"][order[:-1]]) | (found["y"][order[1:]] != found["y"][order[:-1]])
    return found[np.sort(order[new])]


def _pack_found(found: np.ndarray) -> bytes:
    """Digests and hashes as they are; the rest, whose rows ascend, in planes of bytes, ids and rows as differences."""
    rest = np.array([np.diff(found["doc_id"], prepend=0), np.diff(found["row"], prepend=0), found["lo"]], "<i8")
    planes = zstandard.ZstdCompressor(level=1).compress(rest.reshape(-1, 1).view(np.uint8).T.tobytes())
    return np.uint32(len(found)).tobytes() + np.array([found[c] for c in ("x", "y", "anchor")], "<u8").tobytes() + planes


def _unpack_found(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    out = np.empty(n, _OCCURRENCE)
    out["x"], out["y"], out["anchor"] = np.frombuffer(raw, "<u8", 3 * n, 4).reshape(3, n)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 + 24 * n :]), np.uint8).reshape(8, -1)
    doc_id, row, out["lo"] = np.ascontiguousarray(planes.T).view("<i8").reshape(3, n)
    out["doc_id"], out["row"] = np.cumsum(doc_id), np.cumsum(row)
    return out


def _place_keys(row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Places of windows in a partition as single numbers."""
    return (row.view(np.uint64) << np.uint64(31)) | lo.view(np.uint64)


class _Places:
    """Places of first occurrences in a partition."""

    def __init__(self, tables: list[pa.Table]) -> None:
        self.keys = np.sort(_place_keys(column(tables, "row"), column(tables, "lo")))

    def has(self, row: np.ndarray, lo: np.ndarray) -> np.ndarray:
        key = _place_keys(row, lo)
        if not len(self.keys):
            return np.zeros(len(key), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


class _Spans:
    """Spans of a partition by row."""

    def __init__(self, tables: list[pa.Table]) -> None:
        row, start, end = (column(tables, c) for c in ("row", "start", "end"))
        order = np.lexsort((start, row))
        self.row, self.start, self.end = row[order], start[order].tolist(), end[order].tolist()

    def of(self, rows: np.ndarray) -> list[list[tuple[int, int]]]:
        a, b = (np.searchsorted(self.row, rows, side).tolist() for side in ("left", "right"))
        return [list(zip(self.start[i:j], self.end[i:j], strict=True)) for i, j in zip(a, b, strict=True)]


def _front_code(records: list[tuple]) -> bytes:
    """Sorted records (suffix, left bytes, doc_id, row, place), each suffix without what it shares with the one before."""
    shared, rest, before = [], [], b""
    for r in records:
        k = common(before, r[0], 0)
        shared.append(k)
        rest.append(r[0][k:])
        before = r[0]
    head = np.array([shared, [len(x) for x in rest], [len(r[1]) for r in records]], "<u2")
    meta = np.array([r[2:] for r in records], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(records)], "<u4").tobytes() + head.tobytes() + meta.tobytes() + b"".join(rest) + b"".join(r[1] for r in records))


def _decode(block: bytes) -> Iterator[tuple[int, tuple]]:
    """(bytes shared with the suffix before, record) of a front-coded run."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    shared, rest, left = np.frombuffer(raw, "<u2", 3 * n, 4).reshape(3, n).tolist()
    meta = np.frombuffer(raw, "<i8", 3 * n, 4 + 6 * n).reshape(n, 3).tolist()
    at, before = 4 + 30 * n, b""
    at_left = at + sum(rest)
    for k in range(n):
        before = before[: shared[k]] + raw[at : at + rest[k]]
        at += rest[k]
        yield shared[k], (before, raw[at_left : at_left + left[k]], *meta[k])
        at_left += left[k]


def common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known to agree."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    size = n - known
    return known + size - 1 - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() - 1) // 8


class LoserTree:
    """Merges runs of (bytes shared with the suffix before, record).

    Each loser keeps how much it shares with the winner it lost to. Of two contenders that share different amounts with
    the last winner, the one that shares more is smaller: no byte is looked at. Only equal amounts compare bytes, from
    there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, tuple]]]) -> None:
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.head: list[tuple | None] = [None] * self.size
        self.known = [0] * self.size
        for k, r in enumerate(runs):
            self._pull(k)
            self.known[k] = 0
        self.loser = [0] * self.size
        self.best = self._build(1)

    def _pull(self, k: int) -> None:
        self.known[k], self.head[k] = next(self.runs[k], (0, None))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at the node, with what it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None or x is None:
            if x is None:
                a, b = b, a
            self.loser[node] = b
            return a
        p, q = self.known[a], self.known[b]
        if p == q:
            both = common(x[0], y[0], p)
            if both < len(x[0]) and both < len(y[0]):
                less = x[0][both] < y[0][both]
            elif len(x[0]) != len(y[0]):
                less = len(x[0]) < len(y[0])
            else:
                less = x[1:] <= y[1:]
            if not less:
                a, b = b, a
            self.known[b] = both
        elif p < q:
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        """(bytes shared with the record before, record) in order."""
        while (record := self.head[self.best]) is not None:
            k = self.best
            yield self.known[k], record
            self._pull(k)
            node = (k + self.size) // 2
            while node:
                k = self._play(node, k, self.loser[node])
                node //= 2
            self.best = k


def _resolve(merged: Iterator[tuple[int, tuple]]) -> pd.DataFrame:
    """Row and byte span of the windows that also start earlier, from suffixes in order."""
    shared, records = [], []
    for k, r in merged:
        shared.append(k)
        records.append(r)
    n, most = len(records), N - K
    out = {"row": [], "start": [], "end": []}
    if n:
        shared = np.array(shared)
        size = np.array([len(r[0]) for r in records])
        left = np.array([len(r[1]) for r in records])
        doc, row, place = (np.array([r[k] for r in records], np.int64) for k in (2, 3, 4))
        before = np.frombuffer(b"".join(r[1].rjust(most, b"\0") for r in records), np.uint8).reshape(n, most)
        order = np.empty(n, np.int64)
        order[np.lexsort((place, row, doc))] = np.arange(n)
        hit = np.zeros((n, most + 2), bool)
        #: equal for records with equal bytes before the anchor, as far as they were read
        h = np.zeros(n, np.int64)
        for x in range(most + 1):
            if x:
                h = np.unique(h << 8 | before[:, most - x], return_inverse=True)[1]
            (live,) = np.nonzero((size >= N - x) & (left >= x))
            interval = np.cumsum(shared < N - x)[live]
            by = np.lexsort((order[live], h[live], interval))
            same = (interval[by[1:]] == interval[by[:-1]]) & (h[live][by[1:]] == h[live][by[:-1]])
            hit[live[by[1:][same]], x + 1] = True
        edge = np.diff(hit.astype(np.int8), axis=1, append=0)
        (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        # offsets a..b-1 from the anchor are hit
        out = {"row": row[i], "start": place[i] - (b - 1), "end": place[i] - a + N}
    return pd.DataFrame(out).astype({"row": "int64", "start": "int64", "end": "int64"})


def find(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) and spans, for every row of docs.

    carry: further columns of docs to hand on, in a struct named rest; kept is text then, without characters cut into,
    and null for a null text. The text needs no carrying.
    """
    spark = docs.sparkSession
    rest = F.struct(*carry) if carry else F.lit(None).cast("int")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"), F.monotonically_increasing_id().alias("row"))
    folder = file(spark, "spans", lambda: _spans(source.select("doc_id", "text", "row")), "row", "start")

    kind = source.schema["rest"].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    as_text = carry is not None

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Filed(folder, _Spans)
        for pid, batch in by_partition(batches, 500):
            doc_ids, found = batch.column("doc_id").to_pylist(), spans.of(pid).of(batch.column("row").to_numpy())
            texts = batch.column("text").to_pylist()
            for at, enc in chunks(texts):
                rows = []
                for i, raw in enumerate(enc):
                    merged = _merged(found[at + i])
                    cuts = [0, *(x for m in merged for x in m), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                    rows.append((doc_ids[at + i], len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"start": x, "end": y} for x, y in merged]))
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                if as_text:
                    made[5] = pa.array([None if texts[at + i] is None else r[5].decode("utf-8", "ignore") for i, r in enumerate(rows)], pa.string())
                yield pa.RecordBatch.from_arrays([*made, batch.column("rest").slice(at, len(enc))], [*names, "rest"])

    kept = "string" if as_text else "binary"
    return source.mapInArrow(remove, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {kept}, spans array<struct<start:long,end:long>>, rest {kind}")


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _spans(source: DataFrame) -> DataFrame:
    """Spans (pid, row, start, end) of windows that start earlier too."""
    table = settled(source.sparkSession, "contexts", lambda: _contexts(source))
    covered = table.filter("text is null").select("row", F.col("lo").alias("start"), F.col("place").alias("end"))
    return _merge_spans(table.filter("text is not null")).unionByName(covered).select(numbered(), "row", "start", "end")


def _contexts(source: DataFrame) -> DataFrame:
    """First occurrences of contexts whose anchor has others too; without text: lo..place is covered by other occurrences."""
    spark = source.sparkSession
    twice = repeated(source.select("row", "text"), _anchor_hashes, "anchors")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, size = Filed(twice, Tokens), [], 0

        def run() -> pa.RecordBatch:
            found = _firsts(np.concatenate(held))
            part = (found["x"] >> np.uint64(64 - PART_BITS)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            found, part = found[order], part[order]
            ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            return _batch(part=part[[0, *ends[:-1]]], packed=pa.array([_pack_found(found[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()))

        for pid, batch in by_partition(batches):
            ids, rows = _doc_ids(batch), batch.column("row").to_numpy()
            for at, enc in chunks(batch.column("text").to_pylist()):
                a = Anchors(enc)
                (k,) = np.nonzero(anchors.of(pid).has(a.hash))
                found = np.empty(len(k), _OCCURRENCE)
                found["x"], found["y"] = np.frombuffer(b"".join(a.digests(k)), "<u8").reshape(-1, 2).T
                found["doc_id"], found["row"], found["lo"], found["anchor"] = ids[at + a.text[k]], rows[at + a.text[k]], a.lo[k], a.hash[k]
                held.append(found)
                size += len(k)
                if size >= RUN_FOUND:
                    yield run()
                    held, size = [], 0
        if size:
            yield run()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same in ranges(batches):
            found = _firsts(np.concatenate([_unpack_found(r["packed"]) for r in same]))
            yield _batch(row=found["row"].copy(), lo=found["lo"].copy(), anchor=_signed(found["anchor"].copy()))

    def firsts() -> DataFrame:
        found = source.mapInArrow(places, "part int, packed binary").repartition("part").sortWithinPartitions("part")
        return found.mapInArrow(first, "row long, lo long, anchor long").select(numbered(), "*")

    stay = file(spark, "firsts", firsts, "row", "lo")
    anchors = spark.read.schema("row long, lo long, anchor long, pid long").parquet(stay).select("row", "anchor")
    varied = repeated(anchors, lambda batch: iter([batch.column("anchor").to_numpy().view(np.uint64)]), "varied")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, staying, several = Filed(twice, Tokens), Filed(stay, _Places), Filed(varied, Tokens)
        for pid, batch in by_partition(batches):
            ids, rows = _doc_ids(batch), batch.column("row").to_numpy()
            for at, enc in chunks(batch.column("text").to_pylist()):
                a = Anchors(enc)
                (k,) = np.nonzero(anchors.of(pid).has(a.hash))
                stays = staying.of(pid).has(rows[at + a.text[k]], a.lo[k])
                gone, k = k[~stays], k[stays]
                # contexts in order: those that meet or overlap are covered as one
                text, lo, end = a.text[gone], a.lo[gone], a.hi[gone] + N
                new = np.ones(len(gone), bool)
                new[1:] = (text[1:] != text[:-1]) | (lo[1:] > end[:-1])
                last = np.append(new[1:], True) if len(gone) else new
                k = k[several.of(pid).has(a.hash[k])]
                own, of = np.concatenate((text[new], a.text[k])) + at, [None] * int(new.sum()) + [a.bytes_of(i) for i in k]
                yield _batch(doc_id=ids[own], row=rows[own], lo=np.concatenate((lo[new], a.lo[k])), place=np.concatenate((end[last], a.place[k])), text=pa.array(of, pa.binary()))

    return source.mapInArrow(contexts, "doc_id long, row long, lo long, place long, text binary")


def _merge_spans(table: DataFrame) -> DataFrame:
    """Spans (row, start, end) of windows that start earlier too, by the distributed merge sort of the contexts' suffixes."""
    spark = table.sparkSession

    def windows(text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and where each context's begin."""
        lens = np.array([len(t) for t in text], np.int64)
        at = np.concatenate(([0], np.cumsum(lens - N + 1)))
        got, held, size = [np.zeros(0, np.uint64)], [], 0
        for k in range(len(text) + 1):
            if held and (k == len(text) or size + len(text[k]) > CHUNK):
                own = lens[k - len(held) : k]
                inside = np.ones(size, bool)
                for back in range(1, N):
                    inside[np.cumsum(own) - back] = False
                got.append(rolling(np.frombuffer(b"".join(held), np.uint8), N)[inside[: size - N + 1]])
                held, size = [], 0
            if k < len(text):
                held.append(text[k])
                size += len(text[k])
        return np.concatenate(got), at

    def cut(batches: Iterator[pa.RecordBatch], twice: str) -> Iterator[pa.RecordBatch]:
        several = Filed(twice, Tokens)
        for pid, batch in by_partition(batches):
            text = batch.column("text").to_pylist()
            h, at = windows(text)
            ok = several.of(pid).has(h)
            edge = np.zeros(len(h) + 1, bool)
            edge[at] = True
            start = np.flatnonzero(ok & (edge[:-1] | ~np.concatenate(([False], ok[:-1]))))
            stop = np.flatnonzero(ok & (edge[1:] | ~np.concatenate((ok[1:], [False])))) + 1
            of = np.searchsorted(at, start, side="right") - 1
            ids, rows, lo, place = (batch.column(c).to_numpy() for c in ("doc_id", "row", "lo", "place"))
            left, suffix = [], []
            for i, a, b, x in zip(of.tolist(), (start - at[of]).tolist(), (stop - at[of]).tolist(), (place - lo)[of].tolist(), strict=True):
                left.append(text[i][a:x])
                suffix.append(text[i][x : b - 1 + N])
            mark = [hashlib.blake2b(x + y, digest_size=16, salt=len(x).to_bytes(8, "little")).digest() for x, y in zip(left, suffix, strict=True)]
            yield _batch(mark=pa.array(mark, pa.binary()), doc_id=ids[of], row=rows[of], place=place[of], left=pa.array(left, pa.binary()), suffix=pa.array(suffix, pa.binary()))

    def all_cuts() -> DataFrame:
        twice = repeated(table.select("row", "text"), lambda batch: iter([windows(batch.column("text").to_pylist())[0]]), "windows")
        return table.mapInArrow(partial(cut, twice=twice), "mark binary, doc_id long, row long, place long, left binary, suffix binary")

    cuts = settled(spark, "cuts", all_cuts)
    # of equal cuts the first stays, the others are covered throughout
    records = cuts.groupBy("mark").agg(F.min(F.struct("doc_id", "row", "place", "left", "suffix")).alias("r"))
    records = materialise(records.select("mark", "r.*"), "records")
    stays = records.select("mark", F.col("row").alias("first_row"), F.col("place").alias("first_place"))
    covered = cuts.select("mark", "row", (F.col("place") - F.octet_length("left")).alias("start"), (F.col("place") + F.octet_length("suffix")).alias("end"), "place").join(stays, "mark")
    covered = covered.filter("row <> first_row or place <> first_place").select("row", "start", "end")
    n = records.count()
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE)
    # a few K-grams for each range, by hash
    sample = records.select("suffix").filter(F.pmod(F.xxhash64("mark"), F.lit(max(1, n // (32 * n_parts)))) == 0).select(F.substring("suffix", 1, K).alias("head")).distinct()
    heads = sorted(bytes(r.head) for r in sample.collect())
    bounds = sorted({heads[len(heads) * k // n_parts] for k in range(1, n_parts)}) if heads else []

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def run() -> pa.RecordBatch:
            held.sort()
            part = np.array([bisect.bisect_right(bounds, r[0][:K]) for r in held], np.int32)
            ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(held)]
            return _batch(part=part[ends[:-1]], run=pa.array([_front_code(held[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))

        for batch in parts(batches):
            held += zip(*(batch.column(c).to_pylist() for c in ("suffix", "left", "doc_id", "row", "place")), strict=True)
            if len(held) >= RUN:
                yield run()
                held = []
        if held:
            yield run()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _resolve(iter(LoserTree([_decode(r) for r in pdf["run"]])))

    merged = records.drop("mark").mapInArrow(sort_runs, "part int, run binary").groupBy("part").applyInPandas(merge, "row long, start long, end long")
    return merged.unionByName(covered)


def texts(docs: DataFrame) -> DataFrame:
    """The rows of docs, in its columns, with the text that find() leaves; characters cut into go too. Null stays null.

    An n_chars column is counted anew.
    """
    out = find(docs, [c for c in docs.columns if c != "text"])
    put = {"text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*((put[c] if c in put else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
