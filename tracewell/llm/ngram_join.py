"""N-gram Jaccard join: groups of documents whose word-shingle sets overlap by `THRESHOLD` or more, found by signature
trees.

Equal sets are one set. First every set's tokens are counted over all sets: of a set that links, four fifths stand in
other sets too, so sets with fewer such tokens are done with. For the count, tasks pack the tokens of a run of documents,
sorted and cut by ranges of their hash, to about four bytes each; a range is counted by one task, which sends back how
many tokens of each set stand nowhere else.

Of the sets that are left, two that link share a token among their leading tokens in any order common to all (a fifth
of each set). The order used puts tokens last that are frequent somewhere; which order it is affects cost only. Sets that
share such a token form blocks, cut by size so that only sets of comparable size meet. First each set is compared with
the smallest set of its best block; blocks that span several components afterwards are joined by signature trees: nodes
hold OR-combined token bitmaps and size ranges, and a dual traversal skips node pairs whose largest possible overlap is
too small, or which lie in one component already. What remains is verified on the whole sets. First the likeliest
candidate of each component in a block is tried, again as long as most of them hold: so a group of copies is tied
together by a number of pairs in proportion to its size. Then all pairs that still lie apart are tried.

Blocks over `BLOCK` members are cut into parts: a component with so many members fills parts of its own, the others
share parts. Each pair of parts is one task's cell, unless both hold the same component.

Words are hashed under a seed drawn for each job. Sets are known by 128-bit digests and compared by all 64 bits of
their shingles' hashes.

Defined results: null texts and texts without words have the empty set, n_shingles 0, and their own component. Repeated
rows and equal sets link. Null doc_ids are members of their group; its id is the smallest non-null one, or null.
Other columns are not read. The table is read twice and must give the same rows in the same order, as files do.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .bloom import Bloom, bloom
from .components import components
from .store import materialise
from .wordbytes import parts

#: a link needs 100 * intersection >= PERCENT * union
PERCENT = 80
BLOCK = 512
FAN = 8
#: tokens are packed in runs of about so many, of at most RUN_SETS sets, and counted in ranges of about RANGE_TOKENS
RUN_TOKENS, RUN_SETS, RANGE_TOKENS = 500_000, 50_000, 1_000_000
#: a token in so many of the sets that are left comes last in the order
HEAVY = 32
#: tables of keys are broadcast up to so many rows, else joined
BROADCAST_ROWS = 500_000


def _pack(low: np.ndarray, at: np.ndarray) -> bytes:
    """Sorted numbers below 2**40, as differences, and the sets they are from, in planes of bytes."""
    step = np.diff(low, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    raw = step.T.tobytes() + at.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(7, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :5] = planes[:5].T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[5:].T).view("<u2").ravel()


_RUN = [("part", pa.int64()), ("run", pa.int64()), ("packed", pa.binary())] + [(k, pa.list_(t)) for k, t in (("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()))]
_RUN_SCHEMA = "part long, run long, packed binary, row array<long>, doc_id array<long>, at array<int>, n array<int>, digest array<binary>"


class _Run:
    """Documents gathered until their distinct sets have enough tokens."""

    def __init__(self) -> None:
        self.row, self.doc_id, self.at, self.tokens, self.digests, self.place, self.size = [], [], [], [], [], {}, 0

    def add(self, row: int, doc_id: int | None, s: np.ndarray) -> None:
        d = shingles.digest(s) if len(s) else None
        if d not in self.place:
            self.place[d] = len(self.tokens)
            self.tokens.append(s)
            self.digests.append(d)
            self.size += len(s)
        self.row.append(row)
        self.doc_id.append(doc_id)
        self.at.append(self.place[d])

    def batch(self, bits: int) -> pa.RecordBatch:
        """One row for each range of tokens, and one (part -1 - row) for the documents themselves."""
        run = self.row[0]
        n = np.array([len(t) for t in self.tokens])
        low = np.concatenate(self.tokens) >> np.uint64(24)
        order = np.argsort(low, kind="stable")
        low, of = low[order], np.repeat(np.arange(len(n)), n)[order]
        part = (low >> np.uint64(40 - bits)).astype(np.int64)
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(low)] if len(low) else []
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        rows = [(int(part[a]), run, _pack(low[a:b], of[a:b]), None, None, None, None, None) for a, b in spans]
        rows.append((-1 - run, run, None, self.row, self.doc_id, self.at, n.tolist(), self.digests))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_RUN)], [c for c, _ in _RUN])


def _alone(part: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Of one range's packed runs: for each run, how many tokens of each of its sets no other set has."""
    got = [_unpack(raw) for _, raw in part]
    low = np.concatenate([x for x, _ in got])
    order = np.argsort(low, kind="stable")
    low = low[order]
    new = np.concatenate(([True], low[1:] != low[:-1], [True]))
    alone = np.empty(len(low), bool)
    alone[order] = new[:-1] & new[1:]
    begin = 0
    for (run, _), (_, at) in zip(part, got, strict=True):
        yield run, zstandard.ZstdCompressor(level=1).compress(np.bincount(at[alone[begin : begin + len(at)]]).astype("<u4").tobytes())
        begin += len(at)


def _own(docs: DataFrame, seed: int) -> DataFrame:
    """row, doc_id, n, digest of every row, and whether its set may link with another one."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(40, max(6, (size // (5 * RANGE_TOKENS)).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run()
        for batch in parts(batches):
            for row, doc_id, s in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), shingles.sets(batch.column("text").to_pylist(), seed), strict=True):
                run.add(row, doc_id, s)
                if run.size >= RUN_TOKENS or len(run.tokens) >= RUN_SETS or len(run.row) >= 4 * RUN_SETS:
                    yield run.batch(bits)
                    run = _Run()
        if run.row:
            yield run.batch(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out() -> pa.RecordBatch:
            rows = [(-1, run, raw, None, None, None, None, None) for run, raw in _alone(held)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_RUN)], [c for c, _ in _RUN])

        for batch in parts(batches, 200):
            if batch.column("part")[0].as_py() < 0:  # the documents' own rows come first
                own = pc.less(batch.column("part"), 0)
                yield batch.filter(own)
                batch = batch.filter(pc.invert(own))
            for p, run, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "packed")), strict=True):
                if p != part and held:
                    yield out()
                    held = []
                part = p
                held.append((run, raw))
        if held:
            yield out()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, alone, own = None, np.zeros(0, np.int64), None

        def out() -> pa.RecordBatch:
            at, n = np.array(own["at"]), np.array(own["n"], np.int64)
            rest = n.copy()
            rest[: len(alone)] -= alone
            may = (100 * rest >= PERCENT * n) & (n > 0)
            cols = [own["row"], own["doc_id"], n[at], [own["digest"][k] for k in at.tolist()], may[at]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], ["row", "doc_id", "n", "digest", "may"])

        for batch in parts(batches, 200):
            for r in batch.to_pylist():
                if r["run"] != run:
                    if run is not None:
                        yield out()
                    run, alone, own = r["run"], np.zeros(0, np.int64), None
                if r["packed"] is None:
                    own = r
                else:
                    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["packed"]), "<u4")
                    if len(x) > len(alone):
                        alone = np.concatenate((alone, np.zeros(len(x) - len(alone), np.int64)))
                    alone[: len(x)] += x
        if run is not None:
            yield out()

    runs = docs.mapInArrow(pack, _RUN_SCHEMA).repartition("part").sortWithinPartitions("part").mapInArrow(count, _RUN_SCHEMA)
    counted = materialise(runs, "counted").repartition("run").sortWithinPartitions("run")
    return materialise(counted.mapInArrow(judge, "row long, doc_id long, n long, digest binary, may boolean"), "own")


def leading(tokens: np.ndarray, late: Bloom) -> np.ndarray:
    """So many first tokens, in the common order, that two sets that link share one of them."""
    n = len(tokens)
    p = n - (PERCENT * n + 99) // 100 + 1
    is_late = late.has(tokens)
    first = tokens[~is_late][:p]
    return first if len(first) == p else np.concatenate((first, tokens[is_late][: p - len(first)]))


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _sets(docs: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """key (the row), n, tokens and bitmap of the sets of the given rows of docs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            s = [(len(x), x.tobytes()) for x in shingles.sets(batch.column("text").to_pylist(), seed)]
            cols = [pa.array([n for n, _ in s], pa.int64()), pa.array([t for _, t in s], pa.binary()), pa.array([signature(t) for _, t in s], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], ["key", "n", "tokens", "map"])

    return docs.select("row", "text").join(small(rows), "row").select("row", "text").mapInArrow(emit, "key long, n long, tokens binary, map binary")


def _each(sets: DataFrame, late: Bloom | None) -> DataFrame:
    """token, key, n: each set's leading tokens, or all of them where there is no filter yet."""
    shared = sets.sparkSession.sparkContext.broadcast(late)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            got = [_tokens(t) if shared.value is None else leading(_tokens(t), shared.value) for t in batch.column("tokens").to_pylist()]
            size = [len(x) for x in got]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.repeat(batch.column("key").to_numpy(), size)), pa.array(np.repeat(batch.column("n").to_numpy(), size))], ["token", "key", "n"])

    return sets.mapInArrow(emit, "token long, key long, n long")


def similar(x: bytes, y: bytes, percent: int = PERCENT) -> bool:
    a, b = _tokens(x), _tokens(y)
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def _beside(pairs: DataFrame, reps: DataFrame, what: str) -> DataFrame:
    """Pairs (a, b) of keys with a column of both their sets, x and y."""
    left = reps.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col(what).alias("x")).join(small(pairs), "a")
    right = reps.select(F.col("key").alias("b"), F.col("n").alias("o"), F.col(what).alias("y")).join(small(materialise(pairs.select("b").distinct(), "pivots")), "b")
    return left.join(right, "b")


def _verify(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b) of keys those whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 200):
            ok = [similar(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialise(_beside(pairs, reps, "tokens").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def _bounded(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b) of keys those whose bitmaps leave room for a link: trees of two leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 5000):
            ok = [_room(m, x, o, y) for m, x, o, y in zip(*(batch.column(c).to_pylist() for c in ("m", "x", "o", "y")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialise(_beside(pairs, reps, "map").select("a", "b", "m", "x", "o", "y").mapInArrow(run, "a long, b long"), "bounded")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of one or two numbers a row, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def signature(tokens: bytes) -> bytes:
    """A bitmap of at least four bits for each token; its width is a power of two of at least 64."""
    t = _tokens(tokens)
    width = max(64, 1 << int(4 * len(t) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(t & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class SignatureTree:
    """Sets ordered by size in nodes of FAN children: OR of bitmaps, size range, largest loss, and component if single.

    The loss of a set is by how much its tokens outnumber its bits; |x & y| <= common bits + the smaller loss.
    """

    def __init__(self, n: np.ndarray, comp: np.ndarray, maps: list[bytes]) -> None:
        self.order = np.lexsort((comp, n))
        width = min(len(m) for m in maps)
        bits = np.zeros((len(maps), width // 8), np.uint64)
        for i, k in enumerate(self.order):
            m = np.frombuffer(maps[k], np.uint64)
            bits[i] = np.bitwise_or.reduce(m.reshape(-1, width // 8), axis=0)
        n, comp = n[self.order], comp[self.order]
        loss = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, n, n, loss, comp, np.ones(len(n), bool))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, loss, comp, single = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            one = np.logical_and.reduceat(single, at) & (np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at))
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(loss, at), np.minimum.reduceat(comp, at), one))

    def pairs(self, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, common bits) of sets of different components that may link, by dual traversal from the root."""
        i = j = np.zeros(1, np.int64)
        common = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, low, high, loss, comp, single = self.levels[depth]
            if depth < len(self.levels) - 1:
                a, b = np.repeat(i * FAN, FAN * FAN), np.repeat(j * FAN, FAN * FAN)
                a = a + np.tile(np.repeat(np.arange(FAN), FAN), len(i))
                b = b + np.tile(np.tile(np.arange(FAN), FAN), len(i))
                ok = (a <= b) & (a < len(low)) & (b < len(low))
                i, j = a[ok], b[ok]
            ok = ~(single[i] & single[j] & (comp[i] == comp[j]))
            ok &= (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
            i, j = i[ok], j[ok]
            common = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[i[k : k + 4096]] & bits[j[k : k + 4096]]).sum(1).astype(np.int64) for k in range(0, len(i), 4096))])
            most = np.minimum(common + np.minimum(loss[i], loss[j]), np.minimum(high[i], high[j]))
            ok = (100 + percent) * most >= percent * (low[i] + low[j])
            i, j, common = i[ok], j[ok], common[ok]
        ok = i < j
        return self.order[i[ok]], self.order[j[ok]], common[ok]


def _candidates(spread: DataFrame, reps: DataFrame, every: bool) -> DataFrame:
    """Pairs of keys of different components that may link, from blocks (token, key, n, comp)."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))
    # a block and size band holds the sets of that band and those of the band below, which may link with them
    rows = spread.withColumn("band", F.explode(F.array(band, band + 1)))
    cell = rows.groupBy("token", "band").agg(F.count("*").alias("m"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("other_mark"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    # blocks of the same members, by 190 bits over their keys, are joined once
    cell = cell.filter("m > 1 and c0 <> c1").groupBy("mark", "other_mark", "m").agg(F.min(F.struct("token", "band")).alias("at"))
    rows = rows.join(materialise(cell.select("at.token", "at.band", "m"), "blocks"), ["token", "band"])
    # a component with BLOCK members in a block has parts of its own; the rest shares parts
    own = rows.groupBy("token", "band", "comp").agg(F.count("*").alias("members")).filter(F.col("members") >= BLOCK)
    rows = rows.join(small(materialise(own, "large")), ["token", "band", "comp"], "left")
    slots = F.ceil(F.coalesce("members", "m") / BLOCK)
    rows = rows.withColumn("single", F.when(F.col("members").isNotNull(), F.col("comp"))).withColumn("part", F.pmod(F.xxhash64("key", "token"), slots)).drop("m", "members")
    rows = materialise(rows.select("token", "band", F.xxhash64("single", "part").alias("part"), "single", "key", "n", "comp"), "rows")
    part = materialise(rows.select("token", "band", "part", "single").distinct(), "parts")
    other = part.select("token", "band", F.col("part").alias("with"), F.col("single").alias("alone"))
    met = part.join(other, ["token", "band"]).filter("single is null or alone is null or single <> alone")
    rows = rows.join(met.select("token", "band", "part", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q")), ["token", "band", "part"])
    rows = rows.select("token", "band", "p", "q", "key", "n", "comp")
    rows = materialise(rows, "cells")
    # bitmaps join only what is left
    rows = rows.join(reps.select("key", "map"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, found = None, [], []
        for batch in parts(batches, 5000):
            for at, *row in zip(*([tuple(x) for x in zip(*(batch.column(c).to_pylist() for c in ("token", "band", "p", "q")), strict=True)], *(batch.column(c).to_pylist() for c in ("key", "n", "comp", "map"))), strict=True):
                if at != cell:
                    found += _may_link(held, every)
                    cell, held = at, []
                held.append(row)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found + _may_link(held, every))

    # each cell's rows lie together in one partition; a cell has at most two parts of a block
    rows = rows.repartition("token", "band", "p", "q").sortWithinPartitions("token", "band", "p", "q").select("token", "band", "p", "q", "key", "n", "comp", "map")
    return materialise(rows.mapInArrow(run, "a long, b long").distinct(), "candidates")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])


def _may_link(cell: list[list], every: bool) -> list[tuple[int, int]]:
    """Pairs of keys of a cell's rows (key, n, comp, map) that may link; unless every, the likeliest of each component."""
    if len(cell) < 2:
        return []
    if len(cell) == 2:  # the tree of two leaves, without its arrays
        (a, n, c, x), (b, m, d, y) = cell
        return [(a, b)] if c != d and _room(n, x, m, y) else []
    keys, n, comp = (np.array([r[k] for r in cell], np.int64) for k in range(3))
    i, j, common = SignatureTree(n, comp, [r[3] for r in cell]).pairs()
    if not every:
        best = np.argsort(-common / np.minimum(n[i], n[j]), kind="stable")
        i, j = i[best], j[best]
        first = np.union1d(np.unique(comp[i], return_index=True)[1], np.unique(comp[j], return_index=True)[1])
        i, j = i[first], j[first]
    return list(zip(keys[i].tolist(), keys[j].tolist(), strict=True))


def _room(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sets of n and m tokens with these bitmaps may link."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    x, y = _folded(x, len(y)), _folded(y, len(x))
    most = min(n, m, (x & y).bit_count() + min(n - x.bit_count(), m - y.bit_count()))
    return (100 + PERCENT) * most >= PERCENT * (n + m)


def _folded(bits: bytes, width: int) -> int:
    """A bitmap as a number, its parts OR-combined to the width in bytes of a smaller one."""
    out = 0
    for k in range(0, len(bits), min(width, len(bits))):
        out |= int.from_bytes(bits[k : k + min(width, len(bits))], "little")
    return out


def _with_component(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of tokens that still span components, with their component."""
    stars = components(links)
    rows = members.join(stars.withColumnRenamed("id", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    spans = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("token")
    return materialise(rows.join(spans, "token", "left_semi").select("token", "key", "n", "comp"), "spread")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    seed = secrets.randbits(64)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    own = _own(docs, seed)
    # one row stands for all rows of equal sets
    sets = materialise(own.filter("n > 0").groupBy("digest", "n").agg(F.min("row").alias("key"), F.min("doc_id").alias("least"), F.max("may").alias("may")), "classes")
    reps = materialise(_sets(docs, materialise(sets.filter("may").select(F.col("key").alias("row")), "rows"), seed), "sets")
    late = bloom(materialise(_each(reps, None).groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") >= HEAVY).select("token"), "frequent"))
    lead = materialise(_each(reps, late), "leading")
    tokens = lead.groupBy("token").agg(F.min("key").alias("pivot"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = materialise(lead.join(tokens, "token"), "members")
    tried = members.filter("key <> pivot").groupBy("key", "pivot").agg(F.count("*").alias("common")).groupBy("key").agg(F.max_by("pivot", F.struct("common", "pivot")).alias("b"))
    links = _verify(_bounded(materialise(tried.select(F.col("key").alias("a"), "b"), "tried"), reps), reps)
    every = False
    while True:
        spread = _with_component(members.select("token", "key", "n"), links)
        pairs = _candidates(spread, reps, every)
        found = _verify(pairs, reps)
        links = links.unionByName(found)
        if every:
            break
        # as long as most of the likeliest pairs hold, components grow and fewer pairs are left
        every = 2 * found.count() <= pairs.count()
    stars = components(links).withColumnRenamed("id", "key")
    named = sets.join(stars, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("digest", F.col("n").alias("size"), "component_id")
    out = own.join(named, (own.digest == named.digest) & (own.n == named["size"]), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
