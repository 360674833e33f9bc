"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length one whose cosine is at least t lie within eps = sqrt(2 - 2 t) of each other. They are sorted by the
cells of an eps grid on their leading principal dimensions; runs of that sequence are tiles. A tree of sequence
intervals over the tiles is joined with itself level by level: an interval pair whose boxes lie further apart than eps
is skipped with all below it. Each surviving tile pair goes to one task, which recurses into halves of both sequences
the same way and compares what remains in double precision.

Vectors equal but for a power of two are collapsed first and counted by their number, so that copies are never paired. The principal axes are
fitted on at most `FIT` vectors (smallest hash); they steer pruning only, never the result.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length never link; repeated rows count as vectors of their own; a null vec_id links as any, but its
component is that of the smallest non-null id, or null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .store import materialise

THRESHOLD = 0.9
AXES = 16
GRID = 6
FIT = 4096
TILE = 2048
LEAF = 256
FAN = 8
OUT = "vec_id long, n_links long, component_id long, kept boolean"


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, key (digest of the vector; null if it can't link), x (its bytes as doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, xs = [], [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                if len(x) and np.isfinite(x).all() and (most := np.abs(x).max()) > 0:
                    # by a power of two, which changes no cosine and keeps squares within range
                    raw = (np.ldexp(x, -np.frexp(most)[1]) + 0.0).tobytes()
                    dims.append(len(x))
                    keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                    xs.append(raw)
                else:
                    dims.append(None)
                    keys.append(None)
                    xs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(xs, pa.binary())], ["vec_id", "dim", "key", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, key binary, x binary")


def _axes(distinct: DataFrame, fit: int) -> dict[int, np.ndarray]:
    """For each vector length, the leading principal axes of a bounded sample."""
    rows = distinct.select("dim", "x").orderBy(F.xxhash64("key"), "key").limit(fit).collect()
    out = {}
    for d in {r.dim for r in rows}:
        x = np.stack([np.frombuffer(r.x) for r in rows if r.dim == d])
        x = x / np.sqrt((x * x).sum(1))[:, None]
        x = x - x.mean(0)
        _, axes = np.linalg.eigh(x.T @ x)
        out[d] = axes[:, ::-1][:, :AXES]
    return out


def _project(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Coordinates of unit vectors on the principal axes, filled up with zeros."""
    out = np.zeros((len(x), AXES))
    if axes is not None:
        p = x @ axes
        out[:, : p.shape[1]] = p
    else:
        out[:, : min(AXES, x.shape[1])] = x[:, :AXES]
    return out


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r) for r in rows])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _tiles(distinct: DataFrame, axes, eps: float) -> DataFrame:
    """The grid-ordered sequence in tiles: part, idx, dim, lo, hi, ids, counts, x."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, xs = batch.column("dim").to_pylist(), batch.column("x").to_pylist()
            out = []
            for d, raw in zip(dims, xs, strict=True):
                c = np.floor(_project(_unit([raw]), axes.value.get(d))[0, :GRID] / eps).astype(int)
                out.append([d, *c.tolist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "dim", "x")), pa.array(out, pa.list_(pa.int32()))], ["rep", "n", "dim", "x", "cell"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, idx, held = TaskContext.get().partitionId(), 0, []

        def tile() -> pa.RecordBatch:
            p = _project(_unit([r["x"] for r in held]), axes.value.get(held[0]["dim"]))
            cols = [[part], [idx], [held[0]["dim"]], [p.min(0).tolist()], [p.max(0).tolist()], [[r["rep"] for r in held]], [[r["n"] for r in held]], [b"".join(r["x"] for r in held)]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.list_(pa.int64())] * 2, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "idx", "dim", "lo", "hi", "ids", "counts", "x"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == TILE or held[0]["dim"] != r["dim"]):
                    yield tile()
                    idx, held = idx + 1, []
                held.append(r)
        if held:
            yield tile()

    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = distinct.mapInArrow(cells, "rep long, n long, dim int, x binary, cell array<int>")
    placed = placed.repartitionByRange(n, *(F.col("cell")[k] for k in range(GRID + 1))).sortWithinPartitions("cell", "rep")
    return placed.drop("cell").select("rep", "n", "dim", "x").mapInArrow(cut, "part long, idx long, dim int, lo array<double>, hi array<double>, ids array<long>, counts array<long>, x binary")


def _near(a: str, b: str, eps: float):
    """Whether the boxes of two intervals lie within eps."""
    gap = F.transform(F.arrays_zip(F.col(f"{a}.lo").alias("al"), F.col(f"{a}.hi").alias("ah"), F.col(f"{b}.lo").alias("bl"), F.col(f"{b}.hi").alias("bh")), lambda z: F.greatest(F.lit(0.0), z["al"] - z["bh"], z["bl"] - z["ah"]))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps


def _tile_pairs(boxes: DataFrame, n_tiles: int, eps: float) -> DataFrame:
    """Pairs (a <= b) of tile numbers whose boxes are near, by a join of the interval tree with itself, level by level."""
    levels, width = [boxes.select(F.col("tile").alias("node"), "lo", "hi")], n_tiles
    fold = lambda c, f: F.expr(f"transform(sequence(0, {AXES - 1}), k -> {f}(transform({c}, v -> v[k])))").alias(c)
    while width > 1:
        below = levels[-1].withColumn("up", F.floor(F.col("node") / FAN))
        levels.append(materialise(below.groupBy(F.col("up").alias("node")).agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")).select("node", fold("lo", "array_min"), fold("hi", "array_max")), "interval"))
        width = -(-width // FAN)
    top = levels.pop()
    pairs = top.select(F.col("node").alias("a"), F.col("node").alias("b"))
    while levels:
        below = levels.pop().withColumn("up", F.floor(F.col("node") / FAN))
        left = below.select(F.col("up").alias("a"), F.struct(F.col("node").alias("id"), "lo", "hi").alias("x"))
        right = below.select(F.col("up").alias("b"), F.struct(F.col("node").alias("id"), "lo", "hi").alias("y"))
        pairs = pairs.join(left, "a").join(right, "b").filter(F.col("x.id") <= F.col("y.id")).filter(_near("x", "y", eps)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        pairs = materialise(pairs, "pairs")
    return pairs


class _PairJoin:
    """Recursive join of two sequences, halving the longer, in one task."""

    def __init__(self, axes, t: float, eps: float) -> None:
        self.axes, self.t, self.eps = axes, t, eps

    def __call__(self, a: dict, b: dict, same: bool) -> tuple[dict[int, int], list[tuple[int, int]]]:
        self.same = same
        sides = []
        for s in (a, b):
            x = np.frombuffer(s["x"]).reshape(len(s["ids"]), s["dim"])
            norm = np.sqrt((x * x).sum(1))[:, None]
            sides.append((x / norm, _project(x / norm, self.axes.get(s["dim"])), np.array(s["counts"], np.int64)))
        (self.xa, self.pa, self.ca), (self.xb, self.pb, self.cb) = sides
        self.na, self.nb = np.zeros(len(self.ca), np.int64), np.zeros(len(self.cb), np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_links = 0
        self.join(0, len(self.ca), 0, len(self.cb))
        ids = np.array([*a["ids"], *b["ids"]])
        self.shrink(len(ids))
        counts: dict[int, int] = {}
        for own, n in ((a["ids"], self.na), (b["ids"], self.nb)):
            for k in np.flatnonzero(n):
                counts[own[k]] = counts.get(own[k], 0) + int(n[k])
        i, j = self.links[0] if self.links else (np.zeros(0, int), np.zeros(0, int))
        return counts, list(zip(ids[i].tolist(), ids[j].tolist(), strict=True))

    def shrink(self, n: int) -> None:
        """Keep of the links a star for each component."""
        if self.links:
            i, j = (np.concatenate(x) for x in zip(*self.links, strict=True))
            label = roots(n, i, j)
            (own,) = np.nonzero(label != np.arange(n))
            self.links, self.n_links = [(own, label[own])], len(own)

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:
            return
        pa_, pb = self.pa[a0:a1], self.pb[b0:b1]
        gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0)))
        if (gap * gap).sum() > self.eps**2:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(self.xa[a0:a1] @ self.xb[b0:b1].T >= self.t)
            i, j = i + a0, j + b0
            if self.same:
                i, j = i[i < j], j[i < j]
            if len(i):
                self.na += np.bincount(i, self.cb[j], len(self.ca)).astype(np.int64)
                self.nb += np.bincount(j, self.ca[i], len(self.cb)).astype(np.int64)
                self.links.append((i, j if self.same else j + len(self.ca)))
                self.n_links += len(i)
                if self.n_links > 1 << 20:
                    self.shrink(len(self.ca) + len(self.cb))
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            self.join(a0, m, b0, b1)
            self.join(m, a1, b0, b1)
        else:
            m = (b0 + b1) // 2
            self.join(a0, a1, b0, m)
            self.join(a0, a1, m, b1)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, fit: int = FIT) -> DataFrame:
    """vec_id, n_links, component_id and kept, for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    keyed = materialise(_keyed(vectors), "vectors")
    valid = keyed.filter("key is not null")
    # a representative's number: of its smallest vec_id, or of its digest where that is null
    distinct = materialise(valid.groupBy("key", "dim", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rep", F.xxhash64("key")), "distinct")
    axes = spark.sparkContext.broadcast(_axes(distinct, fit))
    tiles = materialise(_tiles(distinct, axes, eps), "tiles")
    parts = sorted((r.part, r.n) for r in tiles.groupBy("part").agg(F.count("*").alias("n")).collect())
    first = dict(zip([p for p, _ in parts], np.concatenate(([0], np.cumsum([n for _, n in parts]))).tolist(), strict=False))
    total = sum(n for _, n in parts)
    if not total:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    offset = F.create_map(*(F.lit(int(x)) for kv in first.items() for x in kv))[F.col("part")]
    tiles = tiles.withColumn("tile", offset + F.col("idx"))
    pairs = _tile_pairs(tiles.select("tile", "lo", "hi"), total, eps)
    side = F.struct("ids", "counts", "x", "dim")
    work = pairs.join(tiles.select(F.col("tile").alias("a"), side.alias("left")), "a").join(tiles.select(F.col("tile").alias("b"), side.alias("right")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = _PairJoin(axes.value, threshold, eps)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["left"]["dim"] != r["right"]["dim"]:
                    continue
                counts, links = join(r["left"], r["right"], r["a"] == r["b"])
                n, m = len(counts), len(links)
                cols = [[*counts, *(x for x, _ in links)], [*[None] * n, *(y for _, y in links)], [*counts.values(), *[None] * m]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n"])

    found = materialise(work.mapInArrow(compare, "a long, b long, n long"), "found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    stars = components(found.filter("b is not null")).withColumnRenamed("id", "rep")
    own = distinct.select("key", "rep", "least", F.col("n").alias("copies")).join(counts, "rep", "left").join(stars, "rep", "left")
    own = own.withColumn("component", F.coalesce("component", "rep"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = own.join(least, "component").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "key").join(own, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
