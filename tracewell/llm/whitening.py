"""Whitening of embeddings by principal components, with eigenvectors refined in mixed precision.

Entries become whole numbers, so the sums of a covariance are exact however the rows are dealt: every task sums its rows'
products about a whole-number centre (the rounded mean), in integers or in doubles that hold them exactly; Spark adds the
tasks' sums up, and the small remainder of the mean is taken off exactly. The driver holds one dims x dims matrix.
Its eigenvectors are found in single precision and then corrected by Ogita-Aishima iterations, matrix products in extended
precision that converge quadratically: R = I - X'X and S = X'VX give each pair's correction. Pairs whose eigenvalues lie
too close for that are clusters; each is solved by itself, shifted by its mean eigenvalue so that its own differences decide.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are those of another
length than the most frequent one (of equals the longer). Entries are held within 2^45 after scaling. Components without
variance (an eigenvalue of at most dims * 2^-52 of the largest) are left out: none remain where all rows are equal, and
then, as for an empty table, there are no rows. A deviation beyond a long is null. Repeated rows and null ids count as rows
of their own. Other columns than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import parts

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
HELD = 1 << 45
ROUNDS = 30
#: corrections below double precision, and those that may be as small as they get
STILL, SETTLED = 2.0**-60, 1e-6
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_SUMS = "i int, j int, low long, mid long, high long"
_LIMB = 31


@dataclass
class Model:
    """n vectors; x's mean is (n * centre + rest) / n; axes (dims x components), eigenvalues falling, their shares of the trace."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


# the eigenvectors


def _products(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """R = I - X'X, S = X'VX, the eigenvalues, and the distance below which two of them can't be told apart yet."""
    r = np.eye(len(v), dtype=v.dtype) - x.T @ x
    s = x.T @ (v @ x)
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: np.sqrt((m * m).sum())
    return r, s, values, 2 * (norm(s - np.diag(values)) + norm(v) * norm(r))


def _correct(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One Ogita-Aishima iteration; how far it moved."""
    r, s, values, near = _products(v, x)
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, float(np.abs(e).max())


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two or more eigenvalues whose neighbours lie within `near`."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > near) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def _solve(v: np.ndarray, x: np.ndarray, run: np.ndarray, values: np.ndarray) -> np.ndarray:
    """x with the columns of one cluster turned to its own eigenvectors."""
    own = x[:, run]
    shifted = v @ own - own * values[run].mean()
    t = own.T @ shifted
    t = (t + t.T) / 2
    size = np.abs(t).max()
    if size > 0:
        x = x.copy()
        x[:, run] = own @ np.linalg.eigh((t / size).astype(np.float64))[1].astype(v.dtype)
    return x


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix in extended precision."""
    v = np.asarray(v, np.longdouble)
    size = np.abs(v).max() if v.size else 0
    if not size > 0:
        return np.zeros(len(v)), np.eye(len(v))
    v = v / size
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(np.longdouble)
    last = float("inf")
    for _ in range(ROUNDS):
        x, moved = _correct(v, x)
        if moved < STILL or last <= moved < SETTLED:  # eigenvalues too close for this precision keep it from getting smaller
            break
        last = moved
        _, _, values, near = _products(v, x)
        for run in _clusters(values, near):
            x = _solve(v, x, run, values)
    for _ in range(2):  # what the correction of close pairs leaves of lengths and angles
        x = x + x @ (np.eye(len(v), dtype=v.dtype) - x.T @ x) / 2
    _, _, values, _ = _products(v, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    lead = x[np.abs(x).argmax(0), np.arange(len(v))]
    return (values[order] * size).astype(np.float64), (x * np.where(lead < 0, -1, 1)).astype(np.float64)


# the sums


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of vectors without null or non-finite entries."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).filter(F.coalesce(sound, F.lit(False)) & (F.size("embedding") > 0))


def _whole(batch: pa.RecordBatch, dims: int, centre: np.ndarray) -> np.ndarray:
    """x - centre of a batch's vectors."""
    c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(c * SCALE), -HELD, HELD).astype(np.int64) + OFFSET - centre


def _gram(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: in doubles while they hold every sum exactly, in two limbs beyond."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    high, low = y >> 23, y & ((1 << 23) - 1)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), 64):
        h, b = high[k : k + 64].astype(np.float64), low[k : k + 64].astype(np.float64)
        hh, hb, bb = ((p.T @ q).astype(np.int64).astype(object) for p, q in ((h, h), (h, b), (b, b)))
        out = out + (hh << 46) + ((hb + hb.T) << 23) + bb
    return out


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as three longs each, of which many can be added without overflow."""
    mask = (1 << _LIMB) - 1
    return [(values & mask).astype(np.int64), ((values >> _LIMB) & mask).astype(np.int64), (values >> 2 * _LIMB).astype(np.int64)]


def _totals(rows: DataFrame, dims: int, centre: np.ndarray, squares: bool) -> dict[tuple[int, int], int]:
    """Sums of x - centre under (i, -1) and, if asked for, of its products under (i, j), i <= j; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, seen = np.zeros(dims, object), np.zeros((dims, dims), object), False
        for batch in parts(batches, 4096):
            y = _whole(batch, dims, centre)
            seen = seen or len(y) > 0
            once = once + y.astype(object).sum(0) if np.abs(y).max(initial=0) > 1 << 50 else once + y.sum(0).astype(object)
            if squares:
                twice = twice + _gram(y).astype(object)
        if seen:
            i, j = np.triu_indices(dims) if squares else (np.zeros(0, np.int64),) * 2
            values = np.concatenate([once, twice[i, j]])
            keys = [np.concatenate([np.arange(dims), i]), np.concatenate([np.full(dims, -1), j])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in keys), *map(pa.array, _limbs(values))], ["i", "j", "low", "mid", "high"])

    sums = rows.select("embedding").mapInArrow(run, _SUMS).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("low", "mid", "high")))
    return {(r.i, r.j): r.low + (r.mid << _LIMB) + (r.high << 2 * _LIMB) for r in sums.collect()}  # dims x dims, however many rows


def _extended(num: int, den: int) -> np.longdouble:
    q = Fraction(num, den)
    near = float(q)
    return np.longdouble(near) + np.longdouble(float(q - Fraction(near)))


def _shape(rows: DataFrame) -> tuple[int, int]:
    """(length, rows) of the most frequent length."""
    found = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return (found[0].dims, found[0].n) if found else (0, 0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The components of all usable vectors' covariance; None without variance."""
    rows = _usable(vectors)
    dims, n = _shape(rows)
    if not n:
        return None
    rows = rows.filter(F.size("embedding") == dims)
    zero = np.full(dims, OFFSET, np.int64)
    sums = [s + n * OFFSET for (_, s) in sorted(_totals(rows, dims, zero, squares=False).items())]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    t = _totals(rows, dims, centre, squares=True)
    rest = [t[i, -1] for i in range(dims)]
    v = np.zeros((dims, dims), np.longdouble)
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = _extended(n * t[i, j] - rest[i] * rest[j], n * n)
    values, axes = eigenvectors(v)
    kept = int((values > max(values[0], 0) * dims * 2.0**-52).sum())
    k = min(components, kept)
    if not k:
        return None
    return Model(n, centre, np.array(rest, object), axes[:, :k], values[:k], values[:k] / float(np.trace(v)))


def _centred(y: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S) / n, and the sum of the squares of n * x - S for each row (None where a long can't hold it)."""
    bound = model.n * (int(np.abs(y).max(initial=0)) + 1)
    if bound * bound * y.shape[1] < 1 << 62:
        d = model.n * y - model.rest.astype(np.int64)
        return d / model.n, (d * d).sum(1)
    d = model.n * y.astype(object) - model.rest
    squares = (d * d).sum(1)
    return (d / model.n).astype(np.float64), np.array([s if s < 1 << 63 else None for s in squares], object)


def _identity_error(rows: DataFrame, model: Model) -> float:
    """The largest entry of the covariance of what `transform` gives, less the identity."""
    dims, k = model.axes.shape
    scaled = model.axes / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, seen = np.zeros(k), np.zeros((k, k)), False
        for batch in parts(batches, 4096):
            w = _centred(_whole(batch, dims, model.centre), model)[0] @ scaled
            once, twice, seen = once + w.sum(0), twice + w.T @ w, seen or len(w) > 0
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(k), i]).astype(np.int32)), pa.array(np.concatenate([np.full(k, -1), j]).astype(np.int32)), pa.array(np.concatenate([once, twice[i, j]]))], ["i", "j", "v"])

    sums = {(r.i, r.j): r.v / model.n for r in rows.select("embedding").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    # the vectors are centred already; what rounding leaves of their mean is taken off
    return max(abs(s - sums[i, -1] * sums[j, -1] - (i == j)) for (i, j), s in sums.items() if j >= 0)


def transform(vectors: DataFrame, model: Model) -> DataFrame:
    """One row for each usable vector of the model's length and each component."""
    dims, k = model.axes.shape
    rows = _usable(vectors).filter(F.size("embedding") == dims)
    error = _identity_error(rows, model)
    scaled = model.axes / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2048):
            z, deviation = _centred(_whole(batch, dims, model.centre), model)
            m = len(z)
            cols = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(np.repeat(deviation, k), pa.int64()), pa.array((z @ scaled).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: fitted on all vectors, applied to all."""
    model = fit(vectors, components)
    return transform(vectors, model) if model else vectors.sparkSession.createDataFrame([], OUT)
