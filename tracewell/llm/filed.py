"""Tables filed by partition of the corpus, and tokens that occur more than once, told to each partition in such a table.

A job that scans the corpus several times numbers its rows by `monotonically_increasing_id`, whose upper bits name the
partition. What a later scan has to know of its rows lies in a folder for each partition; the task that scans it reads
that folder, through pyarrow's file systems, so any store with a URI serves. Neither texts nor a table of the whole corpus
have to move: what a task reads and holds depends on its own rows, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, scratch
from .wordbytes import mix, parts

#: a row's number has its partition above this bit
PARTITION = 33
#: tokens count by the upper 49 bits of their `mix`, as those of one kind may all be small: a range (of 1,024) and 39 bits
#: within it; two tokens that agree in these cost work, never a result
_LOW, _DROP = 39, 15
#: tokens are packed in runs of about so many
RUN_TOKENS = 1 << 18


def by_partition(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches, each with the partition that its rows are numbered in."""
    for batch in parts(batches, rows):
        pid = batch.column("row").to_numpy() >> PARTITION
        cuts = [0, *(np.flatnonzero(np.diff(pid)) + 1).tolist(), len(pid)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(pid[a]), batch.slice(a, b - a)


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each `part`, of batches in its order."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["part"] != r["part"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def file(spark: SparkSession, name: str, make: Callable[[], DataFrame], *order: str) -> str:
    """The rows that make() gives, in a folder for each of their `pid`; what was written on the way is deleted."""
    path = new_path(spark, name)
    with scratch(spark):
        make().repartition("pid").sortWithinPartitions("pid", *order).write.partitionBy("pid").parquet(path)
    return path


class Filed:
    """make(tables) of a partition's files, for the task that asks; the last answer stays."""

    def __init__(self, folder: str, make: Callable[[list[pa.Table]], Any]) -> None:
        self.folder, self.make, self.pid, self.held = folder, make, None, None

    def of(self, pid: int) -> Any:
        if pid != self.pid:
            fs, path = pa.fs.FileSystem.from_uri(f"{self.folder}/pid={pid}")
            files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
            self.held = self.make([pa.parquet.ParquetFile(fs.open_input_file(f)).read() for f in sorted(files)])
            self.pid = pid
        return self.held


def column(tables: list[pa.Table], name: str, kind: str = "i8") -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(t.column(name).to_numpy() for t in tables)]).astype(kind, copy=False)


class Tokens:
    """Sorted tokens, behind a map of their upper bits."""

    def __init__(self, tables: list[pa.Table]) -> None:
        got = [np.zeros(0, np.uint64)]
        for t in tables:
            for part, raw in zip(t.column("part").to_pylist(), t.column("packed").to_pylist(), strict=True):
                got.append(np.uint64(part << _LOW) | _unpacked(raw) >> np.uint64(1))
        self.keys = np.unique(np.concatenate(got))
        bits = min(24, max(10, int(4 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - _DROP - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[(self.keys >> self.shift).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        key = mix(h) >> np.uint64(_DROP)
        out = self.map[(key >> self.shift).astype(np.int64)]
        (i,) = np.nonzero(out)
        if len(i):
            out[i] = self.keys[np.minimum(np.searchsorted(self.keys, key[i]), len(self.keys) - 1)] == key[i]
        return out


def _packed(v: np.ndarray) -> bytes:
    """Numbers below 2**40, five bytes each."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _run(pid: int, held: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct tokens of a run, packed by range; the lowest bit says that the run has a token twice."""
    key, n = np.unique(mix(np.concatenate(held)) >> np.uint64(_DROP), return_counts=True)
    part = (key >> np.uint64(_LOW)).astype(np.int32)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    raw = _packed((key & np.uint64((1 << _LOW) - 1)) << np.uint64(1) | (n > 1))
    packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((5 * cuts).astype(np.int32)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, pid)), packed], ["part", "pid", "packed"])


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each packed run of a range, the tokens that it has twice or another run has too."""
    for held in ranges(batches):
        size = np.array([len(r["packed"]) // 5 for r in held])
        v = _unpacked(b"".join(r["packed"] for r in held))
        _, of, n = np.unique(v >> np.uint64(1), return_inverse=True, return_counts=True)
        hit = (n > 1)[of] | (v & np.uint64(1)).astype(bool)
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(held)), size)[hit], minlength=len(held))).tolist()
        raw = _packed(v[hit])
        rows = [(r["pid"], r["part"], raw[5 * a : 5 * b]) for r, a, b in zip(held, [0, *ends], ends, strict=False) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["pid", "part", "packed"])


def repeated(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], name: str) -> str:
    """A folder of `Tokens`: for each partition, those of its tokens that occur more than once in all rows.

    rows: numbered in `row`. hashes: the tokens of a batch of rows, in arrays.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for pid, batch in by_partition(batches):
            for h in hashes(batch):
                if size and (pid != at or size >= RUN_TOKENS):
                    yield _run(at, held)
                    held, size = [], 0
                held.append(h)
                size += len(h)
                at = pid
        if size:
            yield _run(at, held)

    def told() -> DataFrame:
        runs = rows.mapInArrow(pack, "part int, pid long, packed binary").repartition("part").sortWithinPartitions("part")
        return runs.mapInArrow(_several, "pid long, part int, packed binary")

    return file(rows.sparkSession, name, told, "part")


def numbered() -> Column:
    """The partition of a row's number."""
    return F.shiftright(F.col("row"), PARTITION).alias("pid")
