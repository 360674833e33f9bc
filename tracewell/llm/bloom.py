"""Bounded Bloom filters over 64-bit tokens, built by Spark. A false positive costs work, never a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_M = np.uint64(0x9E3779B97F4A7C15)


class Bloom:
    """A bitmap over tokens with two probes. False positives cost work, never results."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.map = np.zeros(1 << bits - 3, np.uint8)

    def _probes(self, t: np.ndarray) -> Iterator[np.ndarray]:
        yield (t >> np.uint64(64 - self.bits)).astype(np.int64)
        yield ((t * _M) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, t: np.ndarray) -> None:
        for p in self._probes(t):
            np.bitwise_or.at(self.map, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, t: np.ndarray) -> np.ndarray:
        out = np.ones(len(t), bool)
        for p in self._probes(t):
            out &= (self.map[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bloom(tokens: DataFrame, most_bits: int = 27) -> Bloom:
    """A Bloom filter of the column `token`; its size is bounded, whatever the number of tokens."""
    bits = min(most_bits, max(16, int(16 * tokens.count() + 1).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bloom(bits)
        for batch in batches:
            b.add(batch.column("token").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([b.map.tobytes()], pa.binary())], ["map"])

    out = Bloom(bits)
    for r in tokens.select("token").coalesce(4).mapInArrow(build, "map binary").toLocalIterator():
        out.map |= np.frombuffer(r["map"], np.uint8)
    return out


