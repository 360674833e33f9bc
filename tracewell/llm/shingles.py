"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .wordbytes import NON_BLANK, Words, chunks, mix

SIZE = 5
_MULT = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(SIZE)]


def _short(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer than SIZE words."""
    total = np.uint64(0xA0761D6478BD642F * len(h) & (1 << 64) - 1)
    for m, x in zip(_MULT, h, strict=False):
        total = total + m * x
    return mix(np.array([total], np.uint64))


def sets(texts: list, seed: int = 0) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, hashed under a seed; empty for texts without words."""
    with np.errstate(over="ignore"):
        for _, enc in chunks(texts):
            w = Words(enc, NON_BLANK, seed=seed)
            h = w.hash
            n = max(0, len(h) - SIZE + 1)
            total = np.zeros(n, np.uint64)
            for k, m in enumerate(_MULT):
                total += m * h[k : k + n]
            total = mix(total)
            for a, b in zip(w.word_at[:-1], w.word_at[1:], strict=True):
                if b - a >= SIZE:
                    yield np.unique(total[a : b - SIZE + 1])
                else:
                    yield _short(h[a:b]) if b > a else np.zeros(0, np.uint64)


def digest(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
