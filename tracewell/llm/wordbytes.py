"""Whole-text word scanning over UTF-8 bytes, vectorised over many texts at once.

Texts are joined into one byte buffer with blanks between them; words are the maximal runs of bytes that a table marks.
Every word gets a 64-bit hash, eight bytes at a time, under a seed that a job draws for itself: nobody who writes a text
can know which words collide, and words of up to eight bytes never do with others of their length. No Python object is
made for a word, but for those over `LONG` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

CHUNK = 256 << 10
#: longer spans are hashed one by one
LONG = 64
_PAD = 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """A table of the bytes outside the given inclusive ranges."""
    t = np.ones(256, bool)
    for a, b in excluded:
        t[a : b + 1] = False
    return t


#: [^\x20\x09-\x0D]
NON_BLANK = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans of buf, equal for equal bytes wherever they stand; buf goes on for 8 bytes after them."""
    size = ends - starts
    h = mix(np.uint64(seed) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not len(h):
        return h
    eight = np.ndarray(len(buf) - 7, "<u8", buffer=buf, strides=(1,))
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    for k in range(8, LONG, 8):
        (live,) = np.nonzero(size > k)
        if not len(live):
            return h
        h[live] = mix(h[live] ^ (eight[starts[live] + k] & _MASK[np.minimum(size[live] - k, 8)]))
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return h


def parts(batches: Iterator, rows: int = 1000) -> Iterator:
    """The batches in slices of so many rows, so that Python objects are made for few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) in runs of about `size` bytes; a longer text stands alone and whole."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        if held and n + len(b) > size:
            yield at, held
            at, held, n = i, [], 0
        held.append(b)
        n += len(b) + 1
    if held:
        yield at, held


class Words:
    """Words of a run of texts: byte spans, hashes, and the text each belongs to."""

    def __init__(self, encoded: list[bytes], is_word: np.ndarray, lower: np.ndarray = LOWER, seed: int = 0) -> None:
        self.n_texts = len(encoded)
        lens = np.fromiter((len(b) for b in encoded), np.int64, len(encoded))
        self.text_start = np.concatenate(([1], 1 + np.cumsum(lens + 1)[:-1])) if len(lens) else np.zeros(0, np.int64)
        self.text_end = self.text_start + lens
        self.buf = lower[np.frombuffer(b" " + b" ".join(encoded) + b" " * (1 + _PAD), np.uint8)]
        edge = np.diff(is_word[self.buf].view(np.int8))
        self.starts = np.flatnonzero(edge == 1) + 1
        self.ends = np.flatnonzero(edge == -1) + 1
        self.hash = span_hash(self.buf, self.starts, self.ends, seed)
        #: word_at[i]:word_at[i + 1] are the words of text i
        self.word_at = np.concatenate((np.searchsorted(self.starts, self.text_start), [len(self.starts)]))
        self.text_of = np.repeat(np.arange(self.n_texts), np.diff(self.word_at))
