"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges are taken from a queue with one bucket per merge rank. A bucket holds positions of a doubly linked list of
parts; three levels of 64-bit words mark which buckets have entries, so find-first-set gives the lowest rank in three
steps, whatever the length of the pre-token. An entry whose pair has changed since it was queued is stale and skipped.

A match of the pattern of over `LONG` bytes has a queue of its own. Shorter ones share one: their lists lie side by side,
each ends at its own barrier, and a bucket holds the 64 ranks of one word of the bitmap; it is worked off for all of them
at once, each taking its lowest rank, leftmost position first, until a lower bucket has an entry of its.

Texts are whole; each match is encoded separately. Equal matches of a slice are encoded once, and short ones are kept in
a bounded cache under their bytes, whose loss costs time only.

Defined results: null counts as the empty text; the empty text has no ids. Lone surrogates are encoded as U+FFFD.
Repeated rows are encoded alike. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import LONG, parts, span_hash

CACHE = 100_000
#: characters encoded at once; a longer text stands alone
SLICE = 1 << 19
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankBitmap:
    """Which of n buckets have entries: three levels of 64-bit words."""

    def __init__(self, n: int) -> None:
        self.level = [[0] * (n // 64**k + 1) for k in (1, 2, 3)]

    def set(self, i: int) -> None:
        for words in self.level:
            words[i >> 6] |= 1 << (i & 63)
            i >>= 6

    def clear(self, i: int) -> None:
        for words in self.level:
            words[i >> 6] &= ~(1 << (i & 63))
            if words[i >> 6]:
                return
            i >>= 6

    def first(self) -> int:
        """The lowest marked bucket, or -1."""
        for j, w in enumerate(self.level[2]):
            if w:
                break
        else:
            return -1
        for words in (self.level[2], self.level[1], self.level[0]):
            w = words[j]
            j = j << 6 | (w & -w).bit_length() - 1
        return j


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE) -> None:
        self.ranks, self.limit = ranks, cache
        self.splitter = split_codepoints if pattern == WORD_PATTERN else split_by(pattern)
        token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            token[r] = b
        self.bytes_flat = np.frombuffer(b"".join(token), np.uint8)
        self.bytes_len = np.array([len(b) for b in token], np.int64)
        self.byte = [ranks[bytes([i])] for i in range(256)]
        #: rank of the concatenation of two tokens, under left << 20 | right
        self.pair = {ranks[b[:k]] << 20 | ranks[b[k:]]: r for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self._hash_pairs(np.fromiter(self.pair, np.int64), np.fromiter(self.pair.values(), np.int32))
        self.cache: dict[bytes, bytes] = {}

    def _hash_pairs(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """An open-addressing table of the pairs."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]
            placed = self.keys[at[left]] == keys[left]
            self.vals[at[left[placed]]] = vals[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the concatenations of token pairs; _NONE where it is no token. Barriers are negative."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        k = self.keys[at]
        out = np.where(k == key, self.vals[at], np.int32(_NONE))
        (open_,) = np.nonzero((k != key) & (k >= 0) & (key >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            k = self.keys[at[open_]]
            hit = k == key[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (k >= 0)]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit integers."""
        whole = [self.ranks.get(p) for p in pieces]
        short = [i for i, x in enumerate(whole) if x is None and len(pieces[i]) <= LONG]
        out = [b"" if x is None else x.to_bytes(4, "little") for x in whole]
        for i, x in enumerate(whole):
            if x is None and len(pieces[i]) > LONG:
                out[i] = np.array(self.merge(pieces[i]), "<u4").tobytes()
        if short:
            ids, at = self.merge_short([pieces[i] for i in short])
            raw = ids.astype("<u4").tobytes()
            for i, a, b in zip(short, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[i] = raw[4 * a : 4 * b]
        return out

    def merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one after the other, and where each one's begin, with the end."""
        lens = np.array([len(p) for p in pieces])
        ends = np.cumsum(lens + 1)
        n = int(ends[-1])
        part = np.full(n, -1, np.int32)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        part[inside] = np.array(self.byte, np.int32)[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lens + 1)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        dead = np.zeros(n, bool)
        held = np.full(n, _NONE, np.int32)
        held[:-1] = self.rank(part[:-1], part[1:])
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = RankBitmap(len(self.bytes_len) // 64 + 1)

        def push(at: np.ndarray) -> None:
            at = at[held[at] < _NONE]
            if not len(at):
                return
            of = held[at] >> 6
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(at)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                k = int(of[x])
                if k in buckets:
                    buckets[k].append(at[x:y])
                else:
                    buckets[k] = [at[x:y]]
                    bitmap.set(k)

        push(np.arange(n))
        while (bucket := bitmap.first()) >= 0:
            at = np.concatenate(buckets.pop(bucket))
            bitmap.clear(bucket)
            at = at[held[at] >> 6 == bucket]  # the others are stale
            while len(at):
                # by pre-token, rank and place; an entry may be there twice
                key = (piece[at].astype(np.int64) << 6 | held[at] & 63) * np.int64(1 + LONG) + (at - ends[piece[at]] + 1 + LONG)
                order = np.argsort(key)
                at, key = at[order], key[order]
                lead = np.ones(len(at), bool)
                lead[1:] = key[1:] != key[:-1]
                at = at[lead]
                lead = np.ones(len(at), bool)
                lead[1:] = piece[at[1:]] != piece[at[:-1]]
                wait, at = at[~lead], at[lead]
                rank, second = held[at], after[at]
                third = after[second]
                part[at], after[at], held[second], dead[second] = rank, third, _NONE, True
                inner = third < n
                before[third[inner]] = at[inner]
                held[at] = self.rank(rank, part[np.minimum(third, n - 1)])
                has = before[at] >= 0
                left = before[at][has]
                held[left] = self.rank(part[left], rank[has])
                touched = np.concatenate((at, left))
                now = held[touched] >> 6
                same = np.concatenate((wait[held[wait] >> 6 == bucket], touched[now == bucket]))
                low = piece[touched[now < bucket]]
                if len(low) and len(same):  # their pre-tokens go on at a lower bucket
                    back = np.isin(piece[same], low)
                    push(same[back])
                    same = same[~back]
                push(touched[now != bucket])
                at = same
        alive = np.flatnonzero(~dead & (part >= 0))
        return part[alive], np.searchsorted(piece[alive], np.arange(len(pieces) + 1))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece that is no token."""
        n, pair, bitmap = len(piece), self.pair, RankBitmap(len(self.bytes_len))
        part = [self.byte[x] for x in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: rank of the pair that begins at each position; _NONE too where a part was merged into the one before
        held = [pair.get(x << 20 | y, _NONE) for x, y in zip(part, part[1:], strict=False)] + [_NONE]
        buckets: dict[int, list[int]] = {}

        def push(at: int) -> None:
            rank = held[at]
            if rank < _NONE:
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    bitmap.set(rank)

        for at in range(n - 1):
            push(at)
        while (rank := bitmap.first()) >= 0:
            entries = sorted(buckets.pop(rank))
            bitmap.clear(rank)
            for k, at in enumerate(entries):
                if held[at] != rank:  # stale
                    continue
                gone = after[at]
                third, left = after[gone], before[at]
                part[at], after[at], held[gone] = rank, third, _NONE
                low = held[at] = pair.get(rank << 20 | part[third], _NONE) if third < n else _NONE
                if third < n:
                    before[third] = at
                push(at)
                if left >= 0:
                    held[left] = pair.get(part[left] << 20 | rank, _NONE)
                    low = min(low, held[left])
                    push(left)
                if low < rank and k + 1 < len(entries):  # a lower rank goes first; the rest of the bucket waits
                    buckets[rank] = entries[k + 1 :]
                    bitmap.set(rank)
                    break
        out, at = [], 0
        while at < n:
            out.append(part[at])
            at = after[at]
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        joined = "".join(texts)
        raw = joined.encode("utf-8", "replace")
        if not raw:
            return [np.zeros(0, np.uint32) for _ in texts]
        starts, piece_at = self.splitter(texts, joined)
        ends = np.append(starts[1:], len(raw))
        first, inverse = _distinct(np.frombuffer(raw + bytes(8), np.uint8), starts, ends)
        pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.cache) > self.limit:
            self.cache.clear()
        got = [self.cache.get(p) for p in pieces]
        new = [i for i, x in enumerate(got) if x is None]
        for i, ids in zip(new, self.encode([pieces[i] for i in new]), strict=True):
            got[i] = ids
            if len(pieces[i]) <= LONG:
                self.cache[pieces[i]] = ids
        ids, at = _gather(np.frombuffer(b"".join(got), "<u4"), np.fromiter((len(x) // 4 for x in got), np.int64, len(got)), inverse)
        at = at[piece_at]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.bytes_flat, self.bytes_len, np.asarray(ids, np.int64))[0].tobytes()


def _distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of each distinct span, which of them each span equals); the spans lie side by side and hold a byte at least.

    Hashes only propose equal spans; all their bytes are compared.
    """
    _, first, inverse = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, first[inverse]
    n = int(ends[-1])
    at = np.minimum(np.repeat(starts[like] - starts, size) + np.arange(n), n - 1)
    (odd,) = np.nonzero((size != size[like]) | np.logical_or.reduceat(buf[:n] != buf[at], starts))
    own: dict[bytes, int] = {}
    for i in odd.tolist():
        k = own.setdefault(buf[starts[i] : ends[i]].tobytes(), len(first))
        if k == len(first):
            first = np.append(first, i)
        inverse[i] = k
    return first, inverse


def _gather(flat: np.ndarray, lens: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of `flat`, cut by lens, in the order of pick; and where each begins in the result, with its end."""
    start = np.concatenate(([0], np.cumsum(lens)))[pick]
    n = lens[pick]
    at = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat(start - at[:-1], n) + np.arange(at[-1])], at


_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
#: The pattern that split_codepoints() follows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        t = np.full(0x110000, _OTHER, np.uint8)
        for low in range(0, len(t), 1 << 14):
            some = "".join(map(chr, range(low, low + (1 << 14))))
            for k, p in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
                for m in regex.finditer(p, some):
                    t[low + m.start() : low + m.end()] = k
        _classes.append(t)
    return _classes[0]


def split_codepoints(texts: list[str], joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all matches of WORD_PATTERN, and at which of them each text begins, with the end."""
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    cls = _class_table()[cp]
    n = len(cp)
    text_at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    flag = np.zeros(n + 2, bool)
    flag[1:n] = cls[1:] != cls[:-1]
    fresh = np.zeros(n + 2, bool)
    fresh[text_at] = True
    flag[text_at] = True
    runs = np.flatnonzero(flag[:n])
    ends = np.append(runs[1:], n)
    # white space before something else in the same text: its last character stands alone or, if a blank, leads on
    gap = (cls[runs] == _SPACE) & ~fresh[ends]
    last = ends[gap] - 1
    flag[last] = True
    blank = cp[last] == 0x20
    flag[ends[gap][blank]] = False
    # contractions: an apostrophe that starts a match, alone, before letters
    quote = (cp[runs] == 0x27) & (ends - runs == 1) & flag[runs] & ~fresh[ends]
    after = ends[quote]
    after = after[cls[after] == _LETTER]
    c1 = cp[after]
    c2 = np.where((after + 1 < n) & ~fresh[after + 1], cp[np.minimum(after + 1, n - 1)], 0)
    one = np.isin(c1, [ord(c) for c in "stmd"])
    two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
    flag[after[one | two]] = False
    flag[after[one] + 1] = True
    flag[after[two] + 2] = True
    starts = np.flatnonzero(flag[:n])
    width = np.ones(n + 1, np.int64)
    for bound in (0x80, 0x800, 0x10000):
        width[:n] += cp >= bound
    byte_at = np.concatenate(([0], np.cumsum(width[:n])))
    return byte_at[starts], np.searchsorted(starts, text_at)


def split_by(pattern: str):
    """A splitter for any other pattern, whose matches must cover the text."""
    found = regex.compile(pattern)

    def split(texts: list[str], joined: str) -> tuple[np.ndarray, np.ndarray]:
        lens, at = [], [0]
        for t in texts:
            lens += [len(m.encode("utf-8", "replace")) for m in found.findall(t)]
            at.append(len(lens))
        return np.concatenate(([0], np.cumsum(lens)))[:-1].astype(np.int64), np.array(at)

    return split


_loaded: dict[tuple, Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """The vocabulary of a file, read once for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def _slices(texts: list[str], size: int = SLICE) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, if asked for) and the digests of ids and decoded bytes, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in parts(batches):
            ids_of = batch.column("doc_id")
            at = 0
            for texts in _slices([t or "" for t in batch.column("text").to_pylist()]):
                ids = bpe.encode_batch(texts)
                cols = [ids_of.slice(at, len(texts)), pa.array([len(x) for x in ids], pa.int64())]
                cols += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT + (", ids array<int>" if keep_ids else ""))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows of (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in parts(batches):
            got = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
