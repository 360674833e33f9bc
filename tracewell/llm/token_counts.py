"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Within one match of the pre-tokenizer, a prefix's encoding ends in exactly one token t, and what stands before t is the
encoding of a shorter prefix whose last token doesn't merge with t or with a part of it. So the count of tokens at byte i
is the count at i - |t|, plus one; the step needs the last token at each shorter prefix and nothing else, and a match of any
length takes time linear in it. Counts of the matches before are added up, and the cuts at which the pre-tokenizer
would match otherwise (inside a run of white space, a contraction or a special token) are set right. The array answers how
many tokens any prefix has and how much of a text a budget holds, without encoding again: in the task (`count`), or
later from a table of arrays (`stored`, `tokens_at`, `fitting`).

A vocabulary is a tokenizers .json of the byte-level kind (no normalizer, no added prefix space, standard pattern, each token
made by one merge of earlier tokens, special tokens that strip nothing); others raise ValueError. Special strings
inside texts count as one token, as that library does by default.

Defined results: null and empty texts have no prefix and 0 tokens; repeated rows and null ids are counted each by
itself; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordbytes import parts

LIMIT = 512
#: Matches of at most so many characters are remembered, with what is known of their prefixes; so many in each worker.
SHORT = 40
REMEMBERED = 400_000
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"

#: The pre-tokenizer's white space and pattern.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_PATTERN = rf" ?\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_MATCH = regex.compile(_PATTERN)
_RUN = re.compile(rf"[{_SPACE}]{{2,}}(?=[^{_SPACE}])")
_BEYOND_LATIN = re.compile(f"[{chr(0x530)}-{chr(0x10FFFF)}]")
_THREE = {"'re", "'ve", "'ll"}


def _byte_of() -> dict[str, int]:
    """The byte that each character of the file's token strings stands for: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _doubtful() -> regex.Pattern:
    """Characters that one version of Unicode leaves open and another calls a letter or number: the library decides."""
    known = regex.compile(r"[\p{L}\p{N}]")
    found = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    spans: list[list[int]] = []
    for c in found:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans) + "]") if spans else regex.compile(r"(?!)")


class _Known(dict):
    """Remembers what `find` gives; when it is full, what was not asked for since it was last full is forgotten."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Prefixes:
    """A vocabulary, and the counts of every prefix of a text under it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        self._check(spec)
        byte_of = _byte_of()
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: the rank at which two neighbours become one token
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.split = {a + b: (a, b) for a, b in self.rank}
        single = {bytes([b]) for b in range(256)}
        self.made = dict.fromkeys(single, -1) | {a + b: i for (a, b), i in self.rank.items()}
        if len(self.split) < len(pairs) or any(max(self.made.get(a, i), self.made.get(b, i)) >= i for (a, b), i in self.rank.items()):
            raise ValueError("each token must be made by one merge, of tokens made before")
        #: every ending of a token, and whether it is a token itself
        self.tails = {t[i:]: t[i:] in self.made for t in self.made for i in range(len(t))}
        self.widest = max(map(len, self.made))
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.doubtful = _doubtful()
        self._raw, self._library = raw, None
        self._right: dict[bytes, list[tuple[bytes, float]]] = {}
        self._left: dict[bytes, list[tuple[bytes, float]]] = {}
        self._matched = _Known(self._short)
        #: of each prefix of a short match: where the last token then begins and the number of tokens
        self._states = _Known(self._state)
        self._stays = _Known(self._stay)

    @staticmethod
    def _check(spec: dict) -> None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        standard = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        bare = not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        if model.get("type") != "BPE" or spec.get("normalizer") or not (plain and standard and bare):
            raise ValueError("a plain byte-level vocabulary is needed")

    def _edge(self, token: bytes, side: int, seen: dict) -> list[tuple[bytes, float]]:
        """What stands at one edge of a token while it is built, outermost last formed: (part, rank that takes it up)."""
        if token not in seen:
            chain, part, taken = [], token, float("inf")
            while True:
                chain.append((part, taken))
                if part not in self.split:
                    break
                taken, part = self.made[part], self.split[part][side]
            seen[token] = chain
        return seen[token]

    def _stay(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether two tokens stay side by side: no merge across their border comes in time.

        Of merges of one rank the leftmost comes first: before the right neighbour's own, after the left one's.
        """
        left = self._edge(pair[1], 0, self._left)
        for r, r_taken in self._edge(pair[0], 1, self._right):
            for s, s_taken in left:
                at = self.rank.get((r, s))
                if at is not None and at < r_taken and at <= s_taken:
                    return False
        return True

    def _step(self, b: bytes, i: int, state: Sequence[int]) -> tuple[int, int]:
        """Of b[:i]: where its last token begins and how many tokens it has. state: the same of b[:1], b[:2], ... in turn."""
        tails = self.tails
        if i <= self.widest and tails.get(b[:i]):
            return 0, 1
        j, ends = i - 1, []  # where tokens that end at i begin, longest last
        while j and (token := tails.get(b[j:i])) is not None:
            if token:
                ends.append(j)
            j -= 1
        for j in reversed(ends):
            if self._stays[b[state[2 * j - 2] : j], b[j:i]]:
                return j, state[2 * j - 1] + 1
        raise AssertionError("every prefix has one encoding")

    def _state(self, b: bytes) -> bytes:
        """The steps of a short match; those of its prefixes are remembered."""
        state = self._states[b[:-1]] if len(b) > 1 else b""
        return state + bytes(self._step(b, len(b), state))

    def _short(self, piece: str) -> bytes:
        """Counts at each character of a short match, a byte each."""
        b = piece.encode("utf-8", "surrogatepass")
        n = self._states[b][1::2]
        if len(b) != len(piece):
            n = bytes(c for c, after in zip(n, b[1:] + b" ", strict=True) if after & 0xC0 != 0x80)
        if piece in _THREE:
            n = bytes([1, 2, n[2]])  # cut after two, quote and letter match apart
        return n

    def _long(self, piece: str) -> np.ndarray:
        """Counts at each character of a match of any length."""
        b = piece.encode("utf-8", "surrogatepass")
        state: list[int] = []
        for i in range(1, len(b) + 1):
            state.extend(self._step(b, i, state))
        lead = (np.frombuffer(b, np.uint8) & 0xC0) != 0x80
        return np.array(state[1::2])[np.append(np.flatnonzero(lead)[1:], len(b)) - 1]

    def _piece(self, piece: str) -> np.ndarray:
        return self._long(piece) if len(piece) > SHORT else np.frombuffer(self._matched[piece], np.uint8)

    def _matches(self, text: str) -> list[str]:
        if not (_BEYOND_LATIN.search(text) and self.doubtful.search(text)):
            return _MATCH.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._raw).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _ordinary(self, text: str) -> tuple[np.ndarray, int, int]:
        """Counts at each character of a text without special tokens; where its last match begins, and the tokens before that."""
        matches = self._matches(text)
        if not matches:
            return np.zeros(0, np.int64), 0, 0
        size = np.fromiter(map(len, matches), np.int64, len(matches))
        if size.max() <= SHORT:
            own = np.frombuffer(b"".join(map(self._matched.__getitem__, matches)), np.uint8).astype(np.int64)
        else:
            own = np.concatenate([self._piece(x) for x in matches]).astype(np.int64)
        whole = own[np.cumsum(size) - 1]
        before = np.cumsum(whole) - whole
        n = own + np.repeat(before, size)
        for m in _RUN.finditer(text):  # cut at its end, a run of white space is one match
            a, b = m.span()
            n[b - 1] = (n[a - 1] if a else 0) + int(self._piece(m[0])[-1])
        return n, len(text) - int(size[-1]), int(before[-1])

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:1], text[:2], ..., text."""
        spans = [m.span() for m in self.special.finditer(text)] if self.special else []
        if not spans:
            return self._ordinary(text)[0]
        out, before, at = [], 0, 0
        for a, b in spans:
            part = text[at:a]
            n, begins, kept = self._ordinary(part)
            out.append(before + n)
            # cut inside the special string, what stands there is ordinary and may match with what precedes it
            out.append(before + kept + self._ordinary(text[at + begins : b - 1])[0][a - at - begins :])
            before += (int(n[-1]) if len(n) else 0) + 1
            out.append([before])
            at = b
        out.append(before + self._ordinary(text[at:])[0])
        return np.concatenate(out).astype(np.int64)


_loaded: dict[str, Prefixes] = {}


def load(path: str) -> Prefixes:
    """The vocabulary of a file, read once for each worker process."""
    if path not in _loaded:
        _loaded[path] = Prefixes(path)
    return _loaded[path]


def longest(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most so many tokens; counts may fall where a longer prefix merges better."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix within the limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in parts(batches):
            total, fit = [], []
            for text in batch.column("text").to_pylist():
                n = vocabulary.counts(text or "")
                total.append(int(n[-1]) if len(n) else 0)
                fit.append(longest(n, limit))
            n_tokens = pa.array(total, pa.int64())
            over = pa.array([x > limit for x in total], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n_tokens, over, pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return _texts(docs, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).mapInArrow(run, OUT)


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def stored(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts (array<int>): the tokens of the text's first character, first two, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in parts(batches, 100):
            found = [vocabulary.counts(t or "").astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "counts"])

    return _texts(docs).mapInArrow(run, "doc_id long, counts array<int>")


def tokens_at(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` characters: 0 for none or less, the whole text's beyond its end."""
    at = F.least(F.size(counts), (F.lit(chars) if isinstance(chars, int) else chars).cast("int"))
    return F.when(at < 1, 0).otherwise(F.try_element_at(counts, at))


def fitting(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    past = F.array_position(F.reverse(F.transform(counts, lambda c: c <= limit)), True)
    return F.when(past == 0, 0).otherwise(F.size(counts) - past + 1).cast("int")
