"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SF = "/root/testdata/sf0.01"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Find:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def jaccard_groups(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id)"""
    sets = [(d, shingle_set(t)) for d, t in rows]
    f, by_token, by_set = Find(), defaultdict(list), {}
    for d, s in sets:
        f.root(d)
        if s:
            if s in by_set:
                f.join(by_set[s], d)
            else:
                by_set[s] = d
    for s, d in by_set.items():
        seen = defaultdict(int)
        for x in s:
            for other in by_token[x]:
                seen[other] += 1
            by_token[x].append((s, d))
        for (t, e), n in seen.items():
            if 100 * n >= 80 * (len(s) + len(t) - n):
                f.join(d, e)
    return sorted((d, len(s), f.root(d)) for d, s in sets)


def contamination(rows, items):
    """rows: (doc_id, text); items: (item_id, text) -> sorted contract rows"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_UPPER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    lengths = sorted({len(x) for x in windows})
    out = []
    for d, t in rows:
        w, hit, got = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    got |= windows[x]
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def repeats(rows, n=100):
    """rows: (doc_id, text) in any order -> sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if s in seen:
                cover[k : k + n] = b"\1" * n
            seen.add(s)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((d, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out
