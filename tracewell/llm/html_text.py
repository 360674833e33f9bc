"""Main text of web pages: structure first, then a suffix array over all pages of a host.

Each page is cut into blocks. Elements that are chrome by their kind, role or class (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out with all they hold. Then the pages of a host
are joined into one stream of tokens, with a mark at every block's end, and its suffixes are sorted by their first
`RUN` tokens; places that share them are neighbours. Long substrings found so on enough distinct pages are boilerplate:

* on pages without an article or main element, on at least `OPEN_PAGES` distinct pages of the host; but where more than
  half of a page would go, only what stands on `SHARE` of the host's pages and `MOST_PAGES` of them: near copies of a page
  keep their text, pages that are mostly menu lose the menu;
* within an article, on at least `SHARE` of the host's pages and `MIN_PAGES` of them; an article of which more than half
  would go is a copy of others, not boilerplate, and stays whole.

Pages with equal streams count as one. A large host is dealt by hash of the stream into shards of about `SHARD` pages
and `SHARD_BYTES` bytes, which bounds a task and nothing else: shards emit runs with the number of their pages, the numbers are
summed over the host, and every page is judged by the sums. A task sends each stream once; then the rows are read
again and cut where they stand, so that copies of a page do not meet.

Only runs that may reach a bound are emitted. Where no page of a host lies outside articles, a run on `SHARE` of all pages is
on `SHARE` of some shard's, so shards first name such runs and the named ones are counted; else all runs are counted.

Defined results: null or empty html has the empty text; a null url has no host and its pages are taken for one host.
White space is what Unicode counts as such. Repeated rows are extracted alike. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import small
from .store import materialise
from .wordbytes import NON_BLANK, Words, mix, parts

RUN = 8
SHARE = 0.8
MIN_PAGES = 8
OPEN_PAGES = 2
MOST_PAGES = 3
SHARD = 2000
SHARD_BYTES = 32 << 20
#: tables up to so many rows (hosts, runs) are broadcast, else joined
BROADCAST_ROWS = 100_000
BROADCAST_RUNS = 1_000_000
OUT = "page_id long, url string, text string, n_chars long"
_MARK = "\x01"

# Kinds of elements in HTML, and words by which pages name their chrome.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "title", "textarea", "select")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "replies", "share", "sharing", "sidebar", "sidenav", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "masthead", "topbar", "gdpr", "alert"}
#: words that stand beside those in compound names (site-footer, share-buttons, related-posts)
BESIDE = {"after", "area", "articles", "aside", "bar", "before", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "count", "fixed", "form", "global", "group", "header", "icon", "icons", "inline", "inner", "item", "items", "js", "label", "left", "link", "links", "list", "main", "media", "mobile", "module", "outer", "overlay", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "signup", "site", "slot", "sticky", "stories", "text", "thread", "title", "top", "unit", "wrap", "wrapper"}
#: elements with text of their own, whose ids are anchors
TITLED = {"h1", "h2", "h3", "h4", "h5", "h6", "p"} | INLINE
#: elements that may stand in head; any other closes it
IN_HEAD = {"head", "meta", "link", "base", "basefont", "bgsound", "noframes"}
CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}

_NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.IGNORECASE)
#: attributes up to the end of a tag; a quote that nothing closes makes no match
_ATTRS = re.compile(r"""(?>(?:[^<>"']+|"[^"]*"|'[^']*')*)>""")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, whether it closes, attributes) of what isn't text; comments and raw elements have no name.

    Nothing is read twice but what a quote spans, so malformed markup takes no longer than other markup.
    """
    at, last = 0, page.rfind(">")
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        if begin > last:
            return
        name = _NAME.match(page, begin)
        if not name:
            if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = page.index(">", begin) + 1
                yield begin, at, "", False, ""
            else:
                at = begin + 1
            continue
        attrs = _ATTRS.match(page, name.end())
        end = attrs.end() if attrs else page.index(">", name.end()) + 1
        tag, closes, rest = name[1].lower(), page[begin + 1] == "/", page[name.end() : end - 1]
        if tag in _CLOSE and not closes:
            at = end
            if not (tag in ("svg", "math") and rest.endswith("/")):
                close = _CLOSE[tag].search(page, end)
                at = close.end() if close else len(page)
            yield begin, at, "", False, ""
        else:
            at = end
            yield begin, at, tag, closes, rest


def _named(name: str) -> bool:
    """Whether a class or id is a name of chrome: a word for it, alone or compounded with such words or those of BESIDE."""
    words = _WORD.findall(name)
    return bool(CHROME_WORDS.intersection(words)) and all(w in CHROME_WORDS or w in BESIDE or len(w) == 1 for w in words)


def _is_chrome(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden":
            return True
        if name == "role":
            if ROLES.intersection(_WORD.findall(value)):
                return True
        elif name == "id":
            if tag not in TITLED and _named(value):
                return True
        elif name == "class":
            if any(map(_named, value.split())) or not in_article and tag not in TITLED and CHROME_WORDS.intersection(_WORD.findall(value)):
                return True
    return False


def blocks(page: str) -> list[tuple[bool, str]]:
    """(within an article or main element, text) of each block outside chrome, in page order."""
    out: list[tuple[bool, str]] = []
    stack: list[tuple[str, bool]] = []
    count: dict[str, int] = {}
    chrome = article = at = 0
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).replace(_MARK, " ").split())
            held.clear()
            if text:
                out.append((article > 0, text))

    def pop() -> None:
        nonlocal chrome, article
        tag, was = stack.pop()
        count[tag] -= 1
        chrome -= was
        article -= tag in ("article", "main")

    def end_head() -> None:
        while count.get("head"):
            pop()

    for begin, end, tag, closes, attrs in tags(page):
        if begin > at and count.get("head") and not page[at:begin].isspace():
            end_head()
        if begin > at and not chrome:
            held.append(_html.unescape(page[at:begin]))
        at = end
        if not tag:
            continue
        if count.get("head"):
            if not closes and tag == "head":
                continue
            if not closes and tag not in IN_HEAD:
                end_head()
        if tag not in INLINE:
            flush()
        if closes:
            if count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID:
            if stack and (stack[-1][0] == "p" and tag not in INLINE or stack[-1][0] in (tag, CLOSES.get(tag)) and tag in CLOSES):
                pop()
            if attrs.endswith("/") and tag not in ("p", "div"):
                continue
            was = _is_chrome(tag, attrs, article > 0)
            if was or tag in ("article", "main"):
                flush()
            stack.append((tag, was))
            count[tag] = count.get(tag, 0) + 1
            chrome += was
            article += tag in ("article", "main")
    if at < len(page) and not page[at:].isspace():
        end_head()
    if at < len(page) and not chrome:
        held.append(_html.unescape(page[at:]))
    flush()
    return out


def main_blocks(page: str) -> tuple[bool, str]:
    """(whether the page has an article, its candidate blocks joined by marks)."""
    found = blocks(page)
    inside = [t for a, t in found if a]
    return bool(inside), f" {_MARK} ".join(inside or [t for _, t in found])


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def parse(pages: DataFrame, distinct: bool = False) -> DataFrame:
    """page_id, url, host, article, stream, digest of every row, or of one row of each distinct (host, article, stream) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in parts(batches, 500):
            got = [main_blocks(h or "") for h in part.column("html").to_pylist()]
            digests = [hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=16).digest() for _, s in got]
            out = pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array([a for a, _ in got], pa.bool_()), pa.array([s for _, s in got], pa.string()), pa.array(digests, pa.binary())], ["page_id", "url", "host", "article", "stream", "digest"])
            if distinct:
                new = []
                for x in zip(part.column("host").to_pylist(), digests, (a for a, _ in got), strict=True):
                    new.append(x not in seen)
                    seen.add(x)
                out = out.filter(pa.array(new, pa.bool_()))
            yield out

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _host().alias("host"), "html")
    return rows.mapInArrow(run, "page_id long, url string, host string, article boolean, stream string, digest binary")


def repeated(tokens: np.ndarray, page_of: np.ndarray, last: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places grouped by their first `run` tokens: (places in suffix order, group of each, distinct pages of each group).

    tokens: one stream; last: where each place's page ends. Places with fewer tokens left in their page are left out.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width < run:
        step = min(width, run - width)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - step)] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + ahead, return_inverse=True)
        width += step
    (place,) = np.nonzero(np.arange(len(tokens)) + run <= last)
    order = place[np.lexsort((page_of[place], rank[place]))]
    if not len(order):
        return order, order, order
    r, p = rank[order], page_of[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    group = np.cumsum(new) - 1
    fresh = new | np.concatenate(([True], p[1:] != p[:-1]))
    return order, group, np.bincount(group[fresh], minlength=group[-1] + 1)


def _words(streams: list[str]) -> tuple[Words, np.ndarray]:
    """The tokens of streams and where each one's page ends."""
    w = Words([s.encode("utf-8", "replace") for s in streams], NON_BLANK, np.arange(256, dtype=np.uint8))
    return w, np.repeat(w.word_at[1:], np.diff(w.word_at))


def run_hash(tokens: np.ndarray) -> np.ndarray:
    """A hash of the RUN tokens from each place on; the last RUN - 1 places have none."""
    n = max(0, len(tokens) - RUN + 1)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = mix(h ^ tokens[k : k + n]) + np.uint64(k)
    return h.view(np.int64)


def _shard_runs(streams: list[str], alone: bool, has_open: bool) -> tuple[np.ndarray, np.ndarray]:
    """(run, distinct pages) of a shard's distinct streams, of those runs that may reach a bound on the whole host."""
    w, last = _words(streams)
    order, group, pages = repeated(w.hash, w.text_of, last)
    if not len(order):
        return order, order
    runs = run_hash(w.hash)[order[np.concatenate(([True], group[1:] != group[:-1]))]]
    if has_open:
        keep = pages >= (OPEN_PAGES if alone else 1)
    else:
        keep = pages >= np.ceil(SHARE * len(streams) - 1e-9)
    return runs[keep], pages[keep]


def _shards(rows: DataFrame) -> DataFrame:
    """host, run, n (distinct pages) of every shard; the null run has the number of all its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, held, shards, has_open = None, None, [], 1, False

        def out() -> pa.RecordBatch:
            runs, n = _shard_runs(held, shards == 1, has_open)
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * (1 + len(runs)), pa.string()), pa.array([None, *runs.tolist()], pa.int64()), pa.array([len(held), *n.tolist()], pa.int64())], ["host", "run", "n"])

        for batch in parts(batches):
            for host, salt, digest, article, stream, k, whole in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (host, salt) != at:
                    if at:
                        yield out()
                    at, before, held, shards, has_open = (host, salt), None, [], k, whole
                has_open |= bool(stream) and not article
                if digest != before:
                    held.append(stream)
                    before = digest
        if at:
            yield out()

    # each shard's rows lie together in one partition, equal streams side by side
    rows = rows.select("host", "salt", "digest", "article", "stream", "shards", "has_open")
    return rows.repartition("host", "salt").sortWithinPartitions("host", "salt", "digest").mapInArrow(run, "host string, run long, n long")


def _by_host(df: DataFrame) -> dict[str, list]:
    """The rows of a table of host and runs that is small enough, in arrays by host."""
    cols = [c for c in df.columns if c != "host"]
    rows = df.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("rows")).collect()
    return {r["host"]: [np.array([x[c] for x in r["rows"]]) for c in cols] for r in rows}


def _count_named(pages: DataFrame, names: DataFrame) -> DataFrame:
    """host, run, n (distinct pages) of the named runs."""
    known = pages.sparkSession.sparkContext.broadcast(_by_host(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            runs = []
            for host, stream in zip(part.column("host").to_pylist(), part.column("stream").to_pylist(), strict=True):
                (names,) = known.value.get(host, (np.zeros(0, np.int64),))
                runs.append(np.intersect1d(run_hash(_words([stream])[0].hash), names))
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("digest"), pa.array(runs, pa.list_(pa.int64()))], ["host", "digest", "runs"])

    hits = parse(pages, True).select("host", "digest", "stream").mapInArrow(run, "host string, digest binary, runs array<long>")
    return hits.filter("size(runs) > 0").dropDuplicates(["host", "digest"]).select("host", F.explode("runs").alias("run")).groupBy("host", "run").agg(F.count("*").alias("n"))


def boilerplate(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, run, level: runs to be cut from the pages of each host: 2 within articles too, 1 from any other page, 0 from
    pages of which that leaves half.

    hosts: host, shards, has_open of the hosts that have several shards.
    """
    rows = parse(pages, True).join(hosts, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("has_open", F.coalesce("has_open", F.lit(False)))
    counts = materialise(_shards(rows.withColumn("salt", F.pmod(F.xxhash64("digest"), "shards"))), "counts")
    names = counts.filter("run is not null").join(hosts.filter("not has_open").select("host"), "host", "left_semi").select("host", "run").distinct()
    names = materialise(names, "names")
    n = names.count()
    if n > BROADCAST_RUNS:
        return boilerplate(pages, hosts.withColumn("has_open", F.lit(True)))
    if n:
        some = pages.join(F.broadcast(names.select(F.col("host").alias("named")).distinct()), _host() == F.col("named"), "left_semi")
        counts = counts.join(names, ["host", "run"], "left_anti").unionByName(_count_named(some, names))
    runs = counts.filter("run is not null").groupBy("host", "run").agg(F.sum("n").alias("n"))
    size = counts.filter("run is null").groupBy("host").agg(F.sum("n").alias("size"))
    most = F.col("n") >= F.ceil(F.lit(SHARE) * F.col("size"))
    level = F.when(most & (F.col("n") >= MIN_PAGES), 2).when(most & (F.col("n") >= MOST_PAGES), 1).otherwise(0)
    return runs.join(size, "host").filter((F.col("n") >= OPEN_PAGES) | (level > 0)).select("host", "run", level.alias("level"))


def clean(streams: list[str], article: np.ndarray, runs: np.ndarray, level: np.ndarray) -> list[str]:
    """The texts of pages of a host without its boilerplate."""
    out = [s.replace(f" {_MARK} ", " ") for s in streams]
    if not len(runs):
        return out
    w, last = _words(streams)
    h = run_hash(w.hash)
    at = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
    (bad,) = np.nonzero((runs[at] == h) & (np.arange(len(h)) + RUN <= last[: len(h)]))
    if not len(bad):
        return out
    level, of, size = level[at[bad]], w.text_of[bad], np.diff(w.word_at)

    def covered(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that lie in runs of the level that their page asks for, and their number by page."""
        cut = bad[level >= least[of]]
        edge = np.bincount(cut, minlength=len(w.hash) + RUN) - np.bincount(cut + RUN, minlength=len(w.hash) + RUN)
        hit = np.cumsum(edge)[: len(w.hash)] > 0
        return hit, np.bincount(w.text_of[hit], minlength=len(streams))

    least = np.where(article, 2, 0)
    _, n = covered(least)
    hit, n = covered(np.where(~article & (2 * n > size), 1, least))
    for i in np.flatnonzero(n):
        if article[i] and 2 * n[i] > size[i]:
            continue
        a, b = w.word_at[i], w.word_at[i + 1]
        out[i] = " ".join(x for x, c in zip(streams[i].split(" "), hit[a:b], strict=True) if not c and x != _MARK)
    return out


def shards(rows: DataFrame, shard: int, shard_bytes: int) -> DataFrame:
    """host, shards, has_open (whether a page has text outside articles) of the hosts that need several shards."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("stream")).alias("bytes"), F.max(~F.col("article") & (F.col("stream") != "")).alias("has_open"))
    n = F.greatest(F.ceil(F.col("n") / shard), F.ceil(F.col("bytes") / shard_bytes))
    return hosts.select("host", n.alias("shards"), "has_open").filter("shards > 1")


def extract(pages: DataFrame, shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    hosts = small(materialise(shards(parse(pages), shard, shard_bytes), "hosts"), BROADCAST_ROWS)
    runs = materialise(boilerplate(pages, hosts), "runs")
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    if runs.count() <= BROADCAST_RUNS:
        known = pages.sparkSession.sparkContext.broadcast(_by_host(runs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches, 500):
                host, article, streams = part.column("host").to_pylist(), np.array(part.column("article").to_pylist(), bool), part.column("stream").to_pylist()
                got: list[str] = [""] * len(host)
                of: dict[str, list[int]] = {}
                for i, h in enumerate(host):
                    of.setdefault(h, []).append(i)
                for h, at in of.items():
                    for i, t in zip(at, clean([streams[i] for i in at], article[at], *known.value.get(h, none)), strict=True):
                        got[i] = t
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return parse(pages).mapInArrow(run, OUT)

    def cut(key: tuple, pdf: pd.DataFrame, bad: pd.DataFrame) -> pd.DataFrame:
        bad = bad.sort_values("run")
        got = clean(pdf["stream"].tolist(), pdf["article"].to_numpy(bool), bad["run"].to_numpy(np.int64), bad["level"].to_numpy(np.int64))
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": got, "n_chars": [len(t) for t in got]})

    # dealt by row, not by stream: copies of a page go to all of their host's shards
    rows = parse(pages).join(hosts, "host", "left").withColumn("salt", F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), "shards")))
    runs = runs.join(hosts, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shards", F.lit(1)) - 1)))
    rows, runs = rows.select("host", F.col("salt").cast("long").alias("salt"), "page_id", "url", "article", "stream"), runs.select("host", "salt", "run", "level")
    return rows.groupBy("host", "salt").cogroup(runs.groupBy("host", "salt")).applyInPandas(cut, OUT)
