"""URL filtering by pattern rules indexed by their rarest literal token.

Each rule names literal tokens that every URL it fits must contain. Spark counts in how many URLs each of those tokens
stands; the index keeps a rule under its rarest one. A URL's tokens fetch candidate rules from the index, and only these
run their regular expressions. DataFrame functions only.

Up to `INLINE` rules the index is a literal map inside the plan, so that nothing is shuffled; beyond, URLs and index
are joined on the token.

Rules of kind `list` come first: of those that fit, the longest decides. Else the rules of kind `pattern` do: block if
any fits. Else the URL is allowed. A host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z
lower-cased; the path goes on to `?`, `#` or the end.

Defined results: a null URL or one without `://` has an empty host and path, no rule, and is allowed. Repeated rows are
judged alike. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE = 512
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A regular expression on host followed by path, and the literal tokens that it needs."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    kind: str = "pattern"


def listed(verdict: str, rule: str) -> Rule:
    """A rule like `example.com/en/`: the host and all its subdomains, if the path starts with the rule's."""
    tokens = tuple(t for t in re.split(r"[^a-z0-9]+", rule.partition("/")[0]) if t)
    return Rule(rule, verdict, r"\A(?:[^/]*\.)?" + _quoted(rule), tokens, "list")


def host_part(*tokens: str) -> Rule:
    """Blocks hosts with a label that is, or has between hyphens, these tokens in a row."""
    name = "-".join(tokens)
    return Rule(name, BLOCK, rf"\A(?:[^/]*[.-])?{_quoted(name)}(?:[.:-][^/]*)?(?:/|\z)", tokens)


def path_part(*tokens: str) -> Rule:
    name = "-".join(tokens)
    return Rule(f"/{name}/", BLOCK, rf"\A[^/]*/(?:.*/)?{_quoted(name)}(?:[/.]|\z)", tokens)


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", s)


#: Host and path parts of unwanted sites.
PATTERNS = [
    host_part("casino", "win"),
    host_part("free", "bets"),
    host_part("cheap", "pills"),
    host_part("ads", "track"),
    host_part("doubleclick"),
    host_part("porn"),
    path_part("wp", "login"),
    path_part("affiliate"),
]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the distinct tokens of both."""
    url = F.col("url")
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    before = F.regexp_replace(rest, r"(?s)[?#].*\z", "")
    parts = pages.select("page_id", before.alias("before")).withColumn("host", _lower(F.regexp_replace("before", r"(?s)/.*\z", "")))
    parts = parts.withColumn("path", F.col("before").substr(F.length("host") + 1, F.length("before"))).drop("before")
    return parts.withColumn("tokens", F.array_distinct(F.split(_lower(F.concat("host", "path")), "[^a-z0-9]+")))


def rarest(parts: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """The index: each rule under that of its tokens which the fewest URLs have. Counts cover all URLs."""
    known = sorted({t for r in rules for t in r.tokens})
    at = F.explode(F.filter("tokens", lambda t: t.isin(known)))
    seen = {r.token: r.n for r in parts.select(at.alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(r)
    return index


_RULE = "struct<name:string,verdict:string,regex:string,kind:string>"


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.kind).alias("kind"))


def _decide(fits: Column) -> tuple[Column, Column]:
    """(rule, verdict) from the array of rules that fit."""
    best = F.array_max(F.transform(F.filter(fits, lambda r: r["kind"] == "list"), lambda r: F.struct(F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    bad = F.exists(fits, lambda r: (r["kind"] == "pattern") & (r["verdict"] == BLOCK))
    return best["name"], F.coalesce(best["verdict"], F.when(bad, BLOCK).otherwise(ALLOW))


def judge(pages: DataFrame, rules: list[Rule], inline: int = INLINE) -> DataFrame:
    """page_id, host, path, rule (of the list, or null), verdict, and the pattern rules that fit (`patterns`)."""
    parts = with_parts(pages)
    index = rarest(parts, rules)
    subject = F.concat("host", "path")
    if len(rules) <= inline:
        pairs = [c for t, rs in sorted(index.items()) for c in (F.lit(t), F.array(*map(_struct, rs)))]
        lookup = F.create_map(*pairs)
        found = F.flatten(F.transform(F.filter("tokens", lambda t: t.isin(sorted(index))), lambda t: lookup[t]))
        fits = parts.select("page_id", "host", "path", F.filter(found, lambda r: F.regexp_like(subject, r["regex"])).alias("fits"))
    else:
        spark = pages.sparkSession
        rows = spark.createDataFrame([(t, r.name, r.verdict, r.regex, r.kind) for t, rs in index.items() for r in rs], "token string, name string, verdict string, regex string, kind string")
        keyed = parts.withColumn("row", F.monotonically_increasing_id())
        hits = keyed.select("row", subject.alias("subject"), F.explode("tokens").alias("token")).join(rows, "token").filter(F.regexp_like("subject", F.col("regex")))
        hits = hits.groupBy("row").agg(F.collect_list(F.struct("name", "verdict", "regex", "kind")).alias("fits"))
        fits = keyed.join(hits, "row", "left").select("page_id", "host", "path", F.coalesce("fits", F.array().cast(f"array<{_RULE}>")).alias("fits"))
    rule, verdict = _decide(F.col("fits"))
    names = F.array_join(F.array_sort(F.transform(F.filter("fits", lambda r: r["kind"] == "pattern"), lambda r: r["name"])), ",")
    return fits.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), names.alias("patterns"))


#: The contract's rules.
CONTRACT = [
    listed(ALLOW, "com/"),
    listed(BLOCK, "example.com/en/"),
    listed(ALLOW, "www.example.com/en/"),
    listed(BLOCK, "net/es/"),
    listed(BLOCK, "net/fr/"),
]

SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(substr(url, instr(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u
), r(rule, verdict, rhost, rpath) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
), m AS (
  SELECT p.page_id, p.host, p.path,
    array_to_string(list_sort(list_filter([
      CASE WHEN regexp_matches(p.host, '(^|[.-])casino-win($|[.:-])') THEN 'casino-win' END,
      CASE WHEN regexp_matches(p.host, '(^|[.-])free-bets($|[.:-])') THEN 'free-bets' END,
      CASE WHEN regexp_matches(p.host, '(^|[.-])cheap-pills($|[.:-])') THEN 'cheap-pills' END,
      CASE WHEN regexp_matches(p.host, '(^|[.-])ads-track($|[.:-])') THEN 'ads-track' END,
      CASE WHEN regexp_matches(p.host, '(^|[.-])doubleclick($|[.:-])') THEN 'doubleclick' END,
      CASE WHEN regexp_matches(p.host, '(^|[.-])porn($|[.:-])') THEN 'porn' END,
      CASE WHEN regexp_matches(p.path, '^/(.*/)?wp-login([/.]|$)') THEN '/wp-login/' END,
      CASE WHEN regexp_matches(p.path, '^/(.*/)?affiliate([/.]|$)') THEN '/affiliate/' END], lambda x: x IS NOT NULL)), ',') AS patterns
  FROM p
)
SELECT m.page_id, m.host, m.path, best.rule, coalesce(best.verdict, CASE WHEN m.patterns <> '' THEN 'block' ELSE 'allow' END) AS verdict, m.patterns
FROM m LEFT JOIN best ON m.page_id IS NOT DISTINCT FROM best.page_id AND m.host = best.host AND m.path = best.path
"""
