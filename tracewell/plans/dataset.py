"""Queries over narrations, the spread of scores, single paths of money, and files byte for byte."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions.cut import shared_folder
from tracewell.operators import narration as NA
from tracewell.operators import paths as PA
from tracewell.operators import trace as TR
from tracewell.sources import raw_file as RF
from tracewell.sources import transfers as T

from .registry import FEAT, ROLES, TX, case_of, query, rounded, tx_of
from .tracing import PAYERS

_NO = "(['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST({0} % 5 + 1 AS INT)] || lpad(CAST({0} AS VARCHAR), 8, '0')"
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query(rf"""WITH {TX} SELECT CASE WHEN coalesce(trim(narration), '') = '' THEN 'empty' WHEN regexp_full_match(narration, '(UPI|IMPS|NEFT|RTGS)/[^/]+/[^#]+#[0-9]+') THEN 'hash' WHEN regexp_full_match(narration, '(UPI|IMPS|NEFT)/[^/]+/.+_[0-9]+', 's') THEN 'underscore'
  WHEN regexp_full_match(narration, '(UPI|IMPS|NEFT|RTGS)/[^/]+/.+', 's') THEN 'three_parts' ELSE 'other' END AS shape, count(*) AS n, count(DISTINCT src) AS senders FROM tx GROUP BY 1""")
def narration_shapes(spark, sf_dir):
    return NA.shapes(tx_of(spark, sf_dir))


def _words_sql(words: list[str]) -> str:
    return f"WITH {TX} SELECT word, count(tx_key) AS n, count(DISTINCT src) AS senders, count(*) FILTER (layering) AS n_layering FROM (SELECT unnest([{_quoted(words)}]) AS word) LEFT JOIN tx ON contains(lower(narration), word) GROUP BY word"


@query(_words_sql(NA.KEYWORDS))
def narration_keywords(spark, sf_dir):
    return NA.words(tx_of(spark, sf_dir), NA.KEYWORDS)


@query(_words_sql(NA.INJECTION_WORDS + NA.INJECTION_SIGNS))
def narration_injections(spark, sf_dir):
    """Narrations that address a reader's tools: they are text to be kept from them, not labels."""
    return NA.words(tx_of(spark, sf_dir), NA.INJECTION_WORDS + NA.INJECTION_SIGNS)


@query(rf"""WITH {TX} SELECT min(length(narration)) AS shortest, round(quantile_cont(length(narration), 0.5), 6) AS middle, round(quantile_cont(length(narration), 0.99), 6) AS p99, max(length(narration)) AS longest, count(*) FILTER (length(narration) > 200) AS n_long,
  count(*) FILTER (regexp_matches(narration, '[^\x00-\x7F]')) AS n_non_ascii, count(*) FILTER ({" OR ".join(f"contains(narration, chr({c}))" for c in NA.ZERO_WIDTH)}) AS n_zero_width FROM tx""")
def narration_characters(spark, sf_dir):
    return rounded(NA.characters(tx_of(spark, sf_dir)))


@query(f"""WITH {TX}, t AS (SELECT {_NO.format("src")} AS src_no, {_NO.format("dst")} AS dst_no, unnest(regexp_extract_all(narration, '{NA.ACCOUNT}')) AS token FROM tx)
  SELECT token, count(*) AS n, count(*) FILTER (token <> src_no AND token <> dst_no) AS n_decoys, token IN (SELECT {_NO.format("acct")} FROM side) AS is_known FROM t GROUP BY token""")
def narration_accounts(spark, sf_dir):
    """Account numbers that narrations name, and whether they are decoys: of other accounts than the transfer's."""
    tx = tx_of(spark, sf_dir)
    rows = tx.select("narration", T.account_number(F.col("src")).alias("src_no"), T.account_number(F.col("dst")).alias("dst_no"))
    return NA.account_tokens(rows, T.accounts(tx))


@query(f"WITH {TX} SELECT left(token, 4) AS bank, count(*) AS n FROM (SELECT unnest(regexp_extract_all(narration, '{NA.BRANCH}')) AS token FROM tx) GROUP BY 1")
def narration_branches(spark, sf_dir):
    return NA.branch_tokens(tx_of(spark, sf_dir))


@query(f"""WITH {TX}, r AS (SELECT tx_id, regexp_extract(narration, '[#_]([0-9]+)$', 1) AS ref FROM tx)
  SELECT count(*) AS n_references, count(DISTINCT ref) AS n_distinct, (SELECT count(*) FROM (SELECT ref FROM r WHERE ref <> '' GROUP BY ref HAVING count(*) > 1)) AS n_repeated,
    count(*) FILTER ('TXN' || ref = tx_id) AS n_own_id, count(*) FILTER ('TXN' || ref IN (SELECT tx_id FROM tx)) AS n_any_id FROM r WHERE ref <> ''""")
def narration_references(spark, sf_dir):
    return NA.references(tx_of(spark, sf_dir))


@query(f"""WITH {TX} SELECT coalesce(nullif(split_part(split_part(narration, '/', 2), '#', 1), ''), '-') AS category, count(*) AS n, count(DISTINCT src) AS senders, count(*) FILTER (headless) AS n_headless,
  count(*) FILTER (foreign_ip) AS n_foreign, count(*) FILTER (headless AND foreign_ip) AS n_both FROM tx GROUP BY 1""")
def narration_categories(spark, sf_dir):
    return NA.categories(tx_of(spark, sf_dir))


_GROUPS = "CASE WHEN is_send_only THEN 'payer' WHEN is_receive_only THEN 'sink' ELSE 'middle' END"


def _grouped(c):
    kind = F.when(F.col("is_send_only"), "payer").when(F.col("is_receive_only"), "sink").otherwise("middle")
    return c.roles.select("acct", "final_index", "is_flagged", kind.alias("grp"))


@query(f"""WITH {ROLES}, g AS (SELECT {_GROUPS} AS grp, final_index AS x, is_flagged FROM roles) SELECT grp, count(*) AS n, count(x) AS n_scored, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS middle, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS high,
  count(*) FILTER (is_flagged) AS n_flagged, count(*) FILTER (abs(x - 65) <= 5 AND NOT is_flagged) AS n_near_not_flagged, count(*) FILTER (abs(x - 65) <= 5 AND is_flagged) AS n_near_flagged FROM g GROUP BY grp""")
def score_spread(spark, sf_dir):
    """How the final index is spread over the kinds of accounts, and who is near the threshold."""
    c = case_of(spark, sf_dir)
    return rounded(PA.spread(_grouped(c), "grp", "final_index", c.profile["flag"]["threshold"], 5.0))


@query(f"""WITH {ROLES}, g AS (SELECT {_GROUPS} AS grp, final_index AS x FROM roles), r AS (SELECT grp, min(x) AS lo, max(x) AS hi FROM g GROUP BY grp)
  SELECT a.grp AS a, b.grp AS b, round(greatest(a.lo, b.lo), 6) AS low, round(least(a.hi, b.hi), 6) AS high, (SELECT count(*) FROM g WHERE g.grp = a.grp AND x BETWEEN greatest(a.lo, b.lo) AND least(a.hi, b.hi)) AS n_a,
    (SELECT count(*) FROM g WHERE g.grp = b.grp AND x BETWEEN greatest(a.lo, b.lo) AND least(a.hi, b.hi)) AS n_b FROM r a JOIN r b ON a.grp < b.grp AND greatest(a.lo, b.lo) <= least(a.hi, b.hi)""")
def score_overlaps(spark, sf_dir):
    return rounded(PA.overlaps(_grouped(case_of(spark, sf_dir)), "grp", "final_index"))


def _path_sql(hop: int) -> str:
    return f"""p{hop} AS (SELECT start, {hop} AS hop, tx_key, src, dst, amount_paise, ts_sec, lag_s, met FROM (
    SELECT p.start, t.tx_key, t.src, t.dst, t.amount_paise, t.ts_sec, t.ts_sec - p.ts_sec AS lag_s, list_append(p.met, t.dst) AS met,
      row_number() OVER (PARTITION BY p.start ORDER BY t.dst IN (SELECT src FROM tx WHERE layering) DESC, t.dst IN (SELECT acct FROM feat WHERE is_receive_only) DESC, t.amount_paise DESC, t.tx_key) AS r
    FROM p{hop - 1} p JOIN tx t ON t.src = p.dst AND t.ts_sec - p.ts_sec BETWEEN 0 AND 3600 AND NOT list_contains(p.met, t.dst)) WHERE r = 1)"""


@query(f"""WITH {FEAT}, p1 AS (SELECT tx_key AS start, 1 AS hop, tx_key, src, dst, amount_paise, ts_sec, CAST(NULL AS BIGINT) AS lag_s, [src, dst] AS met FROM tx WHERE src IN ({PAYERS})), {_path_sql(2)}, {_path_sql(3)}, {_path_sql(4)}
  SELECT start, hop, tx_key, src AS from_acct, dst AS to_acct, amount_paise, lag_s FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)""")
def payment_paths(spark, sf_dir):
    """One path of money from each payment of a payer."""
    c = case_of(spark, sf_dir)
    payments = c.tx.join(c.features.filter("is_send_only and n_out <= 3").select(F.col("acct").alias("src")), "src", "left_semi")
    return PA.greedy_paths(c.tx, payments, c.features.filter("is_receive_only"))


@query(f"""WITH {ROLES}, h1 AS (SELECT src AS victim, tx_key, dst, ts_sec FROM tx WHERE src IN ({PAYERS})),
  h2 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM h1 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 180 AND 900),
  h3 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM h2 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 0 AND 3600),
  h4 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM h3 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 0 AND 3600),
  ch AS (SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3 UNION ALL SELECT 4, * FROM h4)
  SELECT hop, coalesce(role, '-') AS role, count(DISTINCT ch.tx_key) AS n_transfers, count(DISTINCT dst) AS n_accounts, count(DISTINCT victim) AS n_payers, count(DISTINCT ch.tx_key) FILTER (layering) AS n_layering
  FROM ch JOIN roles ON acct = dst JOIN (SELECT tx_key, layering FROM tx) USING (tx_key) GROUP BY ALL""")
def chain_roles(spark, sf_dir):
    """Where the payers' money is at each hop of the structural chain, by the role that scoring gives its receivers."""
    c = case_of(spark, sf_dir)
    chain = TR.structural_chain(c.tx, c.features.filter("is_send_only and n_out <= 3").select("acct"), c.profile)
    rows = chain.join(c.tx.select("tx_key", F.col("dst").alias("acct"), "is_layering"), "tx_key").join(c.roles.select("acct", F.coalesce("role", F.lit("-")).alias("role")), "acct")
    return rows.groupBy("hop", "role").agg(F.countDistinct("tx_key").alias("n_transfers"), F.countDistinct("acct").alias("n_accounts"), F.countDistinct("victim").alias("n_payers"), F.countDistinct(F.when(F.col("is_layering"), F.col("tx_key"))).alias("n_layering"))


@query("""WITH p AS (SELECT unnest([CAST(page_id AS VARCHAR), coalesce(url, ''), coalesce(html, '')]) AS t FROM pages),
  whole AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, count(*) AS n FROM pages GROUP BY 1, 2, 3),
  s AS (SELECT CAST(sum(octet_length(encode(t))) AS BIGINT) AS octets, CAST(sum(length(t) - length(replace(t, '"', ''))) AS BIGINT) AS quotes, CAST(sum(length(t) - length(replace(t, chr(10), ''))) AS BIGINT) AS ends,
    CAST(sum(octet_length(encode(t)) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))) AS BIGINT) AS wide FROM p)
  SELECT octets + quotes + 9 * n AS n_bytes, 0 AS n_marked, n + ends AS n_lines, 0 AS n_crlf, n + ends AS n_lf, 0 AS n_lone_cr, 0 AS n_open_ends, 2 * quotes + 6 * n AS n_quotes, wide AS n_non_ascii, 0 AS n_control, 0 AS n_invalid, n AS n_records, 0 AS n_wrong_fields, 0 AS n_wrong_headers,
    (SELECT count(*) FROM whole WHERE n > 1) AS n_repeated, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM whole WHERE n > 1) AS n_in_repeats FROM s, (SELECT count(*) AS n FROM pages)""")
def file_bytes(spark, sf_dir):
    """Pages written as delimited text, every field quoted, and that text read byte for byte."""
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(*(text(c).alias(c) for c in ("page_id", "url", "html")))
    pages.write.option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    return RF.check(spark, path, 3).drop("n_files")
