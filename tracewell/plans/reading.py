"""Queries of the read layer: searches with filters, counts and pages, displays of traces, and the blind test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import reads as RE

from .registry import LINKS, RINGS, ROLES, TX, case_of, query, rounded, tx_of
from .tracing import _payers, _sql, _traced

_NO = "(['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST({0} % 5 + 1 AS INT)]"
_CATEGORY = "split_part(split_part(narration, '/', 2), '#', 1)"
_WHERE = f"amount_paise BETWEEN 3000 AND 2000000 AND ({_NO.format('src')} = 'HDFC' OR {_NO.format('dst')} = 'HDFC') AND mode = 'UPI'"
_FILTERS = {"min_amount_paise": 3000, "max_amount_paise": 2_000_000, "bank": "HDFC", "mode": "upi"}


@query(f"""WITH {LINKS} SELECT tx_key, tx_id, src, dst, {_NO.format("src")} AS src_bank, {_NO.format("dst")} AS dst_bank, t.amount_paise, ts_sec, mode, {_CATEGORY} AS category, device, ip, link_type
  FROM tx t LEFT JOIN links USING (tx_key) WHERE {_WHERE.replace("amount_paise", "t.amount_paise")} ORDER BY ts_sec DESC, t.amount_paise DESC, tx_id, tx_key LIMIT 40 OFFSET 20""")
def search_page(spark, sf_dir):
    """The second page of transfers that match four filters."""
    c = case_of(spark, sf_dir)
    return RE.search(c.tx, c.links, 40, 20, **_FILTERS)[0]


@query(f"WITH {TX} SELECT count(*) AS n, CAST(coalesce(sum(amount_paise), 0) AS BIGINT) AS amount_paise FROM tx WHERE {_WHERE}")
def search_count(spark, sf_dir):
    tx = tx_of(spark, sf_dir)
    return RE.search(tx, tx.select("tx_key", F.lit(None).cast("string").alias("link_type")), **_FILTERS)[1]


@query(f"""WITH {TX} SELECT tx_key FROM tx WHERE foreign_ip AND lower(device) = 'linux_script' AND {_CATEGORY} = 'P2A' AND ts_sec BETWEEN 1704900000 AND 1705900000""")
def search_suspicious(spark, sf_dir):
    found = RE.matching(tx_of(spark, sf_dir), foreign_ip=True, device="LINUX_SCRIPT", category="p2a", from_ts=1_704_900_000, to_ts=1_705_900_000)
    return found.select("tx_key")


@query(f"""WITH RECURSIVE {RINGS}, m AS (SELECT acct, {_NO.format("acct")} AS bank, role, final_index, band, freeze_recommended, holding_paise FROM roles WHERE is_flagged AND final_index >= 70),
  f AS (SELECT acct, coalesce(CAST(sum(amount_paise) FILTER (is_in) AS BIGINT), 0) AS in_paise, coalesce(CAST(sum(amount_paise) FILTER (NOT is_in) AS BIGINT), 0) AS out_paise, count(DISTINCT cp) FILTER (is_in) AS senders, count(DISTINCT cp) FILTER (NOT is_in) AS receivers FROM side GROUP BY acct)
  SELECT acct, bank, role, round(final_index, 6) AS final_index, band, freeze_recommended, holding_paise, in_paise, out_paise, senders, receivers, coalesce(n, 0) AS cells
  FROM m JOIN f USING (acct) LEFT JOIN (SELECT acct, count(*) AS n FROM cm GROUP BY acct) USING (acct) WHERE in_paise >= 1000000 ORDER BY m.final_index DESC, acct LIMIT 25""")
def mules_page(spark, sf_dir):
    """Flagged accounts above an index and an amount, the first page."""
    c = case_of(spark, sf_dir)
    return rounded(RE.mules(c.roles, c.tx, c.cell_members, 25, min_final=70, min_in_paise=1_000_000)[0])


@query(_sql(f"""SELECT victim, hop, tx_key, from_acct, to_acct, amount_paise, hop <= 2 AND amount_paise >= 1000000 AND ({_NO.format("from_acct")} = 'ICIC' OR {_NO.format("to_acct")} = 'ICIC') AND contains(lower(narration), 'task') AS is_shown
  FROM flow JOIN (SELECT tx_key, narration FROM tx) USING (tx_key)"""))
def trace_display(spark, sf_dir):
    """Traces with the transfers that a display's filters leave visible."""
    c = case_of(spark, sf_dir)
    return RE.shown(_traced(c), c.tx, hop=2, min_amount_paise=1_000_000, bank="ICIC", keyword="Task")


@query(_sql("""SELECT a.victim, a.acct, d.device, i.ip FROM (SELECT DISTINCT victim, from_acct AS acct FROM flow) a
  LEFT JOIN (SELECT victim, acct, device FROM (SELECT victim, from_acct AS acct, device, row_number() OVER (PARTITION BY victim, from_acct ORDER BY count(*) DESC, min(flow.ts_sec), min(hop), min(tx_key)) AS r FROM flow JOIN (SELECT tx_key, device FROM tx) USING (tx_key) WHERE device IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1) d USING (victim, acct)
  LEFT JOIN (SELECT victim, acct, ip FROM (SELECT victim, from_acct AS acct, ip, row_number() OVER (PARTITION BY victim, from_acct ORDER BY count(*) DESC, min(flow.ts_sec), min(hop), min(tx_key)) AS r FROM flow JOIN (SELECT tx_key, ip FROM tx) USING (tx_key) WHERE ip IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1) i USING (victim, acct)"""))
def trace_usual(spark, sf_dir):
    """The usual device and address of every account in a trace."""
    c = case_of(spark, sf_dir)
    return RE.usual(_traced(c), c.tx)


@query(_sql("""SELECT acct AS victim, coalesce(ma, 0) + coalesce(la, 0) + coalesce(mt, 0) + coalesce(lt, 0) = 0 AS correct, coalesce(na, 0) AS accounts, coalesce(wa, 0) AS accounts_expected, coalesce(nt, 0) AS transfers, coalesce(wt, 0) AS transfers_expected, coalesce(ma, 0) AS only_in_trace, coalesce(la, 0) AS only_in_chain
  FROM payer LEFT JOIN (SELECT victim AS acct, count(a) AS na, count(b) AS wa, count(*) FILTER (b IS NULL) AS ma, count(*) FILTER (a IS NULL) AS la FROM (SELECT DISTINCT victim, to_acct AS x, 1 AS a FROM flow) FULL JOIN (SELECT DISTINCT victim, dst AS x, 1 AS b FROM ch) USING (victim, x) GROUP BY 1) USING (acct)
  LEFT JOIN (SELECT victim AS acct, count(a) AS nt, count(b) AS wt, count(*) FILTER (b IS NULL) AS mt, count(*) FILTER (a IS NULL) AS lt FROM (SELECT DISTINCT victim, tx_key AS x, 1 AS a FROM flow) FULL JOIN (SELECT DISTINCT victim, tx_key AS x, 1 AS b FROM ch) USING (victim, x) GROUP BY 1) USING (acct)""",
  f"""{_sql("").replace("WITH RECURSIVE ", "", 1)},
  k1 AS (SELECT src AS victim, tx_key, dst, ts_sec FROM tx WHERE src IN (SELECT acct FROM payer)),
  k2 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM k1 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 180 AND 900),
  k3 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM k2 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 0 AND 3600),
  k4 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM k3 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 0 AND 3600),
  ch AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4)"""))
def blind_test(spark, sf_dir):
    """Traces against the structural chain, payer by payer."""
    c = case_of(spark, sf_dir)
    return RE.blind_test(_traced(c), c.tx, _payers(c), c.profile)
