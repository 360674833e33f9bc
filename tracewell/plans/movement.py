"""Registered queries on the movement of money and on accounts: funnel hops, dataset checks, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import audit as A
from tracewell.operators import checks as C
from tracewell.sources import transfers as T

from .registry import ROLES, TX, case_of, query, rounded, tx_of

_GROUPS = f"""{TX}, deg AS (SELECT acct, count(*) FILTER (is_in) AS n_in, count(*) FILTER (NOT is_in) AS n_out,
    sum(amount_paise) FILTER (is_in) AS a_in, coalesce(sum(amount_paise) FILTER (NOT is_in), 0) AS a_out FROM side GROUP BY acct),
  send_only AS (SELECT acct FROM deg WHERE n_in = 0), receive_only AS (SELECT acct FROM deg WHERE n_out = 0),
  payees AS (SELECT DISTINCT dst AS acct FROM tx WHERE src IN (FROM send_only)),
  next_hop AS (SELECT DISTINCT dst AS acct FROM tx WHERE src IN (FROM payees) AND dst NOT IN (FROM payees))"""


def _hop_sql(hop: int, a: str, b: str) -> str:
    return f"""SELECT * FROM (SELECT CAST({hop} AS INT) AS hop, count(*) FILTER (dst IN (FROM {b})) AS n_transfers, count(*) FILTER (dst NOT IN (FROM {b})) AS n_elsewhere,
    count(DISTINCT dst) FILTER (dst IN (FROM {b})) AS n_receivers FROM tx WHERE src IN (FROM {a}) HAVING count(*) > 0),
  (SELECT count(wait) AS n_with_arrival, min(wait) AS wait_min_s, max(wait) AS wait_max_s, round(median(wait), 6) AS wait_median_s FROM
    (SELECT h.ts_sec - (SELECT max(i.ts_sec) FROM tx i WHERE i.dst = h.src AND i.ts_sec <= h.ts_sec) AS wait FROM tx h WHERE h.src IN (FROM {a}) AND h.dst IN (FROM {b}))),
  (SELECT count(*) AS n_senders, max(r) AS receivers_max, round(median(r), 6) AS receivers_median, round(quantile_cont(q, 0.25), 6) AS out_in_q1,
    round(median(q), 6) AS out_in_median, round(quantile_cont(q, 0.75), 6) AS out_in_q3 FROM
    (SELECT count(DISTINCT dst) AS r, any_value(round(CAST(a_out AS DOUBLE) / nullif(a_in, 0), 6)) AS q FROM tx JOIN deg ON acct = src WHERE src IN (FROM {a}) AND dst IN (FROM {b}) GROUP BY src))"""


@query(f"WITH {_GROUPS} " + " UNION ALL BY NAME ".join(_hop_sql(i, a, b) for i, (a, b) in enumerate(C.HOPS, 1)))
def funnel_hops(spark, sf_dir):
    return rounded(C.funnel_hops(tx_of(spark, sf_dir)))


@query(f"""WITH {TX}, a AS (SELECT DISTINCT (['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST(acct % 5 + 1 AS INT)] || lpad(CAST(acct AS VARCHAR), 8, '0') AS acct_no FROM side)
  SELECT x.acct_no, count(*) AS n_lookalikes FROM a x JOIN a y ON x.acct_no[1:4] = y.acct_no[1:4] AND hamming(x.acct_no, y.acct_no) = 1 GROUP BY 1""")
def trap_lookalike_accounts(spark, sf_dir):
    return C.lookalikes(T.accounts(tx_of(spark, sf_dir)))


@query(f"""WITH {TX}, lim(limit_rupees) AS (VALUES {', '.join(f'({x})' for x in C.LIMITS)})
  SELECT CAST(limit_rupees AS INT) AS limit_rupees, count(*) FILTER (amount_paise <= limit_rupees * 100) AS n_below, count(*) FILTER (amount_paise > limit_rupees * 100) AS n_above,
  count(DISTINCT src) FILTER (amount_paise <= limit_rupees * 100) AS senders_below FROM lim LEFT JOIN tx ON amount_paise BETWEEN limit_rupees * 99 AND limit_rupees * 101 GROUP BY 1""")
def trap_just_below_limit(spark, sf_dir):
    return C.at_limits(tx_of(spark, sf_dir))


@query(f"""WITH {TX}, p AS (SELECT i.dst AS acct, i.tx_key, any_value(i.amount_paise) AS a, sum(o.amount_paise) AS l FROM tx i JOIN tx o ON o.src = i.dst AND o.ts_sec - i.ts_sec BETWEEN 0 AND 3600 GROUP BY 1, 2)
  SELECT acct, count(*) AS n_inflows, count(*) FILTER (l * 100 BETWEEN a * 95 AND a * 99) AS n_band FROM p GROUP BY acct""")
def trap_commission_60m(spark, sf_dir):
    return C.hourly_fee(tx_of(spark, sf_dir))


@query(f"""WITH {TX}, d AS (SELECT CAST(substr(CAST(amount_paise AS VARCHAR), 1, 1) AS INT) AS digit, count(*) AS n FROM tx GROUP BY 1)
  SELECT digit, n, round(n / sum(n) OVER (), 6) AS share, round(log10(1 + 1 / digit), 6) AS expected FROM d""")
def trap_benford(spark, sf_dir):
    return rounded(A.first_digits(tx_of(spark, sf_dir), "amount_paise"))


@query(f"WITH {ROLES} SELECT acct, role, role_confirmed, band, holding_paise FROM roles WHERE freeze_recommended")
def freeze_list(spark, sf_dir):
    return case_of(spark, sf_dir).roles.filter("freeze_recommended").select("acct", "role", "role_confirmed", "band", "holding_paise")


@query(f"""WITH {ROLES} SELECT r.acct, role, is_flagged, band, round(final_index, 6) AS final_index, freeze_recommended,
  CAST(coalesce(sum(amount_paise) FILTER (is_in), 0) AS BIGINT) AS in_paise, CAST(coalesce(sum(amount_paise) FILTER (NOT is_in), 0) AS BIGINT) AS out_paise FROM roles r JOIN side ON side.acct = r.acct GROUP BY ALL""")
def list_entities(spark, sf_dir):
    c = case_of(spark, sf_dir)
    amount = lambda x: F.sum(F.when(x, F.col("amount_paise")).otherwise(0))
    money = T.sides(c.tx).groupBy("acct").agg(amount(F.col("is_in")).alias("in_paise"), amount(~F.col("is_in")).alias("out_paise"))
    return rounded(c.roles.select("acct", "role", "is_flagged", "band", "final_index", "freeze_recommended").join(money, "acct"))
