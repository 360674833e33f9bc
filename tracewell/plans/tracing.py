"""Queries over the traces of all payers, with SQL that follows the money by its own means: joins of all with all, and a
recursion over each account's events for the pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import findings as FI
from tracewell.operators import trace as TR

from .registry import _RING, RINGS, ROLES, case_of, query, rounded

PAYERS = "SELECT acct FROM feat WHERE is_send_only AND n_out <= 3"

_EDGES = f"""
payer AS ({PAYERS}),
middle AS (SELECT median(amount_paise) AS m FROM tx),
mover AS (SELECT DISTINCT o.tx_key FROM tx o JOIN tx q ON q.src = o.dst AND q.ts_sec - o.ts_sec BETWEEN 0 AND 3600),
onward AS (
  SELECT p.tx_key, coalesce(sum(o.amount_paise), 0) AS sent, coalesce(sum(o.amount_paise) FILTER (o.tx_key IN (SELECT tx_key FROM mover)), 0) AS again
  FROM tx p LEFT JOIN tx o ON o.src = p.dst AND o.ts_sec - p.ts_sec BETWEEN 0 AND 3600 WHERE p.src IN (SELECT acct FROM payer) GROUP BY p.tx_key),
part AS (
  SELECT p.tx_key, p.src, least(1.0, sent / p.amount_paise) AS onward, CASE WHEN sent > 0 THEN again / sent ELSE 0.0 END AS downstream,
    NOT EXISTS (SELECT 1 FROM tx e WHERE e.src = p.src AND e.dst = p.dst AND e.ts_sec < p.ts_sec) AS first_time,
    CASE WHEN p.amount_paise / m >= 20 THEN 1.0 WHEN p.amount_paise / m >= 5 THEN 0.5 ELSE 0.0 END AS anomaly, 0.0 AS burst, p.layering
  FROM tx p JOIN onward USING (tx_key), middle),
edge AS (
  SELECT *, round(40 * onward + 20 * burst + CASE WHEN first_time THEN 15 * anomaly ELSE 0 END + 15 * downstream + CASE WHEN layering THEN 10 ELSE 0 END, 2) AS edge_score FROM part)"""


def _hop_sql(h: int) -> str:
    """The CTEs of one further hop: arrivals, choice, the accounts' events, the pool event by event, the transfers."""
    return f"""
a{h} AS (SELECT victim, to_acct AS acct, ts_sec AS came, tainted, tx_key AS in_key FROM r{h - 1} WHERE NOT untraced AND to_acct NOT IN (SELECT acct FROM feat WHERE is_receive_only)),
n{h} AS (
  SELECT a.victim, a.acct, o.tx_key AS out_key, o.amount_paise, o.is_flagged, o.final_index, any_value(sender) AS sender,
    bool_or(o.linked AND CASE sender WHEN 'L1' THEN o.ts_sec - a.came BETWEEN 180 AND 900 ELSE sender IS NOT NULL END) AS proven
  FROM a{h} a LEFT JOIN sending ON sending.acct = a.acct JOIN outs o ON o.src = a.acct AND o.ts_sec - a.came BETWEEN 0 AND 3600
  GROUP BY a.victim, a.acct, o.tx_key, o.amount_paise, o.is_flagged, o.final_index),
h{h} AS (SELECT victim, acct, min(came) AS t0, max(came) AS t1, sum(tainted) AS held FROM a{h} GROUP BY victim, acct),
c{h} AS (
  SELECT n.*, t0, t1, bool_or(proven) OVER own AS any_link, 0.9 * (held - sum(CASE WHEN is_flagged THEN amount_paise ELSE 0 END) OVER own) AS target,
    coalesce(sum(amount_paise) OVER (PARTITION BY victim, acct ORDER BY is_flagged, final_index DESC, amount_paise DESC, out_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM n{h} n JOIN h{h} USING (victim, acct) WINDOW own AS (PARTITION BY victim, acct)),
f{h} AS (SELECT *, CASE WHEN any_link THEN proven ELSE is_flagged OR (target > 0 AND before < target) END AS follow FROM c{h}),
g{h} AS (SELECT victim, acct, any_link, t0, t1 + CASE WHEN any_link AND max(sender) = 'L1' THEN 900 ELSE 3600 END AS t2 FROM f{h} GROUP BY victim, acct, any_link, t0, t1),
e{h} AS (
  SELECT g.victim, g.acct, x.tx_key, x.kind, x.amount_paise, coalesce(a.tainted, 0) AS brings,
    row_number() OVER (PARTITION BY g.victim, g.acct ORDER BY x.ts_sec, x.kind, x.amount_paise, x.tx_key) AS k
  FROM g{h} g JOIN move x ON x.acct = g.acct AND x.ts_sec BETWEEN t0 AND t2 LEFT JOIN a{h} a ON a.victim = g.victim AND a.acct = g.acct AND a.in_key = x.tx_key AND x.kind = 0),
w{h}(victim, acct, k, pool, taint, carried) AS (
  SELECT victim, acct, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM g{h}
  UNION ALL
  SELECT w.victim, w.acct, e.k, CASE WHEN kind = 0 THEN pool + amount_paise ELSE pool - least(amount_paise, pool) END,
    CASE WHEN kind = 0 THEN taint + brings WHEN pool > 0 THEN taint - least(amount_paise, pool) * taint / pool ELSE taint END,
    CASE WHEN kind = 1 AND pool > 0 THEN least(amount_paise, pool) * taint / pool ELSE 0 END
  FROM w{h} w JOIN e{h} e ON e.victim = w.victim AND e.acct = w.acct AND e.k = w.k + 1),
r{h} AS (
  SELECT w.victim, {h} AS hop, e.tx_key, w.acct AS from_acct, tx.dst AS to_acct, tx.ts_sec, tx.amount_paise, carried AS tainted,
    CASE WHEN g.any_link THEN 'layer_link' ELSE 'fallback' END AS via, NOT coalesce(f.follow, false) OR carried < 0.5 AS untraced, CAST(NULL AS DOUBLE) AS edge_score
  FROM w{h} w JOIN e{h} e USING (victim, acct, k) JOIN tx USING (tx_key) JOIN g{h} g ON g.victim = w.victim AND g.acct = w.acct
  LEFT JOIN f{h} f ON f.victim = w.victim AND f.acct = w.acct AND f.out_key = e.tx_key WHERE e.kind = 1 AND carried > 1e-6)"""


_TRACE = f"""{_EDGES},
outs AS (SELECT tx.*, links.tx_key IS NOT NULL AS linked, is_flagged, final_index FROM tx LEFT JOIN links ON links.tx_key = tx.tx_key JOIN roles ON roles.acct = tx.dst),
sending AS (SELECT from_acct AS acct, min(from_role) AS sender FROM links WHERE from_role IN ('L1', 'L2') GROUP BY from_acct),
move AS (SELECT dst AS acct, tx_key, ts_sec, amount_paise, 0 AS kind FROM tx UNION ALL SELECT src, tx_key, ts_sec, amount_paise, 1 FROM tx),
paid AS (SELECT outs.*, edge_score, bool_or(linked) OVER own AS any_link, bool_or(is_flagged) OVER own AS any_flag, max(edge_score) OVER own AS best FROM outs JOIN edge USING (tx_key) WINDOW own AS (PARTITION BY outs.src)),
r1 AS (
  SELECT src AS victim, 1 AS hop, tx_key, src AS from_acct, dst AS to_acct, ts_sec, amount_paise, CAST(amount_paise AS DOUBLE) AS tainted,
    CASE WHEN linked THEN 'layer_link' ELSE 'fallback' END AS via, false AS untraced, CASE WHEN NOT any_link AND NOT any_flag THEN edge_score END AS edge_score
  FROM paid WHERE CASE WHEN any_link THEN linked WHEN any_flag THEN is_flagged ELSE edge_score = best AND edge_score > 0 END),
{_hop_sql(2)},{_hop_sql(3)},{_hop_sql(4)},
traced AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4),
flow AS (SELECT * FROM traced WHERE NOT untraced),
t_in AS (SELECT victim, to_acct AS acct, min(hop) AS hop, sum(tainted) AS tin FROM flow GROUP BY victim, to_acct),
t_out AS (SELECT victim, from_acct AS acct, sum(CASE WHEN untraced THEN 0 ELSE tainted END) AS tout, sum(CASE WHEN untraced THEN tainted ELSE 0 END) AS lost FROM traced GROUP BY victim, from_acct),
t_acct AS (
  SELECT victim, acct, hop, CAST(round(tin) AS BIGINT) AS tainted_in, CAST(round(coalesce(tout, 0)) AS BIGINT) AS tainted_out, CAST(round(coalesce(lost, 0)) AS BIGINT) AS untraced_out,
    greatest(CAST(round(tin - coalesce(tout, 0) - coalesce(lost, 0)) AS BIGINT), 0) AS holding
  FROM t_in LEFT JOIN t_out USING (victim, acct)),
t_stop AS (
  SELECT victim, to_acct AS acct, CASE WHEN bool_or(to_acct IN (SELECT acct FROM feat WHERE is_receive_only)) THEN 'receive_only' WHEN max(hop) >= 4 THEN 'max_hops'
      WHEN bool_or(NOT EXISTS (SELECT 1 FROM flow n WHERE n.victim = b.victim AND n.from_acct = b.to_acct AND n.hop = b.hop + 1)) THEN 'no_onward_transfer_in_window' END AS stopped
  FROM (SELECT DISTINCT victim, to_acct, hop FROM flow) b GROUP BY victim, to_acct)"""
TRACE = f"{ROLES}, {_TRACE}"


def _sql(select: str, base: str = TRACE) -> str:
    return f"WITH RECURSIVE {base} {select}"


def _payers(case):
    return case.features.filter("is_send_only and n_out <= 3").select("acct")


def _traced(case):
    if not hasattr(case, "traced"):
        case.traced = TR.trace(case.tx, _payers(case), case.roles, case.links, case.profile)
    return case.traced


def _accounts(case):
    return TR.trace_accounts(_traced(case))


@query(f"WITH RECURSIVE {ROLES}, {_EDGES} SELECT tx_key, round(onward, 6) AS onward, round(downstream, 6) AS downstream, first_time, anomaly, burst, edge_score FROM edge")
def edge_scores(spark, sf_dir):
    """How likely each payment of a payer went to a first-layer account."""
    c = case_of(spark, sf_dir)
    payments = c.tx.join(_payers(c).withColumnRenamed("acct", "src"), "src", "left_semi")
    return rounded(TR.edge_scores(c.tx, c.features, payments, c.profile))


@query(_sql("SELECT * REPLACE (round(tainted, 3) AS tainted) FROM traced"))
def trace_transfers(spark, sf_dir):
    return rounded(_traced(case_of(spark, sf_dir)), 3)


@query(_sql("SELECT t_acct.*, stopped FROM t_acct JOIN t_stop USING (victim, acct)"))
def trace_accounts(spark, sf_dir):
    c = case_of(spark, sf_dir)
    why = FI.stopped(_traced(c), c.features, c.profile["trace"]["max_hops"])
    return _accounts(c).join(why, ["victim", "acct"])


@query(
    _sql("""SELECT acct AS victim, coalesce(paid, 0) AS paid, n_out - coalesce(n_followed, 0) AS n_not_followed, sent - coalesce(paid, 0) AS not_followed, coalesce(transfers, 0) AS transfers, coalesce(hops, 0) AS hops,
    coalesce(accounts, 0) AS accounts, coalesce(holding, 0) AS holding, coalesce(untraced, 0) AS untraced, coalesce(used_fallback, false) AS used_fallback, coalesce(low_confidence, false) AS low_confidence,
    CASE WHEN coalesce(n_followed, 0) = 0 THEN 'no_payment_with_l1_edge_score' END AS stopped
  FROM payer LEFT JOIN (SELECT src AS acct, count(*) AS n_out, CAST(sum(amount_paise) AS BIGINT) AS sent FROM tx GROUP BY src) USING (acct)
  LEFT JOIN (SELECT victim AS acct, count(*) FILTER (hop = 1) AS n_followed, CAST(sum(CASE WHEN hop = 1 THEN amount_paise ELSE 0 END) AS BIGINT) AS paid, count(*) AS transfers, max(hop) AS hops, bool_or(via = 'fallback') AS used_fallback, bool_or(edge_score IS NOT NULL) AS low_confidence FROM flow GROUP BY victim) USING (acct)
  LEFT JOIN (SELECT victim AS acct, count(*) AS accounts, CAST(sum(holding) AS BIGINT) AS holding, CAST(sum(untraced_out) AS BIGINT) AS untraced FROM t_acct GROUP BY victim) USING (acct)""")
)
def trace_payers(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return FI.payers(_traced(c), _accounts(c), _payers(c), c.tx)


@query(
    _sql("""SELECT victim, paid, kept, untraced, paid - kept - untraced AS gap FROM (SELECT victim, CAST(sum(amount_paise) AS BIGINT) AS paid FROM traced WHERE hop = 1 GROUP BY victim)
  JOIN (SELECT victim, CAST(sum(holding) AS BIGINT) AS kept, CAST(sum(untraced_out) AS BIGINT) AS untraced FROM t_acct GROUP BY victim) USING (victim)""")
)
def trace_reconcile(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return TR.reconcile(_traced(c), _accounts(c))


@query(_sql("SELECT hop, count(*) AS n_transfers, count(DISTINCT victim) AS n_victims, count(DISTINCT to_acct) AS n_accounts, CAST(round(sum(tainted)) AS BIGINT) AS tainted FROM flow GROUP BY hop"))
def trace_per_hop(spark, sf_dir):
    return TR.per_hop(_traced(case_of(spark, sf_dir)))


@query(
    _sql("""SELECT victim, hop, coalesce(n_accounts, 0) AS n_accounts, n_transfers, tainted, first_ts, last_ts, first_ts - lag(first_ts) OVER (PARTITION BY victim ORDER BY hop) AS seconds_since
  FROM (SELECT victim, hop, count(*) AS n_transfers, CAST(round(sum(tainted)) AS BIGINT) AS tainted, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM flow GROUP BY victim, hop)
  LEFT JOIN (SELECT victim, hop, count(*) AS n_accounts FROM t_in GROUP BY victim, hop) USING (victim, hop)""")
)
def trace_hops(spark, sf_dir):
    return FI.hops(_traced(case_of(spark, sf_dir)))


_FOUND = f"""{TRACE},
c_rapid AS (SELECT victim, acct FROM t_in JOIN t_out USING (victim, acct) JOIN (SELECT victim, to_acct AS acct, min(ts_sec) AS i FROM flow GROUP BY ALL) USING (victim, acct)
  JOIN (SELECT victim, from_acct AS acct, max(ts_sec) AS o FROM flow GROUP BY ALL) USING (victim, acct) WHERE acct <> victim AND tout >= 0.9 * tin AND o - i BETWEEN 0 AND 3600),
c_split AS (SELECT victim, from_acct AS acct FROM flow WHERE from_acct <> victim GROUP BY ALL HAVING count(DISTINCT to_acct) >= 3),
c_funnel AS (SELECT victim, to_acct AS acct FROM flow WHERE from_acct <> victim GROUP BY ALL HAVING count(DISTINCT from_acct) >= 3),
c_path AS (SELECT x.victim, x.from_acct AS a, x.to_acct AS mid, y.to_acct AS z, x.tx_key AS k1, y.tx_key AS k2 FROM flow x JOIN flow y ON y.victim = x.victim AND y.from_acct = x.to_acct AND y.ts_sec >= x.ts_sec WHERE x.from_acct <> x.victim AND y.from_acct <> y.victim),
c_meet AS (SELECT c_path.* FROM c_path JOIN (SELECT victim, a, z FROM c_path GROUP BY ALL HAVING count(DISTINCT mid) >= 2) USING (victim, a, z)),
c_walk AS (SELECT DISTINCT victim, from_acct AS a, to_acct AS z FROM flow UNION SELECT w.victim, w.a, f.to_acct FROM c_walk w JOIN flow f ON f.victim = w.victim AND f.from_acct = w.z),
c_loop AS (SELECT victim, a AS acct FROM c_walk WHERE a = z),
used AS (
  SELECT 'RAPID_PASS_THROUGH' AS pattern, victim, CAST(acct AS VARCHAR) AS cs, tx_key FROM c_rapid JOIN flow USING (victim) WHERE acct IN (from_acct, to_acct)
  UNION SELECT 'SCATTER', victim, CAST(acct AS VARCHAR), tx_key FROM c_split JOIN flow USING (victim) WHERE acct = from_acct
  UNION SELECT 'FUNNEL', victim, CAST(acct AS VARCHAR), tx_key FROM c_funnel JOIN flow USING (victim) WHERE acct = to_acct AND from_acct <> victim
  UNION SELECT 'SCATTER_GATHER', victim, a || '>' || z, unnest([k1, k2]) FROM c_meet
  UNION SELECT 'CYCLE', victim, 'cycle', tx_key FROM flow WHERE (victim, from_acct) IN (SELECT victim, acct FROM c_loop) AND (victim, to_acct) IN (SELECT victim, acct FROM c_loop)),
people AS (
  SELECT 'RAPID_PASS_THROUGH' AS pattern, victim, acct FROM c_rapid
  UNION SELECT 'SCATTER', victim, unnest([from_acct, to_acct]) FROM c_split JOIN flow USING (victim) WHERE acct = from_acct
  UNION SELECT 'FUNNEL', victim, unnest([from_acct, to_acct]) FROM c_funnel JOIN flow USING (victim) WHERE acct = to_acct AND from_acct <> victim
  UNION SELECT 'SCATTER_GATHER', victim, unnest([a, mid, z]) FROM c_meet UNION SELECT 'CYCLE', victim, acct FROM c_loop)"""


@query(
    _sql(
        """SELECT victim, pattern, n_transfers, tainted, hop_from, hop_to, confidence, n_cases, n_accounts
  FROM (SELECT victim, pattern, count(DISTINCT tx_key) AS n_transfers, CAST(round(sum(tainted)) AS BIGINT) AS tainted, min(hop) AS hop_from, max(hop) AS hop_to,
      CASE WHEN bool_or(edge_score IS NOT NULL) THEN 'low' WHEN bool_and(via = 'layer_link') THEN 'high' ELSE 'medium' END AS confidence
    FROM (SELECT DISTINCT victim, pattern, tx_key FROM used) JOIN flow USING (victim, tx_key) GROUP BY victim, pattern)
  JOIN (SELECT victim, pattern, count(DISTINCT cs) AS n_cases FROM used GROUP BY ALL) USING (victim, pattern) JOIN (SELECT victim, pattern, count(*) AS n_accounts FROM people GROUP BY ALL) USING (victim, pattern)""",
        _FOUND,
    )
)
def trace_findings(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return FI.findings(_traced(c), c.profile)[0]


@query(_sql("SELECT DISTINCT victim, pattern, tx_key FROM used", _FOUND))
def trace_finding_transfers(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return FI.findings(_traced(c), c.profile)[1]


@query(
    _sql("""SELECT victim, acct, role, t_acct.hop, holding, tainted_in, n_receipts, received, first_ts, last_ts, CAST(row_number() OVER (PARTITION BY victim ORDER BY holding DESC, acct) AS INT) AS place
  FROM t_acct JOIN (SELECT acct, role FROM roles WHERE freeze_recommended) USING (acct)
  JOIN (SELECT victim, to_acct AS acct, count(DISTINCT tx_key) AS n_receipts, CAST(sum(amount_paise) AS BIGINT) AS received, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM flow GROUP BY ALL) USING (victim, acct) WHERE holding > 0""")
)
def trace_freeze(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return FI.freeze(_traced(c), _accounts(c), c.roles)


_MERGED = f"""{TRACE}, part_tx AS (SELECT tx_key, victim, min(hop) AS hop, CAST(sum(round(tainted)) AS BIGINT) AS tainted FROM flow GROUP BY tx_key, victim),
all_tx AS (SELECT tx_key, min(hop) AS hop, CAST(sum(tainted) AS BIGINT) AS tainted, count(*) AS n_victims FROM part_tx GROUP BY tx_key)"""


@query(_sql("SELECT tx_key, hop, src AS from_acct, dst AS to_acct, amount_paise, tainted, n_victims FROM all_tx JOIN tx USING (tx_key)", _MERGED))
def merged_transfers(spark, sf_dir):
    return FI.merged_transfers(_traced(case_of(spark, sf_dir)))[0]


@query(_sql("SELECT tx_key, victim, p.tainted, CASE WHEN a.tainted > 0 THEN round(p.tainted / a.tainted, 4) END AS share FROM part_tx p JOIN all_tx a USING (tx_key)", _MERGED))
def merged_transfer_shares(spark, sf_dir):
    return FI.merged_transfers(_traced(case_of(spark, sf_dir)))[1]


_SUMS = ", ".join(f"CAST(sum({a}) AS BIGINT) AS {a}" for a in FI.AMOUNTS)


@query(_sql(f"SELECT acct, min(hop) AS hop, {_SUMS}, count(*) AS n_victims FROM t_acct GROUP BY acct"))
def merged_accounts(spark, sf_dir):
    return FI.merged_accounts(_accounts(case_of(spark, sf_dir)))[0]


@query(_sql(f"SELECT acct, victim, {', '.join(FI.AMOUNTS)}, CASE WHEN sum(tainted_in) OVER (PARTITION BY acct) > 0 THEN round(tainted_in / sum(tainted_in) OVER (PARTITION BY acct), 4) END AS share_of_tainted_in FROM t_acct"))
def merged_account_shares(spark, sf_dir):
    return FI.merged_accounts(_accounts(case_of(spark, sf_dir)))[1]


_BACK = f"""{_RING},
money AS (SELECT l1, CAST(coalesce(sum(amount_paise) FILTER (link_type = 'VICTIM_L1'), 0) AS BIGINT) AS total_in_paise, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM cl GROUP BY l1),
held AS (SELECT l1, CAST(coalesce(sum(holding) FILTER (NOT is_victim), 0) AS BIGINT) AS holding_paise FROM cm GROUP BY l1),
cell_of AS (SELECT row_number() OVER (ORDER BY money.total_in_paise DESC, money.first_ts, l1) AS cell_id, l1, ring.ring_id AS network_id, held.holding_paise, money.first_ts, money.last_ts
  FROM money JOIN held USING (l1) JOIN comp ON comp.acct = l1 JOIN ring USING (label)),
into_l1 AS (SELECT tx.dst AS l1, tx.src AS victim, tx.tx_key, tx.ts_sec, tx.amount_paise, links.tx_key IS NOT NULL AS linked, bool_or(links.tx_key IS NOT NULL) OVER (PARTITION BY tx.dst) AS any_link, roles.role = 'VICTIM' AS payer
  FROM tx LEFT JOIN links ON links.tx_key = tx.tx_key AND links.link_type = 'VICTIM_L1' LEFT JOIN roles ON roles.acct = tx.src WHERE tx.dst IN (SELECT l1 FROM cell_of)),
back AS (SELECT * FROM into_l1 WHERE CASE WHEN any_link THEN linked ELSE payer END)"""
_BACK_BY = "SELECT {key}, victim, CAST(sum(amount_paise) AS BIGINT) AS amount, count(*) AS n_payments, count(DISTINCT l1) AS n_l1, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM back JOIN (SELECT {key}, l1 FROM cell_of) USING (l1) GROUP BY {key}, victim"


def _reverse(c, key):
    return FI.reverse(c.cells.select(key, "l1"), key, c.tx, c.links, c.roles)


@query(_sql(_BACK_BY.format(key="cell_id"), _BACK))
def reverse_cells(spark, sf_dir):
    return _reverse(case_of(spark, sf_dir), "cell_id")


@query(_sql(_BACK_BY.format(key="network_id"), _BACK))
def reverse_networks(spark, sf_dir):
    return _reverse(case_of(spark, sf_dir), "network_id")


@query(
    _sql(
        f"""SELECT cell_of.*, coalesce(mules, 0) AS mules, coalesce(n_l1, 0) AS n_l1, coalesce(n_l2, 0) AS n_l2, coalesce(n_l3, 0) AS n_l3, coalesce(n_unclassified_mule, 0) AS n_unclassified_mule, coalesce(n_none, 0) AS n_none,
    coalesce(n_freeze, 0) AS n_freeze, coalesce(freeze_holding, 0) AS freeze_holding, coalesce(n_payers, 0) AS n_payers, coalesce(total_in, 0) AS total_in
  FROM cell_of LEFT JOIN (SELECT l1, count(*) AS mules, {", ".join(f"count(*) FILTER (coalesce(roles.role, 'NONE') = '{r}') AS n_{r.lower()}" for r in ("L1", "L2", "L3", "UNCLASSIFIED_MULE", "NONE"))},
      count(*) FILTER (freeze_recommended) AS n_freeze, CAST(coalesce(sum(holding_paise) FILTER (freeze_recommended), 0) AS BIGINT) AS freeze_holding FROM cm LEFT JOIN roles USING (acct) WHERE roles.role IS DISTINCT FROM 'VICTIM' GROUP BY l1) USING (l1)
  LEFT JOIN (SELECT cell_id, count(*) AS n_payers, CAST(sum(amount) AS BIGINT) AS total_in FROM ({_BACK_BY.format(key="cell_id")}) GROUP BY cell_id) USING (cell_id)""",
        _BACK,
    )
)
def cell_summary(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return FI.cell_summary(c.cells, c.cell_members, _reverse(c, "cell_id"), c.roles)
