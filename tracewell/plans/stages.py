"""Queries over the stages as a whole: invariants, ring stamps, reasons of scores, stored profiles, and numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions.cut import shared_folder
from tracewell.sources import numbering as N
from tracewell.sources import results as R
from tracewell.sources import transfers as T

from .profile import changed
from .registry import _RING, EP, RELATED, ROLES, TX, _network_sql, _reweighted, case_of, query, rounded, tx_of

_CELLS = f"""{_RING}, cell_row AS (SELECT c.*, ring.ring_id AS network_id FROM {_network_sql("l1", "cm", "cl", "cr JOIN cyc USING (acct)")} c LEFT JOIN comp ON comp.acct = l1 LEFT JOIN ring USING (label)),
next_ep AS (SELECT ep_end, lead(ep_start) OVER (PARTITION BY acct ORDER BY ep_start) AS nxt FROM ep_win),
ring_acct AS (SELECT acct, ring_id FROM comp JOIN ring USING (label))"""
_COUNTERS = {
    "outflows_in_two_episodes": "SELECT count(*) FROM (SELECT out_key FROM ep_out GROUP BY out_key HAVING count(*) > 1)",
    "lags_outside_window": "SELECT count(*) FROM ep_out WHERE lag_s NOT BETWEEN 0 AND 3600",
    "inflows_not_in_one_episode": "SELECT (SELECT count(*) FROM tx) - coalesce(CAST(sum(n_inflows) AS BIGINT), 0) FROM ep_win",
    "overlapping_episodes": "SELECT count(*) FROM next_ep WHERE nxt <= ep_end",
    "not_scored_once": "SELECT count(*) FROM (SELECT acct FROM feat FULL JOIN (SELECT acct, count(*) AS s FROM roles GROUP BY acct) r USING (acct) WHERE s IS DISTINCT FROM 1)",
    "undecided": "SELECT count(*) FROM roles WHERE final_index IS NULL OR band IS NULL OR is_flagged IS NULL OR final_index NOT BETWEEN 0 AND 100",
    "role_breaks_flag": "SELECT count(*) FROM roles WHERE is_flagged AND (role IS NULL OR role = 'VICTIM') OR NOT is_flagged AND (coalesce(role, 'VICTIM') <> 'VICTIM' OR victim_score IS NULL)",
    "stale_links": "SELECT count(*) FROM links JOIN s1 ON s1.acct = from_acct WHERE from_role IN ('L1', 'L2') AND NOT is_flagged",
    "links_without_ring": "SELECT count(*) FROM links LEFT JOIN ring_acct ON acct = from_acct WHERE ring_id IS NULL",
    "links_crossing_rings": "SELECT count(*) FROM links LEFT JOIN ring_acct a ON a.acct = from_acct LEFT JOIN ring_acct b ON b.acct = to_acct WHERE a.ring_id IS DISTINCT FROM b.ring_id",
    "links_not_counted": "SELECT (SELECT count(*) FROM links) - coalesce(CAST(sum(n_links) AS BIGINT), 0) FROM ring",
    "ring_fingerprints_twice": "SELECT count(*) - count(DISTINCT fingerprint) FROM ring",
    "ring_sizes_unlike": "SELECT count(*) FROM ring FULL JOIN (SELECT label, count(*) AS n FROM mem GROUP BY label) USING (label) WHERE size + victim_count IS DISTINCT FROM n",
    "l1_without_cell": "SELECT count(*) FROM mem WHERE role = 'L1' AND role_confirmed AND NOT is_victim AND acct NOT IN (SELECT l1 FROM cell_row)",
    "cell_fingerprints_twice": "SELECT count(*) - count(DISTINCT fingerprint) FROM cell_row",
    "cell_sizes_unlike": "SELECT count(*) FROM cell_row FULL JOIN (SELECT l1, count(*) AS n FROM cm GROUP BY l1) USING (l1) WHERE size + victim_count IS DISTINCT FROM n",
    "cells_without_network": "SELECT count(*) FROM cell_row WHERE network_id IS NULL",
}


@query(f"WITH RECURSIVE {_CELLS} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({v}) AS n" for k, v in _COUNTERS.items()))
def case_checks(spark, sf_dir):
    """Every invariant of the stages with the rows that break it; `Case.verify` raises on any."""
    return case_of(spark, sf_dir).checks()


@query(f"WITH RECURSIVE {_CELLS} SELECT tx_key, ring_id FROM links LEFT JOIN ring_acct ON acct = from_acct")
def ring_stamped_links(spark, sf_dir):
    return case_of(spark, sf_dir).stamped_links.select("tx_key", "ring_id")


@query(f"WITH RECURSIVE {_CELLS} SELECT roles.acct, role, ring_id FROM roles LEFT JOIN ring_acct USING (acct)")
def ring_stamped_scores(spark, sf_dir):
    return case_of(spark, sf_dir).stamped_scores.select("acct", "role", "ring_id")


def _fixed_sql(x: str, digits: int = 1) -> str:
    p = 10**digits
    n = f"CAST(round(CAST({x} AS DOUBLE) * {p}) AS BIGINT)"
    return f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END || (abs({n}) // {p}) || '.' || lpad(CAST(abs({n}) % {p} AS VARCHAR), {digits}, '0'))"


def _told(*features: str) -> str:
    return " || ', ' || ".join(f"'{f} ' || coalesce({_fixed_sql(f, 2)}, 'none')" for f in features)


_SHOWN = {
    "MP1": (20, _told("pass_through_share")), "MP2": (15, _told("commission_ratio_median", "split_count_median", "forward_lag_median_s")),
    "MP3": (15, f"CASE WHEN is_receive_only THEN {_told('flagged_in_share')} ELSE {_told('flagged_out_share')} END"), "MP4": (15, _told("tx_count")),
    "MP5": (10, _told("victim_inflow_share")), "MP6": (10, "CASE WHEN is_send_only THEN 'is_send_only' ELSE 'is_receive_only' END"), "MP7": (10, _told("neighbour_risk")),
    "MP8": (5, _told("amount_vs_population")), "T1": (44, _told("days_active")), "T4": (19, _told("amount_diversity", "amount_vs_population")), "T5": (32, _told("neighbour_risk")), "T7": (5, _told("device_consistency")),
}
_LINES = [
    f"'final ' || {_fixed_sql('final_index')} || ': mule ' || {_fixed_sql('mule_index')} || ', trust ' || {_fixed_sql('trust_index')}",
    f"CASE WHEN override_applied THEN 'raised from ' || {_fixed_sql('raw')} || ' to at least 70' END",
    "CASE WHEN is_flagged THEN 'flagged with ' || n_half || ' signals' WHEN final_index >= 65 THEN 'not flagged with ' || n_half || ' signals' END",
    "CASE WHEN NOT is_flagged AND mule_index >= 65 AND trust_index >= 60 THEN 'to be reviewed: much trust' END",
    *(f"CASE WHEN {k} > 0 THEN '{k} ' || {_fixed_sql(k)} || ' of {w}: ' || {shown} END" for k, (w, shown) in _SHOWN.items()),
    "CASE WHEN tx_count < 5 THEN 'no trust: fewer than 5 transfers' END",
]


@query(f"WITH {ROLES} SELECT acct, array_to_string(list_filter([{', '.join(_LINES)}], lambda x: x IS NOT NULL), ' | ') AS reasons FROM roles")
def score_reasons(spark, sf_dir):
    """Why each account has its score, in words compiled from the profile."""
    return case_of(spark, sf_dir).reasons.select("acct", F.array_join("reasons", " | ").alias("reasons"))


_RULES = ("MP1", "MP2", "MP3", "MP4", "MP5", "MP6", "MP7", "MP8", "T1", "T2", "T3", "T4", "T5", "T6", "T7")


@query(f"""WITH {ROLES}
  {" UNION ALL ".join(f"SELECT acct, '{k}' AS rule, round(CAST({k if k not in ('T2', 'T3', 'T6') else 0} AS DOUBLE), 6) AS points FROM roles" for k in _RULES)}""")
def score_points(spark, sf_dir):
    """The points of every rule, from the map that a score carries."""
    return rounded(case_of(spark, sf_dir).reasons.select("acct", F.explode("points").alias("rule", "points")))


@query(f"""WITH {RELATED},
  up AS (SELECT to_acct AS acct, {", ".join(f"coalesce(sum(amount_paise) FILTER (from_role = '{r}'), 0) AS {r}" for r in ("VICTIM", "L1", "L2"))} FROM links GROUP BY to_acct),
  down AS (SELECT from_acct AS acct, {", ".join(f"coalesce(sum(amount_paise) FILTER (to_role = '{r}'), 0) AS {r}" for r in ("L1", "L2", "L3"))} FROM links GROUP BY from_acct),
  whole AS (SELECT acct, sum(amount_paise) FILTER (is_in) AS i, sum(amount_paise) FILTER (NOT is_in) AS o FROM side GROUP BY acct)
  {" UNION ALL ".join(f"SELECT acct, '{d}' AS direction, '{r}' AS role, round({r} / {t}, 6) AS share FROM {d} JOIN whole USING (acct)" for d, t, rs in (("up", "i", ("VICTIM", "L1", "L2")), ("down", "o", ("L1", "L2", "L3"))) for r in rs)}""")
def role_shares(spark, sf_dir):
    """Shares of an account's money by the role at the other end of its links, upstream and downstream."""
    rel = case_of(spark, sf_dir).relations
    side = lambda d: rel.filter(F.col(f"{d}stream_role_share").isNotNull()).select("acct", F.lit(d).alias("direction"), F.explode(f"{d}stream_role_share").alias("role", "share"))
    return rounded(side("up").unionByName(side("down")))


_KEPT = "acct, round(final_index, 6) AS final_index, is_flagged, band, role"


@query(f"SELECT 'v1-verified' AS profile_id, * FROM (WITH {ROLES} SELECT {_KEPT} FROM roles) UNION ALL SELECT 'more-pass-through', * FROM (WITH {_reweighted(ROLES)} SELECT {_KEPT} FROM roles)")
def profiles_side_by_side(spark, sf_dir):
    """Scores of two profiles from their stored tables, one of which was refilled."""
    c = case_of(spark, sf_dir)
    other = c.under(changed(c.profile, {"profile_id": "more-pass-through", "mule.MP1.weight": 30, "mule.MP4.weight": 5}))
    folder = f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}"
    for case in (c, other, c):
        R.refill(case.roles.select("acct", "final_index", "is_flagged", "band", "role"), folder, "scores", case.profile["profile_id"])
    return rounded(R.read(spark, folder, "scores"))


@query(f"WITH {EP}, no AS (SELECT DISTINCT (['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST(acct % 5 + 1 AS INT)] || lpad(CAST(acct AS VARCHAR), 8, '0') AS acct_no FROM side) SELECT acct_no, row_number() OVER (ORDER BY acct_no) - 1 AS acct_id FROM no")
def account_ids(spark, sf_dir):
    return N.dense_ids(T.accounts(tx_of(spark, sf_dir)))


_NO = "(['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST({0} % 5 + 1 AS INT)] || lpad(CAST({0} AS VARCHAR), 8, '0')"


@query(f"""WITH {TX}, no AS (SELECT acct_no, row_number() OVER (ORDER BY acct_no) - 1 AS acct_id FROM (SELECT DISTINCT {_NO.format("acct")} AS acct_no FROM side))
  SELECT tx_key, a.acct_id AS src_id, b.acct_id AS dst_id FROM tx JOIN no a ON a.acct_no = {_NO.format("src")} JOIN no b ON b.acct_no = {_NO.format("dst")}""")
def transfer_ids(spark, sf_dir):
    """Transfers with the dense numbers of both accounts."""
    tx = tx_of(spark, sf_dir)
    rows = tx.select("tx_key", T.account_number(F.col("src")).alias("src_no"), T.account_number(F.col("dst")).alias("dst_no"))
    return N.with_ids(rows, N.dense_ids(T.accounts(tx)), {"src_no": "src_id", "dst_no": "dst_id"}).select("tx_key", "src_id", "dst_id")


@query("SELECT event_id, row_number() OVER () AS row_no FROM events")
def event_row_numbers(spark, sf_dir):
    """Events numbered in the order of their file."""
    return N.in_file_order(spark.read.parquet(f"{sf_dir}/events.parquet"), "row_no").select("event_id", "row_no")
