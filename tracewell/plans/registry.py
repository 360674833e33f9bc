"""All registered queries of the transfer-graph engine, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.cut import stored
from tracewell.operators import episodes as E
from tracewell.operators import features as FE
from tracewell.operators import links as L
from tracewell.sources import transfers as T

from .case import Case
from .profile import changed

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TX = T.TX_SQL
EP = f"{TX}, {E.EPISODE_SQL}"
FEAT = f"{EP}, {FE.FEATURE_SQL}"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, for comparison across engines."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def tx_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.flagged(T.transfers(spark, sf_dir))


@query(f"WITH {TX} SELECT tx_key, tx_id, src, dst, amount_paise, ts_sec, mode, narration, ip, device, layering AS is_layering FROM tx")
def transfers(spark, sf_dir):
    return tx_of(spark, sf_dir).select("tx_key", "tx_id", "src", "dst", "amount_paise", "ts_sec", "mode", "narration", "ip", "device", "is_layering")


@query(f"WITH {TX} SELECT tx_key, tx_id, count(*) OVER (PARTITION BY tx_id) > 1 AS is_dup_tx_id FROM tx")
def dup_flag(spark, sf_dir):
    # counted and joined back, not windowed: an id that repeats often is not gathered in one task
    tx = T.transfers(spark, sf_dir).select("tx_key", "tx_id")
    return tx.join(tx.groupBy("tx_id").agg((F.count("*") > 1).alias("is_dup_tx_id")), "tx_id").select("tx_key", "tx_id", "is_dup_tx_id")


@query(
    f"""WITH {TX}, a AS (SELECT acct, (['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST(acct % 5 + 1 AS INT)] AS bank, min(ts_sec) AS first_seen, max(ts_sec) AS last_seen FROM side GROUP BY acct)
    SELECT acct, bank || lpad(CAST(acct AS VARCHAR), 8, '0') AS acct_no, bank, first_seen, last_seen FROM a"""
)
def accounts_dim(spark, sf_dir):
    return T.accounts(T.transfers(spark, sf_dir))


@query(f"WITH {EP} SELECT * FROM ep_in")
def episodes(spark, sf_dir):
    return E.inflow_episodes(T.transfers(spark, sf_dir))


@query(f"WITH {EP} SELECT * FROM ep_win")
def episode_windows(spark, sf_dir):
    return E.episode_windows(E.inflow_episodes(T.transfers(spark, sf_dir)))


@query(f"WITH {EP} SELECT * FROM ep_out")
def episode_outflows(spark, sf_dir):
    tx = T.transfers(spark, sf_dir)
    return E.episode_outflows(tx, E.inflow_episodes(tx))


@query(
    f"""WITH {EP}, nx AS (SELECT ep_end, lead(ep_start) OVER (PARTITION BY acct ORDER BY ep_start) AS nxt FROM ep_win),
    so AS (SELECT acct, ep, sum(out_amt) AS o FROM ep_out GROUP BY acct, ep)
    SELECT (SELECT count(*) FROM (SELECT out_key FROM ep_out GROUP BY out_key HAVING count(*) > 1)) AS outflows_in_two_episodes,
    (SELECT count(*) FROM ep_out WHERE lag_s NOT BETWEEN 0 AND 3600) AS lags_outside_window,
    (SELECT count(*) FROM tx) - (SELECT CAST(sum(n_inflows) AS BIGINT) FROM ep_win) AS inflows_not_in_one_episode,
    (SELECT count(*) FROM nx WHERE nxt <= ep_end) AS overlapping_episodes,
    (SELECT count(*) FROM ep_win JOIN so USING (acct, ep) WHERE o > in_total) AS episodes_out_over_in"""
)
def episode_audit(spark, sf_dir):
    tx = T.transfers(spark, sf_dir)
    inflows = E.inflow_episodes(tx)
    return E.episode_audit(inflows, E.episode_windows(inflows), E.episode_outflows(tx, inflows))


_FEATURE_DOUBLES = [
    "pass_through_share", "forward_lag_median_s", "split_count_median", "commission_ratio_median", "commission_ratio_iqr", "flagged_out_share", "flagged_in_share",
    "amount_vs_population", "amount_diversity", "reciprocity", "median_hold_hours", "recurring_sender_share", "device_consistency", "victim_inflow_share", "ip_churn",
    "structuring_share", "timing_regularity", "odd_hour_share",
]
_FEATURE_OTHERS = ["acct", "tx_count", "n_in", "n_out", "is_send_only", "is_receive_only", "days_active", "forwarding_episodes", "burst_fan_in", "shared_ip_cluster_size"]


@query(f"WITH {FEAT} SELECT {', '.join(_FEATURE_OTHERS)}, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _FEATURE_DOUBLES)} FROM feat")
def features(spark, sf_dir):
    return rounded(FE.features(tx_of(spark, sf_dir)).select(*_FEATURE_OTHERS, *_FEATURE_DOUBLES))


def case_of(spark: SparkSession, sf_dir: str) -> Case:
    return Case(stored(tx_of(spark, sf_dir)))


def _ramp_sql(x: str, w: float, full: float, half: float | None = None, up: bool = True) -> str:
    op = ">=" if up else "<="
    mid = f" WHEN {x} {op} {half} THEN {w} * (0.5 + 0.5 * ({x} - {half}) / ({full} - {half}))" if half is not None else ""
    return f"CASE WHEN {x} {op} {full} THEN {w}{mid} ELSE 0 END"


_PATTERN = "(split_count_median BETWEEN 3 AND 6 AND forward_lag_median_s BETWEEN 180 AND 900 OR split_count_median = 1 AND forward_lag_median_s BETWEEN 0 AND 3600)"
_FEE = "coalesce(commission_ratio_median BETWEEN {} AND 0.99 AND coalesce(commission_ratio_iqr, 0) <= {} AND " + _PATTERN + ", false)"
_FIRST = f"""{_ramp_sql("pass_through_share", 20.0, 0.9, 0.6)} AS mp1,
  CASE WHEN {_FEE.format(0.94, 0.02)} THEN 15.0 WHEN {_FEE.format(0.90, 0.05)} THEN 7.5 ELSE 0 END AS mp2,
  {_ramp_sql("CASE WHEN is_receive_only THEN flagged_in_share ELSE flagged_out_share END", 15.0, 0.5, 0.2)} AS mp3,
  {_ramp_sql("tx_count / (SELECT median(tx_count) FROM feat)", 15.0, 0.3, 0.5, up=False)} AS mp4,
  {_ramp_sql("victim_inflow_share", 10.0, 0.8, 0.4)} AS mp5, CASE WHEN is_send_only OR is_receive_only THEN 10.0 ELSE 0 END AS mp6,
  {_ramp_sql("amount_vs_population", 5.0, 20.0, 5.0)} AS mp8,
  CASE WHEN tx_count >= 5 AND days_active >= 12 THEN 44.0 ELSE 0 END AS t1, CASE WHEN tx_count >= 5 AND amount_diversity >= 0.9 AND amount_vs_population <= 2 THEN 19.0 ELSE 0 END AS t4,
  CASE WHEN tx_count >= 5 AND device_consistency >= 1 THEN 5.0 ELSE 0 END AS t7,
  coalesce(pass_through_share >= 0.9 AND (split_count_median BETWEEN 3 AND 6 AND forward_lag_median_s BETWEEN 180 AND 900 OR split_count_median = 1 AND commission_ratio_median BETWEEN 0.94 AND 0.99), false) AS lift1"""


def _index_sql(source: str, mule: list[str], trust: list[str], lift: str) -> str:
    halves = {"mp1": 10, "mp2": 7.5, "mp3": 7.5, "mp4": 7.5, "mp5": 5, "mp6": 5, "mp7": 5, "mp8": 2.5}
    return f"""(SELECT *, CASE WHEN final_index < 65 OR n_half < 2 THEN CASE WHEN mule_index >= 65 AND trust_index >= 60 OR final_index >= 65 THEN 'review' ELSE CASE WHEN final_index >= 85 THEN 'high_confidence' WHEN final_index >= 65 THEN 'suspected' ELSE 'clean' END END
      WHEN final_index >= 85 THEN 'high_confidence' ELSE 'suspected' END AS band, final_index >= 65 AND n_half >= 2 AS is_flagged
    FROM (SELECT *, CASE WHEN lift THEN greatest(raw, 70.0) ELSE raw END AS final_index, lift AND raw < 70 AS override_applied
    FROM (SELECT *, mule_index * (1 - 0.5 * trust_index / 100) AS raw, {lift} AS lift
    FROM (SELECT *, {" + ".join(mule)} AS mule_index, {" + ".join(trust)} AS trust_index, {" + ".join(f"CASE WHEN {m} >= {halves[m]} - 1e-9 THEN 1 ELSE 0 END" for m in mule)} AS n_half FROM {source}))))"""


_M1 = ["mp1", "mp2", "mp3", "mp4", "mp5", "mp6", "mp8"]
SCORE1 = f"{FEAT}, pts AS (SELECT *, {_FIRST} FROM feat), s1 AS {_index_sql('pts', _M1, ['t1', 't4', 't7'], 'lift1')}"
LINKS = f"""{SCORE1},
cand AS (SELECT acct, is_flagged, CASE WHEN is_receive_only THEN 'L3' WHEN is_flagged AND split_count_median BETWEEN 3 AND 6 THEN 'L1' WHEN is_flagged AND split_count_median = 1 THEN 'L2'
  WHEN is_flagged THEN 'UNCLASSIFIED_MULE' WHEN is_send_only AND n_out <= 3 THEN 'VICTIM' END AS cand FROM s1),
proof AS (SELECT o.out_key, min(o.out_ts - i.in_ts) AS lag_s FROM ep_out o JOIN cand c ON c.acct = o.acct AND c.is_flagged AND c.cand IN ('L1', 'L2') JOIN ep_in i ON i.acct = o.acct AND i.ep = o.ep
  WHERE CASE c.cand WHEN 'L1' THEN o.out_ts - i.in_ts BETWEEN 180 AND 900 ELSE o.out_ts - i.in_ts BETWEEN 0 AND 3600 END GROUP BY o.out_key),
links AS (SELECT o.out_key AS tx_key, o.acct AS from_acct, o.to_acct, c.cand AS from_role, r.cand AS to_role, c.cand || '_' || r.cand AS link_type, p.lag_s, o.out_amt AS amount_paise, o.out_amt / w.in_total AS share_of_inflow
    FROM proof p JOIN ep_out o USING (out_key) JOIN cand c ON c.acct = o.acct JOIN ep_win w ON w.acct = o.acct AND w.ep = o.ep JOIN cand r ON r.acct = o.to_acct
    WHERE o.out_amt <= w.in_total AND (r.is_flagged OR r.cand = 'L3') AND c.cand || '_' || r.cand IN ('L1_L2', 'L2_L2', 'L2_L3')
  UNION ALL SELECT t.tx_key, t.src, t.dst, 'VICTIM', 'L1', 'VICTIM_L1', NULL, t.amount_paise, NULL FROM tx t JOIN cand v ON v.acct = t.src AND v.cand = 'VICTIM' JOIN cand r ON r.acct = t.dst AND r.cand = 'L1' AND r.is_flagged)"""
_KINDS = ("VICTIM_L1", "L1_L2", "L2_L2", "L2_L3")
RELATED = f"""{LINKS},
nb AS (SELECT side.acct, sum(amount_paise * final_index) / sum(amount_paise) AS neighbour_risk, sum(CASE WHEN is_in THEN amount_paise ELSE -amount_paise END) AS holding, sum(amount_paise) FILTER (is_in) AS got FROM side JOIN s1 ON s1.acct = side.cp GROUP BY side.acct),
li AS (SELECT to_acct AS acct, sum(amount_paise) FILTER (from_role = 'L1') AS f1, sum(amount_paise) FILTER (from_role = 'L2') AS f2, sum(amount_paise) FILTER (link_type = 'L2_L3') AS sk, {", ".join(f"bool_or(link_type = '{k}') AS in_{k}" for k in _KINDS)} FROM links GROUP BY to_acct),
lo AS (SELECT from_acct AS acct, {", ".join(f"bool_or(link_type = '{k}') AS out_{k}" for k in _KINDS)} FROM links GROUP BY from_acct),
rel AS (SELECT acct, neighbour_risk, CAST(holding AS BIGINT) AS holding_paise, CASE WHEN got > 0 THEN coalesce(f1, 0) / got END AS upstream_l1_share, CASE WHEN got > 0 THEN coalesce(f2, 0) / got END AS upstream_l2_share,
  CASE WHEN got > 0 THEN coalesce(sk, 0) / got END AS linked_sink_share, {", ".join(f"coalesce({d}_{k}, false) AS {d}_{k.lower()}" for d in ("in", "out") for k in _KINDS)} FROM nb LEFT JOIN li USING (acct) LEFT JOIN lo USING (acct))"""
SCORE2 = f"""{RELATED}, pts2 AS (SELECT *, {_ramp_sql("neighbour_risk", 10.0, 60.0, 40.0)} AS mp7, CASE WHEN tx_count >= 5 AND 100 - neighbour_risk >= 80 THEN 32.0 ELSE 0 END AS t5 FROM pts JOIN rel USING (acct)),
s2 AS {_index_sql("pts2", sorted([*_M1, "mp7"]), ["t1", "t4", "t5", "t7"], "(lift1 OR coalesce(is_receive_only AND linked_sink_share >= 0.9, false))")}"""
_YES = "CASE WHEN {} THEN 1.0 ELSE 0 END"
ROLES = f"""{SCORE2},
ls AS (SELECT *, CASE WHEN is_flagged THEN 30 * coalesce(victim_inflow_share, 0) + 25 * {_YES.format("split_count_median BETWEEN 3 AND 6")} + 20 * {_YES.format("commission_ratio_median BETWEEN 0.97 AND 0.99")} + 15 * {_YES.format("forward_lag_median_s BETWEEN 180 AND 900")} + 10 * coalesce(flagged_out_share, 0) END AS l1_score,
  CASE WHEN is_flagged THEN 30 * coalesce(upstream_l1_share, 0) + 25 * {_YES.format("split_count_median = 1")} + 20 * {_YES.format("commission_ratio_median BETWEEN 0.94 AND 0.97")} + 15 * {_YES.format("forward_lag_median_s BETWEEN 0 AND 3600")} + 10 * coalesce(flagged_out_share, 0) END AS l2_score,
  CASE WHEN is_flagged THEN 40 * {_YES.format("is_receive_only")} + 30 * coalesce(upstream_l2_share, 0) + 20 * coalesce(flagged_in_share, 0) + 10 * mp4 / 15 END AS l3_score FROM s2),
pay AS (SELECT src AS acct, sum(CASE WHEN l1_score >= 50 THEN amount_paise ELSE 0 END) / sum(amount_paise) AS payee FROM tx JOIN ls ON ls.acct = tx.dst GROUP BY src),
vs AS (SELECT ls.*, CASE WHEN NOT is_flagged THEN 35 * {_YES.format("is_send_only")} + 30 * {_YES.format("n_out <= 3 AND amount_vs_population >= 5")} + 25 * coalesce(payee, 0) + 10 * mp4 / 15 END AS victim_score,
  greatest(l1_score, l2_score, l3_score) AS top, CASE WHEN l1_score >= greatest(l2_score, l3_score) THEN 'L1' WHEN l2_score >= l3_score THEN 'L2' ELSE 'L3' END AS best FROM ls LEFT JOIN pay USING (acct)),
vl AS (SELECT *, CASE best WHEN 'L1' THEN in_victim_l1 OR out_l1_l2 WHEN 'L2' THEN in_l1_l2 OR in_l2_l2 OR out_l2_l2 OR out_l2_l3 ELSE in_l2_l3 END AS linked, list_sort([l1_score, l2_score, l3_score])[2] AS second FROM vs),
ro AS (SELECT *, CASE WHEN is_flagged THEN CASE WHEN top >= 50 AND top - second > 10 AND linked THEN best ELSE 'UNCLASSIFIED_MULE' END WHEN victim_score >= 60 THEN 'VICTIM' END AS role FROM vl),
rol AS (SELECT *, CASE WHEN role IN ('L1', 'L2', 'L3') THEN linked WHEN role = 'VICTIM' THEN out_victim_l1 WHEN role IS NOT NULL THEN false END AS role_confirmed FROM ro),
roles AS (SELECT *, is_flagged AND coalesce(role_confirmed, false) AND coalesce(holding_paise, 0) > 0 AS freeze_recommended FROM rol)"""


def _r(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


_P1 = ("mp1", "mp2", "mp3", "mp4", "mp5", "mp6", "mp8", "t1", "t4", "t7", "mule_index", "trust_index", "final_index")


@query(f"WITH {SCORE1} SELECT acct, {_r(*_P1)}, n_half, override_applied, is_flagged, band FROM s1")
def score_pass1(spark, sf_dir):
    return rounded(case_of(spark, sf_dir).pass1.select("acct", *_P1, "n_half", "override_applied", "is_flagged", "band"))


@query(f"WITH {SCORE1} SELECT band, is_flagged, count(*) AS n, round(avg(final_index), 6) AS mean_index FROM s1 GROUP BY band, is_flagged")
def score_bands(spark, sf_dir):
    return rounded(case_of(spark, sf_dir).pass1.groupBy("band", "is_flagged").agg(F.count("*").alias("n"), F.avg("final_index").alias("mean_index")))


@query(f"WITH {LINKS} SELECT * FROM cand")
def link_candidates(spark, sf_dir):
    return case_of(spark, sf_dir).candidates


@query(f"WITH {LINKS} SELECT * REPLACE (round(share_of_inflow, 6) AS share_of_inflow) FROM links")
def layer_links(spark, sf_dir):
    return rounded(case_of(spark, sf_dir).links)


@query(f"WITH {LINKS} SELECT a.cand AS from_cand, b.cand AS to_cand, count(*) AS n_tx, count(l.tx_key) AS n_links FROM tx JOIN cand a ON a.acct = src JOIN cand b ON b.acct = dst LEFT JOIN links l USING (tx_key) GROUP BY ALL")
def link_pairs(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return L.pair_counts(c.tx, c.candidates, c.links)


@query(f"""WITH {LINKS} SELECT count(*) FILTER (t.tx_key IS NULL OR t.amount_paise <> l.amount_paise OR src <> from_acct OR dst <> to_acct) AS unlike_transfer,
    count(*) FILTER (NOT CASE from_role WHEN 'L1' THEN lag_s BETWEEN 180 AND 900 WHEN 'L2' THEN lag_s BETWEEN 0 AND 3600 ELSE true END) AS lag_outside_window, count(*) FILTER (share_of_inflow > 1) AS share_over_one,
    count(*) FILTER (link_type <> 'VICTIM_L1' AND NOT EXISTS (SELECT 1 FROM tx i WHERE i.dst = l.from_acct AND i.ts_sec = t.ts_sec - l.lag_s)) AS lag_without_inflow FROM links l LEFT JOIN tx t USING (tx_key)""")
def link_check(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return L.check(c.tx, c.links, c.profile)


_REL = ("neighbour_risk", "upstream_l1_share", "upstream_l2_share", "linked_sink_share")
_SEEN = ", ".join(f"{d}_{k.lower()}" for d in ("in", "out") for k in _KINDS)


@query(f"WITH {RELATED} SELECT acct, holding_paise, {_r(*_REL)}, {_SEEN} FROM rel")
def relations(spark, sf_dir):
    return rounded(case_of(spark, sf_dir).relations.drop("upstream_role_share", "downstream_role_share"))


_P2 = ("mp7", "t5", "mule_index", "trust_index", "final_index")


@query(f"WITH {SCORE2} SELECT acct, {_r(*_P2)}, n_half, override_applied, is_flagged, band FROM s2")
def score_pass2(spark, sf_dir):
    return rounded(case_of(spark, sf_dir).pass2.select("acct", *_P2, "n_half", "override_applied", "is_flagged", "band"))


@query(f"WITH {ROLES} SELECT acct, {_r('l1_score', 'l2_score', 'l3_score', 'victim_score')}, role, role_confirmed, freeze_recommended, holding_paise FROM roles")
def roles(spark, sf_dir):
    return rounded(case_of(spark, sf_dir).roles.select("acct", "l1_score", "l2_score", "l3_score", "victim_score", "role", "role_confirmed", "freeze_recommended", "holding_paise"))


@query(f"WITH {ROLES} SELECT role, count(*) AS n, CAST(sum(holding_paise) AS BIGINT) AS holding_paise FROM roles WHERE freeze_recommended GROUP BY ROLLUP (role)")
def freeze_rollup(spark, sf_dir):
    return case_of(spark, sf_dir).roles.filter("freeze_recommended").rollup("role").agg(F.count("*").alias("n"), F.sum("holding_paise").alias("holding_paise"))


RINGS = f"""{ROLES.replace("WITH ", "", 1)},
und AS (SELECT from_acct AS a, to_acct AS b FROM links UNION SELECT to_acct, from_acct FROM links),
walk(acct, via) AS (SELECT DISTINCT a, a FROM und UNION SELECT w.acct, u.b FROM walk w JOIN und u ON u.a = w.via),
comp AS (SELECT acct, min(via) AS label FROM walk GROUP BY acct),
fwd(acct, via) AS (SELECT from_acct, to_acct FROM links UNION SELECT f.acct, l.to_acct FROM fwd f JOIN links l ON l.from_acct = f.via),
cyc AS (SELECT DISTINCT acct FROM fwd WHERE acct = via),
lin AS (SELECT to_acct AS acct, sum(amount_paise) AS i FROM links GROUP BY 1), lout AS (SELECT from_acct AS acct, sum(amount_paise) AS o, bool_or(from_role = 'VICTIM') AS v FROM links GROUP BY 1),
mem AS (SELECT label, comp.acct, coalesce(v, false) AS is_victim, role, coalesce(role_confirmed, false) AS role_confirmed, CAST(greatest(coalesce(i, 0) - coalesce(o, 0), 0) AS BIGINT) AS holding FROM comp LEFT JOIN lin USING (acct) LEFT JOIN lout USING (acct) LEFT JOIN roles USING (acct)),
tl AS (SELECT links.*, ts_sec, label FROM links JOIN (SELECT tx_key, ts_sec FROM tx) USING (tx_key) JOIN comp ON comp.acct = from_acct),
cr AS (SELECT acct AS l1, acct FROM mem WHERE role = 'L1' AND role_confirmed AND NOT is_victim UNION SELECT cr.l1, l.to_acct FROM cr JOIN links l ON l.from_acct = cr.acct AND l.link_type <> 'VICTIM_L1'),
cl AS (SELECT cr.l1, tl.* FROM cr JOIN tl ON tl.from_acct = cr.acct AND link_type <> 'VICTIM_L1' UNION ALL SELECT to_acct, tl.* FROM tl WHERE link_type = 'VICTIM_L1' AND to_acct IN (SELECT l1 FROM cr)),
cm AS (SELECT cr.l1, acct, false AS is_victim, role, holding FROM cr JOIN mem USING (acct) UNION ALL SELECT DISTINCT cl.l1, from_acct, true, role, 0 FROM cl JOIN mem ON mem.acct = from_acct WHERE link_type = 'VICTIM_L1')"""


def _network_sql(key: str, people: str, links_: str, cycles: str) -> str:
    return f"""(SELECT *, size - l1_count - l2_count - l3_count AS unclassified_count FROM (SELECT {key}, count(*) FILTER (NOT is_victim) AS size, {", ".join(f"count(*) FILTER (NOT is_victim AND role = '{k}') AS {k.lower()}_count" for k in ("L1", "L2", "L3"))}, count(*) FILTER (is_victim) AS victim_count, CAST(coalesce(sum(holding) FILTER (NOT is_victim), 0) AS BIGINT) AS holding_paise FROM {people} GROUP BY {key})
    JOIN (SELECT {key}, count(*) AS n_links, CAST(coalesce(sum(amount_paise) FILTER (link_type = 'VICTIM_L1'), 0) AS BIGINT) AS total_in_paise, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts, sha256(string_agg(CAST(tx_key AS VARCHAR), ',' ORDER BY tx_key)) AS fingerprint FROM {links_} GROUP BY {key}) USING ({key})
    LEFT JOIN (SELECT {key}, array_to_string(list(p ORDER BY o), ',') AS patterns FROM (
      SELECT DISTINCT {key}, 'SCATTER_GATHER' AS p, 1 AS o FROM (SELECT x.{key} FROM {links_} x JOIN {links_} y ON x.{key} = y.{key} AND y.from_acct = x.to_acct AND y.ts_sec >= x.ts_sec WHERE x.link_type <> 'VICTIM_L1' GROUP BY x.{key}, x.from_acct, y.to_acct HAVING count(DISTINCT x.to_acct) >= 2)
      UNION SELECT {key}, 'FUNNEL', 2 FROM (SELECT {key} FROM {links_} WHERE link_type <> 'VICTIM_L1' GROUP BY {key}, to_acct HAVING count(DISTINCT from_acct) >= 3)
      UNION SELECT {key}, 'CYCLE', 3 FROM {cycles}) GROUP BY {key}) USING ({key}))"""


_NET = "size, l1_count, l2_count, l3_count, unclassified_count, victim_count, holding_paise, n_links, total_in_paise, first_ts, last_ts, fingerprint"
_RING = f"{RINGS}, ring AS (SELECT *, row_number() OVER (ORDER BY total_in_paise DESC, first_ts, label) AS ring_id FROM {_network_sql('label', 'mem', 'tl', 'comp JOIN cyc USING (acct)')})"


@query(f"WITH RECURSIVE {RINGS} SELECT * FROM comp")
def ring_components(spark, sf_dir):
    return case_of(spark, sf_dir).components


@query(f"WITH RECURSIVE {RINGS} SELECT acct FROM cyc")
def cycle_accounts(spark, sf_dir):
    return case_of(spark, sf_dir).on_cycle


@query(f"WITH RECURSIVE {RINGS} SELECT * FROM mem")
def ring_members(spark, sf_dir):
    return case_of(spark, sf_dir).members


@query(f"WITH RECURSIVE {_RING} SELECT ring_id, label, {_NET}, coalesce(patterns, '') AS patterns FROM ring")
def rings(spark, sf_dir):
    return case_of(spark, sf_dir).rings.select("ring_id", "label", *_NET.split(", "), F.array_join("patterns", ",").alias("patterns"))


@query(f"WITH RECURSIVE {_RING} SELECT row_number() OVER (ORDER BY c.total_in_paise DESC, c.first_ts, l1) AS cell_id, l1, ring.ring_id AS network_id, {', '.join('c.' + x for x in _NET.split(', '))}, coalesce(c.patterns, '') AS patterns FROM {_network_sql('l1', 'cm', 'cl', 'cr JOIN cyc USING (acct)')} c JOIN comp ON comp.acct = l1 JOIN ring USING (label)")
def cells(spark, sf_dir):
    return case_of(spark, sf_dir).cells.select("cell_id", "l1", "network_id", *_NET.split(", "), F.array_join("patterns", ",").alias("patterns"))


@query(f"WITH RECURSIVE {RINGS} SELECT l1, acct, is_victim, role, CAST(holding AS BIGINT) AS holding FROM cm")
def cell_members(spark, sf_dir):
    return case_of(spark, sf_dir).cell_members.select("l1", "acct", "is_victim", "role", "holding")


def _reweighted(sql: str) -> str:
    """The score SQL with weight 30 for MP1 and 5 for MP4."""
    few = "tx_count / (SELECT median(tx_count) FROM feat)"
    changes = {
        _ramp_sql("pass_through_share", 20.0, 0.9, 0.6): _ramp_sql("pass_through_share", 30.0, 0.9, 0.6),
        _ramp_sql(few, 15.0, 0.3, 0.5, up=False): _ramp_sql(few, 5.0, 0.3, 0.5, up=False),
        "mp1 >= 10 ": "mp1 >= 15 ",
        "mp4 >= 7.5 ": "mp4 >= 2.5 ",
    }
    for a, b in changes.items():
        sql = sql.replace(a, b)
    return sql


_SHOWN = ["final_index", "is_flagged", "band", "role"]
_BOTH = ", ".join(f"b.{c} AS {c}_before, a.{c} AS {c}_after" for c in _SHOWN[1:])


@query(
    f"""WITH b AS (WITH {ROLES} SELECT acct, {", ".join(_SHOWN)} FROM roles), a AS (WITH {_reweighted(ROLES)} SELECT acct, {", ".join(_SHOWN)} FROM roles)
    SELECT acct, round(b.final_index, 6) AS final_index_before, round(a.final_index, 6) AS final_index_after, {_BOTH} FROM b JOIN a USING (acct)
    WHERE abs(b.final_index - a.final_index) > 1e-9 OR {" OR ".join(f"b.{c} IS DISTINCT FROM a.{c}" for c in _SHOWN[1:])}"""
)
def preview_diff(spark, sf_dir):
    """What would change with more weight on pass-through and less on low activity."""
    c = case_of(spark, sf_dir)
    return rounded(c.preview(changed(c.profile, {"mule.MP1.weight": 30, "mule.MP4.weight": 5})))


def queries() -> dict[str, Query]:
    from . import dataset, more, movement, reading, stages, tracing, traps, verdict  # noqa: F401  they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
