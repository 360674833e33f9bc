"""Running values in slots against plain folds, edge scores by hand, stops, findings and merged traces."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import findings as FI
from tracewell.operators import scan as S
from tracewell.operators import trace as TR
from tracewell.plans.case import Case
from tracewell.plans.profile import DEFAULT
from tracewell.sources import transfers as T

SF = "/root/testdata/sf0.001"
LOOP = 3_000_200


@pytest.fixture(scope="module")
def case(spark):
    c = Case(T.flagged(T.transfers(spark, SF)))
    c.traced = TR.trace(c.tx, c.features.filter("is_send_only and n_out <= 3").select("acct"), c.roles, c.links, c.profile)
    return c


def loop_rows(df, *cols):
    return sorted(tuple(r[c] - LOOP if c in ("victim", "acct", "from_acct", "to_acct") else r[c] for c in cols) for r in df.collect() if r.victim >= LOOP)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_pool_and_taint_against_a_fold(spark, width):
    rng = random.Random(3)
    rows = [(k, t, i, rng.choice([1, 1, -1, -2]) * rng.randint(1, 50), rng.random() * 9) for i, (k, t) in enumerate((rng.randrange(3), rng.randrange(60)) for _ in range(300))]
    df = spark.createDataFrame(rows, "k long, t long, i long, change long, brings double").withColumn("slot", F.floor(F.col("t") / width))
    df = S.pool_before(df, ["k"], "slot", ["t", "i"], "change", "pool")
    gone = F.when((F.col("change") < 0) & (F.col("pool") > 0), F.least(-F.col("change"), F.col("pool")) / F.col("pool")).otherwise(0.0)
    df = df.withColumns({"keeps": 1 - gone, "new": F.when(F.col("change") > 0, F.col("brings")).otherwise(0.0)})
    got = {r.i: (r.pool, r.taint) for r in S.linear_before(df, ["k"], "slot", ["t", "i"], "keeps", "new", "taint").collect()}
    for k in range(3):
        pool = taint = 0
        for _, _, i, change, brings in sorted(r for r in rows if r[0] == k):
            assert got[i][0] == pool and abs(got[i][1] - taint) < 1e-9
            if change > 0:
                pool, taint = pool + change, taint + brings
            elif pool:
                paid = min(-change, pool)
                pool, taint = pool - paid, taint * (1 - paid / pool)


def test_interval_and_running_sums_against_loops(spark):
    rng = random.Random(4)
    points = [(rng.randrange(4), rng.randrange(-50, 200), rng.randint(1, 9)) for _ in range(200)]
    intervals = [(i, rng.randrange(5), rng.randrange(-60, 210)) for i in range(100)]
    a, b = spark.createDataFrame(intervals, "id long, k long, ts long"), spark.createDataFrame(points, "k long, ts long, v long")
    for low, high in ((0, 30), (5, 5), (-20, -1)):
        got = {r.id: r.v for r in S.interval_sums(a, b, ["k"], low, high, ["v"]).collect()}
        assert got == {i: sum(v for q, u, v in points if q == k and low <= u - t <= high) for i, k, t in intervals}
    assert S.interval_sums(a, b.limit(0), ["k"], 0, 9, ["v"]).agg(F.sum("v")).first()[0] == 0


def test_edge_score_by_hand(spark):
    rows = [
        (1, 1, 2, 0, 1000, False), (2, 2, 3, 3600, 400, False), (3, 2, 4, 3601, 500, False), (4, 3, 5, 7200, 1, False),  # 40 percent in time, all of it on again
        (5, 1, 2, 9000, 1000, True), (6, 2, 3, 9000, 3000, False),  # a second payment of the pair; more than all of it
        (7, 1, 6, 0, 10, False), (8, 6, 7, 10, 10, False),
    ]
    tx = spark.createDataFrame(rows, "tx_key long, src long, dst long, ts_sec long, amount_paise long, is_layering boolean")
    features = spark.createDataFrame([(2, 5)], "acct long, burst_fan_in int")
    got = {r.tx_key: r for r in TR.edge_scores(tx, features, tx.filter("src = 1"), DEFAULT).collect()}
    middle = 450  # of the amounts 1, 10, 10, 400, 500, 1000, 1000, 3000
    assert got[1].onward == 0.4 and got[1].downstream == 1 and got[1].first_time and got[1].anomaly == (1000 / middle >= 5) * 0.5 and got[1].edge_score == 16 + 15
    assert got[5].onward == 1 and not got[5].first_time and got[5].downstream == 0 and got[5].edge_score == 40 + 10
    assert got[7].edge_score == 40
    profile = {**DEFAULT, "trace": {**DEFAULT["trace"], "burst": (10, 5)}, "mule": {**DEFAULT["mule"], "MP8": {"full": 2, "half": 1}}}
    again = {r.tx_key: r for r in TR.edge_scores(tx, features, tx.filter("src = 1"), profile).collect()}
    assert again[1].burst == 0.5 and again[1].anomaly == 1 and again[1].edge_score == 16 + 15 + 10 + 15 and again[5].edge_score == 50 + 10
    assert TR.edge_scores(tx, features, tx.limit(0), DEFAULT).count() == 0


def test_payer_without_links_or_flagged_payees_is_traced_by_its_best_edge(case):
    mine = case.traced.filter(F.col("victim") == LOOP + 6)
    assert loop_rows(mine.filter("not untraced"), "hop", "from_acct", "to_acct", "tainted", "via", "edge_score") == [(1, 6, 7, 6e6, "fallback", 50.0), (2, 7, 8, 3e6, "fallback", None), (3, 8, 9, 1.5e6, "fallback", None)]
    stops = FI.stopped(mine, case.features, 4)
    assert loop_rows(stops, "acct", "stopped") == [(7, None), (8, None), (9, "receive_only")]
    assert FI.findings(mine, case.profile)[0].count() == 0  # half of the money stays at each account


def test_stops(case, spark):
    why = {r.acct - LOOP: r.stopped for r in FI.stopped(case.traced, case.features, 4).filter(F.col("victim") == LOOP).collect()}
    assert why[2] == "max_hops" and why[5] == "receive_only" and why[1] is None
    no_one = spark.createDataFrame([(-5,), (1_000_007,)], "acct long")  # unknown, and one that only receives
    rows = {r.victim: r for r in FI.payers(case.traced, TR.trace_accounts(case.traced), no_one, case.tx).collect()}
    assert {r.stopped for r in rows.values()} == {"no_outgoing_transfers"} and rows[-5].paid == 0


def test_findings_of_the_loop(case):
    found = {r.pattern: r for r in FI.findings(case.traced, case.profile)[0].filter(F.col("victim") == LOOP).collect()}
    assert set(found) >= {"SCATTER", "FUNNEL", "SCATTER_GATHER", "CYCLE"}
    assert (found["CYCLE"].n_accounts, found["CYCLE"].n_transfers, found["CYCLE"].confidence) == (2, 2, "high")
    assert found["FUNNEL"].n_accounts == 4 and found["SCATTER"].n_cases == 1 and found["SCATTER_GATHER"].n_cases >= 1
    mixed = FI.findings(case.traced.filter(F.col("victim") == LOOP + 10), case.profile)
    assert mixed[0].count() == mixed[1].count() == 0


def test_parts_of_the_merged_graph_sum_to_the_whole(case):
    total, shares = FI.merged_transfers(case.traced)
    summed = shares.groupBy("tx_key").agg(F.sum("tainted").alias("parts"), F.sum("share").alias("one"))
    both = total.join(summed, "tx_key").collect()
    assert all(r.tainted == r.parts and abs(r.one - 1) < 1e-3 for r in both) and {r.n_victims for r in both} == {1, 2}
    accounts, parts = FI.merged_accounts(TR.trace_accounts(case.traced))
    back = {r.acct: r.n for r in parts.groupBy("acct").agg(F.sum("holding").alias("n")).collect()}
    assert {r.acct: r.holding for r in accounts.collect()} == back


def test_results_do_not_depend_on_the_slots(case):
    narrow = {**case.profile, "trace": {**case.profile["trace"], "slot_s": 60}}
    again = TR.trace(case.tx, case.features.filter("is_send_only and n_out <= 3").select("acct"), case.roles, case.links, narrow)
    key = lambda t: sorted(map(str, t.select("victim", "hop", "tx_key", F.round("tainted", 4), "untraced").collect()))
    assert key(again) == key(case.traced)


def test_no_payers_and_no_transfers(case, spark):
    none = spark.createDataFrame([], "acct long")
    t = TR.trace(case.tx, none, case.roles, case.links, case.profile)
    accounts = TR.trace_accounts(t)
    assert t.count() == accounts.count() == FI.hops(t).count() == FI.findings(t, case.profile)[0].count() == FI.freeze(t, accounts, case.roles).count() == 0
    assert FI.merged_transfers(t)[1].count() == FI.reverse(case.cells.limit(0).select("cell_id", "l1"), "cell_id", case.tx, case.links, case.roles).count() == 0


def test_payments_into_an_account_without_links_come_from_payers_by_role(spark):
    tx = spark.createDataFrame([(1, 10, 2, 5, 100), (2, 11, 2, 6, 100), (3, 10, 3, 7, 100), (4, 11, 3, 8, 100)], "tx_key long, src long, dst long, ts_sec long, amount_paise long")
    links = spark.createDataFrame([(3, "VICTIM_L1")], "tx_key long, link_type string")
    roles = spark.createDataFrame([(11, "VICTIM"), (10, None)], "acct long, role string")
    starts = spark.createDataFrame([(2,), (3,), (4,)], "l1 long")
    assert sorted((r.l1, r.tx_key, r.via) for r in FI.payments_into(starts, tx, links, roles).collect()) == [(2, 2, "fallback"), (3, 3, "layer_link")]
