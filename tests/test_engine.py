"""Planted cells, odd rows and invariants of the transfer-graph engine."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import audit as A
from tracewell.operators import episodes as E
from tracewell.operators import graph as G
from tracewell.operators import trace as TR
from tracewell.operators.joins import asof_backward, interval_join
from tracewell.plans import profile as P
from tracewell.plans.case import Case
from tracewell.sources import ingest as I
from tracewell.sources import transfers as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def case(spark):
    return Case(T.flagged(T.transfers(spark, SF)))


def tx_frame(spark, rows):
    """rows: (tx_key, src, dst, ts_sec, amount)"""
    return spark.createDataFrame(rows, "tx_key long, src long, dst long, ts_sec long, amount_paise long")


def test_planted_cell_is_found_whole(case):
    role = {r.acct - 1_000_000: r for r in case.roles.filter("acct >= 1000000").collect()}
    assert [role[i].role for i in range(9)] == ["VICTIM"] * 2 + ["L1"] + ["L2"] * 4 + ["L3"] * 2
    kinds = {r.link_type: r["count"] for r in case.links.groupBy("link_type").count().collect()}
    assert kinds == {"VICTIM_L1": 2 + 4, "L1_L2": 8 + 9, "L2_L2": 2, "L2_L3": 8 + 9}
    ring = {r.label: r for r in case.rings.collect()}
    assert sorted(ring) == [1_000_000, 3_000_200]
    assert ring[1_000_000].patterns == ["SCATTER_GATHER", "FUNNEL"] and (ring[1_000_000].size, ring[1_000_000].victim_count) == (7, 2)
    assert ring[3_000_200].patterns == ["SCATTER_GATHER", "FUNNEL", "CYCLE"] and (ring[3_000_200].size, ring[3_000_200].victim_count) == (5, 2)
    assert {r.acct for r in case.on_cycle.collect()} == {3_000_202, 3_000_203}


def test_trace_reconciles_by_hand(case, spark):
    payers = spark.createDataFrame([(1_000_000,)], "acct long")
    t = TR.trace(case.tx, payers, case.roles, case.links, case.profile)
    acc = {r.acct - 1_000_000: r for r in TR.trace_accounts(t).collect()}
    assert acc[2].holding == 100_000 and sum(acc[i].holding for i in range(3, 7)) == 196_000 and acc[7].holding + acc[8].holding == 4_704_000
    r = TR.reconcile(t, TR.trace_accounts(t)).first()
    assert (r.paid, r.gap) == (5_000_000, 0)


def test_merged_trace_is_the_sum_of_its_parts(case):
    payers = case.features.filter("is_send_only and n_out <= 3").select("acct")
    t = TR.trace(case.tx, payers, case.roles, case.links, case.profile)
    for r in TR.reconcile(t, TR.trace_accounts(t)).collect():
        assert abs(r.gap) <= 5
    assert t.filter("tainted < 0 or tainted > amount_paise + 0.001").count() == 0


def test_row_order_does_not_matter(spark, case):
    shuffled = Case(case.tx.orderBy(F.xxhash64("tx_key", F.lit(3))).repartition(3))
    key = lambda c: sorted(map(str, c.roles.select("acct", F.round("final_index", 6), "role", "band").collect()))
    assert key(shuffled) == key(case)


def test_episode_edges(spark):
    rows = [(1, 9, 1, 0, 5), (2, 8, 1, 3600, 5), (3, 9, 1, 7201, 5), (4, 7, 1, 7201, 5), (5, 1, 2, 7201, 5), (6, 1, 2, 10_801, 5), (7, 1, 2, 10_802, 5), (8, 3, 3, 50, 5)]
    tx = tx_frame(spark, rows)
    ep = {r.in_key: r.ep for r in E.inflow_episodes(tx).collect()}
    assert ep[1] == ep[2] and ep[3] == ep[4] == ep[2] + 1
    out = {r.out_key: (r.ep, r.lag_s) for r in E.episode_outflows(tx, E.inflow_episodes(tx)).collect()}
    assert out == {5: (2, 0), 6: (2, 3600), 8: (1, 0)}


def test_joins_against_loops(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(4), rng.randrange(300)) for i in range(200)]
    right = [(i, rng.randrange(4), rng.randrange(300)) for i in range(200)]
    a = spark.createDataFrame(left, "i long, k long, t long")
    b = spark.createDataFrame(right, "j long, k long, u long")
    got = sorted(tuple(r) for r in interval_join(a, b, ["k"], "t", "u", 5, 40).select("i", "j").collect())
    assert got == sorted((i, j) for i, k, t in left for j, m, u in right if k == m and 5 <= u - t <= 40)
    got = {r.i: r.u for r in asof_backward(a, b, ["k"], "t", "u", ["j"]).collect()}
    assert got == {i: max((u for _, m, u in right if m == k and u <= t), default=None) for i, k, t in left}


def test_components_and_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7), (8, 8), (9, 10), (10, 9), (9, 11), (11, 12), (12, 11), (20, 21), (21, 22)] + [(100 + i, 101 + i) for i in range(40)]
    links = spark.createDataFrame(edges, "from_acct long, to_acct long")
    assert {r.acct for r in G.cycle_accounts(links).collect()} == {1, 2, 3, 8, 9, 10, 11, 12}
    comp = {r.acct: r.label for r in G.components(links).collect()}
    assert comp[5] == 1 and comp[12] == 9 and comp[140] == 100 and comp[22] == 20 and comp[8] == 8
    kinds = links.withColumn("link_type", F.lit("L1_L2"))
    got = {(r.l1, r.acct) for r in G.reach(kinds, spark.createDataFrame([(1,), (9,)], "acct long")).collect()}
    assert got == {(1, x) for x in (1, 2, 3, 4, 5)} | {(9, x) for x in (9, 10, 11, 12)}


def test_profile_rules():
    assert P.validate(P.DEFAULT) is P.DEFAULT
    for bad in ({"mule.MP1.weight": 21}, {"mule.MP1.weight": -1, "mule.MP2.weight": 36}, {"no.such": 1}, {"flag.signals": 1}, {"trust_discount": 2}):
        with pytest.raises(P.ProfileError):
            P.changed(P.DEFAULT, bad)
    assert P.changed(P.DEFAULT, {"mule.MP1.weight": 25, "mule.MP4.weight": 10})["mule"]["MP1"]["weight"] == 25 and P.DEFAULT["mule"]["MP1"]["weight"] == 20


def test_ingest_of_a_file(spark, tmp_path):
    lines = ["From Account,to_account,AMT,date,Transaction_ID"]
    good = "SBIN00000001,HDFC00000002,12.50,2026-1-2 3:4:5,T1"
    lines += [good, good.replace("12.50", "1.005"), good.replace("12.50", "0"), good.replace("SBIN", "sb").replace(",T1", ", "), good.replace("2026-1-2 3:4:5", "soon"), good.replace("2026-1-2 3:4:5", "2/1/2026 3:4:5")]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = I.read(spark, str(path))
    assert I.typed(rows).count() == 2 and {r.amount_paise for r in I.typed(rows).collect()} == {1250}
    assert len({r.ts for r in I.typed(rows).collect()}) == 1
    assert {r.reason: r.n for r in I.reject_counts(rows).collect()} == {"sub_paise_amount": 1, "non_positive_amount": 1, "empty_transaction_id": 1, "bad_sender_account": 1, "bad_timestamp": 1}


def test_driver_statistics():
    assert abs(A.chi2_survival(3.841458820694124, 1) - 0.05) < 1e-9 and abs(A.chi2_survival(18.307038053275146, 10) - 0.05) < 1e-9
    assert A.verdict_even([100, 101, 99])[0] == "CLEAN" and A.verdict_even([100, 10, 500])[0] == "SIGNAL" and A.verdict_even([])[0] == "INCONCLUSIVE"
    assert abs(A.cramers_v([("a", "x", 10), ("b", "y", 10)]) - 1) < 1e-12 and A.cramers_v([("a", "x", 5), ("a", "y", 5), ("b", "x", 5), ("b", "y", 5)]) == 0


def test_empty_transfers(spark, case):
    c = Case(case.tx.limit(0))
    assert c.features.count() == c.links.count() == c.rings.count() == 0


def test_networks_are_numbered_in_parts(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 50, (i * 31) % 9) for i in range(400)], "label long, total_in_paise long, first_ts long")
    got = G._numbered(rows, "label", "ring_id")
    assert got.columns == ["label", "total_in_paise", "first_ts", "ring_id"] and dict(got.dtypes)["ring_id"] == "int"
    found = sorted(map(tuple, got.collect()), key=lambda r: r[3])
    assert found == [(*r, k) for k, r in enumerate(sorted(map(tuple, rows.collect()), key=lambda r: (-r[1], r[2], r[0])), 1)]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(_part" in plan and "row_number() windowspecdefinition(total_in_paise" not in plan


def test_every_alias_and_mode(spark):
    for logical, names in I.ALIASES.items():
        for name in names:
            assert I.resolve([name.upper().replace("_", " ") + " ", "other"])[logical]
    assert I.resolve(["from_account", "Sender"])["sender"] == "Sender" and I.resolve(["src"])["sender"] is None
    good = ("t", "SBIN00000001", "HDFC00000001", "1.00", "2026-01-01 10:00:00")
    rows = [(*good, m, None) for m in [*I.MODES, "upi ", "netbanking"]] + [(*good, m, "bad_payment_mode") for m in ("ATM", "CASH", "CHEQUE", "", None)]
    rows += [("t", " SBIN00000001", "HDFC00000001\n", "1.00", "2026-01-01 10:00:00", "UPI", "bad_sender_account;bad_receiver_account")]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, tx_id string, sender string, receiver string, sum string, time string, type string, want string")
    got = I.judged(I.logical(raw.withColumn("ip", F.col("k").cast("string")))).select("ip", "reason", "sender_ifsc").collect()
    assert {int(r.ip): r.reason for r in got} == {i: r[-1] for i, r in enumerate(rows)}
    assert {r.sender_ifsc for r in got} == {"SBIN0001000"}
