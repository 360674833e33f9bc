"""Searches, pages, displays and the blind test on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import reads as RE
from tracewell.plans.profile import DEFAULT

TX = "tx_key long, tx_id string, src long, dst long, amount_paise long, ts_sec long, mode string, narration string, device string, ip string, is_foreign_ip boolean"
ROWS = [
    (1, "a", 0, 1, 100, 10, "UPI", "UPI/TASK/x#1", "Android", "1", False),
    (2, "b", 1, 2, 300, 400, "IMPS", "UPI/P2A/x#1", "iPhone", "2", True),
    (3, "c", 1, 3, 300, 410, None, None, None, None, None),
    (4, "d", 1, 2, 200, 400, "upi", "x", "Android", "2", False),
    (5, "e", 2, 4, 50, 500, "UPI", "UPI/P2A/x#1", "Android", "3", True),
]


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(ROWS, TX)


def traced_of(spark, rows):
    full = [(v, h, k, a, b, t, p, float(p), "layer_link", u, None) for v, h, k, a, b, t, p, u in rows]
    return spark.createDataFrame(full, "victim long, hop int, tx_key long, from_acct long, to_acct long, ts_sec long, amount_paise long, tainted double, via string, untraced boolean, edge_score double")


def test_every_filter(tx):
    keys = lambda **f: sorted(r.tx_key for r in RE.matching(tx, **f).collect())
    assert keys() == [1, 2, 3, 4, 5] and keys(min_amount_paise=200, max_amount_paise=299) == [4] and keys(mode="UPI") == [1, 4, 5]
    assert keys(bank="SBIN") == [1] and keys(bank="UTIB") == [3] and keys(device="ANDROID", foreign_ip=True) == [5] and keys(foreign_ip=False) == [1, 4]
    assert keys(category="p2a") == [2, 5] and keys(from_ts=400, to_ts=410) == [2, 3, 4]
    with pytest.raises(ValueError, match="no such filters"):
        RE.matching(tx, colour="red")


def test_pages_and_counts(spark, tx):
    links = spark.createDataFrame([(2, "L1_L2")], "tx_key long, link_type string")
    page, count = RE.search(tx, links, limit=2, offset=1)
    assert {r.tx_key: r.link_type for r in page.collect()} == {3: None, 2: "L1_L2"} and tuple(count.first()) == (5, 950)
    page, count = RE.search(tx, links, limit=2, offset=9, mode="NEFT")
    assert page.count() == 0 and tuple(count.first()) == (0, 0)


def test_mules(spark, tx):
    roles = spark.createDataFrame([(1, True, "L1", 90.0), (2, True, "L2", 80.0), (3, False, None, 95.0), (9, True, "L2", 85.0)], "acct long, is_flagged boolean, role string, final_index double")
    roles = roles.withColumns({"band": F.lit("x"), "freeze_recommended": F.lit(True), "holding_paise": F.lit(5)})
    cells = spark.createDataFrame([(1,), (1,)], "acct long")
    page, count = RE.mules(roles, tx, cells)
    assert {r.acct: (r.in_paise, r.out_paise, r.senders, r.receivers, r.cells) for r in page.collect()} == {1: (100, 800, 1, 2, 2), 2: (500, 50, 1, 1, 0)} and count.first().n == 2
    one = lambda **k: sorted(r.acct for r in RE.mules(roles, tx, cells, **k)[0].collect())
    assert one(limit=1) == [1] and one(role="L2") == [2] and one(min_final=85) == [1] and one(min_in_paise=101) == [2] and one(bank="ICIC") == [2] and one(bank="SBIN") == []


def test_displays_leave_the_trace_whole(spark, tx):
    t = traced_of(spark, [(0, 1, 1, 0, 1, 10, 100, False), (0, 2, 2, 1, 2, 400, 300, False), (0, 2, 3, 1, 3, 410, 300, False), (0, 2, 4, 1, 2, 400, 200, True)])
    shown = lambda **k: {r.tx_key: r.is_shown for r in RE.shown(t, tx, **k).collect()}
    assert shown() == {1: True, 2: True, 3: True} and shown(hop=1) == {1: True, 2: False, 3: False}
    assert shown(keyword="P2A") == {1: False, 2: True, 3: False} and shown(min_amount_paise=101, bank="ICIC") == {1: False, 2: True, 3: False}


def test_usual_values_and_ties(spark, tx):
    t = traced_of(spark, [(0, 1, 1, 0, 1, 10, 100, False), (0, 2, 2, 1, 2, 400, 300, False), (0, 2, 3, 1, 3, 410, 300, False), (0, 3, 4, 1, 2, 400, 200, False)])
    got = {r.acct: (r.device, r.ip) for r in RE.usual(t, tx).collect()}
    assert got == {0: ("Android", "1"), 1: ("iPhone", "2")}  # two devices once each: that of the earlier hop


def test_samples_are_the_same_under_any_partitioning(spark):
    payers = spark.range(200).select(F.col("id").alias("acct"))
    pick = lambda seed, parts: sorted(r.acct for r in RE.sampled(payers.repartition(parts), 20, seed).collect())
    assert pick(1, 2) == pick(1, 7) != pick(2, 2) and len(pick(1, 3)) == 20


def test_blind_test(spark, tx):
    payers = spark.createDataFrame([(0,), (8,)], "acct long")
    whole = [(0, 1, 1, 0, 1, 10, 100, False), (0, 2, 2, 1, 2, 400, 300, False), (0, 2, 3, 1, 3, 410, 300, False), (0, 2, 4, 1, 2, 400, 200, False), (0, 3, 5, 2, 4, 500, 50, False)]
    judge = lambda rows: {r.victim: r for r in RE.blind_test(traced_of(spark, rows), tx, payers, DEFAULT).collect()}
    right = judge(whole)
    assert right[0].correct and (right[0].accounts, right[0].transfers) == (4, 5) and right[8].correct and right[8].transfers_expected == 0
    less = judge(whole[:-1])[0]
    assert not less.correct and (less.only_in_chain, less.transfers, less.transfers_expected) == (1, 4, 5)
    other = judge([*whole, (0, 2, 9, 1, 7, 400, 1, False), (0, 2, 10, 1, 3, 400, 1, True)])[0]
    assert not other.correct and other.only_in_trace == 1
