"""The checks of a transfer table on small hand-made rows and on none."""

from tracewell.operators import checks as C

SCHEMA = "tx_key long, src long, dst long, amount_paise long, ts_sec long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_no_transfers(spark):
    tx = spark.createDataFrame([], SCHEMA)
    assert C.funnel_hops(tx).count() == C.hourly_fee(tx).count() == 0
    assert {r.n_below for r in C.at_limits(tx).collect()} == {0}
    assert C.lookalikes(spark.createDataFrame([], "acct_no string")).count() == 0


def test_hourly_fee_meets_the_edges_of_the_hour(spark):
    tx = spark.createDataFrame([(1, 1, 2, 10_000, 0), (2, 2, 3, 9_700, 3_600), (3, 1, 2, 10_000, 7_000), (4, 2, 3, 9_700, 10_601), (5, 1, 4, 10_000, 3_600), (6, 4, 5, 9_500, 3_600)], SCHEMA)
    assert rows(C.hourly_fee(tx), "acct", "n_inflows", "n_band") == [(2, 1, 1), (4, 1, 1)]


def test_limits_and_lookalikes(spark):
    tx = spark.createDataFrame([(1, 1, 2, 999_900, 0), (2, 1, 2, 999_901, 0), (3, 1, 2, 989_901, 0), (4, 1, 2, 989_900, 0), (5, 1, 2, None, 0)], SCHEMA)
    assert rows(C.at_limits(tx), "limit_rupees", "n_below", "n_above", "senders_below")[0] == (9_999, 2, 1, 1)
    names = spark.createDataFrame([("SBIN00000001",), ("SBIN00000002",), ("SBIN00000012",), ("HDFC00000001",), ("SBIN00000001",), (None,)], "acct_no string")
    assert rows(C.lookalikes(names), "acct_no", "n_lookalikes") == [("SBIN00000001", 1), ("SBIN00000002", 2), ("SBIN00000012", 1)]
