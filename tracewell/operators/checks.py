"""Checks of a transfer table: how money moves between groups, lookalike accounts, amounts at limits, fees within an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.cut import cut
from tracewell.sources import transfers as T

from .joins import asof_backward

#: The hops of the funnel, in order.
HOPS = [("send_only", "payees"), ("payees", "next_hop"), ("next_hop", "receive_only")]
#: Reporting limits in rupees, and the band beside each in percent.
LIMITS = [9_999, 49_999, 99_999, 199_999, 499_999, 999_999]
BAND = 1


def groups(tx: DataFrame) -> DataFrame:
    """acct, out_in and a flag for each group of the funnel; an account may be in several groups."""
    amount = lambda c: F.sum(F.when(c, F.col("amount_paise")).otherwise(0))
    deg = T.sides(tx).groupBy("acct").agg(F.count_if("is_in").alias("n_in"), F.count_if(~F.col("is_in")).alias("n_out"), amount(F.col("is_in")).alias("a_in"), amount(~F.col("is_in")).alias("a_out"))
    deg = cut(deg)
    pair = tx.select("src", "dst").distinct()
    payees = cut(pair.join(deg.filter("n_in = 0").select(F.col("acct").alias("src")), "src", "left_semi").select(F.col("dst").alias("acct")).distinct())
    later = pair.join(payees.withColumnRenamed("acct", "src"), "src", "left_semi").join(payees.withColumnRenamed("acct", "dst"), "dst", "left_anti").select(F.col("dst").alias("acct")).distinct()
    out = deg.join(payees.withColumn("payees", F.lit(True)), "acct", "left").join(later.withColumn("next_hop", F.lit(True)), "acct", "left").fillna(False, ["payees", "next_hop"])
    return out.select("acct", (F.col("n_in") == 0).alias("send_only"), "payees", "next_hop", (F.col("n_out") == 0).alias("receive_only"), F.round(F.col("a_out") / F.nullif("a_in", F.lit(0)), 6).alias("out_in"))


def _quantiles(rows: DataFrame, value: str, out: dict[str, float]) -> DataFrame:
    """Quantiles of a value for each hop, from counts of equal values rather than from all rows."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy("hop", value).agg(F.count("*").alias("_n"))
    return counted.groupBy("hop").agg(*(F.percentile(value, F.lit(q), F.col("_n")).alias(c) for c, q in out.items()))


def funnel_hops(tx: DataFrame) -> DataFrame:
    """For each hop of the funnel: senders, receivers, transfers, the wait since the last arrival, receivers a sender, out/in.

    A hop whose senders send nothing at all has no row; one without transfers to its receivers has counts of 0 and nulls.
    """
    member = cut(groups(tx))
    side = lambda key, name: member.select(F.col("acct").alias(key), F.struct(*[c for c in member.columns if c != "acct"]).alias(name))
    legs = F.array(*(F.when(F.col(f"s.{a}"), F.struct(F.lit(i).alias("hop"), F.col(f"d.{b}").alias("inside"))) for i, (a, b) in enumerate(HOPS, 1)))
    rows = tx.select("src", "dst", "ts_sec").join(side("src", "s"), "src").join(side("dst", "d"), "dst")
    rows = cut(rows.withColumn("leg", F.explode(F.array_compact(legs))).select("src", "dst", "ts_sec", "leg.*"))
    inside = rows.filter("inside")
    waits = asof_backward(inside.select("hop", "src", "ts_sec"), tx.select(F.col("dst").alias("src"), F.col("ts_sec").alias("arrived")), ["src"], "ts_sec", "arrived", [])
    waits = cut(waits.select("hop", (F.col("ts_sec") - F.col("arrived")).alias("wait")))
    fan = cut(inside.select("hop", "src", "dst").distinct().groupBy("hop", "src").agg(F.count("*").alias("receivers")))
    flow = fan.join(member.select(F.col("acct").alias("src"), "out_in"), "src")
    out = rows.groupBy("hop").agg(F.count_if("inside").alias("n_transfers"), F.count_if(~F.col("inside")).alias("n_elsewhere"))
    parts = [
        inside.select("hop", "dst").distinct().groupBy("hop").agg(F.count("*").alias("n_receivers")),
        waits.groupBy("hop").agg(F.count("wait").alias("n_with_arrival"), F.min("wait").alias("wait_min_s"), F.max("wait").alias("wait_max_s")),
        _quantiles(waits, "wait", {"wait_median_s": 0.5}),
        fan.groupBy("hop").agg(F.count("*").alias("n_senders"), F.max("receivers").alias("receivers_max")),
        _quantiles(fan, "receivers", {"receivers_median": 0.5}),
        _quantiles(flow, "out_in", {"out_in_q1": 0.25, "out_in_median": 0.5, "out_in_q3": 0.75}),
    ]
    for part in parts:
        out = out.join(part, "hop", "left")  # a row for each hop
    return out.fillna(0, ["n_receivers", "n_with_arrival", "n_senders"])


def lookalikes(accounts: DataFrame) -> DataFrame:
    """acct_no and n_lookalikes of accounts (bank, acct_no) of whose number another of the bank differs in one digit.

    Numbers meet under themselves with one digit masked, so a group has ten members at most; no pair is formed.
    """
    digits = range(5, 13)
    masks = F.array(*(F.concat(F.substring("acct_no", 1, i - 1), F.lit("_"), F.substring("acct_no", i + 1, 12)) for i in digits))
    rows = accounts.select("acct_no").distinct().withColumn("mask", F.explode(masks))
    met = rows.groupBy("mask").agg(F.collect_set("acct_no").alias("own")).filter("size(own) > 1")
    met = met.select(F.explode("own").alias("acct_no"), (F.size("own") - 1).alias("n"))
    return met.groupBy("acct_no").agg(F.sum("n").alias("n_lookalikes"))


def at_limits(tx: DataFrame) -> DataFrame:
    """For each limit: transfers in the band below it, in the band above it, and senders below; zeros where there are none."""
    spark = tx.sparkSession
    near = F.array(*(F.when(F.col("amount_paise").between(n * (100 - BAND), n * (100 + BAND)), F.lit(n)) for n in LIMITS))
    rows = tx.withColumn("limit_rupees", F.explode(F.array_compact(near)))
    below = F.col("amount_paise") <= F.col("limit_rupees") * 100
    n = rows.groupBy("limit_rupees").agg(F.count_if(below).alias("n_below"), F.count_if(~below).alias("n_above"), F.countDistinct(F.when(below, F.col("src"))).alias("senders_below"))
    return spark.createDataFrame([(x,) for x in LIMITS], "limit_rupees int").join(n, "limit_rupees", "left").fillna(0)


def hourly_fee(tx: DataFrame, low: int = 95, high: int = 99, within: int = 3600) -> DataFrame:
    """acct, n_inflows (followed by an outflow within the hour) and n_band: those of which low to high percent left then.

    Rows are dealt by account and slot of time, with the slot after, so that a busy account is cut by time; sums run
    over a window of time and no pair is formed.
    """
    slot = F.floor(F.col("ts_sec") / (within + 1))
    rows = T.sides(tx).select("acct", "is_in", "amount_paise", "ts_sec", slot.alias("own"))
    rows = rows.withColumn("slot", F.explode(F.when(F.col("is_in"), F.array("own")).otherwise(F.array("own", F.col("own") - 1))))
    w = Window.partitionBy("acct", "slot").orderBy("ts_sec").rangeBetween(0, within)
    left = F.when(~F.col("is_in"), F.col("amount_paise"))
    rows = rows.select("acct", "is_in", "amount_paise", F.sum(left).over(w).alias("left")).filter("is_in and left is not null")
    share = (F.col("left") * 100).between(F.col("amount_paise") * low, F.col("amount_paise") * high)
    return rows.groupBy("acct").agg(F.count("*").alias("n_inflows"), F.count_if(share).alias("n_band"))
