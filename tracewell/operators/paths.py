"""One path of money from each payment, by preference, and how scores of groups of accounts overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.cut import cut

from .joins import interval_join


def greedy_paths(tx: DataFrame, payments: DataFrame, ends: DataFrame, window: tuple[int, int] = (0, 3600), hops: int = 4) -> DataFrame:
    """start, hop, tx_key, from_acct, to_acct, amount_paise, lag_s: from each payment (tx_key) one transfer at each further hop.

    Of the transfers that its receiver sends within the window and that lead to an account not met before, that to a sender
    of layering transfers, else that to an account that only receives (ends), else the largest; of equals the smallest key.
    """
    row = tx.select("tx_key", F.col("src").alias("from_acct"), F.col("dst").alias("to_acct"), "amount_paise", "ts_sec")
    senders = tx.filter("is_layering").select(F.col("src").alias("to_acct"), F.lit(True).alias("layers")).distinct()
    sinks = ends.select(F.col("acct").alias("to_acct"), F.lit(True).alias("sinks")).distinct()
    out = row.join(senders, "to_acct", "left").join(sinks, "to_acct", "left")
    out = cut(out.select(F.col("from_acct").alias("acct"), F.col("tx_key").alias("next_key"), F.col("to_acct").alias("next_acct"), F.col("amount_paise").alias("sent"), F.col("ts_sec").alias("left"), F.coalesce("layers", F.lit(False)).alias("layers"), F.coalesce("sinks", F.lit(False)).alias("sinks")))
    step = row.join(payments.select("tx_key"), "tx_key", "left_semi").withColumns({"start": F.col("tx_key"), "hop": F.lit(1), "lag_s": F.lit(None).cast("long"), "met": F.array("from_acct", "to_acct")})
    found = step = cut(step)
    for hop in range(2, hops + 1):
        at = step.select("start", F.col("to_acct").alias("acct"), F.col("ts_sec").alias("came"), "met")
        near = interval_join(at, out, ["acct"], "came", "left", *window).filter(~F.array_contains("met", F.col("next_acct")))
        better = F.struct("layers", "sinks", "sent", (-F.col("next_key")).alias("k"))
        best = near.groupBy("start").agg(F.max_by(F.struct("next_key", "acct", "next_acct", "sent", "left", (F.col("left") - F.col("came")).alias("lag_s"), "met"), better).alias("b")).select("start", "b.*")
        step = cut(best.select(
            F.col("next_key").alias("tx_key"), F.col("acct").alias("from_acct"), F.col("next_acct").alias("to_acct"), F.col("sent").alias("amount_paise"), F.col("left").alias("ts_sec"),
            "start", F.lit(hop).alias("hop"), "lag_s", F.concat("met", F.array("next_acct")).alias("met"),
        ))
        found = found.unionByName(step)
    return found.select("start", "hop", "tx_key", "from_acct", "to_acct", "amount_paise", "lag_s")


def spread(rows: DataFrame, group: str, score: str, threshold: float, margin: float) -> DataFrame:
    """group, n, n_scored, low, q1, middle, q3, high, n_flagged, and those within margin of the threshold, flagged or not."""
    x, near = F.col(score), F.abs(F.col(score) - threshold) <= margin
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.count(x).alias("n_scored"), F.min(x).alias("low"), F.percentile(x, F.lit(0.25)).alias("q1"), F.median(x).alias("middle"), F.percentile(x, F.lit(0.75)).alias("q3"), F.max(x).alias("high"),
        F.count_if("is_flagged").alias("n_flagged"), F.count_if(near & ~F.col("is_flagged")).alias("n_near_not_flagged"), F.count_if(near & F.col("is_flagged")).alias("n_near_flagged"),
    )


def overlaps(rows: DataFrame, group: str, score: str) -> DataFrame:
    """a, b, low, high, n_a, n_b of groups whose score ranges meet: the shared range and the rows of each within it.

    Ranges, one row for each group, meet in pairs; rows meet the pairs of their own group alone.
    """
    ranges = cut(rows.filter(F.col(score).isNotNull()).groupBy(group).agg(F.min(score).alias("low"), F.max(score).alias("high")))
    other = ranges.select(F.col(group).alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    # kinds of accounts: a handful of rows, whatever the number of accounts
    pairs = ranges.withColumnRenamed(group, "a").join(F.broadcast(other), (F.col("a") < F.col("b")) & (F.greatest("low", "low_b") <= F.least("high", "high_b")))
    pairs = cut(pairs.select("a", "b", F.greatest("low", "low_b").alias("low"), F.least("high", "high_b").alias("high")))
    side = lambda own: rows.withColumnRenamed(group, own).join(F.broadcast(pairs), own).filter(F.col(score).between(F.col("low"), F.col("high"))).groupBy("a", "b").agg(F.count("*").alias(f"n_{own}"))
    return pairs.join(side("a"), ["a", "b"], "left").join(side("b"), ["a", "b"], "left").fillna(0, ["n_a", "n_b"])
