"""Links between layers, proven by direction, timing and amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import asof_backward

COLUMNS = ["tx_key", "from_acct", "to_acct", "from_role", "to_role", "link_type", "lag_s", "amount_paise", "share_of_inflow"]


def layer_links(tx: DataFrame, cand: DataFrame, inflows: DataFrame, windows: DataFrame, outflows: DataFrame, profile: dict) -> DataFrame:
    """One row for each transfer that links two layers.

    A flagged first- or second-layer account's outflow counts if an inflow of its episode lies within the role's window
    before it, and it isn't larger than the episode's inflow. A transfer from a payer to a flagged first-layer account
    counts as such.
    """
    senders = cand.filter("is_flagged and cand in ('L1', 'L2')").select("acct", F.col("cand").alias("from_role"))
    w = profile["windows_s"]
    out = outflows.drop("lag_s").join(senders, "acct").withColumns({"lo": F.when(F.col("from_role") == "L1", w["split"][0]).otherwise(w["single"][0]), "hi": F.when(F.col("from_role") == "L1", w["split"][1]).otherwise(w["single"][1])})
    # the last inflow of the episode that came early enough is the nearest that may prove it: no pairs
    near = asof_backward(out.withColumn("_early", F.col("out_ts") - F.col("lo")), inflows.select("acct", "ep", "in_ts"), ["acct", "ep"], "_early", "in_ts", [])
    out = near.withColumn("lag_s", F.col("out_ts") - F.col("in_ts")).filter(F.col("lag_s") <= F.col("hi"))
    receivers = cand.filter("is_flagged or cand = 'L3'").select(F.col("acct").alias("to_acct"), F.col("cand").alias("to_role"))
    kind = F.concat_ws("_", "from_role", "to_role")
    mule = out.join(windows.select("acct", "ep", "in_total"), ["acct", "ep"]).join(receivers, "to_acct").filter("out_amt <= in_total")
    mule = mule.withColumn("link_type", kind).filter(F.col("link_type").isin("L1_L2", "L2_L2", "L2_L3"))
    mule = mule.select(F.col("out_key").alias("tx_key"), F.col("acct").alias("from_acct"), "to_acct", "from_role", "to_role", "link_type", "lag_s", F.col("out_amt").alias("amount_paise"), (F.col("out_amt") / F.col("in_total")).alias("share_of_inflow"))
    payers = cand.filter("cand = 'VICTIM'").select(F.col("acct").alias("src"))
    firsts = cand.filter("is_flagged and cand = 'L1'").select(F.col("acct").alias("dst"))
    paid = tx.join(payers, "src").join(firsts, "dst").select(
        "tx_key", F.col("src").alias("from_acct"), F.col("dst").alias("to_acct"), F.lit("VICTIM").alias("from_role"), F.lit("L1").alias("to_role"), F.lit("VICTIM_L1").alias("link_type"),
        F.lit(None).cast("long").alias("lag_s"), "amount_paise", F.lit(None).cast("double").alias("share_of_inflow"),
    )
    return mule.unionByName(paid).select(*COLUMNS)


def pair_counts(tx: DataFrame, cand: DataFrame, links: DataFrame) -> DataFrame:
    """Transfers and links by the candidate roles of both ends."""
    a, b = cand.select(F.col("acct").alias("src"), F.col("cand").alias("from_cand")), cand.select(F.col("acct").alias("dst"), F.col("cand").alias("to_cand"))
    rows = tx.join(a, "src").join(b, "dst").join(links.select("tx_key", F.lit(1).alias("linked")), "tx_key", "left")
    return rows.groupBy("from_cand", "to_cand").agg(F.count("*").alias("n_tx"), F.count("linked").alias("n_links"))


def check(tx: DataFrame, links: DataFrame, profile: dict) -> DataFrame:
    """Counters over the links, each 0 if they hold against the raw transfers."""
    w = profile["windows_s"]
    j = links.join(tx.select("tx_key", "src", "dst", F.col("amount_paise").alias("raw_amount"), "ts_sec"), "tx_key", "left")
    mule = j.filter("link_type <> 'VICTIM_L1'")
    inflow = tx.select(F.col("dst").alias("src"), F.col("ts_sec").alias("in_ts"))
    proof = mule.withColumn("in_ts", F.col("ts_sec") - F.col("lag_s")).join(inflow, ["src", "in_ts"], "left_semi").select("tx_key")
    lag_ok = F.when(F.col("from_role") == "L1", F.col("lag_s").between(*w["split"])).otherwise(F.col("lag_s").between(*w["single"]))
    counts = j.agg(
        F.count_if(F.col("raw_amount").isNull() | (F.col("raw_amount") != F.col("amount_paise")) | (F.col("src") != F.col("from_acct")) | (F.col("dst") != F.col("to_acct"))).alias("unlike_transfer"),
        F.count_if((F.col("link_type") != "VICTIM_L1") & ~lag_ok).alias("lag_outside_window"),
        F.count_if(F.col("share_of_inflow") > 1).alias("share_over_one"),
    )
    missing = mule.join(proof, "tx_key", "left_anti").agg(F.count("*").alias("lag_without_inflow"))
    return counts.join(missing)  # two single rows
