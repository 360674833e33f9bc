"""Following payers' money: the structural chain, and the pro-rata trace of many payers at once.

Every hop is a join of the money's arrivals with the transfers of the accounts they reached; hops are at most
`max_hops`, so the loop is short and unrolled; each hop's rows are written, so later hops read them and know how many they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.cut import stored

from .joins import interval_join
from .scan import interval_sums, linear_before, pool_before, slots_between


def structural_chain(tx: DataFrame, payers: DataFrame, profile: dict) -> DataFrame:
    """victim, hop, tx_key: payments of the payers (acct), then each transfer that leaves in time after one of the chain.

    Second hop: the split window; later hops: the single window.
    """
    row = tx.select("tx_key", "src", "dst", "ts_sec")
    step = row.join(payers.select(F.col("acct").alias("src")), "src").select(F.col("src").alias("victim"), F.lit(1).alias("hop"), "tx_key", F.col("dst").alias("src"), F.col("ts_sec").alias("arrived"))
    found = step = stored(step)
    leave = row.select("src", F.col("tx_key").alias("next_key"), F.col("dst").alias("next_dst"), F.col("ts_sec").alias("left"))
    for hop in range(2, profile["trace"]["max_hops"] + 1):
        low, high = profile["windows_s"]["split" if hop == 2 else "single"]
        step = interval_join(step.select("victim", "src", "arrived"), leave, ["src"], "arrived", "left", low, high)
        step = stored(step.select("victim", F.lit(hop).alias("hop"), F.col("next_key").alias("tx_key"), F.col("next_dst").alias("src"), F.col("left").alias("arrived")).distinct())
        found = found.unionByName(step)
    return found.select("victim", "hop", "tx_key")


def edge_scores(tx: DataFrame, features: DataFrame, payments: DataFrame, profile: dict) -> DataFrame:
    """tx_key, onward, downstream, first_time, anomaly, burst, edge_score (0 to 100) of payments, which are rows of tx.

    onward: the share of the payment that its receiver sent on in time; downstream: the share of that money whose next
    receiver moved any on in time; first_time: no earlier payment of the pair; anomaly and burst: 1, 0.5 or 0 by cut-offs.
    """
    t, (low, high) = profile["trace"], profile["windows_s"]["single"]
    paid = payments.select("tx_key", "src", "dst", "ts_sec", "amount_paise", "is_layering")
    receivers = paid.select(F.col("dst").alias("src")).distinct()
    sent = stored(tx.select("tx_key", "src", "dst", "ts_sec", "amount_paise").join(receivers, "src", "left_semi"))
    movers = tx.select(F.col("src").alias("acct"), F.col("ts_sec").alias("ts"), F.lit(1).alias("n")).join(sent.select(F.col("dst").alias("acct")).distinct(), "acct", "left_semi")
    moved = interval_sums(sent.select(F.col("tx_key").alias("id"), F.col("dst").alias("acct"), F.col("ts_sec").alias("ts")), movers, ["acct"], low, high, ["n"])
    points = sent.join(moved.select(F.col("id").alias("tx_key"), "n"), "tx_key").select(F.col("src").alias("acct"), F.col("ts_sec").alias("ts"), F.col("amount_paise").alias("sent"), F.when(F.col("n") > 0, F.col("amount_paise")).otherwise(0).alias("again"))
    onward = interval_sums(paid.select(F.col("tx_key").alias("id"), F.col("dst").alias("acct"), F.col("ts_sec").alias("ts")), points, ["acct"], low, high, ["sent", "again"])
    pairs = tx.join(paid.select("src", "dst").distinct(), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("ts_sec").alias("first_ts"))
    middle = tx.agg(F.median("amount_paise").alias("middle"))
    step = lambda x, cuts: F.lit(0.0) if cuts is None else F.when(x >= cuts[0], 1.0).when(x >= cuts[1], 0.5).otherwise(0.0)
    rows = paid.join(onward.select(F.col("id").alias("tx_key"), "sent", "again"), "tx_key").join(pairs, ["src", "dst"])
    rows = rows.join(features.select(F.col("acct").alias("dst"), "burst_fan_in"), "dst", "left").join(F.broadcast(middle))  # one row
    big = profile["mule"]["MP8"]
    parts = {
        "onward": F.when(F.col("amount_paise") > 0, F.least(F.lit(1.0), F.col("sent") / F.col("amount_paise"))).otherwise(0.0),
        "downstream": F.when(F.col("sent") > 0, F.col("again") / F.col("sent")).otherwise(0.0),
        "first_time": F.col("ts_sec") <= F.col("first_ts"),
        "anomaly": F.coalesce(step(F.try_divide("amount_paise", "middle"), (big["full"], big["half"])), F.lit(0.0)),
        "burst": F.coalesce(step(F.col("burst_fan_in"), t["burst"]), F.lit(0.0)),
    }
    w = t["edge_weights"]
    score = w["onward"] * F.col("onward") + w["burst"] * F.col("burst") + F.when(F.col("first_time"), w["anomaly"] * F.col("anomaly")).otherwise(0.0) + w["downstream"] * F.col("downstream") + F.when(F.col("is_layering"), w["layering"]).otherwise(0)
    return rows.withColumns(parts).select("tx_key", *parts, F.round(score, 2).alias("edge_score"))


def _first_hop(tx: DataFrame, out: DataFrame, payers: DataFrame, features: DataFrame, profile: dict) -> DataFrame:
    """The payers' payments that are followed: linked ones; without any, those to flagged accounts; without any, the best by edge score."""
    paid = out.join(payers.select(F.col("acct").alias("src")).distinct(), "src")
    rule = paid.groupBy("src").agg(F.bool_or("linked").alias("any_link"), F.bool_or("is_flagged").alias("any_flag"))
    paid = stored(paid.join(rule, "src"))
    known = paid.filter(F.when(F.col("any_link"), F.col("linked")).otherwise(F.col("is_flagged"))).withColumn("edge_score", F.lit(None).cast("double"))
    open_ = paid.filter("not any_link and not any_flag")
    if not open_.isEmpty():
        scores = edge_scores(tx, features, tx.join(open_.select("tx_key"), "tx_key", "left_semi"), profile)
        open_ = stored(open_.join(scores.select("tx_key", "edge_score"), "tx_key"))
        best = open_.groupBy("src").agg(F.max("edge_score").alias("best"))
        known = known.unionByName(open_.join(best, "src").filter("edge_score = best and edge_score > 0").drop("best"))
    return stored(known.select(
        F.col("src").alias("victim"), F.lit(1).alias("hop"), "tx_key", F.col("src").alias("from_acct"), F.col("dst").alias("to_acct"), "ts_sec", "amount_paise",
        F.col("amount_paise").cast("double").alias("tainted"), F.when(F.col("linked"), "layer_link").otherwise("fallback").alias("via"), F.lit(False).alias("untraced"), "edge_score",
    ))


def _choice(arrived: DataFrame, out: DataFrame, role: DataFrame, profile: dict) -> DataFrame:
    """victim, acct, out_key, follow, any_link, sender, t0, t1 of each transfer that leaves in time after an arrival."""
    w = profile["windows_s"]
    leave = out.select(F.col("src").alias("acct"), F.col("tx_key").alias("out_key"), F.col("ts_sec").alias("left"), "amount_paise", "linked", "is_flagged", "final_index")
    near = interval_join(arrived.join(role, "acct", "left").select("victim", "acct", "at", "sender"), leave, ["acct"], "at", "left", *w["single"])
    gap = F.col("left") - F.col("at")
    proven = F.col("linked") & F.when(F.col("sender") == "L1", gap.between(*w["split"])).otherwise(F.col("sender").isNotNull() & gap.between(*w["single"]))
    near = near.groupBy("victim", "acct", "out_key").agg(F.max(proven).alias("proven"), *(F.first(c).alias(c) for c in ("left", "amount_paise", "is_flagged", "final_index", "sender")))
    own = Window.partitionBy("victim", "acct")
    near = near.withColumn("any_link", F.max("proven").over(own))
    held = arrived.groupBy("victim", "acct").agg(F.min("at").alias("t0"), F.max("at").alias("t1"), F.sum("tainted").alias("held"))
    near = near.join(held, ["victim", "acct"])
    to_flagged = F.sum(F.when(F.col("is_flagged"), F.col("amount_paise")).otherwise(0)).over(own)
    by_score = own.orderBy("is_flagged", F.desc("final_index"), F.desc("amount_paise"), "out_key").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumns({"target": profile["trace"]["coverage"] * (F.col("held") - to_flagged), "before": F.coalesce(F.sum("amount_paise").over(by_score), F.lit(0))})
    covers = F.col("is_flagged") | ((F.col("target") > 0) & (F.col("before") < F.col("target")))
    return near.withColumn("follow", F.when(F.col("any_link"), F.col("proven")).otherwise(covers)).select("victim", "acct", "out_key", "follow", "any_link", "sender", "t0", "t1")


def carried(groups: DataFrame, arrived: DataFrame, tx: DataFrame, width: int) -> DataFrame:
    """victim, acct, tx_key, tainted: each outflow's share of the tainted money, pro rata of what the account's pool then holds.

    groups: victim, acct, t0, end. Within that time every inflow of the account fills the pool (arrived: victim, acct,
    in_key, tainted carry taint), and an outflow takes from it, with as much of the taint as it takes of the pool.
    Events at one time: inflows first, then by amount. Events are met, and the pool and the taint carried, slot by slot.
    """
    side = lambda acct, kind: tx.select(F.col(acct).alias("acct"), "tx_key", "ts_sec", "amount_paise", F.lit(kind).alias("kind"), F.floor(F.col("ts_sec") / width).alias("slot"))
    spans = stored(groups.select("victim", "acct", "t0", "end", slots_between(F.col("t0"), F.col("end"), width).alias("slot")))
    events = spans.join(side("dst", 0).unionByName(side("src", 1)), ["acct", "slot"]).filter(F.col("ts_sec").between(F.col("t0"), F.col("end"))).drop("t0", "end")
    taint = arrived.select("victim", "acct", F.col("in_key").alias("tx_key"), F.lit(0).alias("kind"), "tainted")
    events = events.join(taint, ["victim", "acct", "tx_key", "kind"], "left").withColumn("change", F.when(F.col("kind") == 0, F.col("amount_paise")).otherwise(-F.col("amount_paise")))
    order = ["ts_sec", "kind", "amount_paise", "tx_key"]
    events = pool_before(events, ["victim", "acct"], "slot", order, "change", "pool")
    taken = F.least("amount_paise", "pool")
    events = events.withColumn("taken", F.when((F.col("kind") == 1) & (F.col("pool") > 0), taken / F.col("pool")).otherwise(0.0))
    events = events.withColumns({"keeps": 1 - F.col("taken"), "brings": F.coalesce("tainted", F.lit(0.0))}).drop("tainted")
    events = linear_before(events, ["victim", "acct"], "slot", order, "keeps", "brings", "taint")
    return events.filter("kind = 1").select("victim", "acct", "tx_key", (F.col("taken") * F.col("taint")).alias("tainted")).filter("tainted > 0")


def trace(tx: DataFrame, payers: DataFrame, scored: DataFrame, links: DataFrame, profile: dict) -> DataFrame:
    """victim, hop, tx_key, from_acct, to_acct, ts_sec, amount_paise, tainted, via, untraced, edge_score of all payers' money.

    Rows with `untraced` true are shares that left on transfers which the trace doesn't follow. scored holds every
    account's features, score and role. First hop: see `_first_hop`. Then linked transfers inside the sender's window
    after an arrival; an account without any: transfers within the single window, all to flagged receivers, and others by
    score and amount until the coverage target is met. An account reached again at a later hop passes on the new arrivals alone.
    """
    t, w = profile["trace"], profile["windows_s"]
    row = tx.select("tx_key", "src", "dst", "ts_sec", "amount_paise")
    linked = links.select("tx_key", F.lit(True).alias("linked"))
    judged = scored.select(F.col("acct").alias("dst"), "is_flagged", "final_index")
    out = stored(row.join(linked, "tx_key", "left").join(judged, "dst").withColumn("linked", F.coalesce("linked", F.lit(False))))
    role = links.filter("from_role in ('L1', 'L2')").groupBy(F.col("from_acct").alias("acct")).agg(F.min("from_role").alias("sender"))
    ends = scored.filter("is_receive_only").select("acct")
    found = step = _first_hop(tx, out, payers, scored, profile)
    for hop in range(2, t["max_hops"] + 1):
        arrived = step.filter("not untraced").select("victim", F.col("to_acct").alias("acct"), F.col("ts_sec").alias("at"), "tainted", F.col("tx_key").alias("in_key"))
        arrived = stored(arrived.join(ends, "acct", "left_anti"))
        if arrived.isEmpty():
            break
        follow = stored(_choice(arrived, out, role, profile))
        group = follow.groupBy("victim", "acct", "t0", "t1").agg(F.max("any_link").alias("any_link"), F.max("sender").alias("sender"))
        end = F.col("t1") + F.when(F.col("any_link") & (F.col("sender") == "L1"), w["split"][1]).otherwise(w["single"][1])
        group = group.withColumn("end", end)
        shares = carried(group, arrived, row, t["slot_s"]).join(group.select("victim", "acct", "any_link"), ["victim", "acct"])
        shares = shares.join(follow.filter("follow").select("victim", "acct", F.col("out_key").alias("tx_key"), F.lit(True).alias("follow")), ["victim", "acct", "tx_key"], "left")
        step = shares.join(row.select("tx_key", F.col("dst").alias("to_acct"), "ts_sec", "amount_paise"), "tx_key").select(
            "victim", F.lit(hop).alias("hop"), "tx_key", F.col("acct").alias("from_acct"), "to_acct", "ts_sec", "amount_paise", "tainted",
            F.when(F.col("any_link"), "layer_link").otherwise("fallback").alias("via"), (F.col("follow").isNull() | (F.col("tainted") < 0.5)).alias("untraced"), F.lit(None).cast("double").alias("edge_score"),
        )
        step = stored(step)
        found = found.unionByName(step)
    return found


def trace_accounts(traced: DataFrame) -> DataFrame:
    """victim, acct, hop, tainted_in, tainted_out, untraced_out, holding of every account that the money reached."""
    into = traced.filter("not untraced").groupBy("victim", F.col("to_acct").alias("acct")).agg(F.min("hop").alias("hop"), F.sum("tainted").alias("tin"))
    out = traced.groupBy("victim", F.col("from_acct").alias("acct")).agg(F.sum(F.when(~F.col("untraced"), F.col("tainted")).otherwise(0.0)).alias("tout"), F.sum(F.when(F.col("untraced"), F.col("tainted")).otherwise(0.0)).alias("lost"))
    j = into.join(out, ["victim", "acct"], "left").fillna(0.0, ["tout", "lost"])
    whole = lambda c: F.round(c).cast("long")
    held = F.greatest(whole(F.col("tin") - F.col("tout") - F.col("lost")), F.lit(0).cast("long"))
    return j.select("victim", "acct", "hop", whole(F.col("tin")).alias("tainted_in"), whole(F.col("tout")).alias("tainted_out"), whole(F.col("lost")).alias("untraced_out"), held.alias("holding"))


def reconcile(traced: DataFrame, accounts: DataFrame) -> DataFrame:
    """victim, paid, kept, untraced, gap: what was paid is kept somewhere or left untraced, up to rounding."""
    paid = traced.filter("hop = 1").groupBy("victim").agg(F.sum("amount_paise").alias("paid"))
    kept = accounts.groupBy("victim").agg(F.sum("holding").alias("kept"), F.sum("untraced_out").alias("untraced"))
    return paid.join(kept, "victim").withColumn("gap", F.col("paid") - F.col("kept") - F.col("untraced"))


def per_hop(traced: DataFrame) -> DataFrame:
    rows = traced.filter("not untraced")
    return rows.groupBy("hop").agg(F.count("*").alias("n_transfers"), F.countDistinct("victim").alias("n_victims"), F.countDistinct("to_acct").alias("n_accounts"), F.round(F.sum("tainted")).cast("long").alias("tainted"))
