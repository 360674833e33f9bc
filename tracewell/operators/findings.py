"""What a set of traces shows: patterns of each payer's money, hops, accounts to freeze, and all payers' traces as one graph.

Every function takes the rows of `trace.trace`. Payers are keys throughout, so all their graphs are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.cut import cut

from . import graph as G

STOPS = ("receive_only", "max_hops", "no_onward_transfer_in_window", "no_payment_with_l1_edge_score", "no_outgoing_transfers")


def followed(traced: DataFrame) -> DataFrame:
    return traced.filter("not untraced")


def whole(c) -> F.Column:
    return F.round(c).cast("long")


def stopped(traced: DataFrame, features: DataFrame, max_hops: int) -> DataFrame:
    """victim, acct, stopped: why the money that reached an account is not followed further; null where it is."""
    came = followed(traced).groupBy("victim", F.col("to_acct").alias("acct"), "hop").agg(F.lit(1).alias("one"))
    went = followed(traced).select("victim", F.col("from_acct").alias("acct"), (F.col("hop") - 1).alias("hop"), F.lit(True).alias("went")).distinct()
    ends = features.filter("is_receive_only").select("acct", F.lit(True).alias("end"))
    rows = came.join(went, ["victim", "acct", "hop"], "left").join(ends, "acct", "left").groupBy("victim", "acct")
    rows = rows.agg(F.bool_or(F.coalesce("end", F.lit(False))).alias("end"), F.bool_or(F.col("hop") >= max_hops).alias("far"), F.bool_or(F.col("went").isNull()).alias("dry"))
    return rows.select("victim", "acct", F.when(F.col("end"), STOPS[0]).when(F.col("far"), STOPS[1]).when(F.col("dry"), STOPS[2]).alias("stopped"))


def payers(traced: DataFrame, accounts: DataFrame, start: DataFrame, tx: DataFrame) -> DataFrame:
    """One row for each payer of `start` (acct): what it paid, what of that is followed, where it lies, and why nothing was followed."""
    paid = start.select(F.col("acct").alias("victim")).distinct().join(tx.groupBy(F.col("src").alias("victim")).agg(F.count("*").alias("n_out"), F.sum("amount_paise").alias("sent")), "victim", "left")
    rows = followed(traced).groupBy("victim").agg(
        F.count_if(F.col("hop") == 1).alias("n_followed"), F.coalesce(F.sum(F.when(F.col("hop") == 1, F.col("amount_paise"))), F.lit(0)).alias("paid"),
        F.count("*").alias("transfers"), F.max("hop").alias("hops"), F.bool_or(F.col("via") == "fallback").alias("used_fallback"), F.bool_or(F.col("edge_score").isNotNull()).alias("low_confidence"),
    )
    held = accounts.groupBy("victim").agg(F.count("*").alias("accounts"), F.sum("holding").alias("holding"), F.sum("untraced_out").alias("untraced"))
    j = paid.join(rows, "victim", "left").join(held, "victim", "left").fillna(0, ["n_out", "sent", "n_followed", "paid", "transfers", "hops", "accounts", "holding", "untraced"]).fillna(False, ["used_fallback", "low_confidence"])
    why = F.when(F.col("n_out") == 0, STOPS[4]).when(F.col("n_followed") == 0, STOPS[3])
    return j.select("victim", "paid", (F.col("n_out") - F.col("n_followed")).alias("n_not_followed"), (F.col("sent") - F.col("paid")).alias("not_followed"), "transfers", "hops", "accounts", "holding", "untraced", "used_fallback", "low_confidence", why.alias("stopped"))


def hops(traced: DataFrame) -> DataFrame:
    """victim, hop, n_accounts (first reached there), n_transfers, tainted, first_ts, last_ts, seconds since the hop before began."""
    rows = followed(traced)
    first = rows.groupBy("victim", "to_acct").agg(F.min("hop").alias("hop")).groupBy("victim", "hop").agg(F.count("*").alias("n_accounts"))
    each = rows.groupBy("victim", "hop").agg(F.count("*").alias("n_transfers"), whole(F.sum("tainted")).alias("tainted"), F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"))
    w = Window.partitionBy("victim").orderBy("hop")
    each = each.withColumn("seconds_since", F.col("first_ts") - F.lag("first_ts").over(w))
    return each.join(first, ["victim", "hop"], "left").fillna(0, ["n_accounts"])


def cycle_pairs(traced: DataFrame) -> DataFrame:
    """victim, acct of the accounts on a directed cycle of one payer's transfers; strong parts of all payers' graphs at once."""
    end = lambda c: F.struct("victim", F.col(c).alias("acct"))
    found = G.cycle_accounts(followed(traced).select(end("from_acct").alias("from_acct"), end("to_acct").alias("to_acct")))
    return found.select("acct.victim", "acct.acct")


def _cases(traced: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame]:
    """(victim, pattern, case, tx_key) and (victim, pattern, acct): the transfers and accounts of every finding."""
    rows = cut(followed(traced).select("victim", "hop", "tx_key", F.col("from_acct").alias("a"), F.col("to_acct").alias("b"), "ts_sec", "tainted"))
    into, out = rows.withColumn("at", F.col("b")), rows.withColumn("at", F.col("a"))
    rings, window = profile["rings"], max(hi for _, hi in profile["windows_s"].values())
    later = out.filter("a <> victim")
    # rapid pass-through: most of the money left again in time
    came = into.groupBy("victim", "at").agg(F.sum("tainted").alias("came"), F.min("ts_sec").alias("first_in"))
    went = later.groupBy("victim", "at").agg(F.sum("tainted").alias("went"), F.max("ts_sec").alias("last_out"), F.countDistinct("b").alias("n_to"))
    both = cut(came.join(went, ["victim", "at"]))
    rapid = both.filter((F.col("went") >= profile["override"]["forwarded"] * F.col("came")) & (F.col("last_out") - F.col("first_in")).between(0, window)).select("victim", "at")
    # split over several receivers; money of several senders that aren't the payer
    scatter = both.filter(F.col("n_to") >= profile["receivers"]["split"][0]).select("victim", "at")
    legs = into.filter("a <> victim")
    funnel = legs.groupBy("victim", "at").agg(F.countDistinct("a").alias("n")).filter(F.col("n") >= rings["funnel_min"]).select("victim", "at")
    # one account's money meets again at another after several in between; the extreme times of a pair of accounts decide
    one = later.groupBy("victim", "a", F.col("b").alias("mid")).agg(F.min("ts_sec").alias("t1"))
    two = later.groupBy("victim", F.col("a").alias("mid"), F.col("b").alias("target")).agg(F.max("ts_sec").alias("t2"))
    via = cut(one.join(two, ["victim", "mid"]).filter("t2 >= t1"))
    meet = via.groupBy("victim", "a", "target").agg(F.count("*").alias("n")).filter(F.col("n") >= rings["scatter_min"]).select("victim", "a", "target")
    via = cut(via.join(meet, ["victim", "a", "target"]))
    path = F.concat_ws(">", "origin", "target")
    firsts = rows.join(via.select("victim", "a", F.col("a").alias("origin"), F.col("mid").alias("b"), "target", "t2"), ["victim", "a", "b"]).filter("ts_sec <= t2").select("victim", path.alias("case"), "tx_key")
    seconds = rows.join(via.select("victim", F.col("a").alias("origin"), F.col("mid").alias("a"), F.col("target").alias("b"), "target", "t1"), ["victim", "a", "b"]).filter("ts_sec >= t1").select("victim", path.alias("case"), "tx_key")
    loop = cut(cycle_pairs(traced))
    ring = rows.join(loop.select("victim", F.col("acct").alias("a")), ["victim", "a"]).join(loop.select("victim", F.col("acct").alias("b")), ["victim", "b"])
    of = lambda at, side: side.join(at, ["victim", "at"]).select("victim", F.col("at").cast("string").alias("case"), "tx_key")
    used = {
        "RAPID_PASS_THROUGH": of(rapid, into).unionByName(of(rapid, out)),
        "SCATTER": of(scatter, out),
        "FUNNEL": of(funnel, legs),
        "SCATTER_GATHER": firsts.unionByName(seconds).distinct(),
        "CYCLE": ring.select("victim", F.lit("cycle").alias("case"), "tx_key"),
    }
    whom = lambda df, *cs: df.select("victim", F.explode(F.array(*cs)).alias("acct"))
    named = {
        "RAPID_PASS_THROUGH": whom(rapid, "at"),
        "SCATTER": whom(out.join(scatter, ["victim", "at"]), "a", "b"),
        "FUNNEL": whom(legs.join(funnel, ["victim", "at"]), "a", "b"),
        "SCATTER_GATHER": whom(via, "a", "mid", "target"),
        "CYCLE": loop.select("victim", "acct"),
    }
    return _stacked(used), _stacked(named).distinct()


def _stacked(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for pattern, df in parts.items():
        df = df.withColumn("pattern", F.lit(pattern))
        out = df if out is None else out.unionByName(df)
    return out


def findings(traced: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame]:
    """(one row for each payer and pattern; its transfers: victim, pattern, tx_key).

    n_cases, n_accounts, n_transfers, tainted, hop_from, hop_to, confidence: high if every transfer is a proven link, low if
    one was chosen by its edge score, medium otherwise.
    """
    used, named = _cases(traced, profile)
    used = cut(used)
    rows = used.select("victim", "pattern", "tx_key").distinct()
    # a transfer may carry a payer's money at several hops
    each = followed(traced).groupBy("victim", "tx_key").agg(F.min("hop").alias("low"), F.max("hop").alias("high"), F.sum("tainted").alias("tainted"), F.bool_and(F.col("via") == "layer_link").alias("proven"), F.bool_or(F.col("edge_score").isNotNull()).alias("guessed"))
    summed = rows.join(each, ["victim", "tx_key"]).groupBy("victim", "pattern").agg(
        F.count("*").alias("n_transfers"), whole(F.sum("tainted")).alias("tainted"), F.min("low").alias("hop_from"), F.max("high").alias("hop_to"),
        F.when(F.bool_or("guessed"), "low").when(F.bool_and("proven"), "high").otherwise("medium").alias("confidence"),
    )
    cases = used.groupBy("victim", "pattern").agg(F.countDistinct("case").alias("n_cases"))
    people = named.groupBy("victim", "pattern").agg(F.count("*").alias("n_accounts"))
    return summed.join(cases, ["victim", "pattern"]).join(people, ["victim", "pattern"]), rows


def freeze(traced: DataFrame, accounts: DataFrame, roles: DataFrame) -> DataFrame:
    """victim, acct, role, hop, holding, tainted_in, n_receipts, received, first_ts, last_ts, place: accounts to freeze that hold
    the payer's money, the most first, with the transfers that prove it in sum."""
    keep = accounts.filter("holding > 0").join(roles.filter("freeze_recommended").select("acct", "role"), "acct")
    proof = followed(traced).groupBy("victim", F.col("to_acct").alias("acct")).agg(F.countDistinct("tx_key").alias("n_receipts"), F.sum("amount_paise").alias("received"), F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"))
    w = Window.partitionBy("victim").orderBy(F.desc("holding"), "acct")
    return keep.join(proof, ["victim", "acct"]).withColumn("place", F.row_number().over(w)).select("victim", "acct", "role", "hop", "holding", "tainted_in", "n_receipts", "received", "first_ts", "last_ts", "place")


def merged_transfers(traced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All payers' traces as one graph: (one row for each transfer; each payer's part of it).

    Parts are whole paise, rounded before they are added up, so a transfer's parts sum to what it carries. A transfer that
    carries one payer's money at several hops is one part.
    """
    part = followed(traced).groupBy("tx_key", "victim").agg(F.min("hop").alias("hop"), F.sum(whole(F.col("tainted"))).alias("tainted"), F.first("from_acct").alias("from_acct"), F.first("to_acct").alias("to_acct"), F.first("amount_paise").alias("amount_paise"))
    part = cut(part)
    total = part.groupBy("tx_key").agg(F.min("hop").alias("hop"), F.first("from_acct").alias("from_acct"), F.first("to_acct").alias("to_acct"), F.first("amount_paise").alias("amount_paise"), F.sum("tainted").alias("tainted"), F.count("*").alias("n_victims"))
    shares = part.join(total.select("tx_key", F.col("tainted").alias("all")), "tx_key")
    return total, shares.select("tx_key", "victim", "tainted", F.when(F.col("all") > 0, F.round(F.col("tainted") / F.col("all"), 4)).alias("share"))


AMOUNTS = ("tainted_in", "tainted_out", "untraced_out", "holding")


def merged_accounts(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each account with the sums over payers; each payer's part, with its share of what came in)."""
    total = accounts.groupBy("acct").agg(F.min("hop").alias("hop"), *(F.sum(a).alias(a) for a in AMOUNTS), F.count("*").alias("n_victims"))
    parts = accounts.join(total.select("acct", F.col("tainted_in").alias("all")), "acct")
    return total, parts.select("acct", "victim", *AMOUNTS, F.when(F.col("all") > 0, F.round(F.col("tainted_in") / F.col("all"), 4)).alias("share_of_tainted_in"))


def payments_into(starts: DataFrame, tx: DataFrame, links: DataFrame, roles: DataFrame) -> DataFrame:
    """l1, victim, tx_key, ts_sec, amount_paise, via: payers' payments into first-layer accounts (l1), told backwards.

    Linked ones; an account without any: those of accounts with the role of a payer.
    """
    into = tx.select("tx_key", "src", F.col("dst").alias("l1"), "ts_sec", "amount_paise").join(starts.select("l1").distinct(), "l1")
    into = into.join(links.filter("link_type = 'VICTIM_L1'").select("tx_key", F.lit(True).alias("linked")), "tx_key", "left")
    into = into.join(roles.filter("role = 'VICTIM'").select(F.col("acct").alias("src"), F.lit(True).alias("payer")), "src", "left")
    known = into.groupBy("l1").agg(F.bool_or(F.col("linked").isNotNull()).alias("any_link"))
    rows = into.join(known, "l1").filter(F.when(F.col("any_link"), F.col("linked").isNotNull()).otherwise(F.col("payer").isNotNull()))
    return rows.select("l1", F.col("src").alias("victim"), "tx_key", "ts_sec", "amount_paise", F.when(F.col("any_link"), "layer_link").otherwise("fallback").alias("via"))


def reverse(starts: DataFrame, key: str, tx: DataFrame, links: DataFrame, roles: DataFrame) -> DataFrame:
    """key, victim, amount, n_payments, n_l1, first_ts, last_ts: from the first-layer accounts of a cell or network back to its payers."""
    paid = payments_into(starts, tx, links, roles).join(starts.select(key, "l1"), "l1")
    return paid.groupBy(key, "victim").agg(F.sum("amount_paise").alias("amount"), F.count("*").alias("n_payments"), F.countDistinct("l1").alias("n_l1"), F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"))


def cell_summary(cells: DataFrame, people: DataFrame, payers: DataFrame, roles: DataFrame) -> DataFrame:
    """One row for each cell: payers and what they paid, its accounts by role, what it holds, and what is to be frozen.

    people: l1, acct, cell_id of the cells' accounts; payers: `reverse` by cell_id.
    """
    own = people.join(roles.select("acct", F.col("role").alias("own_role"), "freeze_recommended", "holding_paise"), "acct", "left").filter("own_role is null or own_role <> 'VICTIM'")
    by_role = [F.count_if(F.coalesce("own_role", F.lit("NONE")) == r).alias(f"n_{r.lower()}") for r in ("L1", "L2", "L3", "UNCLASSIFIED_MULE", "NONE")]
    frozen = F.coalesce("freeze_recommended", F.lit(False))
    mules = own.groupBy("cell_id").agg(F.count("*").alias("mules"), *by_role, F.count_if(frozen).alias("n_freeze"), F.coalesce(F.sum(F.when(frozen, F.col("holding_paise"))), F.lit(0)).alias("freeze_holding"))
    paid = payers.groupBy("cell_id").agg(F.count("*").alias("n_payers"), F.sum("amount").alias("total_in"))
    rows = cells.select("cell_id", "l1", "network_id", "holding_paise", "first_ts", "last_ts").join(mules, "cell_id", "left").join(paid, "cell_id", "left")
    return rows.fillna(0, ["mules", "n_l1", "n_l2", "n_l3", "n_unclassified_mule", "n_none", "n_freeze", "freeze_holding", "n_payers", "total_in"])
