"""Networks of linked accounts: components, cycles, reach, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.cut import cut

from .audit import ranked


def components(links: DataFrame) -> DataFrame:
    """acct, label: the smallest account that it is linked with, directly or not.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of a chain.
    """
    edge = links.select(F.col("from_acct").alias("a"), F.col("to_acct").alias("b"))
    edge = cut(edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(edge.groupBy(F.col("a").alias("acct")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = edge.join(label.select(F.col("acct").alias("b"), "label"), "b").groupBy(F.col("a").alias("acct")).agg(F.min("label").alias("near"))
        low = label.join(near, "acct").select("acct", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("acct").alias("low"), F.col("label").alias("jump"))
        step = cut(low.join(jump, "low").select("acct", F.least("low", "jump").alias("new"), "label"))
        if step.filter("new <> label").isEmpty():
            return step.select("acct", "label")
        label = step.select("acct", F.col("new").alias("label"))


def cycle_accounts(links: DataFrame) -> DataFrame:
    """acct of every account on a directed cycle of links.

    Accounts without an incoming or an outgoing edge are trimmed until none is left to trim; then each remaining round
    takes, for every account, the smallest account that reaches it and the smallest that it reaches within its colour;
    where both agree lies a strongly connected part, and the rest goes on with both as its colour.
    """
    edge = cut(links.select(F.col("from_acct").alias("a"), F.col("to_acct").alias("b")).distinct())
    loops = edge.filter("a = b").select(F.col("a").alias("acct"))
    edge = edge.filter("a <> b")
    found = loops
    n = edge.count()
    while n:
        # trim
        live = edge.select(F.col("a").alias("acct")).intersect(edge.select(F.col("b").alias("acct")))
        left = cut(edge.join(live.withColumnRenamed("acct", "a"), "a", "left_semi").join(live.withColumnRenamed("acct", "b"), "b", "left_semi").select("a", "b"))
        m = left.count()
        if m < n:
            edge, n = left, m
            continue
        node = edge.select(F.col("a").alias("acct")).union(edge.select("b")).distinct()
        ahead, back = _smallest(edge, node), _smallest(edge.select(F.col("b").alias("a"), F.col("a").alias("b")), node)
        both = cut(ahead.withColumnRenamed("low", "x").join(back.withColumnRenamed("low", "y"), "acct"))
        strong = both.filter("x = y")
        # every account left has edges both ways; parts of one account alone are on no cycle
        size = strong.groupBy("x").count().filter("count > 1").select("x")
        found = found.union(strong.join(size, "x", "left_semi").select("acct"))
        rest = both.filter("x <> y").select("acct", "x", "y")
        a = rest.select(F.col("acct").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = rest.select(F.col("acct").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"))
        edge = cut(edge.join(a, "a").join(b, "b").filter("ax = bx and ay = by_").select("a", "b"))
        n = edge.count()
    return found.distinct()


def _smallest(edge: DataFrame, node: DataFrame) -> DataFrame:
    """acct, low: the smallest account from which it is reached along the edges, itself included."""
    low = cut(node.select("acct", F.col("acct").alias("low")))
    while True:
        sent = edge.join(low.withColumnRenamed("acct", "a"), "a").groupBy(F.col("b").alias("acct")).agg(F.min("low").alias("sent"))
        step = cut(low.join(sent, "acct", "left").select("acct", F.least("low", "sent").alias("new"), "low"))
        if step.filter("new <> low").isEmpty():
            return step.select("acct", "low")
        low = step.select("acct", F.col("new").alias("low"))


def members(links: DataFrame, comp: DataFrame, roles: DataFrame) -> DataFrame:
    """label, acct, is_victim, role, role_confirmed, holding of every linked account."""
    into = links.groupBy(F.col("to_acct").alias("acct")).agg(F.sum("amount_paise").alias("i"))
    out = links.groupBy(F.col("from_acct").alias("acct")).agg(F.sum("amount_paise").alias("o"), F.bool_or(F.col("from_role") == "VICTIM").alias("v"))
    j = comp.join(into, "acct", "left").join(out, "acct", "left").join(roles.select("acct", "role", "role_confirmed"), "acct", "left")
    held = F.greatest(F.coalesce("i", F.lit(0)) - F.coalesce("o", F.lit(0)), F.lit(0))
    return j.select("label", "acct", F.coalesce("v", F.lit(False)).alias("is_victim"), "role", F.coalesce("role_confirmed", F.lit(False)).alias("role_confirmed"), held.alias("holding"))


def _patterns(links: DataFrame, key: str, cycles: DataFrame, profile: dict) -> DataFrame:
    """key, patterns. links carry the key; cycles has the keys with an account on a cycle."""
    r = profile["rings"]
    mule = links.filter("link_type <> 'VICTIM_L1'")
    one = mule.select(key, F.col("from_acct").alias("origin"), F.col("to_acct").alias("mid"), F.col("ts_sec").alias("t1"))
    two = links.select(key, F.col("from_acct").alias("mid"), F.col("to_acct").alias("target"), F.col("ts_sec").alias("t2"))
    # the earliest first leg and the latest second leg of a pair decide whether any of its paths keeps to time
    one = one.groupBy(key, "origin", "mid").agg(F.min("t1").alias("t1"))
    two = two.groupBy(key, "mid", "target").agg(F.max("t2").alias("t2"))
    scatter = one.join(two, [key, "mid"]).filter("t2 >= t1").groupBy(key, "origin", "target").count().filter(F.col("count") >= r["scatter_min"]).select(key).distinct()
    funnel = mule.groupBy(key, "to_acct").agg(F.countDistinct("from_acct").alias("n")).filter(F.col("n") >= r["funnel_min"]).select(key).distinct()
    named = [(scatter, "SCATTER_GATHER", 1), (funnel, "FUNNEL", 2), (cycles.select(key).distinct(), "CYCLE", 3)]
    rows = [d.select(key, F.struct(F.lit(i).alias("i"), F.lit(n).alias("name")).alias("p")) for d, n, i in named]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(key).agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["name"]).alias("patterns"))


def _stats(member: DataFrame, links: DataFrame, key: str) -> DataFrame:
    own = ~F.col("is_victim")
    people = member.groupBy(key).agg(
        F.count_if(own).alias("size"),
        *(F.count_if(own & (F.col("role") == k)).alias(f"{k.lower()}_count") for k in ("L1", "L2", "L3")),
        F.count_if("is_victim").alias("victim_count"),
        F.coalesce(F.sum(F.when(own, F.col("holding"))), F.lit(0)).alias("holding_paise"),
    )
    flow = links.groupBy(key).agg(
        F.count("*").alias("n_links"),
        F.coalesce(F.sum(F.when(F.col("link_type") == "VICTIM_L1", F.col("amount_paise"))), F.lit(0)).alias("total_in_paise"),
        F.min("ts_sec").alias("first_ts"),
        F.max("ts_sec").alias("last_ts"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("tx_key")), lambda k: k.cast("string")), ","), 256).alias("fingerprint"),
    )
    return people.join(flow, key).withColumn("unclassified_count", F.col("size") - F.col("l1_count") - F.col("l2_count") - F.col("l3_count"))


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Numbers from 1 by money received, the largest first, then by time and key."""
    at = ranked(rows.withColumn("_in", -F.col("total_in_paise")), ["_in", "first_ts", key])
    return at.withColumn(name, F.col("_rank").cast("int")).drop("_in", "_rank", "_n")


def rings(links: DataFrame, comp: DataFrame, member: DataFrame, on_cycle: DataFrame, profile: dict) -> DataFrame:
    """One row for each component: ring_id, label, counts, money, times, patterns, fingerprint. links has ts_sec."""
    keyed = links.join(comp.select(F.col("acct").alias("from_acct"), "label"), "from_acct")
    cycles = comp.join(on_cycle, "acct", "left_semi")
    rows = _stats(member, keyed, "label").join(_patterns(keyed, "label", cycles, profile), "label", "left")
    return _numbered(rows.withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>"))), "label", "ring_id")


def reach(links: DataFrame, starts: DataFrame) -> DataFrame:
    """l1, acct: accounts that each start reaches over links between mules, itself included. Each round meets new pairs only."""
    edge = cut(links.filter("link_type <> 'VICTIM_L1'").select(F.col("from_acct").alias("acct"), F.col("to_acct").alias("next")).distinct())
    new = cut(starts.select(F.col("acct").alias("l1"), "acct"))
    seen = new
    while not new.isEmpty():
        ahead = new.join(edge, "acct").select("l1", F.col("next").alias("acct")).distinct()
        new = cut(ahead.join(seen, ["l1", "acct"], "left_anti"))
        seen = cut(seen.unionByName(new))
    return seen


def cells(links: DataFrame, comp: DataFrame, member: DataFrame, ring: DataFrame, on_cycle: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame]:
    """(cells, their members): what each confirmed first-layer account reaches, and its payers."""
    starts = member.filter("role = 'L1' and role_confirmed and not is_victim")
    r = reach(links, starts)
    own = links.filter("link_type <> 'VICTIM_L1'").join(r.select("l1", F.col("acct").alias("from_acct")), "from_acct")
    paid = links.filter("link_type = 'VICTIM_L1'").join(starts.select(F.col("acct").alias("to_acct")), "to_acct", "left_semi").withColumn("l1", F.col("to_acct"))
    keyed = own.unionByName(paid.select(*own.columns))
    inside = r.join(member.select("acct", "role", "holding"), "acct").select("l1", "acct", F.lit(False).alias("is_victim"), "role", "holding")
    payer = paid.select("l1", F.col("from_acct").alias("acct")).distinct().join(member.select("acct", "role"), "acct").select("l1", "acct", F.lit(True).alias("is_victim"), "role", F.lit(0).cast("long").alias("holding"))
    people = inside.unionByName(payer)
    rows = _stats(people, keyed, "l1").join(_patterns(keyed, "l1", r.join(on_cycle, "acct", "left_semi"), profile), "l1", "left")
    network = comp.select(F.col("acct").alias("l1"), "label").join(ring.select("label", F.col("ring_id").alias("network_id")), "label").drop("label")
    rows = rows.withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>"))).join(network, "l1")
    return _numbered(rows, "l1", "cell_id"), people
