"""Two-pass scoring of accounts: a profile's rules compiled to columns.

A rule gives its weight, a part of it, or nothing; a null feature scores nothing. Rules that need the second pass are
null in the first. Weight 0 scores 0.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _between(c: str, bounds: tuple) -> Column:
    return F.col(c).between(*map(float, bounds))


def _ramp(x: Column, rule: dict, up: bool = True) -> Column:
    """Full weight from `full` on, half at `half`, straight between; one step without `half`."""
    w, full, half = float(rule["weight"]), float(rule["full"]), rule.get("half")
    reached = (lambda t: x >= t) if up else (lambda t: x <= t)
    out = F.when(reached(full), w)
    if half is not None:
        part = (x - half) / (full - half)
        out = out.when(reached(float(half)), w * (0.5 + 0.5 * part))
    return out.otherwise(0.0)


def _pattern(profile: dict) -> Column:
    """The account's usual episode is a split or a single forward, in that pattern's time window."""
    kinds = [_between("split_count_median", profile["receivers"][k]) & _between("forward_lag_median_s", profile["windows_s"][k]) for k in ("split", "single")]
    return reduce(or_, kinds)


def points(rule: dict, profile: dict, pass_no: int) -> Column:
    w = float(rule["weight"])
    if rule.get("pass", 1) > pass_no:
        return F.lit(None).cast("double")
    if not w:
        return F.lit(0.0)
    kind = rule["rule"]
    if kind == "at_least":
        x = F.col(rule["feature"]).cast("double")
        if "receive_only_feature" in rule:
            x = F.when(F.col("is_receive_only"), F.col(rule["receive_only_feature"]).cast("double")).otherwise(x)
        if "minus_from" in rule:
            x = float(rule["minus_from"]) - x
        return _ramp(x, rule)
    if kind == "at_most_of_median":
        return _ramp(F.col(rule["feature"]) / F.col(f"median_{rule['feature']}"), rule, up=False)
    if kind == "any":
        return F.when(reduce(or_, [_true(F.col(f)) for f in rule["features"]]), w).otherwise(0.0)
    if kind == "all":
        tests = [F.col(f) >= v for f, v in rule["at_least"].items()] + [F.col(f) <= v for f, v in rule["at_most"].items()]
        return F.when(_true(reduce(and_, tests)), w).otherwise(0.0)
    iqr = F.col("commission_ratio_iqr")
    level = lambda v: _true(_between("commission_ratio_median", v["ratio"]) & (iqr.isNull() | (iqr <= v["iqr"])) & _pattern(profile))
    return F.when(level(rule["full"]), w).when(level(rule["half"]), w / 2).otherwise(0.0)


def score(features: DataFrame, profile: dict, pass_no: int = 1) -> DataFrame:
    """features with points of every rule, the indices, override, flag and band."""
    medians = [f"{r['feature']}" for r in profile["mule"].values() if r["rule"] == "at_most_of_median"]
    population = features.agg(*(F.median(m).alias(f"median_{m}") for m in medians))
    df = features.join(F.broadcast(population))  # one row
    enough = F.col("tx_count") >= profile["min_tx_for_trust"]
    df = df.withColumns({k.lower(): points(r, profile, pass_no) for k, r in profile["mule"].items()})
    df = df.withColumns({k.lower(): (p if r.get("pass", 1) > pass_no else F.when(enough, p).otherwise(0.0)) for k, r in profile["trust"].items() for p in [points(r, profile, pass_no)]})
    total = lambda part: reduce(add, [F.coalesce(k.lower(), F.lit(0.0)) for k in profile[part]])
    signals = reduce(add, [_true(F.col(k.lower()) >= r["weight"] / 2 - EPS).cast("int") for k, r in profile["mule"].items() if r["weight"]])
    o = profile["override"]
    split = _between("split_count_median", profile["receivers"]["split"]) & _between("forward_lag_median_s", profile["windows_s"]["split"])
    single = (F.col("split_count_median") == 1) & _between("commission_ratio_median", o["single_ratio"])
    lifted = _true((F.col("pass_through_share") >= o["forwarded"]) & (split | single))
    if pass_no == 2:
        lifted = lifted | _true(F.col("is_receive_only") & (F.col("linked_sink_share") >= o["sink_share"]))
    df = df.withColumns({"mule_index": total("mule"), "trust_index": total("trust"), "n_half": signals, "_lift": lifted})
    raw = F.col("mule_index") * (1 - profile["trust_discount"] * F.col("trust_index") / 100)
    df = df.withColumn("_raw", raw).withColumn("final_index", F.when(F.col("_lift"), F.greatest("_raw", F.lit(float(o["floor"])))).otherwise(F.col("_raw")))
    final, flag, review, bands = F.col("final_index"), profile["flag"], profile["review"], profile["bands"]
    df = df.withColumns({"override_applied": F.col("_lift") & (final > F.col("_raw")), "is_flagged": (final >= flag["threshold"]) & (F.col("n_half") >= flag["signals"])})
    doubtful = ~F.col("is_flagged") & ((F.col("mule_index") >= review["mule"]) & (F.col("trust_index") >= review["trust"]) | (final >= flag["threshold"]))
    band = F.when(doubtful, "review").when(final >= bands["high_confidence"], "high_confidence").when(final >= bands["suspected"], "suspected").otherwise("clean")
    return df.withColumn("band", band).drop("_lift", "_raw", *population.columns)


def candidates(scored: DataFrame, profile: dict) -> DataFrame:
    """acct, is_flagged, cand: the role that behaviour alone suggests."""
    usual = lambda k: _between("split_count_median", profile["receivers"][k])
    cand = (
        F.when(F.col("is_receive_only"), "L3")
        .when(F.col("is_flagged") & usual("split"), "L1")
        .when(F.col("is_flagged") & usual("single"), "L2")
        .when(F.col("is_flagged"), "UNCLASSIFIED_MULE")
        .when(F.col("is_send_only") & (F.col("n_out") <= profile["roles"]["victim_max_out"]), "VICTIM")
    )
    return scored.select("acct", "is_flagged", cand.alias("cand"))


def relations(tx_sides: DataFrame, scored: DataFrame, links: DataFrame) -> DataFrame:
    """What the second pass adds for each account: neighbour risk, holding, linked shares and link presence."""
    index = scored.select(F.col("acct").alias("cp"), "final_index")
    amount = F.col("amount_paise")
    signed = F.when(F.col("is_in"), amount).otherwise(-amount)
    base = tx_sides.join(index, "cp").groupBy("acct").agg(
        (F.sum(amount * F.col("final_index")) / F.sum(amount)).alias("neighbour_risk"),
        F.sum(signed).alias("holding_paise"),
        F.sum(F.when(F.col("is_in"), amount)).alias("in_total"),
        F.sum(F.when(~F.col("is_in"), amount)).alias("out_total"),
    )
    kind = F.col("link_type")
    into = links.groupBy(F.col("to_acct").alias("acct")).agg(
        F.sum(F.when(F.col("from_role") == "VICTIM", amount)).alias("from_victim"),
        F.sum(F.when(F.col("from_role") == "L1", amount)).alias("from_l1"),
        F.sum(F.when(F.col("from_role") == "L2", amount)).alias("from_l2"),
        F.sum(F.when(kind == "L2_L3", amount)).alias("sunk"),
        *(F.bool_or(kind == k).alias(f"in_{k.lower()}") for k in ("VICTIM_L1", "L1_L2", "L2_L2", "L2_L3")),
    )
    out = links.groupBy(F.col("from_acct").alias("acct")).agg(
        *(F.sum(F.when(F.col("to_role") == r, amount)).alias(f"to_{r.lower()}") for r in ("L1", "L2", "L3")),
        *(F.bool_or(kind == k).alias(f"out_{k.lower()}") for k in ("VICTIM_L1", "L1_L2", "L2_L2", "L2_L3")),
    )
    j = base.join(into, "acct", "left").join(out, "acct", "left")
    of_in = lambda c: F.when(F.col("in_total") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("in_total"))
    seen = [F.coalesce(c, F.lit(False)).alias(c) for c in [*into.columns, *out.columns] if c.startswith(("in_", "out_"))]  # not the totals, which are base's
    # shares of all money in or out by the role at the other end; null without a link in that direction
    part = lambda c, whole: F.coalesce(F.col(c), F.lit(0)) / F.col(whole)
    shares = lambda cs, whole: F.create_map(*(x for r, c in cs.items() for x in (F.lit(r), part(c, whole))))
    up = F.when(F.col("in_l1_l2").isNotNull(), shares({"VICTIM": "from_victim", "L1": "from_l1", "L2": "from_l2"}, "in_total"))
    down = F.when(F.col("out_l1_l2").isNotNull(), shares({"L1": "to_l1", "L2": "to_l2", "L3": "to_l3"}, "out_total"))
    return j.select(
        "acct", "neighbour_risk", "holding_paise", of_in("from_l1").alias("upstream_l1_share"), of_in("from_l2").alias("upstream_l2_share"), of_in("sunk").alias("linked_sink_share"), *seen,
        up.alias("upstream_role_share"), down.alias("downstream_role_share"),
    )


def second_pass(features: DataFrame, related: DataFrame, profile: dict) -> DataFrame:
    """The features with what the links add, scored again."""
    later = [c for c in ("neighbour_risk", "upstream_l1_share", "upstream_l2_share")]
    return score(features.drop(*later).join(related, "acct", "left"), profile, 2)


def roles(scored: DataFrame, tx: DataFrame, profile: dict) -> DataFrame:
    """Role scores, role, confirmation, candidate roles and the freeze recommendation, after the second pass."""
    r = profile["roles"]
    yes = lambda c: _true(c).cast("double")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    quiet = F.col("mp4") / float(profile["mule"]["MP4"]["weight"]) if profile["mule"]["MP4"]["weight"] else F.lit(0.0)
    lag = lambda k: yes(_between("forward_lag_median_s", profile["windows_s"][k]))
    usual = lambda k: yes(_between("split_count_median", profile["receivers"][k]))
    fee = lambda k: yes(_between("commission_ratio_median", r["commission"][k]))
    parts = {
        "L1": {"victim_inflow": share("victim_inflow_share"), "split": usual("split"), "commission": fee("L1"), "lag": lag("split"), "flagged_out": share("flagged_out_share")},
        "L2": {"from_l1": share("upstream_l1_share"), "single": usual("single"), "commission": fee("L2"), "lag": lag("single"), "flagged_out": share("flagged_out_share")},
        "L3": {"receive_only": yes(F.col("is_receive_only")), "from_l2": share("upstream_l2_share"), "flagged_in": share("flagged_in_share"), "low_activity": quiet},
        "VICTIM": {"send_only": yes(F.col("is_send_only")), "large_outflow": yes((F.col("n_out") <= r["victim_max_out"]) & (F.col("amount_vs_population") >= r["victim_multiple"])), "payee_l1": share("payee_l1_share"), "low_activity": quiet},
    }
    total = lambda k: reduce(add, [float(w) * parts[k][p] for p, w in r[k].items()])
    df = scored.withColumns({f"{k.lower()}_score": F.when(F.col("is_flagged"), total(k)) for k in ("L1", "L2", "L3")})
    strong = df.select(F.col("acct").alias("dst"), (F.col("l1_score") >= r["threshold"]).alias("_strong"))
    payee = tx.join(strong, "dst").groupBy(F.col("src").alias("acct")).agg((F.sum(F.when(F.col("_strong"), F.col("amount_paise")).otherwise(0)) / F.sum("amount_paise")).alias("payee_l1_share"))
    df = df.join(payee, "acct", "left").withColumn("victim_score", F.when(~F.col("is_flagged"), total("VICTIM")))
    # the order of the roles decides ties of their scores
    ranked = F.sort_array(F.array(*(F.struct(F.col(f"{k.lower()}_score").alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("r")) for i, k in enumerate(("L1", "L2", "L3")))), asc=False)
    df = df.withColumn("_ranked", ranked).withColumns({"_top": F.col("_ranked")[0]["s"], "_second": F.col("_ranked")[1]["s"], "_role": F.col("_ranked")[0]["r"]})
    any_of = lambda *cs: reduce(or_, [_true(F.col(c)) for c in cs])
    linked = F.when(F.col("_role") == "L1", any_of("in_victim_l1", "out_l1_l2")).when(F.col("_role") == "L2", any_of("in_l1_l2", "in_l2_l2", "out_l2_l2", "out_l2_l3")).otherwise(any_of("in_l2_l3"))
    clear = (F.col("_top") >= r["threshold"]) & (F.col("_top") - F.col("_second") > r["tie_margin"]) & linked
    role = F.when(F.col("is_flagged"), F.when(_true(clear), F.col("_role")).otherwise("UNCLASSIFIED_MULE")).when(F.col("victim_score") >= r["victim_threshold"], "VICTIM")
    df = df.withColumn("role", role)
    confirmed = F.when(F.col("role").isin("L1", "L2", "L3"), linked).when(F.col("role") == "VICTIM", any_of("out_victim_l1")).when(F.col("role").isNotNull(), False)
    near = F.filter("_ranked", lambda x: (x["s"] >= r["threshold"]) | (x["s"] >= F.col("_top") - r["tie_margin"]))
    df = df.withColumns({"role_confirmed": confirmed, "candidate_roles": F.when(F.col("is_flagged"), F.transform(near, lambda x: x["r"]))})
    freeze = F.col("is_flagged") & _true(F.col("role_confirmed")) & (F.coalesce("holding_paise", F.lit(0)) > 0)
    return df.withColumn("freeze_recommended", freeze).drop("_ranked", "_top", "_second", "_role")


def _fixed(x: Column, digits: int = 1) -> Column:
    """A number with so many decimals, halves up, as every engine writes it."""
    n = F.round(x.cast("double") * 10**digits).cast("long")
    whole = F.concat(F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 10**digits).cast("string"))
    return F.concat(whole, F.lit("."), F.lpad((F.abs(n) % 10**digits).cast("string"), digits, "0"))


def _shown(rule: dict) -> Column:
    """The feature that a rule looks at, with its value."""
    told = lambda f: F.concat(F.lit(f"{f} "), F.coalesce(_fixed(F.col(f), 2), F.lit("none")))
    if rule["rule"] == "any":
        return F.concat_ws(", ", *(F.when(F.col(f), F.lit(f)) for f in rule["features"]))
    if rule["rule"] == "commission":
        return F.concat_ws(", ", told("commission_ratio_median"), told("split_count_median"), told("forward_lag_median_s"))
    if rule["rule"] == "all":
        return F.concat_ws(", ", *(told(f) for f in [*rule["at_least"], *rule["at_most"]]))
    if "receive_only_feature" in rule:
        return F.when(F.col("is_receive_only"), told(rule["receive_only_feature"])).otherwise(told(rule["feature"]))
    return told(rule["feature"])


def reasons(scored: DataFrame, profile: dict) -> DataFrame:
    """acct, points (rule to points, null where a rule isn't scored in this pass), points_json (nulls kept), reasons (in order, none null)."""
    rules = {**profile["mule"], **profile["trust"]}
    final, flag, o, review = F.col("final_index"), profile["flag"], profile["override"], profile["review"]
    signals = F.concat(F.col("n_half").cast("string"), F.lit(" signals"))
    doubtful = ~F.col("is_flagged") & (F.col("mule_index") >= review["mule"]) & (F.col("trust_index") >= review["trust"])
    raw = F.col("mule_index") * (1 - profile["trust_discount"] * F.col("trust_index") / 100)
    lines = [
        F.concat(F.lit("final "), _fixed(final), F.lit(": mule "), _fixed(F.col("mule_index")), F.lit(", trust "), _fixed(F.col("trust_index"))),
        F.when(F.col("override_applied"), F.concat(F.lit("raised from "), _fixed(raw), F.lit(f" to at least {o['floor']}"))),
        F.when(F.col("is_flagged"), F.concat(F.lit("flagged with "), signals)).when(final >= flag["threshold"], F.concat(F.lit("not flagged with "), signals)),
        F.when(doubtful, F.lit("to be reviewed: much trust")),
    ]
    for k, r in rules.items():
        got = F.col(k.lower())
        lines.append(F.when(got > 0, F.concat(F.lit(f"{k} "), _fixed(got), F.lit(f" of {r['weight']}: "), _shown(r))))
    lines.append(F.when(F.col("tx_count") < profile["min_tx_for_trust"], F.lit(f"no trust: fewer than {profile['min_tx_for_trust']} transfers")))
    each = F.create_map(*(x for k in rules for x in (F.lit(k), F.col(k.lower()))))
    as_json = F.to_json(F.struct(*(F.round(k.lower(), 6).alias(k) for k in rules)), {"ignoreNullFields": "false"})
    return scored.select("acct", each.alias("points"), as_json.alias("points_json"), F.filter(F.array(*lines), lambda x: x.isNotNull()).alias("reasons"))
