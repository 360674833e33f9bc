"""Invariants of the stages: counted on the rows as a stage is written, or over finished stages, and raising when broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewell.functions.cut import stored

from . import episodes as E


class InvariantError(RuntimeError):
    """A stage's rows break what must hold of them. `broken` has the number of rows by the name of the invariant."""

    def __init__(self, stage: str, broken: dict[str, int]) -> None:
        super().__init__(f"{stage}: " + ", ".join(f"{k} = {v}" for k, v in sorted(broken.items())))
        self.stage, self.broken = stage, broken


def checked(df: DataFrame, stage: str, never: dict[str, Column]) -> tuple[DataFrame, int]:
    """(df, stored; its number of rows). The rows that meet a condition of `never` are counted as they are written; any raises."""
    seen = Observation(stage)
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in never.items()]
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts))
    got = dict(seen.get)
    rows = got.pop("_rows", 0)
    if broken := {k: v for k, v in got.items() if v}:
        raise InvariantError(stage, broken)
    return out, rows


def lag_outside(low_high: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Links whose lag isn't within their sender's window, or that are more than what came in."""
    lag = F.when(F.col("from_role") == "L1", F.col("lag_s").between(*low_high["split"])).when(F.col("from_role") == "L2", F.col("lag_s").between(*low_high["single"]))
    return {"lag_outside_window": ~lag, "share_over_one": F.col("share_of_inflow") > 1}


def undecided() -> dict[str, Column]:
    """Scored accounts without a decision, out of range, or with a role that their flag forbids."""
    missing = [F.col(c).isNull() for c in ("mule_index", "trust_index", "final_index", "band", "is_flagged", "override_applied")]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    scores = F.col("l1_score").isNull() | F.col("l2_score").isNull() | F.col("l3_score").isNull()
    flagged = F.col("is_flagged") & (F.col("role").isNull() | (F.col("role") == "VICTIM") | scores)
    other = ~F.col("is_flagged") & ((F.coalesce("role", F.lit("VICTIM")) != "VICTIM") | F.col("victim_score").isNull())
    second = F.col("mp7").isNull() | F.col("t5").isNull() | F.col("holding_paise").isNull() | F.col("freeze_recommended").isNull()
    return {"undecided": any_missing | ~F.col("final_index").between(0, 100), "role_breaks_flag": F.coalesce(flagged, F.lit(False)) | F.coalesce(other, F.lit(False)) | second}


def _named(one_row: DataFrame) -> DataFrame:
    """check, n from a row of counters."""
    return one_row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in one_row.columns))).alias("x")).select("x.*")


def episode_checks(inflows: DataFrame, outflows: DataFrame) -> DataFrame:
    return _named(E.episode_audit(inflows, E.episode_windows(inflows), outflows).drop("episodes_out_over_in"))


def score_checks(features: DataFrame, roles: DataFrame) -> DataFrame:
    """Accounts with features but no score, scores without features or twice, and rows that `undecided` names."""
    both = features.select("acct", F.lit(1).alias("f")).join(roles.groupBy("acct").agg(F.count("*").alias("s")), "acct", "full")
    rows = both.agg(F.count_if(F.col("s").isNull() | F.col("f").isNull() | (F.col("s") > 1)).alias("not_scored_once"))
    return _named(rows).unionByName(_named(roles.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in undecided().items()))))


def stale_links(links: DataFrame, pass1: DataFrame) -> DataFrame:
    """Links that start at an account which the first pass doesn't flag: proven under another profile or other features."""
    old = links.filter("from_role in ('L1', 'L2')").join(pass1.filter("not is_flagged").select(F.col("acct").alias("from_acct")), "from_acct", "left_semi")
    return _named(old.agg(F.count("*").alias("stale_links")))


def _same_prints(rows: DataFrame, name: str) -> DataFrame:
    each = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    return _named(each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name)))


def _sizes(rows: DataFrame, people: DataFrame, key: str, name: str) -> DataFrame:
    held = people.groupBy(key).agg(F.count("*").alias("held"))
    j = rows.select(key, (F.col("size") + F.col("victim_count")).alias("told")).join(held, key, "full")
    return _named(j.agg(F.count_if(~F.col("told").eqNullSafe(F.col("held"))).alias(name)))


def network_checks(links: DataFrame, components: DataFrame, members: DataFrame, rings: DataFrame, cells: DataFrame, cell_members: DataFrame) -> DataFrame:
    """check, n over networks and cells: nine counters that must be 0."""
    ring = components.join(rings.select("label", "ring_id"), "label", "left").select("acct", "ring_id")
    ends = links.join(ring.select(F.col("acct").alias("from_acct"), F.col("ring_id").alias("a")), "from_acct", "left").join(ring.select(F.col("acct").alias("to_acct"), F.col("ring_id").alias("b")), "to_acct", "left")
    of_links = ends.agg(F.count_if(F.col("a").isNull()).alias("links_without_ring"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("links_crossing_rings"))
    lost = links.agg(F.count("*").alias("all")).join(rings.agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("told"))).select((F.col("all") - F.col("told")).alias("links_not_counted"))  # two single rows
    first = members.filter("role = 'L1' and role_confirmed and not is_victim").select(F.col("acct").alias("l1"))
    no_cell = first.join(cells.select("l1"), "l1", "left_anti").agg(F.count("*").alias("l1_without_cell"))
    no_network = cells.agg(F.count_if(F.col("network_id").isNull()).alias("cells_without_network"))
    out = _named(of_links)
    for more in (_named(lost), _same_prints(rings, "ring_fingerprints_twice"), _sizes(rings, members, "label", "ring_sizes_unlike"), _named(no_cell), _same_prints(cells, "cell_fingerprints_twice"), _sizes(cells, cell_members, "l1", "cell_sizes_unlike"), _named(no_network)):
        out = out.unionByName(more)
    return out


def raising(stage: str, checks: DataFrame) -> None:
    """InvariantError if any counter of (check, n) isn't 0; the rows are as many as there are checks."""
    if broken := {r["check"]: r.n for r in checks.filter("n <> 0").collect()}:
        raise InvariantError(stage, broken)

