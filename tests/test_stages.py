"""Invariants that raise, stored profiles, row numbers and dense ids, reasons, on planted and odd cases."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import invariants as V
from tracewell.operators import scoring as S
from tracewell.plans.case import Case
from tracewell.plans.profile import DEFAULT, changed
from tracewell.sources import numbering as N
from tracewell.sources import results as R
from tracewell.sources import transfers as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def case(spark):
    return Case(T.flagged(T.transfers(spark, SF)))


def counts(df):
    return {r["check"]: r.n for r in df.collect()}


def test_a_clean_case_passes(case):
    found = counts(case.checks())
    assert len(found) == 17 and set(found.values()) == {0}
    case.verify()


def test_rows_are_counted_as_they_are_written(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") < 8, F.col("id")))
    out, n = V.checked(df, "stage", {"large": F.col("x") > 7})
    assert n == out.count() == 10  # null is no violation
    with pytest.raises(V.InvariantError) as e:
        V.checked(df, "stage", {"large": F.col("x") > 5, "small": F.col("x") < 1, "none": F.col("x") < 0})
    assert e.value.broken == {"large": 2, "small": 1} and e.value.stage == "stage" and "large = 2" in str(e.value)
    assert V.checked(df.limit(0), "stage", {"large": F.col("x") > 5})[1] == 0


def test_a_planted_late_outflow_aborts_the_stage(case, monkeypatch):
    from tracewell.operators import episodes as E

    real = E.episode_outflows
    monkeypatch.setattr(E, "episode_outflows", lambda tx, inflows: real(tx, inflows).withColumn("lag_s", F.when(F.col("out_key") % 2 == 1, 3601).otherwise(F.col("lag_s"))))
    with pytest.raises(V.InvariantError, match="outflows: lag_outside_window"):
        Case(case.tx).features  # noqa: B018


def test_planted_scores_and_links_abort(case, monkeypatch):
    real = S.roles
    monkeypatch.setattr(S, "roles", lambda *a: real(*a).withColumn("role", F.when(F.col("is_flagged"), "VICTIM").otherwise(F.col("role"))))
    other = Case(case.tx, features=case.features, links=case.links)
    with pytest.raises(V.InvariantError, match="role_breaks_flag"):
        other.roles  # noqa: B018
    wild = case.links.withColumn("share_of_inflow", F.lit(2.0))
    with pytest.raises(V.InvariantError, match="share_over_one"):
        V.checked(wild, "links", V.lag_outside(DEFAULT["windows_s"]))


def test_stale_links_abort(case):
    strict = changed(case.profile, {"flag.threshold": 99, "bands.suspected": 99})
    with pytest.raises(V.InvariantError, match="stale_links"):
        Case(case.tx, strict, case.features, case.links)
    assert Case(case.tx, case.profile, case.features, case.links).roles.count() == case.roles.count()


def test_each_finished_stage_is_checked(case):
    late = counts(V.episode_checks(case.inflows, case.outflows.unionByName(case.outflows.limit(1))))
    assert late["outflows_in_two_episodes"] == 1
    assert counts(V.score_checks(case.features, case.roles.limit(5)))["not_scored_once"] == case.features.count() - 5
    net = lambda **k: counts(V.network_checks(**({"links": case.links, "components": case.components, "members": case.members, "rings": case.rings, "cells": case.cells, "cell_members": case.cell_members} | k)))
    halved = net(rings=case.rings.filter("ring_id = 1"))
    assert halved["links_without_ring"] > 0 and halved["links_not_counted"] > 0 and halved["ring_sizes_unlike"] == 1
    assert net(components=case.components.withColumn("label", F.when(F.col("acct") % 2 == 0, 1_000_000).otherwise(F.col("label"))))["links_crossing_rings"] > 0
    assert net(cells=case.cells.limit(1))["l1_without_cell"] == 1 and net(cells=case.cells.limit(1))["cell_sizes_unlike"] == 1
    twice = net(cells=case.cells.withColumns({"fingerprint": F.lit("same"), "network_id": F.lit(None).cast("int")}), rings=case.rings.withColumn("fingerprint", F.lit("same")))
    assert twice["cell_fingerprints_twice"] == twice["ring_fingerprints_twice"] == 1 and twice["cells_without_network"] == 2


def test_two_profiles_side_by_side_and_one_refilled(case, tmp_path):
    folder, spark = str(tmp_path / "store"), case.tx.sparkSession
    other = Case(case.tx, changed(case.profile, {"profile_id": "other", "mule.MP1.weight": 30, "mule.MP4.weight": 5}), case.features)
    first = case.store(folder)
    assert other.store(folder) == first | {k: v for k, v in other.store(folder).items()}
    before = sorted(map(str, R.read(spark, folder, "scores", "other").collect()))
    key = lambda p: sorted((r.acct, r.role or "", r.ring_id or 0) for r in R.read(spark, folder, "scores", p).collect())
    assert key(case.profile["profile_id"]) == sorted((r.acct, r.role or "", r.ring_id or 0) for r in case.stamped_scores.collect())
    assert case.store(folder) == first  # a refill leaves its own rows once, and others' alone
    assert R.read(spark, folder, "scores").count() == 2 * case.roles.count()
    assert sorted(map(str, R.read(spark, folder, "scores", "other").collect())) == before
    assert R.refill(case.links.limit(0), folder, "links", "other") == 0
    assert R.read(spark, folder, "links", "other").count() == 0 and R.read(spark, folder, "links").count() == first["links"]
    with pytest.raises(ValueError):
        R.refill(case.links, folder, "links", "a/b")


def test_only_the_named_partition_is_read(case, tmp_path):
    spark = case.tx.sparkSession
    for p in ("a", "b"):
        R.refill(case.links, str(tmp_path), "links", p)
    plan = R.read(spark, str(tmp_path), "links", "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(profile_id" in plan


def test_numbers_in_file_order_under_any_partitioning(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"f{part}.csv").write_text("v\n" + "".join(f"{part}-{i:05d}\n" for i in range(4000)))
    found = []
    for size in ("128m", "4k", "999b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = spark.read.option("header", True).csv(str(tmp_path))
        found.append({r.v: r.tx_key for r in N.in_file_order(rows).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.rdd.getNumPartitions() >= 1 and found[0] == found[1] == found[2]
    assert found[0] == {f"{p}-{i:05d}": 4000 * p + i + 1 for p in range(3) for i in range(4000)}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "f.csv").write_text("v\n")
    assert N.in_file_order(spark.read.option("header", True).csv(str(tmp_path / "none"))).count() == 0


def test_dense_ids(spark):
    rows = spark.createDataFrame([("b", "a"), ("c", None), ("b", "x")], "src_no string, dst_no string")
    for n in (1, 5):
        ids = N.dense_ids(rows.select(F.col("src_no").alias("acct_no")).union(rows.select("dst_no")).repartition(n))
        assert {r.acct_no: r.acct_id for r in ids.collect()} == {"a": 0, "b": 1, "c": 2, "x": 3}
    got = {(r.src_id, r.dst_id) for r in N.with_ids(rows, ids.filter("acct_no <> 'x'"), {"src_no": "src_id", "dst_no": "dst_id"}).collect()}
    assert got == {(1, 0), (2, None), (1, None)}
    assert N.dense_ids(ids.limit(0)).count() == 0


def test_reasons_keep_nulls_in_points_and_drop_them_in_words(case):
    rows = {r.acct: r for r in S.reasons(case.pass1.join(case.features.select("acct"), "acct"), case.profile).collect()}
    one = rows[1_000_003]
    assert one.points["MP7"] is None and '"MP7":null' in one.points_json and one.points["MP1"] == 20 and None not in one.reasons
    assert one.reasons[0].startswith("final ") and not any("neighbour_risk" in x for x in one.reasons)
    second = {r.acct: r for r in case.reasons.collect()}[1_000_003]
    assert second.points["MP7"] > 0 and any(x.startswith("MP7 ") for x in second.reasons)


def test_numbers_in_words_round_halves_up(spark):
    df = spark.createDataFrame([(0.25,), (-0.25,), (72.25,), (0.04,), (1e6,), (None,)], "x double")
    assert [r[0] for r in df.select(S._fixed(F.col("x"))).collect()] == ["0.3", "-0.3", "72.3", "0.0", "1000000.0", None]
