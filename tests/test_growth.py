"""What keeps the analysis in step with its input: what is read once, and how often rows are multiplied or moved."""

import datetime
import random
import statistics

from tracewell.functions.cut import stored
from tracewell.operators import episodes as E
from tracewell.operators import features as FE
from tracewell.operators import trace as TR
from tracewell.operators import verdicts as V
from tracewell.plans import profile as P
from tracewell.plans import registry
from tracewell.sources import transfers

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_read_stored_transfers(spark):
    c = registry.case_of(spark, SF)
    assert "stored-" in c.tx.inputFiles()[0] and not any("events.parquet" in f for f in c.tx.inputFiles())
    assert "stored-" in c.inflows.inputFiles()[0]
    assert "ReadSchema: struct<acct:bigint>" in _plan(c.inflows.select("acct"))


def test_stored_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, [1], {"a": 0.5}), (2, "x", None, {})], "a int, b string, c array<long>, d map<string, double>")
    for rows in (df, df.limit(0)):
        assert stored(rows).dtypes == df.dtypes and sorted(map(str, stored(rows).collect())) == sorted(map(str, rows.collect()))


def test_distinct_counts_expand_no_rows(spark):
    plan = _plan(registry.queries()["features"](spark, SF))
    assert plan.count("Expand") <= 1  # devices and addresses, of the few rows that a sender's addresses make


def test_median_and_distinct_amounts(spark):
    rng = random.Random(5)
    rows = [(a, rng.randrange(1, 9) * 10**rng.randrange(1, 12)) for a in range(1, 30) for _ in range(rng.randrange(1, 9))] + [(90, 7), (91, 4), (91, 4), (92, 1), (92, 2)]
    got = {r.acct: (r.amounts, r.median_amount) for r in FE.spread(spark.createDataFrame(rows, "acct long, amount_paise long")).collect()}
    of = {a: [v for b, v in rows if b == a] for a, _ in rows}
    assert got == {a: (len(set(v)), float(statistics.median(v))) for a, v in of.items()}


def test_days_and_pairs_against_plain_counts(spark):
    rng, start = random.Random(7), datetime.datetime(1969, 12, 30)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([1, 2, 3, 4, 5, 6]), rng.choice([None, *range(1, 5)]), rng.choice([700, 100_000, None])) for _ in range(300)]
    rows = [(s, d, n and start + datetime.timedelta(days=rng.choice([0, 1, 2, 62, 63, 64, 200]), hours=n), p) for s, d, n, p in rows] + [(8, 8, None, 1), (9, 8, start, 1)]
    tx = spark.createDataFrame([(*r, False, 1) for r in rows], "src long, dst long, ts timestamp_ntz, amount_paise long, is_layering boolean, x int")
    got = {r.acct: r for r in FE.activity(transfers.sides(tx)).collect()}
    pairs = {r.acct: r for r in FE.counterparties(tx).collect()}
    side = [(d, s, True, t, p) for s, d, t, p in rows] + [(s, d, False, t, p) for s, d, t, p in rows]
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    assert set(got) == set(pairs) == {x[0] for x in side}
    for a, r in got.items():
        own = [x[1:] for x in side if x[0] == a]
        assert r.days_active == len({t.date() for _, _, t, _ in own if t})
        assert (r.tx_count, r.n_in, r.in_total) == (len(own), sum(x[1] for x in own), sum(p or 0 for _, i, _, p in own if i) if any(i and p for _, i, _, p in own) else None)
        assert r.odd_hour_share == mean([1 <= t.hour <= 4 for _, _, t, _ in own if t])
        assert r.structuring_share == mean([p % 100_000 == 0 for _, i, _, p in own if not i and p])
        cps = {c: ([x for x in own if x[0] == c and x[1]], any(x[0] == c and not x[1] for x in own)) for c in {x[0] for x in own}}
        assert pairs[a].reciprocity == mean([bool(n) and out for n, out in cps.values()])
        often = sum(len(n) for n, _ in cps.values() if len({t.date() for _, _, t, _ in n if t}) >= FE.RECURRING_DAYS)
        assert pairs[a].recurring_sender_share == (often / r.n_in if r.n_in else None)


def test_rows_move_once_for_pairs_and_not_for_days(spark):
    tx = registry.case_of(spark, SF).tx
    assert _plan(FE.activity(transfers.sides(tx))).count("Generate") == 2  # sums and amounts; days were a third
    plan = _plan(FE.counterparties(tx))
    assert plan.index("Generate") < plan.index("REPARTITION_BY_COL")  # plans begin at the end: pairs are expanded, transfers aren't


def test_another_profile_shares_episodes(spark, monkeypatch):
    c = registry.case_of(spark, SF)
    assert c.features is not None
    for name in ("inflow_episodes", "episode_outflows"):
        monkeypatch.setattr(E, name, lambda *_: 1 / 0)
    assert c.under(P.changed(c.profile, {"mule.MP1.weight": 30, "mule.MP4.weight": 5})).links.columns == c.links.columns


def test_hops_of_the_chain_are_not_worked_out_again(spark):
    rows = [(i, i, i + 1, 1000 * i + 300, 5) for i in range(1, 6)]
    tx = spark.createDataFrame(rows, "tx_key long, src long, dst long, ts_sec long, amount_paise long")
    chain = TR.structural_chain(tx, spark.createDataFrame([(1,)], "acct long"), {**P.DEFAULT, "windows_s": {"split": (0, 1000), "single": (0, 1000)}})
    assert "Join" not in _plan(chain)
    assert sorted((r.hop, r.tx_key) for r in chain.collect()) == [(h, h) for h in range(1, P.DEFAULT["trace"]["max_hops"] + 1)]


def test_verdicts_read_stored_transfers(spark, monkeypatch):
    seen, placed = [], V.placed
    monkeypatch.setattr(V, "placed", lambda df, *a: seen.append(df.inputFiles()) or placed(df, *a))
    registry.queries()["audit_verdicts"](spark, SF)
    assert any("stored-" in f for f in seen[0])
