"""What keeps op4's disk in step with its input: exact counts told to each partition, no texts moved, nothing left behind."""

import os
import random
from collections import Counter

import numpy as np
from pyspark import SparkContext
from pyspark.sql import functions as F

from tests.llm import brute
from tracewell.llm import filed, store, suffix_dedup

REPEAT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def documents(n):
    rng = random.Random(4)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passages = [text(300) for _ in range(5)]
    data = [(rng.choice([None, *range(n)]), text(rng.randrange(150)) + p[rng.randrange(150) : 120 + rng.randrange(180)] + text(rng.randrange(150))) for p in passages for _ in range(n // 5)]
    return data + [(d, t) for d, t in rng.sample(data, n // 10)] + [(n, None), (n, "")]


def test_tokens_that_repeat_are_told_exactly(spark, monkeypatch):
    monkeypatch.setattr(filed, "RUN_TOKENS", 60)
    rng = random.Random(1)
    tokens = [rng.getrandbits(64) for _ in range(400)]
    rows = [[rng.choice(tokens if rng.random() < 0.3 else [rng.getrandbits(64)]) for _ in range(rng.randrange(4))] for _ in range(2000)]
    df = spark.createDataFrame([([x - (1 << 63) for x in r],) for r in rows], "tokens array<long>").repartition(7).withColumn("row", F.monotonically_increasing_id())
    df = store.materialise(df, "rows")

    def hashes(batch):
        yield batch.column("tokens").flatten().to_numpy().view(np.uint64) ^ np.uint64(1 << 63)

    folder = filed.repeated(df, hashes, "tokens")
    n, of = Counter(x for r in rows for x in r), {}
    for r in df.collect():
        of.setdefault(r.row >> filed.PARTITION, []).extend(x + (1 << 63) for x in r.tokens)
    assert len(of) == 7 and sum(k > 1 for k in n.values()) > 150
    told = filed.Filed(folder, filed.Tokens)
    for pid, own in of.items():
        assert told.of(pid).has(np.array(own, np.uint64)).tolist() == [n[x] > 1 for x in own]
        assert not told.of(pid).has(np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)).any()
        assert len(told.of(pid).keys) == len({x for x in own if n[x] > 1})
    assert not told.of(99).has(np.array(tokens, np.uint64)).any()


def test_small_tokens_spread_over_all_ranges():
    """Hashes of anchors are the smallest of some fifty."""
    run = filed._run(0, [np.arange(50_000, dtype=np.uint64)])
    size = [len(x) // 5 for x in run.column("packed").to_pylist()]
    assert run.num_rows == 1024 and sum(size) == 50_000 and max(size) < 100


def test_repeats_in_many_runs_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(filed, "RUN_TOKENS", 50)
    monkeypatch.setattr(suffix_dedup, "RUN_FOUND", 30)
    data = [(i if d is None else d, t) for i, (d, t) in enumerate(documents(200), 1000)]
    data = list({d: (d, t) for d, t in data}.values())
    random.Random(2).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    docs = store.materialise(docs, "documents")
    assert sorted(tuple(r) for r in suffix_dedup.find(docs).select(*REPEAT).collect()) == brute.repeats(data)


def test_repeats_send_nothing_to_all_and_move_no_texts(spark, monkeypatch, tmp_path):
    docs = store.materialise(spark.createDataFrame(documents(200), "doc_id long, text string"), "documents")
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(SparkContext, "broadcast", None)
    found = suffix_dedup.find(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # what stays until the result is written is the spans
    assert [x.split("-")[0] for x in os.listdir(tmp_path)] == ["spans"]
    assert found.agg(F.sum("n_removed")).first()[0] > 20_000
