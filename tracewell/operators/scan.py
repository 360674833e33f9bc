"""Running values along the rows of a key, cut into slots so that a busy key's rows are shared by many tasks.

Each slot is worked out by itself; what the slots before leave over is carried through one row for each slot. A slot is any
column that grows with the order, such as hours; results don't depend on its width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.cut import cut

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def running_sums(rows: DataFrame, keys: list[str], slot: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with sum_<value>: the sum of value over the key's rows up to each row, itself included. Rows that tie in order must not differ in result."""
    own = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(*_UPTO)
    slots = rows.groupBy(*keys, slot).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(*_BEFORE)
    slots = slots.select(*keys, slot, *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    at = rows.withColumns({f"sum_{v}": F.sum(v).over(own) for v in values}).join(slots, [*keys, slot])
    return at.withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.col(f"_{v}") for v in values}).drop(*(f"_{v}" for v in values))


def interval_sums(intervals: DataFrame, points: DataFrame, keys: list[str], low: int, high: int, values: list[str]) -> DataFrame:
    """id and, for each value, its sum over the points of the interval's keys with ts in ts + low .. ts + high.

    intervals: id, keys, ts; points: keys, ts, values. No pair is formed: an interval is the difference of two running sums.
    """
    width = max(1, high - low + 1)
    marks = F.array(F.struct(F.lit(low).alias("by"), F.lit(0).alias("kind"), F.lit(-1).alias("sign")), F.struct(F.lit(high).alias("by"), F.lit(2).alias("kind"), F.lit(1).alias("sign")))
    ends = intervals.select("id", *keys, "ts", F.explode(marks).alias("m"))
    ends = ends.select("id", *keys, (F.col("ts") + F.col("m.by")).alias("ts"), "m.kind", "m.sign", *(F.lit(0).cast("long").alias(v) for v in values))
    at = points.select(F.lit(None).cast(ends.schema["id"].dataType).alias("id"), *keys, "ts", F.lit(1).alias("kind"), F.lit(0).alias("sign"), *(F.col(v).cast("long").alias(v) for v in values))
    both = ends.unionByName(at).withColumn("_slot", F.floor(F.col("ts") / width))
    sums = running_sums(both, keys, "_slot", ["ts", "kind"], values).filter("kind <> 1")
    return sums.groupBy("id").agg(*(F.sum(F.col("sign") * F.col(f"sum_{v}")).alias(v) for v in values))


def pool_before(rows: DataFrame, keys: list[str], slot: str, order: list[str], change: str, name: str) -> DataFrame:
    """rows with `name`: what a pool holds before each row, if it starts empty and a row that would take more takes all.

    The pool is the running sum less the lowest that sum has been, if that was below zero; order must be unique in a key.
    """
    own = Window.partitionBy(*keys, slot).orderBy(*order)
    rows = rows.withColumn("_c", F.sum(change).over(own.rowsBetween(*_UPTO)))
    slots = rows.groupBy(*keys, slot).agg(F.sum(change).alias("_s"), F.min("_c").alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(*_BEFORE)
    slots = slots.withColumn("_start", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    slots = slots.withColumn("_low", F.least(F.lit(0), F.coalesce(F.min(F.col("_start") + F.col("_m")).over(earlier), F.lit(0)))).drop("_s", "_m")
    at = rows.withColumn("_below", F.min("_c").over(own.rowsBetween(*_BEFORE))).join(slots, [*keys, slot])
    low = F.least(F.col("_low"), F.col("_start") + F.coalesce("_below", F.lit(0)))
    return at.withColumn(name, F.col("_start") + F.col("_c") - F.col(change) - low).drop("_c", "_below", "_start", "_low")


def _maps(rows: DataFrame, keys: list[str], order: list[str], scale: str, add: str) -> DataFrame:
    """rows with _scale and _add: the maps x -> scale * x + add of the key's rows before each row, in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, p, q = None, 1.0, 0.0
        for batch in batches:
            n = batch.num_rows
            scales, adds = np.empty(n), np.empty(n)
            columns = zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(scale).to_pylist(), batch.column(add).to_pylist(), strict=True)
            for i, (key, s, a) in enumerate(columns):
                if key != at:
                    at, p, q = key, 1.0, 0.0
                scales[i], adds[i] = p, q
                p, q = p * s, q * s + a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scales), pa.array(adds)], [*batch.schema.names, "_scale", "_add"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_scale", T.DoubleType()), T.StructField("_add", T.DoubleType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def linear_before(rows: DataFrame, keys: list[str], slot: str, order: list[str], scale: str, add: str, name: str) -> DataFrame:
    """rows with `name`: x before each row, if x starts at 0 and each row makes it scale * x + add; order is unique in a key."""
    inner = cut(_maps(rows, [*keys, slot], order, scale, add))
    last = F.struct((F.col("_scale") * F.col(scale)).alias("s"), (F.col("_add") * F.col(scale) + F.col(add)).alias("a"))
    slots = inner.groupBy(*keys, slot).agg(F.max_by(last, F.struct(*order)).alias("m")).select(*keys, slot, "m.s", "m.a")
    start = _maps(slots, keys, [slot], "s", "a").select(*keys, slot, F.col("_add").alias("_start"))
    return inner.join(start, [*keys, slot]).withColumn(name, F.col("_scale") * F.col("_start") + F.col("_add")).drop("_scale", "_add", "_start")


def slots_between(first: Column, last: Column, width: int) -> Column:
    """One row for each slot that first .. last touches."""
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
