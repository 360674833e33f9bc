"""Join patterns that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], on: str, right_on: str, take: list[str]) -> DataFrame:
    """Each left row with the columns `take` of the last right row of its keys that isn't later; null without one.

    Rows of equal time match. One shuffle by keys: both sides are stacked and the last right row is carried forward.
    Of right rows at one time, the largest `take` wins.
    """
    carried = F.struct(F.col(right_on).alias("_at"), *take)
    a = left.select(*keys, F.col(on).alias("_t"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_last"))
    b = right.select(*keys, F.col(right_on).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), carried.alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_t", "_kind", "_last").rowsBetween(Window.unboundedPreceding, 0)
    stacked = a.unionByName(b).withColumn("_last", F.last("_last", ignorenulls=True).over(w))
    return stacked.filter("_kind = 1").select("_row.*", F.col("_last._at").alias(right_on), *(F.col(f"_last.{c}").alias(c) for c in take))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, low: int, high: int) -> DataFrame:
    """Pairs of equal keys with right_ts - left_ts in low..high, by time buckets as wide as the interval.

    A left row meets the two buckets that its interval may reach, so the work for a busy key is cut by time.
    Columns of the two sides other than keys must differ.
    """
    width = max(1, high - low + 1)
    start = F.floor((F.col(left_ts) + low) / width)
    a = left.withColumn("_b", F.explode(F.array(start, start + 1)))
    b = right.withColumn("_b", F.floor(F.col(right_ts) / width))
    gap: Column = F.col(right_ts) - F.col(left_ts)
    return a.join(b, [*keys, "_b"]).filter(gap.between(low, high)).drop("_b")
