"""Statistical checks of any table: shapes, uniqueness, consistency, ranges, outliers, digits, order, time.

Each returns the aggregates behind a verdict; `verdict_*` helpers judge small results on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.cut import cut


def shapes(df: DataFrame, column: str) -> DataFrame:
    """shape, n, share: letters as A, digits as 9, other non-ASCII characters as U."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(column, "[^\\x00-\\x7F]", "U"), "[A-Za-z]", "A"), "[0-9]", "9")
    n = df.filter(F.col(column).isNotNull()).groupBy(s.alias("shape")).agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("_t"))).select("shape", "n", (F.col("n") / F.col("_t")).alias("share"))


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat, and of those with rows that differ elsewhere."""
    each = df.groupBy(*columns).agg(F.count("*").alias("n"), F.min(F.xxhash64(*df.columns)).alias("x"), F.max(F.xxhash64(*df.columns)).alias("y"))
    return each.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("x") != F.col("y")).alias("n_differing"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def ranges(df: DataFrame, column: str, group: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """For each group: rows, smallest, largest, rows outside the group's limits."""
    spark = df.sparkSession
    table = spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in limits.items()], "_g string, lo double, hi double")
    j = df.join(F.broadcast(table), F.col(group).cast("string") == F.col("_g"), "left")
    x = F.col(column).cast("double")
    return j.groupBy(F.col(group).cast("string").alias("grp")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("n_outside"))


def outliers(df: DataFrame, column: str, group: str, k: float = 1.5) -> DataFrame:
    """For each group: rows, rows beyond the population's quartile fences, and the lift over the population's rate."""
    x = F.col(column).cast("double")
    q = df.agg(F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.75)).alias("q3"), F.count("*").alias("_n"))
    far = (x < F.col("q1") - k * (F.col("q3") - F.col("q1"))) | (x > F.col("q3") + k * (F.col("q3") - F.col("q1")))
    each = df.join(F.broadcast(q)).groupBy(F.col(group).cast("string").alias("grp")).agg(F.count("*").alias("n"), F.count_if(far).alias("n_out"))
    total = each.agg(F.sum("n").alias("_n"), F.sum("n_out").alias("_o"))
    return each.join(F.broadcast(total)).select("grp", "n", "n_out", F.when(F.col("_o") > 0, (F.col("n_out") / F.col("n")) / (F.col("_o") / F.col("_n"))).alias("lift"))


def first_digits(df: DataFrame, column: str) -> DataFrame:
    """digit, n, share, expected by Benford's law."""
    digit = F.regexp_extract(F.abs(F.col(column)).cast("decimal(38,4)").cast("string"), "[1-9]", 0)
    n = df.select(digit.alias("digit")).filter("digit <> ''").groupBy(F.col("digit").cast("int").alias("digit")).agg(F.count("*").alias("n"))
    return n.join(n.agg(F.sum("n").alias("_t"))).select("digit", "n", (F.col("n") / F.col("_t")).alias("share"), F.log10(1 + 1 / F.col("digit")).alias("expected"))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _rank, from 1, and _n, in the given unique order: a range sort whose parts are numbered, no single task."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    size = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    start = size.withColumn("_start", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = start.join(F.broadcast(size.agg(F.sum("_size").alias("_n")))).drop("_size")  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(start), "_part").withColumn("_rank", F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def row_position(df: DataFrame, order: list[str], rare, bins: int = 20) -> DataFrame:
    """bin, n, n_rare: equal parts of the order (the first ones take the remainder) and the rare rows in each."""
    at = ranked(df, order)
    small, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    cutoff = extra * (small + 1)
    b = F.when(F.col("_rank") <= cutoff, F.floor((F.col("_rank") - 1) / (small + 1))).otherwise(extra + F.floor((F.col("_rank") - 1 - cutoff) / F.greatest(small, F.lit(1))))
    return at.groupBy((b + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(rare).alias("n_rare"))


def adjacency(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """One row: pairs of neighbours in the order, how many agree in the column, and the share expected by chance.

    Neighbours meet by rank, a row with its successor, in a join.
    """
    at = ranked(df, order).select("_rank", F.col(column).alias("v"))
    pair = at.join(at.select((F.col("_rank") - 1).alias("_rank"), F.col("v").alias("w")), "_rank")
    same = pair.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("v") == F.col("w")).alias("n_same"))
    freq = df.groupBy(column).agg(F.count("*").alias("n"))
    chance = freq.agg((F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("expected"))
    return same.join(chance)


def adjacent(df: DataFrame, order: list[str], column: str, next_column: str) -> DataFrame:
    """One row: pairs of a row's `column` and the next row's `next_column`, how many agree, and the chance that any two do."""
    text = lambda c: F.col(c).cast("string")
    at = ranked(df, order).select("_rank", text(column).alias("v"), text(next_column).alias("w"))
    pair = at.select("_rank", "v").join(at.select((F.col("_rank") - 1).alias("_rank"), F.col("w").alias("after")), "_rank").filter("v is not null and after is not null")
    same = pair.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("v") == F.col("after")).alias("n_same"))
    count = lambda c, n: df.filter(F.col(c).isNotNull()).groupBy(text(c).alias("x")).agg(F.count("*").alias(n))
    both = count(column, "a").join(count(next_column, "b"), "x", "full")
    product = F.sum(F.coalesce(F.col("a"), F.lit(0)).cast("double") * F.coalesce("b", F.lit(0)))
    return same.join(both.agg(F.try_divide(product, F.sum("a").cast("double") * F.sum("b")).alias("chance")))  # single rows


def time_sorted(df: DataFrame, order: list[str], ts: str) -> float | None:
    """The share of rows, after the first, whose time isn't before that of the row before them in the order."""
    at = ranked(df, order).select("_rank", ts)
    pair = at.join(at.select((F.col("_rank") - 1).alias("_rank"), F.col(ts).alias("_after")), "_rank")
    r = pair.agg(F.count("*").alias("n"), F.count_if(F.col("_after") >= F.col(ts)).alias("up")).first()
    return r.up / r.n if r.n else None


def time_pattern(df: DataFrame, ts: str) -> DataFrame:
    """hour, n, days: rows and distinct dates by hour of the day."""
    t = F.col(ts).cast("timestamp_ntz")
    return df.groupBy(F.hour(t).cast("int").alias("hour")).agg(F.count("*").alias("n"), F.countDistinct(t.cast("date")).alias("days"))


def chi2_survival(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), by the regularised incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(log_front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b) if an * d + b else 1e300
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return math.exp(log_front) * h


def verdict_even(counts: list[int], alpha: float = 0.001) -> tuple[str, float, float]:
    """(CLEAN or SIGNAL, chi-square, p) of counts against an equal split."""
    total = sum(counts)
    if len(counts) < 2 or not total:
        return "INCONCLUSIVE", 0.0, 1.0
    e = total / len(counts)
    x = sum((c - e) ** 2 / e for c in counts)
    p = chi2_survival(x, len(counts) - 1)
    return ("SIGNAL" if p < alpha else "CLEAN"), x, p


def cramers_v(rows: list[tuple[str, str, int]]) -> float:
    """Association of two columns from their contingency rows (a, b, n)."""
    left, right, total = {}, {}, 0
    for a, b, n in rows:
        left[a], right[b], total = left.get(a, 0) + n, right.get(b, 0) + n, total + n
    k = min(len(left), len(right)) - 1
    if not total or k < 1:
        return 0.0
    seen = {(a, b): n for a, b, n in rows}
    x = sum((seen.get((a, b), 0) - p * q / total) ** 2 / (p * q / total) for a, p in left.items() for b, q in right.items())
    return math.sqrt(x / total / k)
