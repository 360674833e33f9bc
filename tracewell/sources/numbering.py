"""Row numbers in file order, and dense numbers of accounts; the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.audit import ranked


def in_file_order(rows: DataFrame, name: str = "tx_key") -> DataFrame:
    """rows, read from files, with `name`: 1, 2, ... in the order of file names and of rows within each file.

    Rows are numbered within the blocks in which files are read, and each block starts after the rows of those before it;
    however files are cut into blocks, a row's number is the same. One row for each block meets in one task, no more.
    """
    own = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_read")]
    placed = rows.select(*rows.columns, *own)
    size = rows.groupBy(own[0], own[1]).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    start = size.select("_file", "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_read"))
    return placed.withColumn("_own", within).join(start, ["_file", "_block"]).select(*rows.columns, (F.col("_start") + F.col("_own")).alias(name))


def dense_ids(accounts: DataFrame, column: str = "acct_no", name: str = "acct_id") -> DataFrame:
    """column and name: its distinct values, not null, numbered from 0 in their order by a range sort."""
    distinct = accounts.select(column).filter(F.col(column).isNotNull()).distinct()
    return ranked(distinct, [column]).select(column, (F.col("_rank") - 1).alias(name))


def with_ids(rows: DataFrame, ids: DataFrame, columns: dict[str, str], column: str = "acct_no", name: str = "acct_id") -> DataFrame:
    """rows with the number of the value in each of `columns` (value column to new column); null where a value has none."""
    for c, new in columns.items():
        rows = rows.join(ids.select(F.col(column).alias(c), F.col(name).alias(new)), c, "left")
    return rows
