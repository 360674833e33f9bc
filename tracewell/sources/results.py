"""Stored results of several profiles side by side: one folder for each table, one partition for each profile.

A refill replaces the rows of its own profile alone, by dynamic partition overwrite, and may be repeated.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PLAIN = re.compile(r"[A-Za-z0-9._-]+")


def refill(df: DataFrame, folder: str, table: str, profile_id: str) -> int:
    """Store df as the profile's rows of the table; the number of rows. No rows leave the profile without any."""
    if not PLAIN.fullmatch(profile_id):
        raise ValueError(f"a profile's id has letters, digits, dots, dashes and underscores alone: {profile_id!r}")
    path, seen = f"{folder.rstrip('/')}/{table}", Observation(table)
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("profile_id", F.lit(profile_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_id").parquet(path)
    n = seen.get.get("n", 0)
    if not n:  # what isn't written isn't overwritten either
        spark = df.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/profile_id={profile_id}")
        old.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(old, True)
    return n


def read(spark: SparkSession, folder: str, table: str, profile_id: str | None = None) -> DataFrame:
    """A table's rows with their profile_id, of one profile if it is named; only that partition is read."""
    rows = spark.read.option("basePath", f"{folder.rstrip('/')}/{table}").parquet(f"{folder.rstrip('/')}/{table}").withColumn("profile_id", F.col("profile_id").cast("string"))
    return rows if profile_id is None else rows.filter(F.col("profile_id") == profile_id)
