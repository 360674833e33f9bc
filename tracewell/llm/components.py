"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step joins every node to the smallest node of its neighbourhood; what stays is a star around the smallest id of
each component. Steps are written to the shared folder, so no lineage grows; nothing is collected but a checksum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """e has a > b: every node to the smallest of its smaller neighbours, and those too."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of links (a, b); the component is its smallest id. Null ids are left out."""
    e = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _sum(e)
    while before[0]:
        e = materialise(_small(_large(e)), "stars")
        now = _sum(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links (i, j): the smallest node of each node's component."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label
