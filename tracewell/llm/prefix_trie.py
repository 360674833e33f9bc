"""Prefix trie of conversations with subtree totals, rolled up in bands of depth.

A node is a distinct sequence of a conversation's first d turns. Its name is a digest of the turns' digests, so texts are
read once and never shuffled. Bands hold `height` depths each. Within a band, every node is exploded to its ancestors in
that band only, and their totals are summed; then, from the deepest band up, the totals of band roots, now complete, go to
their parents in the band above and to those parents' ancestors there. With the default height, the square root of
the greatest depth, a node has at most that many ancestors to explode to and there are at most that many rounds.

A conversation's turns are numbered by a range sort, and its node names are built band by band, so a very long one is
shared by many tasks. Nodes are counted with partial aggregates, so a first turn that all conversations share is one row
for each task. The ids of conversations that end at one node are joined to text in blocks of at most `BLOCK` ids;
only the digest of a node with several blocks, which SHA-256 allows in order alone, streams through one task.

Defined results: turns are ordered by turn (null first), then by the digest of role and text; null role or text is
empty; repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. A
conversation without turns after rebuilding is a member of the root alone. An empty table gives no nodes. Other columns
than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, settled

BLOCK = 4096
ROOT = ""
_DIGEST = 32


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256, as hex."""
    return F.left(F.sha2(F.concat(*parts).cast("binary"), 256), F.lit(_DIGEST))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), said (digest of role and text), words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("said"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "said", "row"]
    # sorted parts are written, so that their numbers stay; each part counts by itself, and what came before is added
    parts = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "said", "row")
    counted = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = counted.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    at = parts.withColumn("pos", F.row_number().over(within)).join(offset, ["conv_id", "part"])
    return at.select("conv_id", (F.col("pos") + F.col("before")).cast("long").alias("pos"), "said", "words")


def rebuild(numbered: DataFrame, shared: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, said, words, is_end) of every rebuilt turn; the ids of conversations without any.

    The first h turns of conversation c - c % shared, h = crc32(c) % heads, then c's own after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % shared
    convs = numbered.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"h": h, "base": base})
    head = numbered.filter(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "said", "words")
    held = head.groupBy("base").agg(F.max("pos").alias("held"))
    convs = convs.join(held, "base", "left").withColumn("k", F.least("h", F.coalesce("held", F.lit(0))))
    convs = materialise(convs.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    plan = convs.select("conv_id", "h", "k", "length")
    first = convs.select("conv_id", "base", "k", "length").filter("k > 0").join(head, "base").filter("pos <= k").select("conv_id", F.col("pos").alias("depth"), "said", "words", "length")
    own = numbered.join(plan, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "said", "words", "length")
    rows = first.unionByName(own).withColumn("is_end", F.col("depth") == F.col("length")).drop("length")
    return rows, convs.filter("length = 0").select("conv_id")


def named(rows: DataFrame, height: int) -> DataFrame:
    """Every rebuilt turn with its node, its parent and path: the nodes of its band from the band's root to itself."""
    rows = rows.withColumn("band", F.floor(F.col("depth") / height))
    upto = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = materialise(rows.withColumn("within", F.array_join(F.collect_list("said").over(upto), "")), "turns")
    # a band's last turn holds what the whole band says; the bands before name the place where a band begins
    full = rows.filter((F.col("depth") + 1) % height == 0).select("conv_id", "band", _digest("within").alias("whole"))
    bands = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    place = full.select("conv_id", (F.col("band") + 1).alias("band"), _digest(F.lit("place"), F.array_join(F.collect_list("whole").over(bands), "")).alias("entry"))
    after = place.select("conv_id", (F.col("band") - 1).alias("band"), F.col("entry").alias("last"))
    rows = rows.join(place, ["conv_id", "band"], "left").join(after, ["conv_id", "band"], "left").withColumn("entry", F.coalesce("entry", F.lit(ROOT)))
    is_last = (F.col("depth") + 1) % height == 0
    rows = rows.withColumn("node", F.when(is_last, F.col("last")).otherwise(_digest(F.lit("node"), "entry", "within")))
    before = F.lag("node").over(Window.partitionBy("conv_id", "band").orderBy("depth"))
    in_band = F.collect_list("node").over(upto)
    return rows.select(
        "conv_id", "depth", "band", "words", "is_end", "node", F.coalesce(before, "entry").alias("parent"),
        F.when(F.col("band") == 0, F.concat(F.array(F.lit(ROOT)), in_band)).otherwise(in_band).alias("path"),
    )


def _ends(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id): the digest of the ids, ascending, joined by commas."""
    blocks = ends.groupBy("node", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    blocks = materialise(blocks, "ends")
    alone = blocks.groupBy("node").agg(F.count("*").alias("n"), F.max("ids").alias("ids"))
    one = alone.filter("n = 1").select("node", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = blocks.join(alone.filter("n > 1").select("node"), "node").select("node", "block", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hasher, done = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != at:
                    if hasher:
                        done.append((at, hasher.hexdigest()))
                    at, hasher = node, hashlib.sha256(ids.encode())
                else:
                    hasher.update(b"," + ids.encode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])
                done = []
        if hasher:
            done.append((at, hasher.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])

    streamed = several.repartition("node").sortWithinPartitions("node", "block").mapInArrow(run, "node string, ends_sha256 string")
    return one.unionByName(streamed)


def _up(totals: DataFrame) -> DataFrame:
    """Totals (path, leaves, saved) summed at every node of their paths."""
    return totals.select(F.explode("path").alias("node"), "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rollup(nodes: DataFrame, height: int, bands: int) -> DataFrame:
    """node, leaves, saved over whole subtrees, from nodes (node, parent, depth, band, path, leaves, saved of their own)."""
    whole = materialise(_up(nodes).join(nodes.select("node", "parent", "depth", "band"), "node"), "within")
    done = []
    for band in range(bands, -1, -1):
        here = whole.filter(F.col("band") == band)
        if band < bands:
            given = nodes.filter(F.col("band") == band).select("node", "path").join(roots, F.col("node") == F.col("to")).select("path", "leaves", "saved")
            more = _up(given).withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
            here = here.join(more, "node", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
        here = materialise(here.select("node", "parent", "depth", "leaves", "saved"), "band")
        roots = here.filter((F.col("depth") == band * height) & (F.col("depth") > 0)).groupBy(F.col("parent").alias("to")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        done.append(here.select("node", "leaves", "saved"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def trie(conversations: DataFrame, height: int | None = None) -> DataFrame:
    """One row for each node of the rebuilt conversations' trie.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    return settled(conversations.sparkSession, "trie", lambda: _trie(conversations, height))


def _trie(conversations: DataFrame, height: int | None) -> DataFrame:
    rows, turnless = rebuild(materialise(turns(conversations), "numbered"))
    rows = materialise(rows, "rebuilt")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    height = height or max(4, math.isqrt(deepest) + 1)
    rows = materialise(named(rows, height), "named")
    size = rows.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    # the smallest member's row tells the rest; it is one row, as a conversation passes a node once
    nodes = size.join(rows.select("node", "conv_id", "parent", "depth", "band", "words", "path"), ["node", "conv_id"])
    everyone = rows.filter("depth = 1").select("conv_id").unionByName(turnless)
    root = everyone.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), "conv_id", "n_convs", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("words"), F.array(F.lit(ROOT)).alias("path"))
    nodes = nodes.unionByName(root)
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").fillna(0, ["n_children"])
    nodes = materialise(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "nodes")
    totals = rollup(nodes, height, deepest // height)
    ends = _ends(rows.filter("is_end").select("node", "conv_id").unionByName(turnless.select(F.lit(ROOT).alias("node"), "conv_id")))
    named_parent = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_children").join(totals, "node").join(ends, "node", "left").join(named_parent, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
