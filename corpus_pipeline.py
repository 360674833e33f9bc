"""The corpus pipeline: language ID, near duplicates, repeated strings, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents. What they decide takes effect:

* language: documents without a letter, and those whose leading language holds less than half of them, go;
* near_duplicates: of each group only the document with the smallest doc_id stays (one row of it, if it is repeated;
  null doc_ids come last);
* repeated_strings: every byte in a string of 100 bytes that also starts earlier is cut out of the text;
* contamination: documents of which at least a twentieth of the words lie in benchmark passages go;
* tokens: every remaining text becomes the ids of the byte-level vocabulary.

Every row is judged by itself, under its number in the stage's input: rows that share a doc_id or have none don't take
each other with them. Null texts are rejected by the first stage. Empty input gives empty output. A stage reads its input
more than once, which must give the same rows in the same order, as files do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, language_id, ngram_join, suffix_dedup
from tracewell.llm.store import bounded_batches, materialise, remove, scratch, shared_dir, ship, table

MIN_SHARE = 0.5


ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered rows without those of the given numbers, which are broadcast only if they are few."""
    return rows.join(ngram_join.small(materialise(gone.select(ROW), "gone")), ROW, "left_anti").drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = language_id.identify(docs, docs.columns).filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_SHARE))
    return found.select(*(F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = _numbered(docs)
    groups = ngram_join.groups(rows.select(F.col(ROW).alias("doc_id"), "text")).filter("n_shingles > 0")
    groups = groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("component"))
    members = materialise(rows.select(ROW, "doc_id").join(groups, ROW), "members")
    # null doc_ids come last in a group, rows of one doc_id in their order
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    return _without(rows, members.join(first, "component").filter(F.col(ROW) != F.col(f"first.{ROW}")))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return suffix_dedup.texts(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = _numbered(docs)
    found = decontaminate.find(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.filter("contaminated").select(F.col("doc_id").alias(ROW)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", contamination),
    ("byte-level BPE", tokens),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again. What lies between is deleted."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
