"""What a delimited text file holds byte for byte, before anything parses it: marks, line ends, quotes, fields, repeats.

The file is read as lines of raw bytes in as many parts as Spark cuts it into. A quoted field may hold line ends, so whether
a line begins inside quotes depends on all quotes before it: a running sum over lines in file order, slot by slot. A record
is the run of lines up to the next that begins outside.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.cut import cut
from tracewell.operators.scan import running_sums

from .numbering import in_file_order

SLOT = 10_000


def lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """One row of numbers for each line: file, file_size, line_no (from 1, over all files), size, what it holds, and digests.

    The bytes are read once and stay where they are. even, odd: delimiters outside quotes if the line begins outside or
    inside; whole, ended: 128-bit digests with and without a carriage return at the end.
    """
    text = F.decode("bytes", "ISO-8859-1")  # a character for each byte
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("bytes"), "_metadata")
    pieces = F.split(text, '"', -1)
    cuts = lambda side: F.aggregate(F.filter(pieces, lambda p, i: i % 2 == side), F.lit(0), lambda n, p: n + F.length(p) - F.length(F.replace(p, F.lit(delimiter), F.lit("")))).cast("long")
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    print_of = lambda x: F.left(F.sha2(F.encode(x, "ISO-8859-1"), 256), F.lit(32))
    slim = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.length("bytes").cast("long").alias("size"), text.endswith("\r").alias("cr_end"),
        count(r"\r").alias("cr"), count('"').alias("quotes"), count(r"[\x80-\xff]").alias("wide"), count(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]").alias("control"),
        (~F.is_valid_utf8(F.col("bytes").cast("string"))).alias("invalid"), cuts(0).alias("even"), cuts(1).alias("odd"), print_of(text).alias("whole"), print_of(F.regexp_replace(text, r"\r\z", "")).alias("ended"), "_metadata",
    )
    return in_file_order(slim, "line_no").drop("_metadata")


def records(found: DataFrame) -> DataFrame:
    """file, record (from 1 in each file), n_fields, n_lines, print (digest of its lines' digests) of every record."""
    rows = found.select("file", "line_no", F.floor(F.col("line_no") / SLOT).alias("slot"), "quotes", "even", "odd", "whole", "ended")
    rows = running_sums(rows, ["file"], "slot", ["line_no"], ["quotes"]).withColumn("inside", (F.col("sum_quotes") - F.col("quotes")) % 2)
    rows = rows.select("file", "line_no", "slot", "whole", "ended", (F.col("inside") == 0).cast("long").alias("begins"), F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")).alias("cuts"))
    rows = running_sums(cut(rows), ["file"], "slot", ["line_no"], ["begins"])
    # the lines of one record: as many as its fields hold line ends
    parts = F.array_sort(F.collect_list(F.struct("line_no", "whole", "ended")))
    one = rows.groupBy("file", F.col("sum_begins").alias("record")).agg((F.sum("cuts") + 1).alias("n_fields"), F.count("*").alias("n_lines"), parts.alias("parts"))
    before = F.array_join(F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: p["whole"]), "")
    return one.select("file", "record", "n_fields", "n_lines", F.concat(before, F.element_at("parts", -1)["ended"]).alias("print"))


def check(spark: SparkSession, path: str, n_fields: int, header: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """One row of counts over all files of a path. Empty files have no lines and are not counted.

    n_files, n_bytes, n_marked (files with a byte order mark), n_lines, n_crlf, n_lf, n_lone_cr, n_open_ends (files whose last
    line has no end), n_quotes, n_non_ascii, n_control (bytes below a blank but tab and line ends, and DEL), n_invalid (lines
    that aren't UTF-8), n_records, n_wrong_fields, n_wrong_headers (files), n_repeated and n_in_repeats (records that occur more
    than once by the digests of their lines). With a header each file's first record is one and no record of data.
    """
    found = cut(lines(spark, path, delimiter))
    files = found.groupBy("file").agg(
        F.max("file_size").alias("file_size"), F.sum(F.col("size") + 1).alias("told"), F.count("*").alias("n_lines"), F.count_if("cr_end").alias("cr_ends"), F.max_by("cr_end", "line_no").alias("last_cr"),
        F.sum("cr").alias("cr"), F.sum("quotes").alias("n_quotes"), F.sum("wide").alias("n_non_ascii"), F.sum("control").alias("n_control"), F.count_if("invalid").alias("n_invalid"),
    )
    # the reader leaves out a byte order mark of three bytes and says nothing of a last line's end: the sizes tell both
    marked = F.col("told") < F.col("file_size")
    open_end = F.col("told") + F.when(marked, 3).otherwise(0) > F.col("file_size")
    files = files.withColumn("n_non_ascii", F.col("n_non_ascii") + F.when(marked, 3).otherwise(0))
    crlf = F.col("cr_ends") - F.when(open_end & F.col("last_cr"), 1).otherwise(0)
    files = files.withColumns({"n_crlf": crlf, "n_lone_cr": F.col("cr") - crlf, "n_lf": F.col("n_lines") - F.when(open_end, 1).otherwise(0) - crlf})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = files.agg(
        F.count("*").alias("n_files"), total("file_size").alias("n_bytes"), F.count_if(marked).alias("n_marked"), F.count_if(open_end).alias("n_open_ends"),
        *(total(c).alias(c) for c in ("n_lines", "n_crlf", "n_lf", "n_lone_cr", "n_quotes", "n_non_ascii", "n_control", "n_invalid")),
    )
    rows = cut(records(found))
    head = F.col("record") == 1 if header else F.lit(False)
    expected = hashlib.sha256(delimiter.join(header or []).encode()).hexdigest()[:32]
    fields = rows.agg(F.count_if(~head).alias("n_records"), F.count_if(~head & (F.col("n_fields") != n_fields)).alias("n_wrong_fields"), F.count_if(head & (F.col("print") != expected)).alias("n_wrong_headers"))
    twice = rows.filter(~head).groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n_repeated"), total("n").alias("n_in_repeats"))
    return sums.join(fields).join(twice)  # single rows
