"""What transfers say about themselves: shapes, words, hostile text, odd characters, account numbers and references.

Every function is one pass over the narrations with partial aggregates; text is matched and exploded, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of cash-out and scams, words and signs of text that addresses a reader's tools, characters without width.
KEYWORDS = [
    "crypto", "usdt", "p2p", "binance", "wazirx", "wallet", "gateway", "atm", "cash", "withdraw", "offshore", "task", "bonus",
    "invest", "ipo", "kyc", "customs", "arrest", "cbi", "police", "loan", "refund", "betting", "hawala", "mule",
]
INJECTION_WORDS = ["ignore", "previous", "instruction", "system", "assistant", "prompt", "override"]
INJECTION_SIGNS = ["{{", "${", "<script", "</", "' or", "drop", "--", ";"]
ZERO_WIDTH = [0x200B, 0x200C, 0x200D, 0xFEFF]
# The shapes of a narration, of an account number and of a branch code.
HASH = r"\A(?:UPI|IMPS|NEFT|RTGS)/[^/]+/[^#]+#[0-9]+\z"
UNDERSCORE = r"\A(?:UPI|IMPS|NEFT)/[^/]+/[\s\S]+_[0-9]+\z"
THREE_PARTS = r"\A(?:UPI|IMPS|NEFT|RTGS)/[^/]+/[\s\S]+\z"
ACCOUNT, BRANCH = r"[A-Z]{4}[0-9]{8}", r"[A-Z]{4}0[A-Z0-9]{6}"
REFERENCE = r"[#_]([0-9]+)\z"


def shapes(tx: DataFrame) -> DataFrame:
    """shape, n, senders: reference after # or _, three parts without one, empty, or other."""
    text = F.col("narration")
    shape = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(text.rlike(HASH), "hash").when(text.rlike(UNDERSCORE), "underscore").when(text.rlike(THREE_PARTS), "three_parts").otherwise("other")
    return tx.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders"))


def words(tx: DataFrame, wanted: list[str]) -> DataFrame:
    """word, n, senders, n_layering of the narrations that hold each word, in any case; words that none holds with zeros."""
    held = F.filter(F.array(*map(F.lit, wanted)), lambda w: F.contains(F.lower("narration"), w))
    rows = tx.select("src", "is_layering", F.explode(held).alias("word"))
    found = rows.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders"), F.count_if("is_layering").alias("n_layering"))
    return tx.sparkSession.createDataFrame([(w,) for w in wanted], "word string").join(found, "word", "left").fillna(0)


def characters(tx: DataFrame) -> DataFrame:
    """One row: shortest, middle and longest narration, those over 200 characters, beyond ASCII, and with characters of no width."""
    text, size = F.col("narration"), F.length("narration")
    return tx.agg(
        F.min(size).alias("shortest"), F.percentile(size, F.lit(0.5)).alias("middle"), F.percentile(size, F.lit(0.99)).alias("p99"), F.max(size).alias("longest"),
        F.count_if(size > 200).alias("n_long"), F.count_if(text.rlike(r"[^\x00-\x7F]")).alias("n_non_ascii"), F.count_if(text.rlike("[" + "".join(map(chr, ZERO_WIDTH)) + "]")).alias("n_zero_width"),
    )


def account_tokens(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """token, n, n_decoys (in transfers of other accounts), is_known (an account has this number), by account-like token.

    tx: narration, src_no, dst_no; accounts: acct_no.
    """
    rows = tx.select("src_no", "dst_no", F.explode(F.regexp_extract_all("narration", F.lit(ACCOUNT), F.lit(0))).alias("token"))
    found = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if((F.col("token") != F.col("src_no")) & (F.col("token") != F.col("dst_no"))).alias("n_decoys"))
    known = accounts.select(F.col("acct_no").alias("token"), F.lit(True).alias("is_known")).distinct()
    return found.join(known, "token", "left").fillna(False, ["is_known"])


def branch_tokens(tx: DataFrame) -> DataFrame:
    """bank, n of branch-code-like tokens."""
    return tx.select(F.explode(F.regexp_extract_all("narration", F.lit(BRANCH), F.lit(0))).alias("token")).groupBy(F.left("token", F.lit(4)).alias("bank")).agg(F.count("*").alias("n"))


def references(tx: DataFrame) -> DataFrame:
    """One row: narrations that end in a reference, distinct and repeated references, and those that name a transfer's id."""
    ref = F.regexp_extract("narration", REFERENCE, 1)
    rows = tx.select("tx_id", ref.alias("ref")).filter("ref <> ''")
    each = rows.groupBy("ref").agg(F.count("*").alias("n"), F.count_if(F.col("tx_id") == F.concat(F.lit("TXN"), "ref")).alias("own"))
    ids = tx.select(F.col("tx_id").alias("named")).distinct()
    each = each.withColumn("named", F.concat(F.lit("TXN"), "ref")).join(ids.withColumn("is_id", F.lit(1)), "named", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(total("n").alias("n_references"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_repeated"), total("own").alias("n_own_id"), total(F.when(F.col("is_id") == 1, F.col("n"))).alias("n_any_id"))


def categories(tx: DataFrame) -> DataFrame:
    """category (the second part), n, senders, n_headless, n_foreign, n_both: rare categories and what goes with them."""
    category = F.coalesce(F.nullif(F.split_part(F.split_part("narration", F.lit("/"), F.lit(2)), F.lit("#"), F.lit(1)), F.lit("")), F.lit("-"))
    return tx.groupBy(category.alias("category")).agg(
        F.count("*").alias("n"), F.countDistinct("src").alias("senders"), F.count_if("is_headless").alias("n_headless"), F.count_if("is_foreign_ip").alias("n_foreign"), F.count_if(F.col("is_headless") & F.col("is_foreign_ip")).alias("n_both")
    )
