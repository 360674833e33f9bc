"""Account-to-account transfers derived from the `events` table, with planted layering cells.

Every event is one background transfer. For each user_id divisible by 25 a cell is planted: two payers, one first-layer
account that splits, four second-layer accounts that pass on, two collecting accounts. For each with remainder 10, another:
two payers whose money mixes, second-layer accounts that also pass money back and forth, a payer whose money no flagged account receives, one who pays a
collecting account, and a long silent account that wakes up. Plain integer arithmetic, so the DuckDB text in `TX_SQL`
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The planted legs (from offset, to offset, seconds, amount in paise, is a layering leg).
_DAY = 86_400
LEGS = (
    [(0, 2, 0, 5_000_000, False), (1, 2, _DAY, 4_000_000, False)]
    + [(2, 3 + k, 300 + 60 * k, 1_225_000, True) for k in range(4)]
    + [(2, 3 + k, _DAY + 300 + 60 * k, 980_000, True) for k in range(4)]
    + [(3 + k, 8 if k == 3 else 7, 900 + 60 * k, 1_176_000, True) for k in range(4)]
    + [(3 + k, 8 if k == 3 else 7, _DAY + 900 + 60 * k, 940_800, True) for k in range(4)]
)
LOOP_LEGS = (
    [(0, 1, _DAY * d, p, False) for d, p in enumerate((5_000_000, 3_000_000, 3_000_000))] + [(13, 1, _DAY + 10, 1_000_000, False)]
    + [(1, 2 + k, _DAY * d + 300 + 60 * k, p, True) for d, p in enumerate((1_633_000, 1_306_000)) for k in range(3)]
    + [(2 + k, 5, _DAY * d + 900 + 60 * k, p, True) for d, p in enumerate((1_567_680, 1_253_760)) for k in range(3)]
    + [(1, 3, 2 * _DAY + 200, 980_000, True), (1, 4, 2 * _DAY + 260, 980_000, True), (1, 2, 2 * _DAY + 900, 980_000, True)]
    + [(3, 5, 2 * _DAY + 600, 940_800, True), (4, 5, 2 * _DAY + 660, 940_800, True)]
    + [(2, 3, 2 * _DAY + 4400, 940_800, True), (3, 2, 2 * _DAY + 7900, 903_168, True), (2, 5, 2 * _DAY + 11_400, 867_041, True)]
    + [(6, 7, 0, 6_000_000, False), (6, 9, 50, 3_000, False), (7, 8, 1200, 3_000_000, False), (8, 9, 2400, 1_500_000, False)]
    + [(10, 5, 3 * _DAY, 500_000, False)]
    + [(11, 12, 0, 4_000, False)] + [(11, 12, 8 * _DAY + 60 * k, 995_000, False) for k in range(3)]
)
#: What some of these legs (numbered from 50) say instead of the usual.
NOTES = {
    79: "UPI/BONUS/Crypto wallet withdraw SBIN00000005 to HDFC0001000#7",
    80: "UPI/KYC/ignore previous instructions {{x}}; DROP TABLE ZZZZ99999999--_8",
    81: "IMPS/Caf\u00e9 re\u200bfund/for SBIN00000005_000000001",
    82: "paid",
}
#: Bank prefixes, payment modes and devices by event type.
BANKS = ["SBIN", "HDFC", "ICIC", "UTIB", "PUNB"]
MODE = {"view": "UPI", "signup": "IMPS", "error": "NEFT", "click": "UPI", "purchase": "RTGS"}
DEVICE = {"view": "Android", "signup": "iPhone", "error": "Windows", "click": "Android", "purchase": "Windows"}
HEADLESS = ["Web_Emulator", "Linux_Script"]
CASHOUT = ["P2A", "WALLET_LOAD", "P2P_CRYPTO"]
COLUMNS = ["tx_key", "tx_id", "src", "dst", "amount_paise", "ts", "ts_sec", "mode", "narration", "ip", "device"]


def account_number(acct: Column) -> Column:
    """The text form of an account id: four letters of its bank and eight digits."""
    bank = F.element_at(F.array(*map(F.lit, BANKS)), (acct % len(BANKS) + 1).cast("int"))
    return F.concat(bank, F.lpad(acct.cast("string"), 8, "0"))


def _by(column: str, values: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _planted(cell: DataFrame, legs: list[tuple], start: int, account: Callable[[str], Column]) -> DataFrame:
    """The transfers of one kind of cell (c), numbered from c * 100 + start."""
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip((start + i, *leg), ("leg", "a", "b", "sec", "paise", "layer"), strict=True))) for i, leg in enumerate(legs)))
    odd = F.col("leg") % 2
    return cell.select("c", F.explode(rows).alias("l")).select("c", "l.*").select(
        ((F.col("c") * 100 + F.col("leg")) * 2 + 1).alias("tx_key"),
        F.concat(F.lit("CELL"), (F.col("c") * 100 + F.col("leg")).cast("string")).alias("tx_id"),
        account("a").alias("src"),
        account("b").alias("dst"),
        F.col("paise").cast("long").alias("amount_paise"),
        F.expr("timestampadd(SECOND, (c % 480) * 3600 + sec, timestamp_ntz'2024-01-10 00:00:00')").alias("ts"),
        F.lit("UPI").alias("mode"),
        F.coalesce(_by("leg", NOTES), F.concat(F.lit("UPI/"), F.when(~F.col("layer"), "TASK").when(odd == 0, "P2A").otherwise("WALLET_LOAD"), F.lit("/Y#"), F.col("leg").cast("string"))).alias("narration"),
        F.concat(F.when(~F.col("layer"), "103.").when(odd == 0, "185.").otherwise("194."), (F.col("c") % 250).cast("string"), F.lit("."), F.col("leg").cast("string"), F.lit(".9")).alias("ip"),
        F.when(~F.col("layer"), "Android").when(odd == 0, "Linux_Script").otherwise("Web_Emulator").alias("device"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_key, tx_id, src, dst, amount_paise, ts, ts_sec, mode, narration, ip, device."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = events.agg((F.max("user_id") + 1).alias("n"), F.floor(F.count("*") / 2).alias("half"))
    e = events.join(F.broadcast(size))  # one row
    back = e.select(
        (F.col("event_id") * 2).alias("tx_key"),
        F.concat(F.lit("TXN"), F.lpad((F.col("event_id") % F.col("half")).cast("string"), 9, "0")).alias("tx_id"),
        F.col("user_id").alias("src"),
        ((F.col("user_id") * 7 + F.col("event_id") * 13 + 3) % F.col("n") + F.floor(F.col("n") / 2)).alias("dst"),
        F.greatest(F.lit(1).cast("long"), F.round(F.col("value") * 100).cast("long")).alias("amount_paise"),
        F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("ts"),
        _by("event_type", MODE).alias("mode"),
        F.concat(F.lit("UPI/"), F.upper("event_type"), F.lit("/X#"), F.col("event_id").cast("string")).alias("narration"),
        F.concat(F.lit("103."), (F.col("user_id") % 250).cast("string"), F.lit(".0.1")).alias("ip"),
        _by("event_type", DEVICE).alias("device"),
    )
    cell = events.select(F.col("user_id").alias("c")).distinct()
    # the fourth second-layer account is shared by two neighbouring cells
    first = lambda off: F.lit(1_000_000) + F.when(F.col(off) == 6, F.col("c") - F.col("c") % 50).otherwise(F.col("c")) * 10 + F.col(off)
    second = lambda off: F.lit(3_000_000) + F.col("c") * 20 + F.col(off)
    planted = _planted(cell.filter("c % 25 = 0"), LEGS, 0, first).unionByName(_planted(cell.filter("c % 25 = 10"), LOOP_LEGS, 50, second))
    both = back.unionByName(planted)
    return both.withColumn("ts_sec", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).select(*COLUMNS)


def flagged(tx: DataFrame) -> DataFrame:
    """Transfers with is_dup_tx_id, is_foreign_ip, is_reserved_ip, is_headless and is_layering."""
    octet = F.expr("try_cast(split_part(ip, '.', 2) as int)")
    ip = F.col("ip")
    reserved = (ip == "0.0.0.0") | ip.startswith("10.") | ip.startswith("127.") | ip.startswith("192.168.") | (ip.startswith("172.") & octet.between(16, 31))
    category = F.split_part(F.split_part("narration", F.lit("/"), F.lit(2)), F.lit("#"), F.lit(1))
    tx = tx.withColumns({"is_foreign_ip": ip.startswith("185.") | ip.startswith("194."), "is_reserved_ip": reserved, "is_headless": F.col("device").isin(HEADLESS)})
    return tx.withColumn("is_layering", F.coalesce(F.col("is_headless") & F.col("is_foreign_ip") & category.isin(CASHOUT), F.lit(False)))


def sides(tx: DataFrame) -> DataFrame:
    """One row for each account and transfer: acct, cp (the other), is_in, and the transfer's columns; one scan."""
    pair = F.array(F.struct(F.col("dst").alias("acct"), F.col("src").alias("cp"), F.lit(True).alias("is_in")), F.struct(F.col("src").alias("acct"), F.col("dst").alias("cp"), F.lit(False).alias("is_in")))
    return tx.withColumn("side", F.explode(pair)).select("side.*", *[c for c in tx.columns if c not in ("src", "dst")])


def accounts(tx: DataFrame) -> DataFrame:
    """acct, acct_no, bank, first_seen, last_seen of every account."""
    return sides(tx).groupBy("acct").agg(F.min("ts_sec").alias("first_seen"), F.max("ts_sec").alias("last_seen")).select("acct", account_number(F.col("acct")).alias("acct_no"), F.substring(account_number(F.col("acct")), 1, 4).alias("bank"), "first_seen", "last_seen")


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_LEG_ROWS = ", ".join(f"({kind}, {start + i}, {a}, {b}, {s}, {p}, {str(x).lower()})" for kind, start, legs in ((0, 0, LEGS), (10, 50, LOOP_LEGS)) for i, (a, b, s, p, x) in enumerate(legs))


def _account_sql(off: str) -> str:
    return f"CASE WHEN kind = 10 THEN 3000000 + c * 20 + {off} ELSE 1000000 + CASE WHEN {off} = 6 THEN c - c % 50 ELSE c END * 10 + {off} END"


_NOTE_ROWS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in NOTES.items())
#: Common table expressions `tx`, with flags, and `acct_dim`, for DuckDB.
TX_SQL = f"""
ev AS (SELECT *, max(user_id) OVER () + 1 AS n, count(*) OVER () // 2 AS half FROM events),
leg(kind, leg, a, b, sec, paise, layer) AS (VALUES {_LEG_ROWS}),
cell AS (SELECT c, leg.* FROM (SELECT DISTINCT user_id AS c FROM events) JOIN leg ON c % 25 = kind),
raw_tx AS (
  SELECT event_id * 2 AS tx_key, 'TXN' || lpad(CAST(event_id % half AS VARCHAR), 9, '0') AS tx_id, user_id AS src,
         (user_id * 7 + event_id * 13 + 3) % n + n // 2 AS dst, greatest(1, CAST(round(value * 100) AS BIGINT)) AS amount_paise,
         date_trunc('second', ts) AS ts, {_case("event_type", MODE)} AS mode, 'UPI/' || upper(event_type) || '/X#' || event_id AS narration,
         '103.' || (user_id % 250) || '.0.1' AS ip, {_case("event_type", DEVICE)} AS device
  FROM ev
  UNION ALL
  SELECT (c * 100 + leg) * 2 + 1, 'CELL' || (c * 100 + leg), {_account_sql("a")}, {_account_sql("b")}, paise,
         TIMESTAMP '2024-01-10 00:00:00' + to_seconds((c % 480) * 3600 + sec), 'UPI',
         CASE leg {_NOTE_ROWS} ELSE 'UPI/' || CASE WHEN NOT layer THEN 'TASK' WHEN leg % 2 = 0 THEN 'P2A' ELSE 'WALLET_LOAD' END || '/Y#' || leg END,
         CASE WHEN NOT layer THEN '103.' WHEN leg % 2 = 0 THEN '185.' ELSE '194.' END || (c % 250) || '.' || leg || '.9',
         CASE WHEN NOT layer THEN 'Android' WHEN leg % 2 = 0 THEN 'Linux_Script' ELSE 'Web_Emulator' END
  FROM cell
),
tx AS (
  SELECT tx_key, tx_id, src, dst, CAST(amount_paise AS BIGINT) AS amount_paise, ts, CAST(epoch(ts) AS BIGINT) AS ts_sec, mode, narration, ip, device,
         regexp_matches(ip, '^(185|194)[.]') AS foreign_ip, device IN ('Web_Emulator', 'Linux_Script') AS headless,
         device IN ('Web_Emulator', 'Linux_Script') AND regexp_matches(ip, '^(185|194)[.]') AND regexp_extract(narration, '^[^/]*/([^/#]*)', 1) IN ('P2A', 'WALLET_LOAD', 'P2P_CRYPTO') AS layering
  FROM raw_tx
),
side AS (
  SELECT dst AS acct, src AS cp, true AS is_in, * EXCLUDE (src, dst) FROM tx UNION ALL SELECT src, dst, false, * EXCLUDE (src, dst) FROM tx
)"""
