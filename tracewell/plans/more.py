"""Further registered queries: traces, data audit, dataset checks, read layer, ingest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import audit as A
from tracewell.operators import trace as TR
from tracewell.operators.joins import interval_join
from tracewell.sources import ingest as I
from tracewell.sources import transfers as T

from .registry import FEAT, LINKS, ROLES, SCORE1, TX, case_of, query, rounded, tx_of

_PAYERS = "SELECT acct FROM feat WHERE is_send_only AND n_out <= 3"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _payers(case):
    return case.features.filter("is_send_only and n_out <= 3").select("acct")


# traces


@query(f"""WITH {FEAT}, h1 AS (SELECT src AS victim, tx_key, dst, ts_sec FROM tx WHERE src IN ({_PAYERS})),
  h2 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM h1 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 180 AND 900),
  h3 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM h2 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 0 AND 3600),
  h4 AS (SELECT DISTINCT h.victim, t.tx_key, t.dst, t.ts_sec FROM h3 h JOIN tx t ON t.src = h.dst AND t.ts_sec - h.ts_sec BETWEEN 0 AND 3600)
  SELECT victim, 1 AS hop, tx_key FROM h1 UNION ALL SELECT victim, 2, tx_key FROM h2 UNION ALL SELECT victim, 3, tx_key FROM h3 UNION ALL SELECT victim, 4, tx_key FROM h4""")
def structural_chain(spark, sf_dir):
    c = case_of(spark, sf_dir)
    return TR.structural_chain(c.tx, _payers(c), c.profile)


@query(f"WITH {LINKS} SELECT l.from_acct AS victim, l.to_acct AS l1, count(*) AS n_payments, CAST(sum(amount_paise) AS BIGINT) AS paid_paise FROM links l WHERE link_type = 'VICTIM_L1' GROUP BY ALL")
def reverse_payers(spark, sf_dir):
    """Who paid each first-layer account, backwards from it."""
    paid = case_of(spark, sf_dir).links.filter("link_type = 'VICTIM_L1'")
    return paid.groupBy(F.col("from_acct").alias("victim"), F.col("to_acct").alias("l1")).agg(F.count("*").alias("n_payments"), F.sum("amount_paise").alias("paid_paise"))


# data audit, over the given tables


@query("""SELECT shape, n, round(n / (SUM(n) OVER ()), 6) AS share FROM (SELECT regexp_replace(regexp_replace(regexp_replace(p_name, '[^\\x00-\\x7F]', 'U', 'g'), '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1)""")
def audit_shapes(spark, sf_dir):
    return rounded(A.shapes(_table(spark, sf_dir, "part"), "p_name"))


@query("""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (d > 1) AS n_differing FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT lineitem) AS d FROM lineitem GROUP BY 1, 2)""")
def audit_uniqueness(spark, sf_dir):
    return A.uniqueness(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def audit_consistency(spark, sf_dir):
    return A.contingency(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT event_type AS grp, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) FILTER (value < 1 OR value > CASE event_type WHEN 'purchase' THEN 100 ELSE 200 END) AS n_outside FROM events GROUP BY 1""")
def audit_ranges(spark, sf_dir):
    limits = {k: (1, 100 if k == "purchase" else 200) for k in T.MODE}
    return rounded(A.ranges(_table(spark, sf_dir, "events"), "value", "event_type", limits))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), g AS (SELECT event_type AS grp, count(*) AS n, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS n_out FROM events, q GROUP BY 1)
  SELECT grp, n, n_out, CASE WHEN sum(n_out) OVER () > 0 THEN round((n_out / n) / (sum(n_out) OVER () / sum(n) OVER ()), 6) END AS lift FROM g""")
def audit_outliers(spark, sf_dir):
    return rounded(A.outliers(_table(spark, sf_dir, "events"), "value", "event_type"))


@query("""SELECT digit, n, round(n / sum(n) OVER (), 6) AS share, round(log10(1 + 1 / digit), 6) AS expected FROM (SELECT CAST(regexp_extract(CAST(CAST(abs(o_totalprice) AS DECIMAL(38, 4)) AS VARCHAR), '[1-9]') AS INT) AS digit, count(*) AS n FROM orders WHERE regexp_extract(CAST(CAST(abs(o_totalprice) AS DECIMAL(38, 4)) AS VARCHAR), '[1-9]') <> '' GROUP BY 1)""")
def audit_distribution(spark, sf_dir):
    return rounded(A.first_digits(_table(spark, sf_dir, "orders"), "o_totalprice"))


@query("SELECT CAST(bin AS INT) AS bin, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_rare FROM (SELECT event_type, ntile(20) OVER (ORDER BY event_id) AS bin FROM events) GROUP BY 1")
def audit_row_position(spark, sf_dir):
    return A.row_position(_table(spark, sf_dir, "events"), ["event_id"], F.col("event_type") == "purchase")


@query("""SELECT count(*) AS n_pairs, count(*) FILTER (v = w) AS n_same, round((SELECT sum(n * n) / (sum(n) * sum(n)) FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type)), 6) AS expected FROM (SELECT event_type AS v, lead(event_type) OVER (ORDER BY event_id) AS w, lead(event_id) OVER (ORDER BY event_id) AS x FROM events) WHERE x IS NOT NULL""")
def audit_adjacency(spark, sf_dir):
    return rounded(A.adjacency(_table(spark, sf_dir, "events"), ["event_id"], "event_type"))


@query("SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def audit_time_pattern(spark, sf_dir):
    return A.time_pattern(_table(spark, sf_dir, "events"), "ts")


# flow funnel


@query(f"WITH {SCORE1} SELECT CASE WHEN is_send_only THEN 'send_only' WHEN is_receive_only THEN 'receive_only' ELSE 'both' END AS kind, band, count(*) AS n, CAST(sum(tx_count) AS BIGINT) AS n_tx FROM s1 GROUP BY ALL")
def funnel_population(spark, sf_dir):
    kind = F.when(F.col("is_send_only"), "send_only").when(F.col("is_receive_only"), "receive_only").otherwise("both")
    return case_of(spark, sf_dir).pass1.groupBy(kind.alias("kind"), "band").agg(F.count("*").alias("n"), F.sum("tx_count").alias("n_tx"))


@query(f"""WITH {ROLES}, e AS (SELECT acct AS k, min(CASE WHEN is_send_only THEN 'payer' WHEN is_receive_only THEN 'sink' ELSE 'middle' END) AS grp FROM feat GROUP BY 1)
  SELECT coalesce(grp, '-') AS grp, coalesce(role, '-') AS role, count(*) AS n FROM e FULL JOIN (SELECT acct, role FROM roles WHERE role IS NOT NULL) r ON r.acct = e.k GROUP BY 1, 2""")
def funnel_agreement(spark, sf_dir):
    c = case_of(spark, sf_dir)
    grp = F.when(F.col("is_send_only"), "payer").when(F.col("is_receive_only"), "sink").otherwise("middle")
    j = c.features.select("acct", grp.alias("grp")).join(c.roles.filter("role is not null").select("acct", "role"), "acct", "full")
    return j.groupBy(F.coalesce("grp", F.lit("-")).alias("grp"), F.coalesce("role", F.lit("-")).alias("role")).agg(F.count("*").alias("n"))


# dataset checks


@query(f"WITH {TX}, p AS (SELECT src, dst, count(*) AS n FROM tx GROUP BY 1, 2) SELECT x.src AS a, x.dst AS b, x.n AS n_ab, y.n AS n_ba FROM p x JOIN p y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def trap_reciprocal_pairs(spark, sf_dir):
    p = tx_of(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))
    # one row for each unordered pair: both directions meet in a group, not in a self-join
    low, high = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    side = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rows = p.filter("src <> dst").select(low, high, "src", "n").groupBy("a", "b").agg(side(F.col("src") == F.col("a")).alias("n_ab"), side(F.col("src") == F.col("b")).alias("n_ba"))
    return rows.filter("n_ab > 0 and n_ba > 0")


@query(f"WITH {TX}, e AS (SELECT DISTINCT src AS a, dst AS b FROM tx WHERE src <> dst) SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b")
def trap_three_cycles(spark, sf_dir):
    e = tx_of(spark, sf_dir).filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    up = e.filter("a < b")  # the cycle is told from its smallest account
    two = up.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").filter("a < c")
    return two.join(e.select(F.col("a").alias("c"), F.col("b").alias("a")), ["c", "a"], "left_semi").select("a", "b", "c")


@query(f"""WITH {TX}, r AS (SELECT acct, sum(CASE WHEN is_in THEN amount_paise ELSE -amount_paise END) OVER (PARTITION BY acct ORDER BY ts_sec, tx_key, is_in DESC ROWS UNBOUNDED PRECEDING) AS bal FROM side)
  SELECT acct, CAST(min(bal) AS BIGINT) AS lowest, count(*) FILTER (bal < 0) AS n_negative FROM r GROUP BY acct""")
def trap_running_balance(spark, sf_dir):
    side = T.sides(tx_of(spark, sf_dir)).withColumn("delta", F.when(F.col("is_in"), F.col("amount_paise")).otherwise(-F.col("amount_paise")))
    w = Window.partitionBy("acct").orderBy("ts_sec", "tx_key", F.desc("is_in")).rowsBetween(Window.unboundedPreceding, 0)
    return side.withColumn("bal", F.sum("delta").over(w)).groupBy("acct").agg(F.min("bal").alias("lowest"), F.count_if(F.col("bal") < 0).alias("n_negative"))


@query(f"""WITH {TX}, p AS (SELECT i.tx_key AS in_key, o.dst FROM tx i JOIN tx o ON o.src = i.dst AND o.ts_sec - i.ts_sec BETWEEN 0 AND 900 AND o.tx_key <> i.tx_key)
  SELECT receivers, count(*) AS n_inflows FROM (SELECT in_key, count(DISTINCT dst) AS receivers FROM p GROUP BY 1) GROUP BY 1""")
def trap_fanout_15m(spark, sf_dir):
    tx = tx_of(spark, sf_dir)
    i = tx.select(F.col("tx_key").alias("in_key"), F.col("dst").alias("acct"), F.col("ts_sec").alias("t0"))
    o = tx.select(F.col("tx_key").alias("out_key"), F.col("src").alias("acct"), F.col("ts_sec").alias("t1"), F.col("dst").alias("to_acct"))
    p = interval_join(i, o, ["acct"], "t0", "t1", 0, 900).filter("in_key <> out_key").groupBy("in_key").agg(F.countDistinct("to_acct").alias("receivers"))
    return p.groupBy("receivers").agg(F.count("*").alias("n_inflows"))


@query(f"WITH {TX} SELECT acct, min(ts_sec) AS first_seen, max(ts_sec) AS last_seen, count(*) AS n FROM side GROUP BY acct HAVING max(ts_sec) - min(ts_sec) < 7 * 86400")
def trap_short_lived(spark, sf_dir):
    s = T.sides(tx_of(spark, sf_dir)).groupBy("acct").agg(F.min("ts_sec").alias("first_seen"), F.max("ts_sec").alias("last_seen"), F.count("*").alias("n"))
    return s.filter(F.col("last_seen") - F.col("first_seen") < 7 * 86400)


@query(f"""WITH {TX}, g AS (SELECT acct, ts_sec - lag(ts_sec) OVER (PARTITION BY acct ORDER BY ts_sec, tx_key) AS gap, count(*) OVER (PARTITION BY acct ORDER BY ts_sec RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS burst FROM side)
  SELECT acct, count(*) AS n_bursts FROM g WHERE gap > 5 * 86400 AND burst >= 3 GROUP BY acct""")
def trap_dormant_burst(spark, sf_dir):
    w = Window.partitionBy("acct")
    s = T.sides(tx_of(spark, sf_dir)).select("acct", "ts_sec", "tx_key")
    s = s.withColumn("gap", F.col("ts_sec") - F.lag("ts_sec").over(w.orderBy("ts_sec", "tx_key"))).withColumn("burst", F.count("*").over(w.orderBy("ts_sec").rangeBetween(0, 86400)))
    return s.filter("gap > 5 * 86400 and burst >= 3").groupBy("acct").agg(F.count("*").alias("n_bursts"))


@query(f"WITH {TX} SELECT mode, count(*) AS n, round(quantile_cont(amount_paise, 0.01), 6) AS p01, round(median(amount_paise), 6) AS p50, round(quantile_cont(amount_paise, 0.99), 6) AS p99, count(*) FILTER (amount_paise % 100000 = 0) AS n_round FROM tx GROUP BY mode")
def trap_amount_quantiles(spark, sf_dir):
    a = "amount_paise"
    return rounded(tx_of(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"), F.percentile(a, F.lit(0.01)).alias("p01"), F.median(a).alias("p50"), F.percentile(a, F.lit(0.99)).alias("p99"), F.count_if(F.col(a) % 100000 == 0).alias("n_round")))


@query(f"WITH {TX} SELECT ts_sec // 60 AS minute, count(*) AS n, count(DISTINCT src) AS senders FROM tx GROUP BY 1 HAVING count(*) >= 2")
def trap_minute_bursts(spark, sf_dir):
    return tx_of(spark, sf_dir).groupBy(F.floor(F.col("ts_sec") / 60).alias("minute")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders")).filter("n >= 2")


@query(f"WITH {TX}, s AS (SELECT src, ts_sec // 900 AS slot, count(*) AS n, stddev_pop(amount_paise) / avg(amount_paise) AS cv FROM tx GROUP BY 1, 2 HAVING count(*) >= 3) SELECT src, slot, n, round(cv, 6) AS cv FROM s WHERE cv < 0.02")
def trap_equal_splits(spark, sf_dir):
    s = tx_of(spark, sf_dir).groupBy("src", F.floor(F.col("ts_sec") / 900).alias("slot")).agg(F.count("*").alias("n"), (F.stddev_pop("amount_paise") / F.avg("amount_paise")).alias("cv"))
    return rounded(s.filter("n >= 3 and cv < 0.02"))


@query(f"WITH {TX} SELECT device, headless AS is_headless, foreign_ip AS is_foreign_ip, regexp_extract(narration, '^[^/]*/([^/#]*)', 1) AS category, count(*) AS n, count(DISTINCT src) AS senders FROM tx GROUP BY ALL")
def trap_cooccurrence(spark, sf_dir):
    category = F.split_part(F.split_part("narration", F.lit("/"), F.lit(2)), F.lit("#"), F.lit(1))
    return tx_of(spark, sf_dir).groupBy("device", "is_headless", "is_foreign_ip", category.alias("category")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders"))


# read layer


@query(f"""WITH {LINKS} SELECT t.tx_key, t.src, t.dst, t.amount_paise, t.mode, l.link_type FROM tx t LEFT JOIN links l USING (tx_key) WHERE t.mode = 'UPI' AND t.amount_paise >= 5000 ORDER BY t.amount_paise DESC, t.tx_key LIMIT 50""")
def search_transactions(spark, sf_dir):
    c = case_of(spark, sf_dir)
    # the filter and the page come first: the join meets 50 rows
    page = c.tx.filter("mode = 'UPI' and amount_paise >= 5000").orderBy(F.desc("amount_paise"), "tx_key").limit(50)
    return page.join(c.links.select("tx_key", "link_type"), "tx_key", "left").select("tx_key", "src", "dst", "amount_paise", "mode", "link_type")


@query(f"WITH {ROLES} SELECT r.acct, role, band, round(final_index, 6) AS final_index, holding_paise, CAST(sum(amount_paise) FILTER (is_in) AS BIGINT) AS in_paise FROM roles r JOIN side ON side.acct = r.acct WHERE is_flagged GROUP BY ALL")
def list_mules(spark, sf_dir):
    c = case_of(spark, sf_dir)
    mules = c.roles.filter("is_flagged").select("acct", "role", "band", "final_index", "holding_paise")
    money = T.sides(c.tx).join(mules.select("acct"), "acct", "left_semi").groupBy("acct").agg(F.sum(F.when(F.col("is_in"), F.col("amount_paise"))).alias("in_paise"))
    return rounded(mules.join(money, "acct"))


@query(f"""WITH {ROLES} SELECT (['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST(acct % 5 + 1 AS INT)] AS bank, count(*) AS n, count(*) FILTER (is_flagged) AS n_flagged, round(count(*) FILTER (is_flagged) / count(*), 6) AS share FROM roles GROUP BY 1""")
def bank_stats(spark, sf_dir):
    r = case_of(spark, sf_dir).roles
    bank = F.substring(T.account_number(F.col("acct")), 1, 4)
    return rounded(r.groupBy(bank.alias("bank")).agg(F.count("*").alias("n"), F.count_if("is_flagged").alias("n_flagged"), (F.count_if("is_flagged") / F.count("*")).alias("share")))


@query(f"WITH {ROLES} SELECT r.acct, CAST(sum(amount_paise) AS BIGINT) AS paid_paise, min(ts_sec) AS first_ts FROM roles r JOIN tx ON tx.src = r.acct WHERE role = 'VICTIM' GROUP BY r.acct")
def list_victims(spark, sf_dir):
    c = case_of(spark, sf_dir)
    v = c.roles.filter("role = 'VICTIM'").select(F.col("acct").alias("src"))
    return c.tx.join(v, "src").groupBy(F.col("src").alias("acct")).agg(F.sum("amount_paise").alias("paid_paise"), F.min("ts_sec").alias("first_ts"))


@query(f"""WITH {ROLES}, f AS (SELECT acct FROM roles WHERE is_flagged) SELECT count(*) AS n_tx, count(l.tx_key) AS n_linked, count(*) FILTER (src IN (SELECT acct FROM f) OR dst IN (SELECT acct FROM f)) AS n_flagged_end,
  CAST(sum(CASE WHEN l.tx_key IS NOT NULL OR src IN (SELECT acct FROM f) OR dst IN (SELECT acct FROM f) THEN t.amount_paise ELSE 0 END) AS BIGINT) AS problem_paise FROM tx t LEFT JOIN links l USING (tx_key)""")
def scanner_summary(spark, sf_dir):
    c = case_of(spark, sf_dir)
    f = c.roles.filter("is_flagged").select("acct", F.lit(True).alias("f"))
    j = c.tx.join(f.select(F.col("acct").alias("src"), F.col("f").alias("fs")), "src", "left").join(f.select(F.col("acct").alias("dst"), F.col("f").alias("fd")), "dst", "left")
    j = j.join(c.links.select("tx_key", F.lit(True).alias("l")), "tx_key", "left")
    end = F.col("fs").isNotNull() | F.col("fd").isNotNull()
    return j.agg(F.count("*").alias("n_tx"), F.count("l").alias("n_linked"), F.count_if(end).alias("n_flagged_end"), F.sum(F.when(end | F.col("l").isNotNull(), F.col("amount_paise")).otherwise(0)).alias("problem_paise"))


@query(f"WITH {ROLES} SELECT coalesce(role, 'NONE') AS role, band, count(*) AS n FROM roles GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    return case_of(spark, sf_dir).roles.groupBy(F.coalesce("role", F.lit("NONE")).alias("role"), "band").agg(F.count("*").alias("n"))


# ingest: the transfers as raw text, some rows broken by rule


_FORMS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]
_UNKNOWN = ["BARTER", "ATM", "CASH", "CHEQUE"]


def _raw(spark, sf_dir):
    """Every payment mode and time format, and rows that break each of the ten rules."""
    tx = T.transfers(spark, sf_dir)
    k = F.col("tx_key")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values) + 1).cast("int"))
    text = F.coalesce(*(F.when(k % len(_FORMS) == i, F.date_format("ts", f)) for i, f in enumerate(_FORMS)))
    amount = (F.col("amount_paise") / 100).cast("decimal(18,2)").cast("string")
    mode = of(I.MODES, 1)
    return tx.select(
        "tx_key",
        F.when(k % 101 == 0, " ").otherwise(F.col("tx_id")).alias("Transaction ID"),
        F.when(k % 103 == 0, F.lit("bad-1")).otherwise(T.account_number(F.col("src"))).alias("From_Account"),
        F.when(k % 137 == 0, F.concat(F.lit(" "), T.account_number(F.col("dst")))).otherwise(T.account_number(F.col("dst"))).alias("to_acc"),
        F.when(k % 139 == 0, "SBIN1").otherwise("SBIN0000001").alias("src_ifsc"),
        F.when(k % 149 == 0, "HDFC0000001 ").otherwise("HDFC0000001").alias("Receiver Bank IFSC"),
        F.when(k % 107 == 0, "12x").when(k % 109 == 0, "-5").when(k % 113 == 0, "1.005").otherwise(amount).alias("Amt"),
        F.when(k % 127 == 0, "yesterday").otherwise(text).alias("date"),
        F.when(k % 131 == 0, of(_UNKNOWN, 131)).when(k % 2 == 0, F.lower(mode)).otherwise(F.concat(mode, F.lit(" "))).alias("Channel"),
    )


def _logical(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return I.logical(raw.drop("tx_key")), raw


_BROKEN = {
    "empty_transaction_id": "tx_key % 101 = 0",
    "bad_sender_account": "tx_key % 103 = 0",
    "bad_receiver_account": "tx_key % 137 = 0",
    "bad_sender_ifsc": "tx_key % 139 = 0",
    "bad_receiver_ifsc": "tx_key % 149 = 0",
    "bad_timestamp": "tx_key % 127 = 0",
    "non_numeric_amount": "tx_key % 107 = 0",
    "non_positive_amount": "tx_key % 107 <> 0 AND tx_key % 109 = 0",
    "sub_paise_amount": "tx_key % 107 <> 0 AND tx_key % 109 <> 0 AND tx_key % 113 = 0",
    "bad_payment_mode": "tx_key % 131 = 0",
}
_REASONS = ",\n  ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in _BROKEN.items())
_RAW_SQL = f"""{TX}, raw AS (SELECT tx_key, list_filter([{_REASONS}], lambda x: x IS NOT NULL) AS reasons,
  tx_id, src, dst, amount_paise, ts_sec FROM tx)"""


@query(f"WITH {_RAW_SQL} SELECT array_to_string(reasons, ';') AS reason, count(*) AS n FROM raw WHERE len(reasons) > 0 GROUP BY 1")
def ingest_rejects(spark, sf_dir):
    rows, _ = _logical(spark, sf_dir)
    return I.judged(rows).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_RAW_SQL} SELECT count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS amount_paise, count(DISTINCT tx_id) AS n_ids, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts FROM raw WHERE len(reasons) = 0")
def ingest_valid(spark, sf_dir):
    rows, _ = _logical(spark, sf_dir)
    good = I.typed(rows).withColumn("s", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))
    return good.agg(F.count("*").alias("n"), F.sum("amount_paise").alias("amount_paise"), F.countDistinct("tx_id").alias("n_ids"), F.min("s").alias("first_ts"), F.max("s").alias("last_ts"))
