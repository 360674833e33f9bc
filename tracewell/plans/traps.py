"""Further checks of a transfer table: modes and rails, addresses, devices, limits of modes, amounts, times, banks, ids, flags.

Each is one or two aggregations with partial sums; reports of the most frequent take the top of what was counted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import audit as A
from tracewell.operators import narration as NA
from tracewell.operators.reads import category
from tracewell.sources import transfers as T

from .registry import FEAT, TX, case_of, query, rounded, tx_of

# Limits of payment modes in rupees (least, most), words of generated data, and amounts that count as round, in rupees.
MODE_LIMITS = {"UPI": (None, 100_000), "RTGS": (200_000, None), "IMPS": (None, 500_000)}
LEAK_WORDS = ["mule", "victim", "fraud", "layer", "l1", "l2", "l3", "test", "fake", "injected"]
ROUND = [100, 500, 1_000, 10_000]
_CATEGORY = "split_part(split_part(narration, '/', 2), '#', 1)"
_BANK = "(['SBIN', 'HDFC', 'ICIC', 'UTIB', 'PUNB'])[CAST({0} % 5 + 1 AS INT)]"


@query(f"WITH {TX} SELECT coalesce(mode, '-') AS mode, count(*) AS n, count(*) FILTER (mode <> upper(trim(mode))) AS n_variants, count(DISTINCT src) AS senders FROM tx GROUP BY 1")
def trap_modes(spark, sf_dir):
    return tx_of(spark, sf_dir).groupBy(F.coalesce("mode", F.lit("-")).alias("mode")).agg(F.count("*").alias("n"), F.count_if(F.col("mode") != F.upper(F.trim("mode"))).alias("n_variants"), F.countDistinct("src").alias("senders"))


@query(f"WITH {TX} SELECT mode, rail, n, round(n / sum(n) OVER (PARTITION BY mode), 6) AS share FROM (SELECT coalesce(mode, '-') AS mode, split_part(coalesce(narration, ''), '/', 1) AS rail, count(*) AS n FROM tx GROUP BY 1, 2)")
def trap_rails(spark, sf_dir):
    """Whether the rail that a narration names goes with the payment mode."""
    n = tx_of(spark, sf_dir).groupBy(F.coalesce("mode", F.lit("-")).alias("mode"), F.split_part(F.coalesce("narration", F.lit("")), F.lit("/"), F.lit(1)).alias("rail")).agg(F.count("*").alias("n"))
    return rounded(n.join(n.groupBy("mode").agg(F.sum("n").alias("all")), "mode").select("mode", "rail", "n", (F.col("n") / F.col("all")).alias("share")))


@query(f"""WITH {TX} SELECT regexp_replace(ip, '[0-9]+', 'N', 'g') AS shape, count(*) AS n, count(*) FILTER (list_max([coalesce(TRY_CAST(x AS INT), 0) FOR x IN string_split(ip, '.')]) > 255) AS n_large, count(*) FILTER (regexp_matches(ip, '(^|[.])0[0-9]')) AS n_leading_zero, count(*) FILTER (regexp_matches(ip, '^[.]|[.][.]|[.]$')) AS n_empty FROM tx WHERE ip IS NOT NULL GROUP BY 1""")
def trap_ip_shapes(spark, sf_dir):
    ip = F.col("ip")
    large = F.exists(F.split(ip, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)) > 255)
    return tx_of(spark, sf_dir).filter(ip.isNotNull()).groupBy(F.regexp_replace(ip, "[0-9]+", "N").alias("shape")).agg(F.count("*").alias("n"), F.count_if(large).alias("n_large"), F.count_if(ip.rlike(r"(^|\.)0[0-9]")).alias("n_leading_zero"), F.count_if(ip.rlike(r"^\.|\.\.|\.\z")).alias("n_empty"))


@query(f"WITH {TX} SELECT split_part(ip, '.', 1) AS octet, count(*) AS n, count(DISTINCT src) AS senders, count(*) FILTER (headless) AS n_headless, count(*) FILTER (layering) AS n_layering FROM tx WHERE ip IS NOT NULL GROUP BY 1")
def trap_ip_octets(spark, sf_dir):
    rows = tx_of(spark, sf_dir).filter("ip is not null").groupBy(F.split_part("ip", F.lit("."), F.lit(1)).alias("octet"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders"), F.count_if("is_headless").alias("n_headless"), F.count_if("is_layering").alias("n_layering"))


@query(f"WITH {TX} SELECT ip, count(DISTINCT src) AS senders, count(*) AS n FROM tx WHERE ip IS NOT NULL GROUP BY ip ORDER BY senders DESC, n DESC, ip LIMIT 20")
def trap_shared_ips(spark, sf_dir):
    """The twenty addresses with the most senders; counted by address and sender first, so a hot address is no hot group."""
    pair = tx_of(spark, sf_dir).filter("ip is not null").groupBy("ip", "src").agg(F.count("*").alias("k"))
    return pair.groupBy("ip").agg(F.count("*").alias("senders"), F.sum("k").alias("n")).orderBy(F.desc("senders"), F.desc("n"), "ip").limit(20)


@query(f"WITH {TX} SELECT src AS acct, count(DISTINCT ip) AS n_ips, count(*) FILTER (foreign_ip) AS n_foreign, count(*) FILTER (NOT foreign_ip) AS n_domestic FROM tx GROUP BY src HAVING count(*) FILTER (foreign_ip) > 0 AND count(*) FILTER (NOT foreign_ip) > 0 OR count(DISTINCT ip) > 1")
def trap_ip_switchers(spark, sf_dir):
    """Senders with several addresses, and those that send from home and from abroad."""
    pair = tx_of(spark, sf_dir).groupBy("src", "ip").agg(F.count_if("is_foreign_ip").alias("f"), F.count_if(~F.col("is_foreign_ip")).alias("d"))
    return pair.groupBy(F.col("src").alias("acct")).agg(F.count("ip").alias("n_ips"), F.sum("f").alias("n_foreign"), F.sum("d").alias("n_domestic")).filter("n_foreign > 0 and n_domestic > 0 or n_ips > 1")


@query(f"WITH {TX} SELECT device, mode, {_CATEGORY} AS category, count(*) AS n, CAST(min(amount_paise) AS BIGINT) AS low, round(median(amount_paise), 6) AS middle, CAST(max(amount_paise) AS BIGINT) AS high FROM tx WHERE foreign_ip GROUP BY ALL")
def trap_foreign_rows(spark, sf_dir):
    a = "amount_paise"
    return rounded(tx_of(spark, sf_dir).filter("is_foreign_ip").groupBy("device", "mode", category().alias("category")).agg(F.count("*").alias("n"), F.min(a).alias("low"), F.median(a).alias("middle"), F.max(a).alias("high")))


@query(f"WITH {TX} SELECT n_devices, mixes, count(*) AS n_accounts FROM (SELECT src, count(DISTINCT device) AS n_devices, count(*) FILTER (headless) > 0 AND count(*) FILTER (device IN ('Android', 'iPhone')) > 0 AS mixes FROM tx GROUP BY src) GROUP BY ALL")
def trap_device_mixers(spark, sf_dir):
    """Accounts by their number of devices and whether they mix phones with headless devices."""
    each = tx_of(spark, sf_dir).groupBy("src").agg(F.countDistinct("device").alias("n_devices"), ((F.count_if("is_headless") > 0) & (F.count_if(F.col("device").isin("Android", "iPhone")) > 0)).alias("mixes"))
    return each.groupBy("n_devices", "mixes").agg(F.count("*").alias("n_accounts"))


@query(f"""WITH {TX}, lim(mode, lo, hi) AS (VALUES {", ".join(f"('{m}', {'NULL' if lo is None else lo}, {'NULL' if hi is None else hi})" for m, (lo, hi) in MODE_LIMITS.items())})
  SELECT lim.mode, count(tx_key) AS n, count(*) FILTER (amount_paise < lo * 100) AS n_below, count(*) FILTER (amount_paise > hi * 100) AS n_above FROM lim LEFT JOIN tx ON tx.mode = lim.mode GROUP BY lim.mode""")
def trap_mode_limits(spark, sf_dir):
    """Transfers beyond the limits of their payment mode."""
    limits = spark.createDataFrame([(m, lo, hi) for m, (lo, hi) in MODE_LIMITS.items()], "mode string, lo long, hi long")
    n = tx_of(spark, sf_dir).join(F.broadcast(limits), "mode").groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("amount_paise") < F.col("lo") * 100).alias("n_below"), F.count_if(F.col("amount_paise") > F.col("hi") * 100).alias("n_above"))
    return limits.select("mode").join(n, "mode", "left").fillna(0)


@query(f"WITH {TX} SELECT headless AS is_headless, foreign_ip AS is_foreign_ip, count(*) AS n, {', '.join(f'count(*) FILTER (amount_paise % {r * 100} = 0) AS round_{r}' for r in ROUND)} FROM tx GROUP BY ALL")
def trap_round_amounts(spark, sf_dir):
    return tx_of(spark, sf_dir).groupBy("is_headless", "is_foreign_ip").agg(F.count("*").alias("n"), *(F.count_if(F.col("amount_paise") % (r * 100) == 0).alias(f"round_{r}") for r in ROUND))


@query(f"WITH {TX} SELECT amount_paise, count(*) AS n, count(DISTINCT src) AS senders FROM tx GROUP BY 1 ORDER BY n DESC, amount_paise LIMIT 30")
def trap_top_amounts(spark, sf_dir):
    """The thirty most frequent amounts."""
    return tx_of(spark, sf_dir).groupBy("amount_paise").agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders")).orderBy(F.desc("n"), "amount_paise").limit(30)


@query(f"WITH {TX} SELECT headless AS is_headless, count(*) AS n, {', '.join(f'round(quantile_cont(amount_paise, {q}), 6) AS p{int(q * 1000)}' for q in (0.1, 0.5, 0.9, 0.99, 0.999))} FROM tx GROUP BY 1")
def trap_amounts_by_device(spark, sf_dir):
    return rounded(tx_of(spark, sf_dir).groupBy("is_headless").agg(F.count("*").alias("n"), *(F.percentile("amount_paise", F.lit(q)).alias(f"p{int(q * 1000)}") for q in (0.1, 0.5, 0.9, 0.99, 0.999))))


@query(f"WITH {TX} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT hour(ts)) AS hours, count(*) FILTER (second(ts) = 0) AS n_whole_minutes, count(DISTINCT src) AS senders FROM tx GROUP BY 1")
def trap_days(spark, sf_dir):
    """Transfers by day: silent hours and too even seconds show."""
    ts = F.col("ts")
    return tx_of(spark, sf_dir).groupBy(ts.cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct(F.hour(ts)).alias("hours"), F.count_if(F.second(ts) == 0).alias("n_whole_minutes"), F.countDistinct("src").alias("senders"))


@query(f"WITH {TX} SELECT ts_sec, count(*) AS n, count(DISTINCT src) AS senders FROM tx GROUP BY 1 ORDER BY n DESC, ts_sec LIMIT 10")
def trap_top_seconds(spark, sf_dir):
    """The ten seconds with the most transfers."""
    return tx_of(spark, sf_dir).groupBy("ts_sec").agg(F.count("*").alias("n"), F.countDistinct("src").alias("senders")).orderBy(F.desc("n"), "ts_sec").limit(10)


@query(f"WITH {TX} SELECT round(count(*) FILTER (up) / (count(*) - 1), 6) AS share FROM (SELECT ts >= lag(ts) OVER (ORDER BY tx_key) AS up FROM tx)")
def trap_row_order(spark, sf_dir):
    """The share of rows that keep to the order of time, in the order of their keys."""
    return rounded(spark.createDataFrame([(A.time_sorted(tx_of(spark, sf_dir), ["tx_key"], "ts"),)], "share double"))


@query(f"""WITH {TX}, b AS (SELECT {_BANK.format("acct")} AS bank, * FROM side) SELECT bank, count(DISTINCT acct) AS n_accounts, count(*) AS n_sides, count(*) FILTER (NOT is_in AND headless) AS n_headless, count(*) FILTER (NOT is_in AND foreign_ip) AS n_foreign, CAST(min(acct) FILTER (layering) AS BIGINT) AS first_layering, CAST(max(acct) FILTER (layering) AS BIGINT) AS last_layering FROM b GROUP BY bank""")
def trap_banks(spark, sf_dir):
    """Accounts and transfers by bank, and the range of numbers whose transfers look layered."""
    side = T.sides(tx_of(spark, sf_dir)).groupBy("acct").agg(F.count("*").alias("n"), F.count_if(~F.col("is_in") & F.col("is_headless")).alias("h"), F.count_if(~F.col("is_in") & F.col("is_foreign_ip")).alias("f"), F.bool_or("is_layering").alias("l"))
    bank = F.substring(T.account_number(F.col("acct")), 1, 4)
    layered = F.when(F.col("l"), F.col("acct"))
    return side.groupBy(bank.alias("bank")).agg(F.count("*").alias("n_accounts"), F.sum("n").alias("n_sides"), F.sum("h").alias("n_headless"), F.sum("f").alias("n_foreign"), F.min(layered).alias("first_layering"), F.max(layered).alias("last_layering"))


@query(f"WITH {TX}, a AS (SELECT acct, count(*) AS n FROM side GROUP BY acct) SELECT count(*) AS n_accounts, count(*) FILTER (n = 1) AS n_once, round(quantile_cont(n, 0.5), 6) AS middle, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most FROM a")
def trap_activity(spark, sf_dir):
    each = T.sides(tx_of(spark, sf_dir)).groupBy("acct").agg(F.count("*").alias("n"))
    return rounded(each.agg(F.count("*").alias("n_accounts"), F.count_if(F.col("n") == 1).alias("n_once"), F.percentile("n", F.lit(0.5)).alias("middle"), F.percentile("n", F.lit(0.99)).alias("p99"), F.max("n").alias("most")))


@query(f"""WITH {TX}, i AS (SELECT tx_id, count(*) AS n, count(DISTINCT src) AS s FROM tx GROUP BY tx_id) SELECT count(*) AS n_ids, count(*) FILTER (n > 1) AS n_repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_in_repeats, count(*) FILTER (s > 1) AS n_of_several_senders,
  count(*) FILTER (NOT regexp_full_match(tx_id, '[A-Z]+[0-9]+')) AS n_malformed FROM i""")
def trap_ids(spark, sf_dir):
    """Transfer ids: repeated ones, those of several senders, malformed ones."""
    each = tx_of(spark, sf_dir).groupBy("tx_id").agg(F.count("*").alias("n"), F.min("src").alias("a"), F.max("src").alias("b"))
    return each.agg(F.count("*").alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_in_repeats"), F.count_if(F.col("a") != F.col("b")).alias("n_of_several_senders"), F.count_if(~F.col("tx_id").rlike(r"\A[A-Z]+[0-9]+\z")).alias("n_malformed"))


@query(f"WITH {TX} SELECT word, count(tx_key) AS n, count(DISTINCT src) AS senders, count(*) FILTER (layering) AS n_layering FROM (SELECT unnest([{', '.join(repr(w) for w in LEAK_WORDS)}]) AS word) LEFT JOIN tx ON contains(lower(narration), word) GROUP BY word")
def trap_leaks(spark, sf_dir):
    """Words that would give generated rows away."""
    return NA.words(tx_of(spark, sf_dir), LEAK_WORDS)


@query(f"""WITH {FEAT}, f AS (SELECT acct, coalesce(pass_through_share >= 0.9 AND forward_lag_median_s <= 900, false) AS fast, coalesce(burst_fan_in >= 3, false) AS burst, coalesce(split_count_median BETWEEN 3 AND 7, false) AS split, coalesce(flagged_out_share > 0, false) AS odd FROM feat)
  SELECT *, CAST(fast AS INT) + CAST(burst AS INT) + CAST(split AS INT) + CAST(odd AS INT) AS n_flags FROM f WHERE CAST(fast AS INT) + CAST(burst AS INT) + CAST(split AS INT) + CAST(odd AS INT) >= 2""")
def trap_two_of_four(spark, sf_dir):
    """Accounts with at least two of: fast pass-through, burst of senders, split over three to seven, layering transfers."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "fast": yes((F.col("pass_through_share") >= 0.9) & (F.col("forward_lag_median_s") <= 900)), "burst": yes(F.col("burst_fan_in") >= 3),
        "split": yes(F.col("split_count_median").between(3, 7)), "odd": yes(F.col("flagged_out_share") > 0),
    }
    rows = case_of(spark, sf_dir).features.withColumns(flags)
    return rows.withColumn("n_flags", sum((F.col(f).cast("int") for f in flags), F.lit(0))).filter("n_flags >= 2").select("acct", *flags, "n_flags")


@query(f"""WITH {FEAT}, o AS (SELECT src AS acct, max(amount_paise) AS most_out FROM tx GROUP BY src), i AS (SELECT dst AS acct, max(amount_paise) AS most_in, max(ts_sec) AS last_in FROM tx GROUP BY dst)
  SELECT feat.acct, n_out, most_out, most_in FROM feat JOIN o ON o.acct = feat.acct JOIN i ON i.acct = feat.acct WHERE n_out <= 3 AND most_in >= 5 * (SELECT median(amount_paise) FROM tx)""")
def trap_payers_that_receive(spark, sf_dir):
    """Accounts that pay seldom, as payers do, but also receive large sums."""
    c = case_of(spark, sf_dir)
    out = c.tx.groupBy(F.col("src").alias("acct")).agg(F.max("amount_paise").alias("most_out"))
    into = c.tx.groupBy(F.col("dst").alias("acct")).agg(F.max("amount_paise").alias("most_in"))
    rows = c.features.select("acct", "n_out").filter("n_out <= 3").join(out, "acct").join(into, "acct").join(F.broadcast(c.tx.agg(F.median("amount_paise").alias("middle"))))  # one row
    return rows.filter(F.col("most_in") >= 5 * F.col("middle")).select("acct", "n_out", "most_out", "most_in")
