"""One query: verdicts on columns of the given tables and of the transfers, with SQL by critical values."""

from __future__ import annotations

from tracewell.functions.cut import stored
from tracewell.operators import audit as A
from tracewell.operators import verdicts as V
from tracewell.sources import transfers as T

from .registry import TX, query, rounded, tx_of


def _critical(p: float, k: int) -> float:
    """The chi-square beyond which less than p lies, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if A.chi2_survival(mid, k) > p else (low, mid)
    return low


_CRIT = ", ".join(f"({k}, {_critical(0.01, k)!r}, {_critical(0.001, k)!r})" for k in range(1, 65))
_LIMITS = {k: (1.0, 100.0 if k == "purchase" else 200.0) for k in T.MODE}


def _shape_sql(source: str, column: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace(CAST({column} AS VARCHAR), '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g'), '[^ -~]+', 'U', 'g')"
    return f"""SELECT 'shape' AS tool, '{column}' AS on, CASE WHEN count(*) = 0 THEN 'INCONCLUSIVE' WHEN count(*) > 20 THEN 'NOISE' WHEN count(*) = 1 THEN 'CLEAN' WHEN count(*) FILTER (n < 0.01 * t) > 0 THEN 'SIGNAL' ELSE 'INCONCLUSIVE' END AS verdict, CAST(count(*) AS DOUBLE) AS measure
  FROM (SELECT s, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT {x} AS s FROM {source}) WHERE s IS NOT NULL GROUP BY s)"""


def _unique_sql(source: str, column: str) -> str:
    return f"""SELECT 'unique', '{column}', CASE WHEN count(*) = 0 THEN 'INCONCLUSIVE' WHEN max(n) = 1 THEN 'CLEAN' WHEN count(*) / sum(n) >= 0.99 THEN 'TRAP' ELSE 'NOISE' END, count(*) / sum(n) FROM (SELECT {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)"""


def _consistent_sql(source: str, a: str, b: str) -> str:
    """For columns that share no label."""
    return f"""SELECT 'consistent', '{a}, {b}', CASE WHEN least(na, nb) < 2 THEN 'NOISE' WHEN np = na AND np = nb THEN 'ARTEFACT' WHEN np = na OR np = nb THEN 'CLEAN' WHEN v < 0.05 THEN 'NOISE' ELSE 'INCONCLUSIVE' END, CASE WHEN least(na, nb) > 1 THEN v END
  FROM (SELECT count(*) AS np, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, sqrt(greatest(0, sum(n * n / (ra * cb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) AS v
    FROM (SELECT a, b, CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb FROM (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n FROM {source} GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL))"""


def _outlying_sql(source: str, column: str, group: str) -> str:
    return f"""SELECT 'outlying', '{column} by {group}', CASE WHEN sum(o) = 0 THEN 'CLEAN' WHEN count(*) FILTER (n >= 30) < 2 THEN 'INCONCLUSIVE' WHEN max(lift) FILTER (n >= 30) >= 3 AND arg_max(o / n, lift) FILTER (n >= 30) >= 0.25 THEN 'SIGNAL' ELSE 'NOISE' END,
    CASE WHEN sum(o) > 0 AND count(*) FILTER (n >= 30) >= 2 THEN max(lift) FILTER (n >= 30) END
  FROM (SELECT g, n, o, (o / n) / nullif(sum(o) OVER () / sum(n) OVER (), 0) AS lift FROM (SELECT {group} AS g, count(*) AS n, count(*) FILTER ({column} < a - 1.5 * (b - a) OR {column} > b + 1.5 * (b - a)) AS o FROM {source}, (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM {source}) GROUP BY 1))"""


def _distributed_sql(source: str, column: str) -> str:
    return f"""SELECT 'distributed', '{column}', CASE WHEN nv > 64 OR nv = 0 THEN 'INCONCLUSIVE' WHEN nv = 1 THEN 'NOISE' WHEN nc > 1 AND mean >= 5 AND chi <= (SELECT x FROM crit WHERE k = nc - 1) AND (hi - lo) / mean <= 0.1 OR nr > 1 AND rhi = rlo AND pow(1 / sqrt(4 * pi() * rhi), nr - 1) < 0.05 THEN 'ARTEFACT' WHEN nr > 0 THEN 'SIGNAL' ELSE 'CLEAN' END,
    CASE WHEN nc > 1 AND nv <= 64 THEN (hi - lo) / mean END
  FROM (SELECT count(*) AS nv, count(*) FILTER (c) AS nc, count(*) FILTER (NOT c) AS nr, avg(n) FILTER (c) AS mean, max(n) FILTER (c) AS hi, min(n) FILTER (c) AS lo, max(n) FILTER (NOT c) AS rhi, min(n) FILTER (NOT c) AS rlo, sum(CASE WHEN c THEN (n - m) * (n - m) / m END) AS chi
    FROM (SELECT *, avg(n) FILTER (c) OVER () AS m FROM (SELECT {column} AS v, CAST(count(*) AS DOUBLE) AS n, count(*) / sum(count(*)) OVER () >= 0.01 AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)))"""


def _placed_sql(source: str, column: str, order: str, ts: str) -> str:
    return f"""SELECT 'placed', '{column}', CASE WHEN coalesce(sum(r), 0) = 0 THEN 'CLEAN' WHEN min(due) < 5 THEN 'INCONCLUSIVE' WHEN sum((r - due) * (r - due) / due) <= (SELECT y FROM crit WHERE k = 19) OR max(r / due) < 2 THEN 'CLEAN' WHEN min(up) >= 0.99 THEN 'SIGNAL' ELSE 'ARTEFACT' END, CASE WHEN sum(r) > 0 THEN max(r / due) END
  FROM (SELECT bin, r, sum(r) OVER () * n / sum(n) OVER () AS due, sum(ups) OVER () / (sum(n) OVER () - 1) AS up FROM (SELECT bin, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (c < 0.01 * t) AS DOUBLE) AS r, count(*) FILTER (u) AS ups
    FROM (SELECT ntile(20) OVER (ORDER BY {order}) AS bin, {ts} >= lag({ts}) OVER (ORDER BY {order}) AS u, count(*) OVER (PARTITION BY {column}) AS c, count(*) OVER () AS t FROM {source}) GROUP BY bin))"""


def _adjacent_sql(source: str, a: str, b: str, order: str) -> str:
    return f"""SELECT 'adjacent', '{a}, next {b}', CASE WHEN same > 0 AND same / (pairs * chance) >= 3 AND (same - pairs * chance) / sqrt(pairs * chance * (1 - chance)) > 3.090232306167813 THEN 'ARTEFACT' ELSE 'CLEAN' END, same / nullif(pairs * chance, 0)
  FROM (SELECT count(*) FILTER (v IS NOT NULL AND w IS NOT NULL) AS pairs, count(*) FILTER (v = w) AS same FROM (SELECT CAST({a} AS VARCHAR) AS v, lead(CAST({b} AS VARCHAR)) OVER (ORDER BY {order}) AS w FROM {source})),
    (SELECT sum(x.n * y.n) / ((SELECT count({a}) FROM {source}) * CAST((SELECT count({b}) FROM {source}) AS DOUBLE)) AS chance FROM (SELECT {a} AS v, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1) x JOIN (SELECT {b} AS v, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1) y USING (v))"""


def _rhythmic_sql(source: str, ts: str) -> str:
    cycle = lambda slot, full: f"SELECT {full} AS f, count(*) AS k, min(e) AS least, sum((n - e) * (n - e) / e) AS chi, (max(n / d) - min(n / d)) / avg(n / d) AS spread FROM (SELECT n, d, sum(n) OVER () * d / sum(d) OVER () AS e FROM (SELECT {slot} AS s, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT CAST({ts} AS DATE)) AS DOUBLE) AS d FROM {source} WHERE {ts} IS NOT NULL GROUP BY 1))"
    return f"""SELECT 'rhythmic', '{ts}', CASE WHEN bool_or(least >= 5 AND chi <= crit.x AND spread <= 0.1) THEN 'ARTEFACT' WHEN bool_or(least >= 5) THEN 'CLEAN' ELSE 'INCONCLUSIVE' END, min(spread) FROM ({cycle(f"hour({ts})", 24)} UNION ALL {cycle(f"dayofweek({ts})", 7)}) c JOIN crit ON crit.k = c.k - 1 WHERE c.k = f"""


_WITHIN = f"""SELECT 'within', 'value by event_type', CASE WHEN max(o / n) >= 0.05 THEN 'TRAP' WHEN max(o / n) > 0 OR (SELECT count(*) FROM events WHERE value IS NULL OR value < 0) > 0 THEN 'SIGNAL' ELSE 'CLEAN' END, max(o / n)
  FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value < 1 OR value > CASE event_type WHEN 'purchase' THEN 100 ELSE 200 END) AS o FROM events WHERE value IS NOT NULL AND event_type IN ({", ".join(f"'{k}'" for k in _LIMITS)}) GROUP BY 1)"""
_DIGITS = """SELECT 'distributed', CASE WHEN flat THEN 'o_totalprice' ELSE 'first digit of o_totalprice' END, CASE WHEN flat THEN 'ARTEFACT' WHEN mad <= 0.015 THEN 'CLEAN' ELSE 'INCONCLUSIVE' END, CASE WHEN flat THEN spread ELSE mad END
  FROM (SELECT mean >= 5 AND chi <= crit.x AND spread <= 0.1 AS flat, spread, mad
    FROM (SELECT count(*) AS k, min(m) AS mean, sum((n - m) * (n - m) / m) AS chi, (max(n) - min(n)) / min(m) AS spread, (sum(abs(n / t - log10(1 + 1 / d))) + (SELECT coalesce(sum(log10(1 + 1 / x)), 0) FROM range(1, 10) r(x) WHERE x NOT IN (SELECT DISTINCT d FROM dig))) / 9 AS mad
      FROM (SELECT d, CAST(count(*) AS DOUBLE) AS n, avg(count(*)) OVER () AS m, sum(count(*)) OVER () AS t FROM dig GROUP BY d)) q JOIN crit ON crit.k = q.k - 1)"""
_PARTS = [
    _shape_sql("events", "event_type"), _shape_sql("tx", "narration"), _shape_sql("part", "p_name"),
    _unique_sql("events", "event_id"), _unique_sql("tx", "tx_id"), _unique_sql("orders", "o_custkey"),
    _consistent_sql("lineitem", "l_returnflag", "l_linestatus"), _consistent_sql("tx", "device", "headless"), _consistent_sql("events", "event_type", "user_id % 3"),
    _WITHIN, _outlying_sql("events", "value", "event_type"), _outlying_sql("tx", "amount_paise", "device"),
    _distributed_sql("events", "event_type"), _distributed_sql("tx", "device"), _DIGITS, _placed_sql("tx", "device", "tx_key", "ts"), _placed_sql("events", "event_type", "event_id", "ts"),
    _adjacent_sql("events", "user_id", "user_id", "event_id"), _adjacent_sql("tx", "src", "dst", "tx_key"), _rhythmic_sql("events", "ts"),
]


@query(f"""WITH {TX}, crit(k, x, y) AS (VALUES {_CRIT}), dig AS (SELECT CAST(regexp_extract(CAST(CAST(abs(o_totalprice) AS DECIMAL(38, 4)) AS VARCHAR), '[1-9]') AS INT) AS d FROM orders WHERE regexp_extract(CAST(CAST(abs(o_totalprice) AS DECIMAL(38, 4)) AS VARCHAR), '[1-9]') <> '')
  SELECT tool, "on", verdict, round(measure, 6) AS measure FROM ({" UNION ALL ".join(p.replace(" AS on", ' AS "on"') for p in _PARTS)})""")
def audit_verdicts(spark, sf_dir):
    """What the audit says about columns of the given tables: one row for each tool and column."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    events, tx = read("events"), stored(tx_of(spark, sf_dir)).withColumnRenamed("is_headless", "headless")
    mixed = events.selectExpr("*", "user_id % 3 AS `user_id % 3`")
    found = [
        V.shape(events, "event_type"), V.shape(tx, "narration"), V.shape(read("part"), "p_name"),
        V.unique(events, "event_id"), V.unique(tx, "tx_id"), V.unique(read("orders"), "o_custkey"),
        V.consistent(read("lineitem"), "l_returnflag", "l_linestatus"), V.consistent(tx, "device", "headless"), V.consistent(mixed, "event_type", "user_id % 3"),
        V.within(events, "value", "event_type", _LIMITS), V.outlying(events, "value", "event_type"), V.outlying(tx, "amount_paise", "device"),
        V.distributed(events, "event_type"), V.distributed(tx, "device"), V.distributed(read("orders"), "o_totalprice", digits=True), V.placed(tx, "device", ["tx_key"], "ts"), V.placed(events, "event_type", ["event_id"], "ts"),
        V.adjacent(events, "user_id", "user_id", ["event_id"]), V.adjacent(tx, "src", "dst", ["tx_key"]), V.rhythmic(events, "ts"),
    ]
    return rounded(spark.createDataFrame(found, V.SCHEMA))
