"""What a reader asks of a finished case: transfers by any filters, flagged accounts, displays of a trace, and a test of it.

Filters come first and pages last; what is joined in between is what the filters left, and a page's rows alone are decorated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources import transfers as T

from . import findings as FI
from . import trace as TR


def _bank(acct: str) -> Column:
    return F.substring(T.account_number(F.col(acct)), 1, 4)


def category() -> Column:
    return F.split_part(F.split_part("narration", F.lit("/"), F.lit(2)), F.lit("#"), F.lit(1))


#: A filter's name and its condition; other names are refused.
FILTERS: dict[str, Callable[[object], Column]] = {
    "min_amount_paise": lambda v: F.col("amount_paise") >= v,
    "max_amount_paise": lambda v: F.col("amount_paise") <= v,
    "bank": lambda v: (_bank("src") == v) | (_bank("dst") == v),
    "mode": lambda v: F.lower("mode") == str(v).lower(),
    "device": lambda v: F.lower("device") == str(v).lower(),
    "foreign_ip": lambda v: F.col("is_foreign_ip") == F.lit(v),
    "category": lambda v: F.lower(category()) == str(v).lower(),
    "from_ts": lambda v: F.col("ts_sec") >= v,
    "to_ts": lambda v: F.col("ts_sec") <= v,
}


def matching(tx: DataFrame, **filters) -> DataFrame:
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"no such filters: {sorted(unknown)}")
    for name, value in filters.items():
        tx = tx.filter(FILTERS[name](value))
    return tx


def search(tx: DataFrame, links: DataFrame, limit: int = 100, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(one page of the transfers that match, the latest first, with their link; one row: n, amount_paise of all that match)."""
    found = matching(tx, **filters)
    page = found.orderBy(F.desc("ts_sec"), F.desc("amount_paise"), "tx_id", "tx_key").offset(offset).limit(limit)
    page = page.join(links.select("tx_key", "link_type"), "tx_key", "left")
    rows = page.select("tx_key", "tx_id", "src", "dst", _bank("src").alias("src_bank"), _bank("dst").alias("dst_bank"), "amount_paise", "ts_sec", "mode", category().alias("category"), "device", "ip", "link_type")
    return rows, found.agg(F.count("*").alias("n"), F.coalesce(F.sum("amount_paise"), F.lit(0)).alias("amount_paise"))


def mules(case_roles: DataFrame, tx: DataFrame, cell_members: DataFrame, limit: int = 100, role: str | None = None, min_final: float | None = None, min_in_paise: int | None = None, bank: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one page of the flagged accounts that match, the highest index first; one row: n that match).

    acct, bank, role, final_index, band, freeze_recommended, holding_paise, in_paise, out_paise, senders, receivers, cells.
    """
    scope = case_roles.filter("is_flagged").withColumn("bank", _bank("acct"))
    for condition in ((F.col("role") == role) if role is not None else None, (F.col("final_index") >= min_final) if min_final is not None else None, (F.col("bank") == bank) if bank is not None else None):
        scope = scope if condition is None else scope.filter(condition)
    scope = scope.select("acct", "bank", "role", "final_index", "band", "freeze_recommended", "holding_paise")
    pair = T.sides(tx.select("src", "dst", "amount_paise")).join(scope.select("acct"), "acct", "left_semi").groupBy("acct", "cp", "is_in").agg(F.sum("amount_paise").alias("paise"))
    of = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    money = pair.groupBy("acct").agg(of(F.col("is_in"), F.col("paise")).alias("in_paise"), of(~F.col("is_in"), F.col("paise")).alias("out_paise"), F.count_if("is_in").alias("senders"), F.count_if(~F.col("is_in")).alias("receivers"))
    rows = scope.join(money, "acct")
    if min_in_paise is not None:
        rows = rows.filter(F.col("in_paise") >= min_in_paise)
    page = rows.orderBy(F.desc("final_index"), "acct").limit(limit)
    cells = cell_members.groupBy("acct").agg(F.count("*").alias("cells"))
    return page.join(cells, "acct", "left").fillna(0, ["cells"]), rows.agg(F.count("*").alias("n"))


def shown(traced: DataFrame, tx: DataFrame, hop: int | None = None, min_amount_paise: int | None = None, bank: str | None = None, keyword: str | None = None) -> DataFrame:
    """The followed transfers of traces that a display asks for, with `is_shown`; none goes, so the trace stays as it is."""
    rows = FI.followed(traced).join(tx.select("tx_key", "narration"), "tx_key")
    tests = [
        F.col("hop") <= hop if hop is not None else None, F.col("amount_paise") >= min_amount_paise if min_amount_paise is not None else None,
        (_bank("from_acct") == bank) | (_bank("to_acct") == bank) if bank is not None else None, F.contains(F.lower("narration"), F.lit(keyword.lower())) if keyword is not None else None,
    ]
    keep = F.lit(True)
    for t in tests:
        keep = keep if t is None else keep & F.coalesce(t, F.lit(False))
    return rows.select("victim", "hop", "tx_key", "from_acct", "to_acct", "amount_paise", keep.alias("is_shown"))


def usual(traced: DataFrame, tx: DataFrame, columns: tuple[str, ...] = ("device", "ip")) -> DataFrame:
    """victim, acct and, for each column, the most frequent value of the account's transfers in the trace; of equally
    frequent ones that of the earliest transfer."""
    rows = FI.followed(traced).select("victim", "tx_key", "hop", "ts_sec", F.col("from_acct").alias("acct")).join(tx.select("tx_key", *columns), "tx_key")
    out = rows.select("victim", "acct").distinct()
    for c in columns:
        each = rows.filter(F.col(c).isNotNull()).groupBy("victim", "acct", c).agg(F.count("*").alias("n"), F.min(F.struct("ts_sec", "hop", "tx_key")).alias("first"))
        best = each.groupBy("victim", "acct").agg(F.max_by(c, F.struct("n", (-F.col("first.ts_sec")).alias("t"), (-F.col("first.hop")).alias("h"), (-F.col("first.tx_key")).alias("k"))).alias(c))
        out = out.join(best, ["victim", "acct"], "left")
    return out


def sampled(payers: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the accounts, the same ones for the same seed under any partitioning: those of smallest hash."""
    return payers.select("acct").orderBy(F.xxhash64("acct", F.lit(seed)), "acct").limit(n)


def blind_test(traced: DataFrame, tx: DataFrame, payers: DataFrame, profile: dict) -> DataFrame:
    """For each payer: whether its trace and its structural chain, which knows no scores, have the same accounts and transfers.

    victim, correct, accounts, accounts_expected, transfers, transfers_expected, only_in_trace, only_in_chain (accounts).
    """
    mine = FI.followed(traced).join(payers.select(F.col("acct").alias("victim")).distinct(), "victim", "left_semi")
    chain = TR.structural_chain(tx, payers.select("acct").distinct(), profile).join(tx.select("tx_key", F.col("dst").alias("to_acct")), "tx_key")

    def met(key: str) -> DataFrame:
        a = mine.select("victim", key).distinct().withColumn("a", F.lit(1))
        b = chain.select("victim", key).distinct().withColumn("b", F.lit(1))
        both = a.join(b, ["victim", key], "full").groupBy("victim")
        return both.agg(F.count("a").alias(f"n_{key}"), F.count("b").alias(f"want_{key}"), F.count_if(F.col("b").isNull()).alias(f"more_{key}"), F.count_if(F.col("a").isNull()).alias(f"less_{key}"))

    rows = payers.select(F.col("acct").alias("victim")).distinct().join(met("to_acct"), "victim", "left").join(met("tx_key"), "victim", "left").fillna(0)
    exact = (F.col("more_to_acct") + F.col("less_to_acct") + F.col("more_tx_key") + F.col("less_tx_key")) == 0
    return rows.select("victim", exact.alias("correct"), F.col("n_to_acct").alias("accounts"), F.col("want_to_acct").alias("accounts_expected"), F.col("n_tx_key").alias("transfers"), F.col("want_tx_key").alias("transfers_expected"), F.col("more_to_acct").alias("only_in_trace"), F.col("less_to_acct").alias("only_in_chain"))
