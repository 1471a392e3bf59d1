"""Merging and refreshing stored bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative change of an old close from which on a source has restated its history.
DRIFT = 0.001


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the one with the highest value of `order`."""
    names = [c for c in rows.columns if c not in keys and c != order]
    best = F.max_by(F.struct(*names), order) if names else F.max(order)
    picked = rows.groupBy(*keys).agg(best.alias("row"))
    return picked.select(*keys, *(F.col("row")[c].alias(c) for c in names))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The bars of both by (code, date); a new bar takes an old one's place. Each side has one bar a key."""
    return old.join(new.select("code", "date"), ["code", "date"], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def refresh_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """action for each code of `new`, bars fetched anew from shortly before the stored tail.

    reload: a shared day's close has drifted, or no day is shared though the new bars don't all follow the tail.
    merge: otherwise. Codes without new bars have no row, and nothing to do.
    """
    o, n = old.select("code", "date", F.col("close").alias("was")), new.select("code", "date", "close")
    shared = n.join(o, ["code", "date"], "left")
    drift = F.max(F.when(F.col("was") > 0, F.abs(F.col("close") / F.col("was") - 1)))
    by_code = shared.groupBy("code").agg(F.count("was").alias("overlap"), drift.alias("drift"), F.min("date").alias("first"))
    tails = old.groupBy("code").agg(F.max("date").alias("tail"))
    joined = by_code.join(tails, "code", "left")
    moved = F.coalesce(F.col("drift") > DRIFT, F.lit(False)) | ((F.col("overlap") == 0) & (F.col("first") <= F.col("tail")))
    return joined.select("code", F.when(F.col("tail").isNull(), "load").when(moved, "reload").otherwise("merge").alias("action"), "overlap", "drift")


def mergeable(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new bars that may be merged, and the codes whose whole history has to be loaded anew."""
    plan = refresh_plan(old, new)
    ready = new.join(plan.where("action <> 'reload'").select("code"), "code", "left_semi").select(*old.columns)
    return ready, plan.where("action = 'reload'").select("code")


def refreshed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored bars with what may be merged, and the codes whose whole history has to be loaded anew."""
    ready, again = mergeable(old, new)
    return merge(old, ready), again


def acquisition(stocks: DataFrame, files: DataFrame, start: str, trading_day: str, today: str) -> DataFrame:
    """What each security's stored bars need: load, backfill, retry (empty), refresh or nothing (hit).

    files: code, fetched_at, start_date, tail (null when empty). Dates are yyyyMMdd texts.
    """
    have = stocks.select("code").join(files, "code", "left")
    stale = (F.coalesce("tail", F.lit("")) < trading_day) & (F.coalesce("fetched_at", F.lit("")) < today)
    known = F.col("fetched_at").isNotNull() | F.col("start_date").isNotNull() | F.col("tail").isNotNull()
    action = F.when(~known, "load").when(F.col("start_date") > start, "backfill").when(stale & F.col("tail").isNull(), "retry").when(stale, "refresh").otherwise("hit")
    return have.select("code", action.alias("action"))

