"""The universe: which securities are screened, why others are left out, and how many there are of each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.market import is_special


@dataclass(frozen=True)
class UniverseRules:
    """as_of: yyyyMMdd, the day from which ages are counted back. max_list_days: 0 for no bound."""

    as_of: str
    exclude_special: bool = True
    exclude_bse: bool = True
    min_list_days: int = 365
    max_list_days: int = 0


def days_before(ymd: str, days: int) -> str:
    from datetime import datetime, timedelta

    return (datetime.strptime(ymd, "%Y%m%d") - timedelta(days=days)).strftime("%Y%m%d")


def skip_reason(rules: UniverseRules) -> Column:
    """The first reason that keeps a security out; null for those that are in. Dates compare as texts."""
    reason = F.when(F.lit(rules.exclude_special) & is_special(F.col("name")), "st-or-delisting")
    reason = reason.when(F.lit(rules.exclude_bse) & (F.col("board") == "bse"), "bse")
    young = days_before(rules.as_of, rules.min_list_days)
    reason = reason.when((F.coalesce("list_date", F.lit("")) == "") | (F.col("list_date") >= young), "recent-or-unknown-listing")
    if rules.max_list_days > 0:
        reason = reason.when(F.col("list_date") < days_before(rules.as_of, rules.max_list_days), "too-old-listing")
    return reason


def marked(stocks: DataFrame, rules: UniverseRules) -> DataFrame:
    return stocks.withColumn("skip_reason", skip_reason(rules))


def universe(stocks: DataFrame, rules: UniverseRules) -> DataFrame:
    return stocks.where(skip_reason(rules).isNull())


def whitelisted(stocks: DataFrame, codes: DataFrame | Sequence[str] | None) -> DataFrame:
    """The securities among the codes; all without any codes. codes: a list, or a frame with a column code."""
    if codes is None or (not isinstance(codes, DataFrame) and not len(codes)):
        return stocks
    if not isinstance(codes, DataFrame):
        codes = stocks.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(codes)], "code string")
    return stocks.join(codes.select("code"), "code", "left_semi")


def skips(stocks: DataFrame, rules: UniverseRules, codes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """skip_reason and n. With codes also code-filtered, even if that is none."""
    found = marked(stocks, rules)
    out = found.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))
    if codes is None or (not isinstance(codes, DataFrame) and not len(codes)):
        return out
    free = found.where("skip_reason IS NULL")
    listed = whitelisted(free, codes).select(F.lit(-1).cast("long").alias("k"))
    left = free.select(F.lit(1).cast("long").alias("k")).unionAll(listed).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    return out.unionByName(left.select(F.lit("code-filtered").alias("skip_reason"), "n"))


def too_many_failures(failed: int, securities: int) -> bool:
    """Whether so many securities failed to load that the source itself must be down."""
    return failed > max(10, securities // 10)
