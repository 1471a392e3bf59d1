"""Statistics of industries: how far their members are below their highs, and where they stand in their own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import whole

#: Bars of a member's percentile, and the drawdown from which on it counts as deep.
WINDOW, DEEP = 730, 0.6


def cycle_rows() -> dict[str, Column]:
    return {"cycle_last": F.last("idx").over(whole())}


def cycle_aggregates() -> dict[str, Column]:
    recent = F.col("r") < WINDOW
    return {
        "cycle_drawdown": 1 - F.max("cycle_last") / F.max("idx"),
        "cycle_pos": F.count(F.when(recent & (F.col("idx") <= F.col("cycle_last")), 1)) / F.count(F.when(recent, 1)),
    }


def statistics() -> dict[str, Column]:
    """Aggregates of members; one without bars has nulls, which count as no drawdown and the highest percentile."""
    d, p = F.coalesce("cycle_drawdown", F.lit(0.0)), F.coalesce("cycle_pos", F.lit(1.0))
    return {"members": F.count(F.lit(1)), "med_drawdown": F.median(d), "med_pos": F.median(p), "deep_share": F.avg((d >= DEEP).cast("double"))}


def industry_stats(members: DataFrame) -> DataFrame:
    """Statistics of each industry. members: industry, cycle_drawdown, cycle_pos."""
    return members.where("industry IS NOT NULL").groupBy("industry").agg(*(c.alias(k) for k, c in statistics().items()))
