"""From bars to the chained return index of each security.

All of it is windows over (code, date), so one shuffle and one sort by code serve every filter and the aggregate that
follows. Bars: code, date (yyyyMMdd), close, volume (lots), amount and pre_close (nullable); one a day and code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FLOOR = 1e-9


def by_date() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def whole() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def backwards() -> WindowSpec:
    """From the last bar to the first. Frames up to the end of a series are taken from here as frames from its start:
    Spark evaluates those in one pass, the others in a time that grows with the square of the series."""
    return Window.partitionBy("code").orderBy(F.desc("date"))


def so_far() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def returns(bars: DataFrame) -> DataFrame:
    """Bars with i (place), n (bars in all), r (bars before the last) and ret, the day's return or null."""
    prev = F.lag("close").over(by_date())
    numbered = bars.withColumns({"i": F.row_number().over(by_date()) - 1, "n": F.count(F.lit(1)).over(whole()), "prev": prev})
    own = F.when(F.col("pre_close") > 0, F.col("close") / F.col("pre_close") - 1)
    ret = F.when(F.col("pre_close") > 0, own).when(F.col("prev") > 0, F.col("close") / F.col("prev") - 1)
    return numbered.withColumns({"ret": ret, "r": F.col("n") - 1 - F.col("i")}).drop("prev")


def chained(series: DataFrame) -> DataFrame:
    """A series with idx: 1 on the first bar, then times the return's factor, which never falls to zero."""
    factor = F.when(F.col("i") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(FLOOR), 1 + F.coalesce("ret", F.lit(0.0))))
    return series.withColumn("idx", F.product(factor).over(so_far()))


def surge(series: DataFrame) -> DataFrame:
    """A series with surge: volume over the mean volume of up to five bars before, 0 where that isn't positive."""
    before = F.avg("volume").over(by_date().rowsBetween(-5, -1))
    with_mean = series.withColumn("before", before)
    return with_mean.withColumn("surge", F.when(F.col("before") > 0, F.col("volume") / F.col("before")).otherwise(0.0)).drop("before")


def limit_up(limit: Column) -> Column:
    """Whether a day's return reaches the limit."""
    return F.coalesce(F.col("ret") >= limit, F.lit(False))


def limit_up_days(series: DataFrame) -> DataFrame:
    """The limit-up days of a series that has surge and the column limit."""
    return series.where(limit_up(F.col("limit"))).select("code", "i", "date", "ret", "surge")
