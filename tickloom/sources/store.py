"""Stored tables: versions of Parquet tables in a folder, the newest complete one of which counts."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import merge

BARS = "code string, date string, open double, high double, low double, close double, volume double, amount double, pre_close double"
STOCKS = "code string, full_code string, name string, board string, list_date string, industry string, total_cap double, float_cap double"
FILES = "code string, fetched_at string, start_date string, tail string"


class Store:
    """root/<name>/v=<n>; a version counts once its writer has finished, so readers never see half of one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, name: str) -> list[int]:
        fs, path = self._folder(name)
        if not fs.exists(path):
            return []
        done = []
        for status in fs.listStatus(path):
            own = status.getPath()
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS")
            if own.getName().startswith("v=") and fs.exists(mark):
                done.append(int(own.getName()[2:]))
        return sorted(done)

    def read(self, name: str, schema: str) -> DataFrame:
        """The newest version; an empty table if there is none."""
        path = self.newest(name)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def newest(self, name: str) -> str | None:
        """The folder of the newest version that can be read; a damaged one is passed over for the one before."""
        for v in reversed(self.versions(name)):
            path = f"{self.root}/{name}/v={v}"
            try:
                self.spark.read.parquet(path)  # reads a footer
            except Exception as bad:  # noqa: BLE001  whatever is wrong with it, an older one may do
                warnings.warn(f"{path} can't be read: {str(bad)[:200]}", stacklevel=2)
            else:
                return path
        return None

    def write(self, name: str, df: DataFrame, keep: int = 2) -> int:
        """Writes a further version and drops all but the last `keep`."""
        known = self.versions(name)
        new = (known[-1] if known else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={new}")
        fs, path = self._folder(name)
        for old in [*known, new][:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v={old}"), True)
        return new

    def years(self, source: str) -> list[str]:
        """The years that have bars, each a versioned table of its own."""
        fs, path = self._folder(f"bars/source={source}")
        if not fs.exists(path):
            return []
        return sorted(n[5:] for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith("year="))

    def bars(self, source: str, start: str = "") -> DataFrame:
        """The bars of a source from the year of `start` (yyyyMMdd) on; earlier years' files are not looked at."""
        found = [p for y in self.years(source) if y >= start[:4] and (p := self.newest(f"bars/source={source}/year={y}"))]
        return self.spark.read.schema(BARS).parquet(*found) if found else self.spark.createDataFrame([], BARS)

    def write_year(self, source: str, year: str, bars: DataFrame) -> None:
        """Bars dealt by code and sorted, so that scans of some codes or days read few row groups."""
        columns = [c.split()[0] for c in BARS.split(", ")]
        self.write(f"bars/source={source}/year={year}", bars.select(*columns).repartition("code").sortWithinPartitions("code", "date"))

    def write_bars(self, source: str, bars: DataFrame) -> None:
        """The bars instead of all that there were."""
        new = touched(bars)
        for y in sorted({*new, *self.years(source)}):
            self.write_year(source, y, bars.where(F.col("date").startswith(y)) if y in new else self.spark.createDataFrame([], BARS))

    def merge_bars(self, source: str, new: DataFrame, instead_of: DataFrame | None = None) -> None:
        """Merges bars; only the years that they touch are written again.

        instead_of: codes whose stored bars all go first, which touches every year.
        """
        own = touched(new)
        for y in sorted({*own, *(self.years(source) if instead_of is not None else ())}):
            old = self.read(f"bars/source={source}/year={y}", BARS)
            if instead_of is not None:
                old = old.join(instead_of.select("code"), "code", "left_anti")
            self.write_year(source, y, merge(old, new.where(F.col("date").startswith(y)).select(*old.columns)))

    def files(self, source: str) -> DataFrame:
        """What has been loaded of each security; see FILES."""
        return self.read(f"files/source={source}", FILES)

    def note_files(self, source: str, codes: DataFrame, today: str, start: str) -> None:
        """Notes that the history of the codes from `start` on was asked for today."""
        tails = self.bars(source).groupBy("code").agg(F.max("date").alias("tail"))
        now = codes.select("code").distinct().join(tails, "code", "left").select("code", F.lit(today).alias("fetched_at"), F.lit(start).alias("start_date"), "tail")
        old = self.files(source).join(codes.select("code"), "code", "left_anti").select("code", "fetched_at", "start_date", "tail")
        self.write(f"files/source={source}", old.unionByName(now))

    def stocks(self) -> DataFrame:
        return self.read("stocks", STOCKS)


def touched(bars: DataFrame) -> list[str]:
    """The years of bars; a few dozen at most."""
    return [r.y for r in bars.select(F.substring("date", 1, 4).alias("y")).distinct().collect()]


def legacy_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of JSON files with rows [date, open, high, low, close, volume, preClose] and, in newer ones, amount."""
    raw = spark.read.schema("code string, fetchedAt string, startDate string, bars array<array<string>>").option("multiLine", True).json(path)
    row = raw.select(F.substring_index("code", ".", 1).alias("code"), F.explode("bars").alias("b"))
    at = lambda i: F.get("b", F.lit(i)).try_cast("double")
    return row.select("code", F.get("b", F.lit(0)).alias("date"), at(1).alias("open"), at(2).alias("high"), at(3).alias("low"), at(4).alias("close"), at(5).alias("volume"), at(7).alias("amount"), at(6).alias("pre_close"))
