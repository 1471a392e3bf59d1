"""A stream of landed bars that is merged into a store.

Every micro-batch is reduced to one bar a code and day and merged with what is stored; codes whose history a source has
restated are written to `restated` for the fetch stage to load anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.bars import latest, mergeable
from tickloom.sources.store import BARS, Store


def merge_stream(spark: SparkSession, landed: str, store: Store, source: str, checkpoint: str) -> StreamingQuery:
    """Takes all that has landed (Parquet, with a column `seq` that orders bars of a key) and stops."""
    rows = spark.readStream.schema(f"{BARS}, seq long").parquet(landed)

    def batch(new: DataFrame, epoch: int) -> None:
        one = latest(new, ["code", "date"], "seq").persist()
        try:
            ready, restated = mergeable(store.bars(source), one)
            restated = restated.persist()
            if not restated.isEmpty():
                store.write(f"restated/source={source}", store.read(f"restated/source={source}", "code string").union(restated).distinct())
            store.merge_bars(source, one.join(restated, "code", "left_anti").select(*ready.columns))
            restated.unpersist()
        finally:
            one.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_volume(bars: DataFrame, late: str = "3 days") -> DataFrame:
    """Volume by code and seven days (from Thursdays on) of a stream of bars, with late bars up to a watermark."""
    timed = bars.withColumn("at", F.to_timestamp("date", "yyyyMMdd"))
    return timed.withWatermark("at", late).groupBy("code", F.window("at", "7 days")).agg(F.sum("volume").alias("volume"), F.count("*").alias("bars"))
