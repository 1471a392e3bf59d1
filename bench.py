"""Times the headline scans and prints one line of JSON.

Bars and securities of the sample at BENCH_SF_DIR are stored once, as after a sync; scans then read the store, which
corresponds to a scan with a warm cache. Each is run to the end with all its columns, the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import queries
from tickloom.operators.filters import FILTERS
from tickloom.plans import predicate as pred
from tickloom.plans import screen as scr
from tickloom.plans import strategies as st
from tickloom.sources import sample
from tickloom.sources.store import Store


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as folder:
        store = Store(spark, folder)
        store.write_bars("eastmoney", sample.bars(spark, sf_dir))
        store.write("stocks", sample.stocks(spark, sf_dir))
        over = scr.Scan(store.bars("eastmoney"), store.stocks(), queries.RULES)
        securities = over.bars.select("code").distinct().count()
        everything = st.Strategy("everything", "All filters.", pred.Node("or", tuple(pred.leaf(f) for f in FILTERS)), lambda p: 60)
        timed: dict[str, DataFrame] = {
            "scan_15_filters_with_industries": scr.diagnose(over, everything),
            "scan_low_flat_limit_up": scr.diagnose(over, st.strategy("low_flat_limit_up")),
            "scan_flat_base_low": scr.diagnose(over, st.strategy("flat_base_low")),
            "scan_low_flat_breakout": scr.diagnose(over, st.strategy("low_flat_breakout"), queries.BREAKOUT),
            "industry_stats": queries.q_industry_stats(spark, sf_dir),
            "bars_from_sample": queries.q_bars(spark, sf_dir),
            "bars_merge": queries.q_bars_merge(spark, sf_dir),
        }
        seconds = {}
        for name, df in timed.items():
            best = float("inf")
            for _ in range(2):
                start = time.perf_counter()
                df.select(*(F.col(f"`{c}`") for c in df.columns)).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - start)
            seconds[name] = round(best, 3)
    first = seconds["scan_15_filters_with_industries"]
    print(json.dumps({"metric": "seconds of all scans", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "securities": securities, "securities_per_second": round(securities / first, 1), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
