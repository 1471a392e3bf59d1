"""What a caller uses: screens by strategy or predicate, and listings of what there is."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators.filters import FILTERS
from tickloom.operators.universe import UniverseRules
from tickloom.plans import predicate as pred
from tickloom.plans import screen as scr
from tickloom.plans import strategies as st
from tickloom.plans.params import Param, resolved
from tickloom.sources.vendors import SOURCES, source

#: Settings of a screener and their bounds.
SETTINGS = (
    Param("requestsPerMinute", 200, 30, 1000, True, "Requests a minute of the fetch stage."),
    Param("historyBars", 800, 250, 3000, True, "Trading days of history to keep."),
    Param("excludeST", True, about="Leave out special treatment and delistings."),
    Param("excludeBSE", True, about="Leave out the bse board."),
    Param("minListDays", 365, 0, 5000, True, "Least days since listing."),
    Param("maxListDays", 0, 0, 10000, True, "Most days since listing; 0 for no bound."),
    Param("scanTimeoutMs", 1_800_000, 60_000, 7_200_000, True, "Time after which a scan's jobs are cancelled."),
    Param("dataSource", "sina", about="Where bars come from."),
)


@dataclass(frozen=True)
class Settings:
    values: Mapping[str, Any]

    @classmethod
    def of(cls, **given: Any) -> Settings:
        values = resolved({p.name: p for p in SETTINGS}, given)
        source(values["dataSource"])
        return cls(values)

    def rules(self, as_of: str) -> UniverseRules:
        v = self.values
        return UniverseRules(as_of, v["excludeST"], v["excludeBSE"], v["minListDays"], v["maxListDays"])

    def history_start(self, today: str) -> str:
        """A day that surely lies historyBars trading days back."""
        from tickloom.operators.universe import days_before

        return days_before(today, -(-self.values["historyBars"] * 3 // 2) + 45)


@contextlib.contextmanager
def limited(spark: SparkSession, milliseconds: int) -> Iterator[None]:
    """Jobs started by this thread in here are cancelled once the time is up, and a TimeoutError is raised."""
    context, group, late = spark.sparkContext, f"tickloom-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, "tickloom", True)
    timer = threading.Timer(milliseconds / 1000, stop)
    timer.daemon = True
    timer.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"cancelled after {milliseconds} ms") from error
        raise
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)


def expected_trading_day(today: str) -> str:
    """The latest day that can have bars: today, on weekends the Friday before."""
    from datetime import datetime

    from tickloom.operators.universe import days_before

    return days_before(today, max(0, datetime.strptime(today, "%Y%m%d").weekday() - 4))


def chosen(strategy: str | None = None, predicate: Any = None) -> st.Strategy:
    """The strategy by id or by a predicate in JSON form; exactly one of them is given."""
    if (strategy is None) == (predicate is None):
        raise ValueError("give either a strategy or a predicate")
    return st.strategy(strategy) if strategy is not None else st.custom(pred.parse(predicate))


def check_source(strategy: st.Strategy, source_id: str) -> None:
    if missing := source(source_id).lacks(strategy.needs):
        raise ValueError(f"{strategy.id} needs {', '.join(missing)}, which source {source_id} doesn't have")


def screen(bars: DataFrame, stocks: DataFrame, as_of: str, strategy: str | None = None, predicate: Any = None, params: Mapping[str, Any] | None = None, codes: Sequence[str] | DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """The hits of a strategy or predicate; see plans.screen."""
    settings = settings or Settings.of()
    own = chosen(strategy, predicate)
    check_source(own, settings.values["dataSource"])
    return scr.screen(scr.Scan(bars, stocks, settings.rules(as_of), codes if codes is None or isinstance(codes, DataFrame) else tuple(codes)), own, params)


def diagnose(bars: DataFrame, stocks: DataFrame, as_of: str, strategy: str | None = None, predicate: Any = None, params: Mapping[str, Any] | None = None, codes: Sequence[str] | DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    settings = settings or Settings.of()
    own = chosen(strategy, predicate)
    check_source(own, settings.values["dataSource"])
    return scr.diagnose(scr.Scan(bars, stocks, settings.rules(as_of), codes if codes is None or isinstance(codes, DataFrame) else tuple(codes)), own, params)


PARAMS = "array<struct<name: string, kind: string, default: string, low: double, high: double, about: string>>"


def documented(params: Sequence[Param]) -> list[tuple]:
    return [(p.name, p.kind, str(p.default).lower() if isinstance(p.default, bool) else str(p.default), None if p.low is None else float(p.low), None if p.high is None else float(p.high), p.about) for p in params]


def list_strategies(spark: SparkSession) -> DataFrame:
    rows = [(s.id, s.about, str(s.predicate), documented(list(s.params.values()))) for s in st.STRATEGIES.values()]
    return spark.createDataFrame(rows, f"id string, about string, predicate string, params {PARAMS}")


def list_filters(spark: SparkSession) -> DataFrame:
    rows = [(f.id, f.about, "industry" in f.needs, "market_cap" in f.needs, "amount" in f.needs, documented(f.params)) for f in FILTERS.values()]
    return spark.createDataFrame(rows, f"id string, about string, requiresIndustry boolean, requiresMarketCap boolean, requiresAmount boolean, params {PARAMS}")


def list_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.id, s.about, s.adjusted, s.industry, s.market_cap, s.amount) for s in SOURCES.values()], "id string, about string, adjusted string, industry boolean, market_cap boolean, amount boolean")
