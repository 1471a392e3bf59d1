"""Screens: one plan from bars and securities to hits, diagnoses and tiers.

The plan is one join of bars with the securities that are in, one shuffle by code for all windows and the aggregate, and
expressions. Industry strategies join the industries' statistics to the aggregated rows, of which there is one a code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.market import limit_of
from tickloom.operators import industry
from tickloom.operators.filters import FILTERS
from tickloom.operators.series import chained, returns, surge
from tickloom.operators.universe import UniverseRules, universe, whitelisted
from tickloom.plans.predicate import Node, compiled
from tickloom.plans.strategies import Strategy

BAR_COLUMNS = ("code", "date", "close", "volume", "amount", "pre_close")
STOCK_COLUMNS = ("code", "full_code", "name", "board", "industry", "total_cap", "float_cap")


def derived(bars: DataFrame, stocks: DataFrame, filters: Sequence[str], params: Mapping[str, Any], cycle: bool = False) -> DataFrame:
    """The series of the given securities with every row column that the filters ask for."""
    needs = frozenset().union(*(FILTERS[f].needs for f in filters)) if filters else frozenset()
    per_stock = ["code"]
    if "limit" in needs:
        stocks = stocks.withColumn("limit", limit_of(F.col("board"), F.col("name")))
        per_stock.append("limit")
    if "float_cap" in needs:
        per_stock.append("float_cap")
    rows = chained(returns(bars.select(*BAR_COLUMNS).join(stocks.select(*per_stock), "code")))
    if "surge" in needs:
        rows = surge(rows)
    extra = {k: c for f in filters for k, c in FILTERS[f].rows(params).items()}
    if cycle:
        extra |= industry.cycle_rows()
    return rows.withColumns(extra) if extra else rows


def aggregated(bars: DataFrame, stocks: DataFrame, filters: Sequence[str], params: Mapping[str, Any], cycle: bool = False) -> DataFrame:
    """One row a code that has bars: bars_analyzed, close, last_date and the filters' aggregates."""
    found = {k: c for f in filters for k, c in FILTERS[f].aggregates(params).items()}
    if cycle:
        found |= industry.cycle_aggregates()
    rows = derived(bars, stocks, filters, params, cycle)
    return rows.groupBy("code").agg(F.max("n").alias("bars_analyzed"), F.max(F.when(F.col("r") == 0, F.col("close"))).alias("close"), F.max("date").alias("last_date"), *(c.alias(k) for k, c in found.items()))


def with_industries(members: DataFrame, rows: DataFrame) -> DataFrame:
    """All members with their aggregated rows and the statistics of their industries.

    rows: aggregates of all members, cycle's among them. The same pass over the bars serves the filters and the
    industries; what is dealt by industry is one row a member.
    """
    joined = members.select(*STOCK_COLUMNS).join(rows, "code", "left")
    known = F.col("industry").isNotNull()
    return joined.withColumns({k: F.when(known, c.over(Window.partitionBy("industry"))) for k, c in industry.statistics().items()})


def measured(bars: DataFrame, members: DataFrame, candidates: DataFrame, filters: Sequence[str], params: Mapping[str, Any]) -> DataFrame:
    """Candidates with bars, and for each filter gate_<id> and evidence ev_<id>_<key>."""
    if any("industry" in FILTERS[f].needs for f in filters):
        rows = with_industries(members, aggregated(bars, members, filters, params, cycle=True)).where("bars_analyzed IS NOT NULL")
        if candidates is not members:
            rows = rows.join(candidates.select("code"), "code", "left_semi")
    else:
        rows = candidates.select(*STOCK_COLUMNS).join(aggregated(bars, candidates, filters, params), "code")
    out: list[Column] = []
    for f in filters:
        own = {k: params[k] for k in (p.name for p in FILTERS[f].params)}
        out.append(F.coalesce(FILTERS[f].gate(own), F.lit(False)).alias(f"gate_{f}"))
        out += [c.alias(f"ev_{f}_{k}") for k, c in FILTERS[f].evidence(own).items()]
    return rows.select("code", "full_code", "name", "board", "bars_analyzed", "close", "last_date", *out)


def evidence(node: Node, params: Mapping[str, Any], short: bool) -> dict[str, Column]:
    """For each key the value of the last leaf evaluated that declares it; null where none was."""
    out: dict[str, Column] = {}
    for f, reach in compiled(node, short).reached:
        for k in FILTERS[f].evidence({p.name: params[p.name] for p in FILTERS[f].params}):
            value = F.col(f"ev_{f}_{k}")
            out[k] = F.when(reach, value).otherwise(out[k]) if k in out else F.when(reach, value)
    return out


@dataclass(frozen=True)
class Scan:
    """What a screen runs over. codes: restricts candidates, not the members of industries."""

    bars: DataFrame
    stocks: DataFrame
    rules: UniverseRules
    codes: DataFrame | tuple[str, ...] | None = None

    def members(self) -> DataFrame:
        return universe(self.stocks, self.rules)

    def candidates(self) -> DataFrame:
        return whitelisted(self.members(), self.codes)


def evaluated(scan: Scan, strategy: Strategy, given: Mapping[str, Any] | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """The measured candidates with enough bars, and the parameters."""
    params = strategy.resolve(given)
    members = scan.members()
    rows = measured(scan.bars, members, whitelisted(members, scan.codes), strategy.predicate.filters(), params)
    return rows.where(F.col("bars_analyzed") >= strategy.least(params)), params


def screen(scan: Scan, strategy: Strategy, given: Mapping[str, Any] | None = None) -> DataFrame:
    """The hits: security, strategy and evidence (a struct; null for what wasn't evaluated), by code."""
    rows, params = evaluated(scan, strategy, given)
    done = compiled(strategy.predicate, short=True)
    found = evidence(strategy.predicate, params, short=True)
    values = F.struct(*(c.alias(k) for k, c in found.items()), F.col("close"), F.col("bars_analyzed").alias("barsAnalyzed"))
    return rows.where(done.passed).select("code", "full_code", "name", "board", F.lit(strategy.id).alias("strategy"), values.alias("evidence")).orderBy("code")


def diagnose(scan: Scan, strategy: Strategy, given: Mapping[str, Any] | None = None) -> DataFrame:
    """Every evaluated candidate: matched, gates, failed_gates and metrics (a struct)."""
    rows, params = evaluated(scan, strategy, given)
    done = compiled(strategy.predicate, short=False)
    gates = F.create_map(*(x for f in strategy.predicate.filters() for x in (F.lit(f), F.col(f"gate_{f}"))))
    metrics = F.struct(*(c.alias(k) for k, c in evidence(strategy.predicate, params, short=False).items()), F.col("close"), F.col("bars_analyzed").alias("barsAnalyzed"))
    return rows.select("code", "full_code", "name", "board", "last_date", done.passed.alias("matched"), gates.alias("gates"), done.failed.alias("failed_gates"), metrics.alias("metrics"))


def tiers(diagnosis: DataFrame) -> DataFrame:
    """A diagnosis with tier: hit, near (exactly one failed gate) or other."""
    return diagnosis.withColumn("tier", F.when(F.col("matched"), "hit").when(F.size("failed_gates") == 1, "near").otherwise("other"))


def drawdown(diagnosis: DataFrame) -> Column:
    known = "drawdownFromHigh" in diagnosis.schema["metrics"].dataType.names
    return F.coalesce(F.col("metrics.drawdownFromHigh"), F.lit(0.0)) if known else F.lit(0.0)


def near_misses(diagnosis: DataFrame, top: int = 30) -> DataFrame:
    """The near misses with the deepest drawdowns, ties by code."""
    return tiers(diagnosis).where("tier = 'near'").orderBy(drawdown(diagnosis).desc(), "code").limit(max(1, top))


def hits(diagnosis: DataFrame) -> DataFrame:
    return tiers(diagnosis).where("tier = 'hit'").orderBy("code")
