"""Reports of a scan: Markdown, JSON and plain text. Renders collected hits and a bounded number of near misses."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.filters import FILTERS
from tickloom.operators.universe import UniverseRules, skips
from tickloom.plans import screen as scr
from tickloom.plans.params import merged, resolved

#: What gates are called in reports.
LABELS = {
    "deep_drawdown": "距高点回撤",
    "low_percentile": "历史分位",
    "bars_since_low": "距低点时长",
    "flat_base": "平台走平+均线收敛",
    "platform_breakout": "平台放量突破",
    "ma_stabilization": "均线企稳",
    "volatility_regime": "波动率区间",
    "volume_limit_up": "放量涨停",
    "cooldown_pullback": "涨停后回落缩量",
    "volume_dry_up": "地量",
    "industry_clearance": "行业出清",
    "industry_position": "行业位置",
    "market_cap_band": "市值区间",
    "amount_liquidity": "成交额下限",
    "turnover_band": "换手率区间",
}
DISCLAIMER = "Technical screening of historical data for research; not investment advice."


#: How the numbers of evidence are written; whatever is not named here is written as it is.
FORMATS: dict[str, tuple[Callable[[float], str], tuple[str, ...]]] = {
    "share": (lambda x: f"{100 * x:.1f}%", ("drawdownFromHigh", "percentileInWindow", "pctAboveLow", "flatNetChange", "flatMaSpread", "baseToClosePct", "maSlope", "closeVsMaPct", "annualVol", "limitUpPct", "dryUpVolumeRatio", "cooldownVolumeRatio", "industryMedDrawdown", "industryMedPos", "industryDeepShare")),
    "times": (lambda x: f"{x:.1f}x", ("breakoutSurge", "limitUpVolumeSurge")),
    "whole": (lambda x: f"{x:.0f}", ("barsSinceLow", "barsSinceBreakout", "daysSinceLimitUp", "industryMembers", "marketCapYi")),
    "exact": (lambda x: f"{x:.2f}", ("medianAmountYi", "medianTurnoverPct", "close")),
}
WRITTEN = {key: write for write, keys in FORMATS.values() for key in keys}


def shown(key: str, value: Any) -> str:
    if value is None:
        return "-"
    return WRITTEN[key](value) if key in WRITTEN else str(value)


@lru_cache(64)
def evidence_keys(filter_id: str) -> tuple[str, ...]:
    f = FILTERS[filter_id]
    return tuple(f.evidence(resolved(merged([f.params]), None)))


@dataclass
class Report:
    strategy: str
    params: Mapping[str, Any]
    source: str
    scope: str
    made: str
    last_bar: str | None
    evaluated: int
    skipped: dict[str, int]
    hits: list[dict[str, Any]] = field(default_factory=list)
    near: list[dict[str, Any]] = field(default_factory=list)
    near_in_all: int = 0
    others: int = 0


def collected(rows: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in rows.select("code", "full_code", "name", "board", "gates", "failed_gates", "metrics").collect()]


def build(diagnosis: DataFrame, stocks: DataFrame, rules: UniverseRules, strategy: str, params: Mapping[str, Any], source: str, scope: str, made: str, codes: Sequence[str] | None = None, top: int = 30) -> Report:
    """Runs a diagnosis and gathers what a report shows: all hits, `top` near misses, and counts."""
    kept = diagnosis.persist()
    try:
        counts = {r.tier: (r.n, r.last) for r in scr.tiers(kept).groupBy("tier").agg(F.count("*").alias("n"), F.max("last_date").alias("last")).collect()}
        n = lambda t: counts.get(t, (0, None))[0]
        last = max((d for _, d in counts.values() if d), default=None)
        skipped = {r.skip_reason: r.n for r in skips(stocks, rules, codes).collect()}
        return Report(strategy, params, source, scope, made, last, sum(map(n, counts)), skipped, collected(scr.hits(kept)), collected(scr.near_misses(kept, top)), n("near"), n("other"))
    finally:
        kept.unpersist()


def gate_cells(entry: Mapping[str, Any]) -> list[str]:
    """For each gate, in the order of the filters' registry, its outcome, name and evidence."""
    gates, metrics = entry["gates"], entry["metrics"]
    out = []
    for g in (f for f in FILTERS if f in gates):
        found = ", ".join(f"{k} {shown(k, metrics.get(k))}" for k in evidence_keys(g))
        out.append(f"{'pass' if gates[g] else 'fail'} {LABELS.get(g, g)} ({found})")
    return out


def table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> list[str]:
    if not rows:
        return ["None.", ""]
    line = lambda cells: "| " + " | ".join(c.replace("|", "/") for c in cells) + " |"
    return [line(head), line(["-"] * len(head)), *map(line, rows), ""]


def markdown(report: Report) -> str:
    """Facts of the scan, then tables of hits, of near misses with the gate that each lacks, and of what was left out."""

    def security(e: Mapping[str, Any]) -> list[str]:
        return [e["code"], e["name"], e["board"], shown("close", e["metrics"].get("close"))]

    facts = [("Strategy", report.strategy), ("Source", report.source), ("Scope", report.scope), ("Made", report.made), ("Last bar", report.last_bar or "unknown"), ("Evaluated", report.evaluated), ("Hits", len(report.hits)), ("Near misses", f"{len(report.near)} of {report.near_in_all}"), ("Others", report.others)]
    facts += [(f"`{k}`", v) for k, v in report.params.items()]
    head = ["Code", "Name", "Board", "Close"]
    return "\n".join(
        [
            f"# Screen {report.strategy}",
            "",
            *table(["Fact", "Value"], [[k, str(v)] for k, v in facts]),
            "## Hits",
            "",
            *table([*head, "Gates"], [[*security(e), "; ".join(gate_cells(e))] for e in report.hits]),
            "## One gate short",
            "",
            *table([*head, "Lacks", "Gates"], [[*security(e), ", ".join(LABELS.get(g, g) for g in e["failed_gates"]), "; ".join(gate_cells(e))] for e in report.near]),
            "## Left out",
            "",
            *table(["Reason", "Securities"], [[k, str(v)] for k, v in report.skipped.items()]),
            DISCLAIMER,
        ]
    )


def as_json(report: Report) -> str:
    def view(e: Mapping[str, Any]) -> dict[str, Any]:
        return {"code": e["code"], "fullCode": e["full_code"], "name": e["name"], "board": e["board"], "gates": e["gates"], "failedGates": e["failed_gates"], "metrics": e["metrics"]}

    return json.dumps(
        {
            "strategy": report.strategy,
            "source": report.source,
            "scope": report.scope,
            "generatedAt": report.made,
            "lastBarDate": report.last_bar,
            "evaluated": report.evaluated,
            "skipped": report.skipped,
            "params": dict(report.params),
            "summary": {"hits": len(report.hits), "nearMisses": len(report.near), "nearMissesInAll": report.near_in_all, "others": report.others},
            "hits": [view(e) for e in report.hits],
            "nearMisses": [view(e) for e in report.near],
        },
        ensure_ascii=False,
        indent=2,
    )


def text(hits: Sequence[Mapping[str, Any]], strategy: str, source: str, scanned: int, skipped: Mapping[str, int], notes: Sequence[str] = ()) -> str:
    """A table of hits with one column for each evidence that any of them has."""
    out = [f"Screen {strategy} ({source}): {scanned} securities scanned, {len(hits)} matched."]
    if hits:
        keys = list(dict.fromkeys(k for h in hits for k, v in h["evidence"].items() if v is not None and k != "close"))
        rows = [["code", "name", "board", *keys, "close"]]
        rows += [[h["code"], h["name"][:12], h["board"], *("-" if h["evidence"].get(k) is None else str(h["evidence"][k]) for k in keys), str(h["evidence"].get("close"))] for h in hits]
        width = [max(map(len, c)) + 2 for c in zip(*rows, strict=True)]
        out += ["", *("".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows), ""]
    else:
        out.append("No security matched with the given parameters.")
    if skipped:
        out.append(f"Left out of the universe: {json.dumps(dict(skipped))}")
    return "\n".join([*out, *(f"Note: {n}" for n in notes), DISCLAIMER])
