"""The fifteen atomic filters.

A filter declares row columns (windows over one code's bars), aggregates over a code's rows, a gate over the aggregates
and the security's own columns, and rounded evidence. Screens put the declarations of all the filters that they use
into one window stage and one aggregate by code. Gates compare unrounded values and are never null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite, half_up, positive
from tickloom.operators.series import backwards, by_date, limit_up, whole
from tickloom.plans.params import Param, merged

Columns = dict[str, Column]
Given = Mapping[str, float | bool | str]
YI = 1e8
LOT = 100
YEAR = 252


@dataclass(frozen=True)
class Filter:
    id: str
    about: str
    params: tuple[Param, ...]
    gate: Callable[[Given], Column]
    evidence: Callable[[Given], Columns]
    aggregates: Callable[[Given], Columns] = lambda p: {}
    rows: Callable[[Given], Columns] = lambda p: {}
    needs: frozenset[str] = field(default_factory=frozenset)


def number(name: str, default: float, low: float, high: float, about: str) -> Param:
    return Param(name, float(default), low, high, False, about)


def count(name: str, default: int, low: int, high: int, about: str) -> Param:
    return Param(name, default, low, high, True, about)


def C(name: str) -> Column:  # noqa: N802  columns are the nouns of this module
    return F.col(name)


def tail(x: str, bars: float) -> Column:
    """x on the last `bars` bars, else null."""
    return F.when(C("r") < int(bars), C(x))


def sma(bars: int, back: int = 0) -> Column:
    """The mean of idx over `bars` bars that end `back` bars before the last; null where there aren't as many."""
    return F.when(F.max("n") >= bars + back, F.avg(F.when((C("r") >= back) & (C("r") < bars + back), C("idx"))))


def last() -> Column:
    return F.max(F.when(C("r") == 0, C("idx")))


def bars() -> Column:
    return F.max("n")


MEMBERS = count("minIndustryMembers", 8, 3, 100, "Industries with fewer members in the universe don't pass.")
LIMIT_PARAMS = (
    count("limitUpWindowBars", 120, 20, 500, "Bars back in which the limit-up day is looked for."),
    number("minVolumeSurge", 2, 1.1, 20, "Least volume of that day, as a multiple of the mean of the five bars before."),
    count("minBarsAfterLimitUp", 6, 1, 30, "Bars that have to follow the limit-up day."),
)


def limit_day(p: Given, after: float) -> Column:
    """A limit-up day with enough volume, within the window and followed by at least `after` bars."""
    return limit_up(C("limit")) & (C("surge") >= p["minVolumeSurge"]) & (C("i") >= 5) & (C("r") <= p["limitUpWindowBars"]) & (C("r") >= after)


def breakout_rows(p: Given) -> Columns:
    base = int(p["baseWindowBars"])
    return {
        "bo_prev": F.lag("idx", 1).over(by_date()),
        "bo_first": F.lag("idx", base).over(by_date()),
        "bo_max": F.max("idx").over(by_date().rowsBetween(-base, -1)),
        "low_from_here": F.min("idx").over(backwards().rowsBetween(START, 0)),
    }


START = Window.unboundedPreceding


def breakout(p: Given) -> Columns:
    ok = (
        (C("i") >= int(p["baseWindowBars"]))
        & (C("i") >= 5)
        & (C("r") <= p["breakoutWindowBars"])
        & (C("r") >= p["minBarsAfterBreakout"])
        & (F.abs(C("bo_prev") / C("bo_first") - 1) <= p["maxBaseRangeChange"])
        & (C("idx") >= C("bo_max") * (1 + p["minBreakoutMargin"]))
        & (C("surge") >= p["minBreakoutSurge"])
        & (C("low_from_here") >= C("bo_max") * (1 - p["maxBaseGiveback"]))
    )
    return {"bo_day": F.max(F.when(ok, F.struct("i", "date", "surge", "bo_max"))), "bo_last": last(), "bo_n": bars()}


def cooldown_after(p: Given) -> float:
    return max(p["minBarsAfterLimitUp"], p["cooldownBars"] + 1)


def cooldown(p: Given) -> Columns:
    ok = limit_day(p, cooldown_after(p)) & (C("low_after_here") < C("idx")) & (C("cool_volume") <= p["maxCooldownVolumeRatio"] * C("volume"))
    return {"cd_day": F.max(F.when(ok, F.struct("i", "date", "volume", "cool_volume"))), "cd_n": bars()}


def flat(p: Given) -> Columns:
    fw = int(p["flatWindowBars"])
    return {"fb_ref": F.max(F.when(C("r") == fw, C("idx"))), "fb_last": last()} | {f"fb_{k}": sma(k) for k in (5, 10, 20, 60)}


FLAT_MEANS = tuple(f"fb_{k}" for k in (5, 10, 20, 60))


def flat_net() -> Column:
    return F.abs(C("fb_last") / C("fb_ref") - 1)


def flat_spread() -> Column:
    # Spark's greatest() and least() pass over nulls, so the longest mean has to be there.
    spread = (F.greatest(*FLAT_MEANS) - F.least(*FLAT_MEANS)) / F.least(*FLAT_MEANS)
    return F.when(C("fb_60").isNotNull() & C("fb_ref").isNotNull(), spread)


def ma_slope() -> Column:
    return F.when((C("ms_now") > 0) & (C("ms_then") > 0), C("ms_now") / C("ms_then") - 1)


def dry() -> Column:
    return F.when(C("dry_base") > 0, C("dry_now") / C("dry_base"))


def cap() -> Column:
    return positive(C("total_cap")) / YI


def liquid() -> Column:
    return C("liquid") / YI


def turnover() -> Column:
    return C("turned") * 100


def volatility() -> Column:
    return F.when(C("vol_n") >= 2, C("vol_sd") * F.sqrt(F.lit(float(YEAR))))


def band(x: Column, low: float, high: float) -> Column:
    """Within [low, high], where a high of 0 or less is no bound."""
    inside = x >= low
    return inside & (x <= high) if high > 0 else inside


FILTERS: dict[str, Filter] = {
    f.id: f
    for f in (
        Filter(
            "deep_drawdown",
            "The return index is far below its high.",
            (number("minDrawdownFromHigh", 0.65, 0.1, 0.99, "Least drawdown from the window's high."),),
            lambda p: 1 - C("dd_last") / C("dd_max") >= p["minDrawdownFromHigh"],
            lambda p: {"drawdownFromHigh": half_up(1 - C("dd_last") / C("dd_max"), 4)},
            lambda p: {"dd_last": last(), "dd_max": F.max("idx")},
        ),
        Filter(
            "low_percentile",
            "The return index stands low among its own past values.",
            (count("percentileWindowBars", 730, 120, 3000, "Bars among which the rank is taken."), number("maxPercentile", 0.15, 0.01, 1, "Highest share of values at or below the last one.")),
            lambda p: C("lp_below") / C("lp_count") <= p["maxPercentile"],
            lambda p: {"percentileInWindow": half_up(C("lp_below") / C("lp_count"), 4)},
            lambda p: {"lp_below": F.count(F.when((C("r") < p["percentileWindowBars"]) & (C("idx") <= C("last_idx")), 1)), "lp_count": F.count(tail("idx", p["percentileWindowBars"]))},
            lambda p: {"last_idx": F.last("idx").over(whole())},
        ),
        Filter(
            "bars_since_low",
            "The low is some time ago and the index hasn't run far from it.",
            (count("lowLookbackBars", 500, 60, 3000, "Bars in which the low is looked for."), count("minBarsSinceLow", 40, 1, 1000, "Least bars since the first low."), number("maxPctAboveLow", 0.5, 0.01, 5, "Most that the index stands above the low.")),
            lambda p: (C("bl_n") - 1 - C("bl_low.i") >= p["minBarsSinceLow"]) & (C("bl_last") / C("bl_low.idx") - 1 <= p["maxPctAboveLow"]),
            lambda p: {"barsSinceLow": (C("bl_n") - 1 - C("bl_low.i")).cast("double"), "pctAboveLow": half_up(C("bl_last") / C("bl_low.idx") - 1, 4)},
            lambda p: {"bl_low": F.min(F.when(C("r") < p["lowLookbackBars"], F.struct("idx", "i"))), "bl_last": last(), "bl_n": bars()},
        ),
        Filter(
            "flat_base",
            "The index has moved sideways and its moving averages have come together.",
            (count("flatWindowBars", 30, 10, 250, "Bars of the sideways move."), number("maxFlatRangeChange", 0.08, 0.005, 0.5, "Most net change over the window."), number("maxFlatMaSpread", 0.03, 0.002, 0.3, "Most spread of the 5, 10, 20 and 60 bar averages.")),
            lambda p: (flat_net() <= p["maxFlatRangeChange"]) & (flat_spread() <= p["maxFlatMaSpread"]),
            lambda p: {"flatNetChange": half_up(flat_net(), 4), "flatMaSpread": half_up(flat_spread(), 4)},
            flat,
        ),
        Filter(
            "platform_breakout",
            "The index has left a flat base on high volume and stayed above it.",
            (
                count("breakoutWindowBars", 10, 1, 60, "Bars back in which the breakout is looked for."),
                count("baseWindowBars", 30, 10, 250, "Bars of the base before the breakout."),
                number("maxBaseRangeChange", 0.08, 0.005, 0.5, "Most net change over the base."),
                number("minBreakoutMargin", 0.02, 0, 0.3, "How far the breakout has to clear the base's high."),
                number("minBreakoutSurge", 2, 1.1, 20, "Least volume of the breakout, as a multiple of the five bars before."),
                count("minBarsAfterBreakout", 2, 1, 30, "Bars that have to follow the breakout."),
                number("maxBaseGiveback", 0, 0, 0.1, "How far the index may fall back below the base's high."),
            ),
            lambda p: C("bo_day").isNotNull(),
            lambda p: {"breakoutDate": C("bo_day.date"), "breakoutSurge": half_up(C("bo_day.surge"), 2), "barsSinceBreakout": (C("bo_n") - 1 - C("bo_day.i")).cast("double"), "baseToClosePct": half_up(C("bo_last") / C("bo_day.bo_max") - 1, 4)},
            breakout,
            breakout_rows,
            frozenset({"surge"}),
        ),
        Filter(
            "ma_stabilization",
            "The moving average has stopped falling.",
            (
                count("maStabWindow", 20, 5, 120, "Bars of the moving average."),
                count("maSlopeBars", 5, 2, 30, "Bars over which its change is taken."),
                number("minMaSlope", 0, -0.05, 0.2, "Least relative change."),
                Param("requireCloseAboveMa", True, about="Whether the index has to stand at or above the average."),
            ),
            lambda p: (ma_slope() >= p["minMaSlope"]) & (C("ms_last") >= C("ms_now") if p["requireCloseAboveMa"] else F.lit(True)),
            lambda p: {"maSlope": half_up(ma_slope(), 4), "closeVsMaPct": half_up(F.when(ma_slope().isNotNull(), C("ms_last") / C("ms_now") - 1), 4)},
            lambda p: {
                "ms_now": F.when(bars() >= int(p["maStabWindow"]) + int(p["maSlopeBars"]), sma(int(p["maStabWindow"]))),
                "ms_then": sma(int(p["maStabWindow"]), int(p["maSlopeBars"])),
                "ms_last": last(),
            },
        ),
        Filter(
            "volatility_regime",
            "The realised volatility lies in a band.",
            (count("volWindow", 60, 20, 250, "Bars of the volatility."), number("minAnnualVol", 0.15, 0.01, 3, "Least annual volatility."), number("maxAnnualVol", 0.8, 0.05, 5, "Most annual volatility.")),
            lambda p: (volatility() >= p["minAnnualVol"]) & (volatility() <= p["maxAnnualVol"]),
            lambda p: {"annualVol": half_up(volatility(), 4)},
            lambda p: {"vol_sd": F.stddev_samp(tail("ret", p["volWindow"])), "vol_n": F.count(tail("ret", p["volWindow"]))},
        ),
        Filter(
            "volume_limit_up",
            "There was a limit-up day on high volume.",
            LIMIT_PARAMS,
            lambda p: C("lu_day").isNotNull(),
            lambda p: {"limitUpDate": C("lu_day.date"), "limitUpPct": half_up(C("lu_day.ret"), 4), "limitUpVolumeSurge": half_up(C("lu_day.surge"), 2)},
            lambda p: {"lu_day": F.max(F.when(limit_day(p, p["minBarsAfterLimitUp"]), F.struct("i", "date", "ret", "surge")))},
            needs=frozenset({"surge", "limit"}),
        ),
        Filter(
            "cooldown_pullback",
            "After a limit-up day on high volume the index has come back and volume has dried up.",
            (*LIMIT_PARAMS, number("maxCooldownVolumeRatio", 0.4, 0.05, 1.5, "Most recent mean volume, as a share of the limit-up day's."), count("cooldownBars", 5, 3, 30, "Bars of the recent mean.")),
            lambda p: C("cd_day").isNotNull(),
            lambda p: {"cooldownRefDate": C("cd_day.date"), "cooldownVolumeRatio": half_up(C("cd_day.cool_volume") / C("cd_day.volume"), 4), "daysSinceLimitUp": (C("cd_n") - 1 - C("cd_day.i")).cast("double")},
            cooldown,
            lambda p: {"low_after_here": F.min("idx").over(backwards().rowsBetween(START, -1)), "cool_volume": F.avg(tail("volume", p["cooldownBars"])).over(whole())},
            frozenset({"surge", "limit"}),
        ),
        Filter(
            "volume_dry_up",
            "Recent volume is low against the bars before.",
            (count("dryUpBars", 5, 3, 30, "Bars of the recent mean."), count("referenceWindowBars", 120, 20, 500, "Bars of the mean before them."), number("maxDryUpRatio", 0.5, 0.05, 2, "Most ratio of the two.")),
            lambda p: dry() <= p["maxDryUpRatio"],
            lambda p: {"dryUpVolumeRatio": half_up(dry(), 4)},
            lambda p: {"dry_now": F.avg(tail("volume", p["dryUpBars"])), "dry_base": F.avg(F.when((C("r") >= p["dryUpBars"]) & (C("r") < p["dryUpBars"] + p["referenceWindowBars"]), C("volume")))},
        ),
        Filter(
            "industry_clearance",
            "The security's industry has been sold off.",
            (MEMBERS, number("minIndustryMedDrawdown", 0.4, 0.1, 0.9, "Least median drawdown of the members."), number("minIndustryDeepShare", 0.25, 0.05, 1, "Least share of members 60 % or more below their high.")),
            lambda p: (C("med_drawdown") >= p["minIndustryMedDrawdown"]) & (C("deep_share") >= p["minIndustryDeepShare"]) & (C("members") >= p["minIndustryMembers"]),
            lambda p: {"industry": C("industry"), "industryMedDrawdown": half_up(C("med_drawdown"), 4), "industryDeepShare": half_up(C("deep_share"), 4), "industryMembers": C("members").cast("double")},
            needs=frozenset({"industry"}),
        ),
        Filter(
            "industry_position",
            "The security's industry stands low in its own history.",
            (MEMBERS, number("maxIndustryMedPos", 0.35, 0.05, 1, "Highest median percentile of the members.")),
            lambda p: (C("med_pos") <= p["maxIndustryMedPos"]) & (C("members") >= p["minIndustryMembers"]),
            lambda p: {"industry": C("industry"), "industryMedPos": half_up(C("med_pos"), 4), "industryMembers": C("members").cast("double")},
            needs=frozenset({"industry"}),
        ),
        Filter(
            "market_cap_band",
            "The market capitalisation lies in a band.",
            (number("minCapYi", 20, 0, 1e5, "Least capitalisation in 1e8 yuan."), number("maxCapYi", 0, 0, 1e6, "Most capitalisation in 1e8 yuan; 0 for no bound.")),
            lambda p: band(cap(), p["minCapYi"], p["maxCapYi"]),
            lambda p: {"marketCapYi": half_up(cap(), 1)},
            needs=frozenset({"market_cap"}),
        ),
        Filter(
            "amount_liquidity",
            "The median traded value is high enough.",
            (count("liquidityWindowBars", 20, 5, 250, "Bars of the median."), number("minMedianAmountYi", 0.3, 0, 1000, "Least median in 1e8 yuan.")),
            lambda p: liquid() >= p["minMedianAmountYi"],
            lambda p: {"medianAmountYi": half_up(liquid(), 3)},
            lambda p: {"liquid": F.median(F.when((C("r") < p["liquidityWindowBars"]) & finite(C("amount")) & (C("amount") >= 0), C("amount")))},
            needs=frozenset({"amount"}),
        ),
        Filter(
            "turnover_band",
            "The median turnover lies in a band.",
            (count("turnoverWindowBars", 20, 5, 250, "Bars of the median."), number("minTurnoverPct", 0.5, 0, 100, "Least median in percent of the float."), number("maxTurnoverPct", 0, 0, 100, "Most median in percent; 0 for no bound.")),
            lambda p: band(turnover(), p["minTurnoverPct"], p["maxTurnoverPct"]),
            lambda p: {"medianTurnoverPct": half_up(turnover(), 3)},
            lambda p: {"turned": F.median(F.when((C("r") < p["turnoverWindowBars"]) & (C("close") > 0) & (C("float_shares") > 0), C("volume") * LOT / C("float_shares")))},
            lambda p: {"float_shares": F.when(finite(C("float_cap")) & (C("float_cap") > 0) & (F.last("close").over(whole()) > 0), C("float_cap") / F.last("close").over(whole()))},
            frozenset({"market_cap", "float_cap"}),
        ),
    )
}


def need(filter_id: str) -> Filter:
    if filter_id not in FILTERS:
        raise ValueError(f"unknown filter {filter_id!r}; there are {', '.join(FILTERS)}")
    return FILTERS[filter_id]


def register(new: Filter) -> Filter:
    """Adds a filter, which predicates and strategies may then name. Its parameters' names are its own or mean the same."""
    if new.id in FILTERS:
        raise ValueError(f"there is a filter {new.id!r} already")
    merged([f.params for f in (*FILTERS.values(), new)])
    FILTERS[new.id] = new
    return new
