"""Strategies: a predicate with its parameters and the least history that it needs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from tickloom.operators.filters import FILTERS
from tickloom.plans.params import Param, merged, resolved
from tickloom.plans.predicate import Node, both

MIN_BARS = Param("minBars", 240, 60, 3000, True, "Bars that a security needs to be evaluated at all.")


@dataclass(frozen=True)
class Strategy:
    id: str
    about: str
    predicate: Node
    least: Callable[[Mapping[str, Any]], int]

    @property
    def params(self) -> dict[str, Param]:
        return merged([*(FILTERS[f].params for f in self.predicate.filters()), (MIN_BARS,)])

    @property
    def needs(self) -> frozenset[str]:
        return frozenset().union(*(FILTERS[f].needs for f in self.predicate.filters()))

    def resolve(self, given: Mapping[str, Any] | None = None) -> dict[str, Any]:
        return resolved(self.params, given)


def least_flat(p: Mapping[str, Any]) -> int:
    return max(60, p["minBars"], p["flatWindowBars"] + 1)


def least_breakout(p: Mapping[str, Any]) -> int:
    return max(60, p["minBars"], p["baseWindowBars"] + p["breakoutWindowBars"] + 6, p["maStabWindow"] + p["maSlopeBars"])


STRATEGIES: dict[str, Strategy] = {
    s.id: s
    for s in (
        Strategy("low_flat_limit_up", "Deep below its high, low and flat, after a limit-up day on volume that has cooled down.", both("deep_drawdown", "low_percentile", "flat_base", "volume_limit_up", "cooldown_pullback"), least_flat),
        Strategy("flat_base_low", "Low among its past values, and flat.", both("low_percentile", "flat_base"), least_flat),
        Strategy("low_flat_breakout", "Deep below its high, some time after the low, out of a flat base on volume.", both("deep_drawdown", "bars_since_low", "platform_breakout", "ma_stabilization"), least_breakout),
    )
}


def register(strategy: Strategy) -> Strategy:
    if strategy.id in STRATEGIES:
        raise ValueError(f"there is a strategy {strategy.id!r} already")
    STRATEGIES[strategy.id] = strategy
    return strategy


def custom(predicate: Node) -> Strategy:
    """A strategy of a caller's own predicate."""
    return Strategy("custom", f"Own predicate: {predicate}", predicate, lambda p: max(60, p["minBars"]))


def strategy(strategy_id: str) -> Strategy:
    if strategy_id not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy_id!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy_id]
