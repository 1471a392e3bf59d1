"""The shipped strategies on 800-bar series and one change for each gate."""

from __future__ import annotations

import pytest

from tests.bars import BARS, STOCKS, breakout_series, flat_series, limit_up_series, rows, stock
from tickloom.operators.universe import UniverseRules
from tickloom.plans.screen import Scan, diagnose, screen
from tickloom.plans.strategies import strategy

RULES = UniverseRules("20300101", exclude_special=False, exclude_bse=False)


def run(spark, strategy_id: str, cases: dict[str, tuple], given: dict | None = None):
    """cases: name -> (close, volume, stock's columns). Gives hits and diagnoses by name."""
    names = {f"60{i:04d}": n for i, n in enumerate(cases)}
    bars, stocks = [], []
    for c, n in names.items():
        close, volume, other = cases[n]
        bars += rows(c, close, volume)
        stocks.append(stock(c, **other))
    over = Scan(spark.createDataFrame(bars, BARS), spark.createDataFrame(stocks, STOCKS), RULES)
    s = strategy(strategy_id)
    hits = {names[r.code]: r.evidence.asDict() for r in screen(over, s, given).collect()}
    found = {names[r.code]: r for r in diagnose(over, s, given).collect()}
    assert set(hits) == {n for n, r in found.items() if r.matched}
    return hits, found


def changed(series: tuple[list, list], close: dict | None = None, volume: dict | None = None, cut: int | None = None, **stock_columns) -> tuple:
    c, v = list(series[0]), list(series[1])
    for i, x in (close or {}).items():
        c[i] = x
    for i, x in (volume or {}).items():
        v[i] = x
    return (c[:cut], v[:cut], stock_columns)


def test_low_flat_limit_up(spark):
    base = limit_up_series()
    c = base[0]
    drift = {769 + k: c[769] * 1.006**k for k in range(1, 31)}
    st_close = list(c)
    st_close[740] = c[739] * 1.05
    cases = {
        "hit": changed(base),
        "high": changed(base, {i: c[i] * 1.8 for i in range(700, 800)}),
        "drifting": changed(base, drift),
        "thin": changed(base, volume={740: 1200.0}),
        "busy": changed(base, volume={i: 2000.0 for i in range(795, 800)}),
        "held": changed(base, {i: 3.08 for i in range(741, 800)}),
        "chinext": changed(base, board="chinext"),
        "short": changed(base, cut=100),
        "special": (st_close, base[1], {"name": "ST恒久"}),
        "plain": (st_close, base[1], {}),
        "special chinext": (st_close, base[1], {"name": "ST恒久", "board": "chinext"}),
    }
    hits, found = run(spark, "low_flat_limit_up", cases)
    assert set(hits) == {"hit", "special"}
    assert "short" not in found
    e = hits["hit"]
    assert e["daysSinceLimitUp"] == 59 and e["drawdownFromHigh"] > 0.65 and e["percentileInWindow"] < 0.15
    assert e["limitUpVolumeSurge"] >= 2 and e["cooldownVolumeRatio"] <= 0.4 and e["barsAnalyzed"] == 800
    assert run(spark, "low_flat_limit_up", {"hit": changed(base)}, {"limitUpWindowBars": 20})[0] == {}


def test_flat_base_low(spark):
    base = flat_series()
    c = base[0]
    tail = (c[-240:], base[1][-240:], {})
    cases = {
        "hit": changed(base),
        "least": tail,
        "short": (tail[0][1:], tail[1][1:], {}),
        "high": changed(base, {i: c[i] * 1.8 for i in range(700, 800)}),
        "falling": changed(base, {i: c[i] * 0.995 ** (i - 769) for i in range(770, 800)}),
    }
    hits, found = run(spark, "flat_base_low", cases)
    assert hits["hit"]["barsAnalyzed"] == 800 and "short" not in found and found["least"].metrics.barsAnalyzed == 240
    assert "low_percentile" in found["high"].failed_gates and "flat_base" not in found["high"].failed_gates
    assert found["falling"].failed_gates == ["flat_base"]


def test_low_flat_breakout(spark):
    base, shallow = breakout_series(), breakout_series(0.6)
    decline = [10 - 7.2 * i / 799 for i in range(800)]
    cases = {
        "hit": changed(base),
        "shallow": changed(shallow),
        "decline": (decline, [1000.0] * 800, {}),
        "fallen back": changed(base, {799: base[0][799] * 0.92}),
    }
    hits, found = run(spark, "low_flat_breakout", cases)
    assert set(hits) == {"hit"}
    e = hits["hit"]
    assert e["breakoutSurge"] == 3 and e["barsSinceBreakout"] == 10 and e["barsSinceLow"] >= 40 and e["maSlope"] >= 0
    assert found["shallow"].failed_gates == ["deep_drawdown"]
    assert {"platform_breakout", "ma_stabilization"} <= set(found["decline"].failed_gates)
    assert "deep_drawdown" not in found["decline"].failed_gates
    assert "platform_breakout" in found["fallen back"].failed_gates
    for given in ({"maxPctAboveLow": 0.03}, {"minBarsSinceLow": 200}):
        assert run(spark, "low_flat_breakout", {"hit": changed(base)}, given)[1]["hit"].failed_gates == ["bars_since_low"]


@pytest.mark.parametrize("strategy_id", ["low_flat_limit_up", "flat_base_low", "low_flat_breakout"])
def test_no_bars_no_rows(spark, strategy_id):
    over = Scan(spark.createDataFrame([], BARS), spark.createDataFrame([stock("600001")], STOCKS), RULES)
    assert screen(over, strategy(strategy_id)).collect() == [] and diagnose(over, strategy(strategy_id)).collect() == []
