"""Single filters on short series: pass, fail, boundaries and missing evidence."""

from __future__ import annotations

import math
import statistics

import pytest

from tests.bars import BARS, STOCKS, by_returns, rows, stock
from tickloom.operators.filters import FILTERS
from tickloom.plans.params import merged, resolved
from tickloom.plans.screen import measured


@pytest.fixture
def apply(spark):
    def run(filter_id: str, series: dict[str, list[tuple]], given: dict | None = None, stocks: dict[str, dict] | None = None) -> dict[str, dict]:
        params = resolved(merged([FILTERS[filter_id].params]), given)
        bars = spark.createDataFrame([r for s in series.values() for r in s], BARS)
        known = spark.createDataFrame([stock(c, **(stocks or {}).get(c, {})) for c in series], STOCKS)
        keys = list(FILTERS[filter_id].evidence(params))
        out = {}
        for r in measured(bars, known, known, [filter_id], params).collect():
            out[r.code] = {"passed": r[f"gate_{filter_id}"]} | {k: r[f"ev_{filter_id}_{k}"] for k in keys}
        return out

    return run


def flat(n: int, value: float = 0.0) -> list[float]:
    return [value] * n


def test_platform_breakout(apply):
    def ret(n: int, **at: float) -> list[float]:
        r = flat(n)
        for k, v in at.items():
            r[int(k[1:])] = v
        return r

    def vol(n: int, **at: float) -> list[float]:
        return [at.get(f"v{i}", 1000.0) for i in range(n)]

    series = {
        "600001": by_returns("600001", ret(40, r37=0.06), vol(40, v37=3000)),
        "600002": by_returns("600002", ret(40, r37=0.06, r39=-0.06), vol(40, v37=3000)),
        "600003": by_returns("600003", ret(45, r35=0.06, r42=0.06), vol(45, v35=3000, v42=3000)),
        "600004": by_returns("600004", ret(40, r37=0.06), vol(40, v32=0, v33=0, v34=0, v35=0, v36=0, v37=3000)),
        "600005": by_returns("600005", ret(12, r9=0.06), vol(12, v9=3000)),
    }
    got = apply("platform_breakout", series)
    assert got["600001"]["passed"] and got["600001"]["breakoutSurge"] == 3 and got["600001"]["barsSinceBreakout"] == 2
    assert got["600001"]["breakoutDate"] == series["600001"][37][1]
    assert got["600002"] == {"passed": False, "breakoutDate": None, "breakoutSurge": None, "barsSinceBreakout": None, "baseToClosePct": None}
    assert got["600003"]["breakoutDate"] == series["600003"][42][1]
    assert not got["600004"]["passed"] and not got["600005"]["passed"]
    assert apply("platform_breakout", {"600002": series["600002"]}, {"maxBaseGiveback": 0.03})["600002"]["passed"]


def test_cooldown_takes_an_older_day_that_has_come_back(apply):
    n = 40
    ret, vol = flat(n), [1000.0] * n
    ret[20], ret[21], ret[27] = 0.1, -0.05, 0.1
    vol[20] = vol[27] = 3500.0
    vol[35:] = [100.0] * 5
    got = apply("cooldown_pullback", {"600001": by_returns("600001", ret, vol)})["600001"]
    assert got["passed"] and got["daysSinceLimitUp"] == 19
    late = flat(n)
    late[31], late[32] = 0.1, -0.05
    v = [1000.0] * n
    v[31] = 5000.0
    assert not apply("cooldown_pullback", {"600001": by_returns("600001", late, v)}, {"cooldownBars": 8})["600001"]["passed"]


def test_bars_since_low_takes_the_first_of_equal_minima(apply):
    close = [16.0] * 261
    close[100] = close[200] = 8.0
    series = {"600001": rows("600001", close, [1.0] * 261), "600002": rows("600002", [10.0] * 10 + [5.0] + [6.0] * 109, [1.0] * 120)}
    got = apply("bars_since_low", series, {"maxPctAboveLow": 5})
    assert got["600001"]["barsSinceLow"] == 160 and got["600001"]["pctAboveLow"] == 1
    assert got["600002"]["barsSinceLow"] == 109 and got["600002"]["passed"]


def test_ma_stabilization(apply):
    series = {"600001": rows("600001", [5.0] * 60, [1.0] * 60), "600002": rows("600002", [5.0] * 24, [1.0] * 24), "600003": rows("600003", [5.0] * 25, [1.0] * 25)}
    got = apply("ma_stabilization", series)
    assert got["600001"] == {"passed": True, "maSlope": 0, "closeVsMaPct": 0}
    assert got["600002"] == {"passed": False, "maSlope": None, "closeVsMaPct": None}
    assert got["600003"]["passed"]
    assert not apply("ma_stabilization", {"600001": series["600001"]}, {"minMaSlope": 0.001})["600001"]["passed"]


def test_volatility_regime(apply):
    def swing(x: float) -> list[float]:
        return [x if i % 2 else -x for i in range(60)]

    series = {c: by_returns(c, r, [1.0] * len(r)) for c, r in {"600001": swing(0.01), "600002": swing(0.0005), "600003": swing(0.06), "600004": [0.01, -0.01]}.items()}
    series["600005"] = rows("600005", [5.0, 5.5], [1.0] * 2)
    got = apply("volatility_regime", series)
    assert [got[c]["passed"] for c in series] == [True, False, False, True, False]
    assert got["600001"]["annualVol"] == pytest.approx(statistics.stdev(swing(0.01)) * math.sqrt(252), abs=1e-4)
    assert got["600005"]["annualVol"] is None and got["600004"]["annualVol"] is not None


def test_volume_dry_up(apply):
    def series(v: list[float]) -> list[tuple]:
        return rows("600001", [5.0] * len(v), v)

    assert apply("volume_dry_up", {"600001": series([1000.0] * 120 + [100.0] * 5)})["600001"] == {"passed": True, "dryUpVolumeRatio": 0.1}
    for v in ([1000.0] * 3, [0.0] * 120 + [100.0] * 5):
        assert apply("volume_dry_up", {"600001": series(v)})["600001"] == {"passed": False, "dryUpVolumeRatio": None}


def test_turnover_amount_and_capitalisation(apply):
    b = rows("600001", [10.0] * 3, [1000.0, 2000.0, 3000.0])
    assert apply("turnover_band", {"600001": b}, stocks={"600001": {"float_cap": 1e9}})["600001"]["medianTurnoverPct"] == 0.2
    assert apply("turnover_band", {"600001": b})["600001"] == {"passed": False, "medianTurnoverPct": None}
    assert apply("turnover_band", {"600001": b}, {"minTurnoverPct": 0.1, "maxTurnoverPct": 0.1}, {"600001": {"float_cap": 1e9}})["600001"]["passed"] is False
    money = rows("600001", [10.0] * 4, [1.0] * 4, [0.4e8, 0.5e8, 0.7e8, 0.9e8])
    assert apply("amount_liquidity", {"600001": money})["600001"] == {"passed": True, "medianAmountYi": 0.6}
    bad = rows("600001", [10.0] * 4, [1.0] * 4, [None, float("nan"), float("inf"), -1.0])
    assert apply("amount_liquidity", {"600001": bad})["600001"] == {"passed": False, "medianAmountYi": None}
    caps = {"600001": {"total_cap": 8.5e9}, "600002": {"total_cap": 1.5e9}, "600003": {"total_cap": -1.0}, "600004": {"total_cap": 2e9}}
    got = apply("market_cap_band", {c: rows(c, [1.0], [1.0]) for c in caps}, stocks=caps)
    assert [got[c]["passed"] for c in caps] == [True, False, False, True] and got["600001"]["marketCapYi"] == 85 and got["600003"]["marketCapYi"] is None


def test_deep_falls_keep_the_index_positive(apply, spark):
    from tickloom.operators.series import chained, returns

    b = [("600001", "20200101", 1.0, 1.0, None, None), ("600001", "20200102", -0.5, 1.0, None, 1.0), ("600001", "20200103", 1.0, 1.0, None, 0.0)]
    idx = [r.idx for r in chained(returns(spark.createDataFrame(b, BARS))).orderBy("date").collect()]
    assert idx[0] == 1 and all(x > 0 for x in idx)


def test_first_return_counts_for_limit_up_but_not_for_the_index(spark):
    from tickloom.operators.series import chained, returns

    b = by_returns("600001", [0.5, 0.1], [1.0, 1.0])
    got = chained(returns(spark.createDataFrame(b, BARS))).orderBy("date").collect()
    assert got[0].ret == pytest.approx(0.5) and got[0].idx == 1 and got[1].idx == pytest.approx(1.1)


def test_flat_base_has_half_evidence_between_window_and_sixty_bars(apply):
    series = {c: rows(c, [5.0] * n, [1.0] * n) for c, n in {"600001": 30, "600002": 59, "600003": 60}.items()}
    got = apply("flat_base", series)
    assert got["600001"] == {"passed": False, "flatNetChange": None, "flatMaSpread": None}
    assert got["600002"] == {"passed": False, "flatNetChange": 0, "flatMaSpread": None}
    assert got["600003"] == {"passed": True, "flatNetChange": 0, "flatMaSpread": 0}


def test_industry_filters(apply, spark):
    from tickloom.plans.screen import measured

    deep, shallow = [10.0] + [3.0] * 99, [10.0] * 100
    codes = {"600001": deep, "600002": deep, "600003": deep, "600004": shallow, "600005": deep}
    stocks = spark.createDataFrame([stock(c, industry=None if c == "600005" else "steel") for c in codes] + [stock("600006", industry="steel")], STOCKS)
    bars = spark.createDataFrame([r for c, s in codes.items() for r in rows(c, s, [1.0] * 100)], BARS)
    params = resolved(merged([FILTERS[f].params for f in ("industry_clearance", "industry_position")]), {"minIndustryMembers": 3, "maxIndustryMedPos": 1.0})
    got = {r.code: r for r in measured(bars, stocks, stocks, ["industry_clearance", "industry_position"], params).collect()}
    assert "600006" not in got  # without bars it is no candidate, but a member with drawdown 0
    assert got["600004"].gate_industry_clearance and got["600001"].ev_industry_clearance_industryMembers == 5
    assert got["600001"].ev_industry_clearance_industryDeepShare == 0.6
    assert not got["600005"].gate_industry_clearance and got["600005"].ev_industry_position_industryMedPos is None
