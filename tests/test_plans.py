"""Parameters, predicates, universe, tiers and merging."""

from __future__ import annotations

import pytest

from tests.bars import BARS, STOCKS, rows, stock
from tickloom.operators import bars as bar_ops
from tickloom.operators.universe import UniverseRules, skips, too_many_failures, universe
from tickloom.plans import predicate as pred
from tickloom.plans.params import Param, merged, resolved
from tickloom.plans.screen import Scan, diagnose, near_misses, screen, tiers
from tickloom.plans.strategies import STRATEGIES, custom, strategy

RULES = UniverseRules("20300101", exclude_special=False, exclude_bse=False)


def test_params():
    a, b = Param("x", 3, 1, 5, True), Param("x", 3.0, 1, 5)
    assert list(merged([[a], [a]])) == ["x"]
    with pytest.raises(ValueError, match="collision"):
        merged([[a], [Param("x", 4, 1, 5, True)]])
    docs = {"x": a, "flag": Param("flag", True)}
    assert resolved(docs, {"x": 2.0}) == {"x": 2, "flag": True}
    for bad in ({"y": 1}, {"x": 0}, {"x": 6}, {"x": 1.5}, {"x": "2"}, {"x": True}, {"x": float("nan")}, {"flag": 1}, [1]):
        with pytest.raises(ValueError):
            resolved(docs, bad)
    assert docs["flag"].parse("false") is False and b.parse("2.5") == 2.5
    with pytest.raises(ValueError):
        a.parse("two")


def test_predicates():
    node = pred.parse({"all": ["flat_base", {"any": ["deep_drawdown", {"not": "volume_dry_up"}]}]})
    assert str(node) == "flat_base AND deep_drawdown OR NOT(volume_dry_up)"
    assert node.filters() == ["flat_base", "deep_drawdown", "volume_dry_up"]
    for bad in ("nothing", {}, {"all": []}, {"all": "flat_base"}, {"all": ["flat_base"], "not": "flat_base"}, 3, None, ["flat_base"], {"not": {"not": {"not": {"not": "flat_base"}}}}, {"all": ["flat_base"] * 13}):
        with pytest.raises(ValueError):
            pred.parse(bad)
    pred.parse({"not": {"not": {"not": "flat_base"}}})
    pred.parse({"all": ["flat_base"] * 12})


def test_strategies_have_all_parameters():
    assert list(STRATEGIES) == ["low_flat_limit_up", "flat_base_low", "low_flat_breakout"]
    p = strategy("low_flat_limit_up").resolve({"minBars": 100})
    assert p["minBars"] == 100 and p["limitUpWindowBars"] == 120 and strategy("low_flat_limit_up").least(p) == 100
    with pytest.raises(ValueError, match="unknown strategy"):
        strategy("none")


def scan(spark, close: list[float]) -> Scan:
    return Scan(spark.createDataFrame(rows("600001", close, [1000.0] * len(close)), BARS), spark.createDataFrame([stock("600001")], STOCKS), RULES)


def test_evidence_of_what_was_evaluated(spark):
    over = scan(spark, [10.0] * 150 + [3.0] * 150)  # deep below its high, and flat
    either = custom(pred.either("deep_drawdown", "volume_dry_up"))
    hit = screen(over, either).collect()[0].evidence
    assert hit.drawdownFromHigh == 0.7 and hit.dryUpVolumeRatio is None and hit.close == 3.0 and hit.barsAnalyzed == 300
    whole = diagnose(over, either).collect()[0]
    assert whole.metrics.dryUpVolumeRatio == 1.0 and whole.gates == {"deep_drawdown": True, "volume_dry_up": False} and whole.failed_gates == []
    no = diagnose(over, custom(pred.negated("deep_drawdown"))).collect()[0]
    assert not no.matched and no.gates == {"deep_drawdown": True} and no.failed_gates == []
    yes = screen(over, custom(pred.negated("volume_dry_up"))).collect()[0]
    assert yes.evidence.dryUpVolumeRatio == 1.0
    nulls = screen(over, custom(pred.negated("market_cap_band"))).collect()  # no capitalisation: the gate is false, not null
    assert len(nulls) == 1 and nulls[0].evidence.marketCapYi is None
    both = diagnose(over, custom(pred.both("deep_drawdown", pred.either("volume_dry_up", "market_cap_band")))).collect()[0]
    assert both.failed_gates == ["volume_dry_up", "market_cap_band"]


def test_universe_and_skips(spark):
    known = spark.createDataFrame([stock("600001"), stock("600002", name="*ST x"), stock("600003", name="x退"), stock("830001", board="bse"), stock("600004", list_date="20290601"), stock("600005", list_date=""), stock("600006", list_date="20000101"), stock("600007", list_date="0")], STOCKS)
    rules = UniverseRules("20300101")
    assert {r.code for r in universe(known, rules).collect()} == {"600001", "600006", "600007"}
    got = {r.skip_reason: r.n for r in skips(known, UniverseRules("20300101", max_list_days=9000), ["600001"]).collect()}
    assert got == {"st-or-delisting": 2, "bse": 1, "recent-or-unknown-listing": 2, "too-old-listing": 2, "code-filtered": 0}
    at = spark.createDataFrame([stock("600001", list_date="20290101")], STOCKS)
    assert universe(at, rules).count() == 0 and universe(at, UniverseRules("20300102")).count() == 1
    assert not too_many_failures(10, 20) and too_many_failures(11, 20) and not too_many_failures(50, 500)


def test_tiers_and_order_of_near_misses(spark):
    series = {"600001": [10.0] * 300, "600002": [10.0] * 100 + [3.0] * 200, "600003": [10.0] * 100 + [2.0] * 200, "600004": [10.0] * 100 + [2.0] * 200}
    bars = [r for c, s in series.items() for r in rows(c, s, [1000.0] * 300)]
    over = Scan(spark.createDataFrame(bars, BARS), spark.createDataFrame([stock(c) for c in series], STOCKS), RULES)
    found = diagnose(over, custom(pred.both("deep_drawdown", "volume_dry_up")))
    assert {r.code: r.tier for r in tiers(found).collect()} == {"600001": "other", "600002": "near", "600003": "near", "600004": "near"}
    assert [r.code for r in near_misses(found, 2).collect()] == ["600003", "600004"]
    assert near_misses(found, 0).count() == 1


def test_merge_and_refresh(spark):
    kind = "code string, date string, close double"
    old = spark.createDataFrame([("a", "01", 1.0), ("a", "02", 2.0), ("b", "02", 1.0), ("c", "02", 1.0), ("d", "05", 1.0)], kind)
    new = spark.createDataFrame([("a", "02", 2.001), ("a", "03", 3.0), ("b", "02", 1.1), ("c", "03", 1.0), ("d", "04", 1.0), ("e", "01", 1.0)], kind)
    plan = {r.code: r.action for r in bar_ops.refresh_plan(old, new).collect()}
    assert plan == {"a": "merge", "b": "reload", "c": "merge", "d": "reload", "e": "load"}
    stored, again = bar_ops.refreshed(old, new)
    assert {(r.code, r.date): r.close for r in stored.collect()} == {("a", "01"): 1.0, ("a", "02"): 2.001, ("a", "03"): 3.0, ("b", "02"): 1.0, ("c", "02"): 1.0, ("c", "03"): 1.0, ("d", "05"): 1.0, ("e", "01"): 1.0}
    assert {r.code for r in again.collect()} == {"b", "d"}


def test_acquisition(spark):
    codes = spark.createDataFrame([(c,) for c in "abcdef"], "code string")
    files = spark.createDataFrame([("b", "20300101", "20290101", "20300101"), ("c", "20291230", "20280101", "20291201"), ("d", "20291230", "20280101", None), ("e", "20300102", "20280101", "20291201"), ("f", "20291230", "20280101", "20300102")], "code string, fetched_at string, start_date string, tail string")
    got = {r.code: r.action for r in bar_ops.acquisition(codes, files, "20280601", "20300102", "20300102").collect()}
    assert got == {"a": "load", "b": "backfill", "c": "refresh", "d": "retry", "e": "hit", "f": "hit"}
