"""The engine's queries over the sample tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import source_queries
from tickloom.functions.market import limit_of
from tickloom.operators import bars as bar_ops
from tickloom.operators import industry, series
from tickloom.operators import universe as uni
from tickloom.operators.filters import FILTERS
from tickloom.plans import predicate as pred
from tickloom.plans import screen as scr
from tickloom.plans import strategies
from tickloom.plans.params import merged, resolved
from tickloom.sources import sample

RULES = uni.UniverseRules(sample.AS_OF)
CODES = ("600000", "600004", "600008", "300001", "680002", "999999")
#: The sample has no breakouts at the defaults.
BREAKOUT = {"breakoutWindowBars": 60, "maxBaseRangeChange": 0.5}
#: Screens that find something in the sample.
LOOSE_LIMIT_UP = {"minDrawdownFromHigh": 0.2, "maxPercentile": 0.9, "maxFlatRangeChange": 0.5, "maxFlatMaSpread": 0.3, "limitUpWindowBars": 500, "minVolumeSurge": 1.1, "maxCooldownVolumeRatio": 1.5}
LOOSE_BREAKOUT = BREAKOUT | {"minDrawdownFromHigh": 0.1, "minBarsSinceLow": 1, "maxPctAboveLow": 5, "minBreakoutSurge": 1.1, "minBreakoutMargin": 0.0, "maxBaseGiveback": 0.1, "minMaSlope": -0.05, "requireCloseAboveMa": False}
#: Parameters of the filter queries where the defaults would pass nothing or everything.
GIVEN: dict[str, dict] = {"platform_breakout": BREAKOUT, "amount_liquidity": {"minMedianAmountYi": 1.5}, "industry_clearance": {"minIndustryMembers": 3, "minIndustryMedDrawdown": 0.3}, "industry_position": {"minIndustryMembers": 3, "maxIndustryMedPos": 0.5}}
OWN = pred.parse({"any": [{"all": ["deep_drawdown", "volatility_regime"]}, {"not": "volume_limit_up"}, "volume_dry_up"]})


def scan(spark: SparkSession, sf_dir: str, codes: tuple[str, ...] | None = None) -> scr.Scan:
    return scr.Scan(sample.bars(spark, sf_dir), sample.stocks(spark, sf_dir), RULES, codes)


def q_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.bars(spark, sf_dir).select("code", "date", "close", "pre_close", "volume", "amount")


def q_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.returns(sample.bars(spark, sf_dir)).select("code", "date", F.col("i").cast("long").alias("i"), "n", "ret")


def q_chained_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.chained(series.returns(sample.bars(spark, sf_dir))).select("code", "date", "idx")


def q_limit_up_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = sample.stocks(spark, sf_dir).select("code", limit_of(F.col("board"), F.col("name")).alias("limit"))
    rows = series.surge(series.returns(sample.bars(spark, sf_dir).join(stocks, "code")))
    return series.limit_up_days(rows).select("code", "date", "ret", "surge")


def q_filter(filter_id: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f, over = FILTERS[filter_id], scan(spark, sf_dir)
        params = resolved(merged([f.params]), GIVEN.get(filter_id))
        members = over.members()
        rows = scr.measured(over.bars, members, uni.whitelisted(members, over.codes), [filter_id], params)
        return rows.select("code", F.col(f"gate_{filter_id}").alias("passed"), *(F.col(f"ev_{filter_id}_{k}").alias(k) for k in f.evidence(params)))

    return run


def q_universe_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = uni.UniverseRules(sample.AS_OF, max_list_days=3650)
    return uni.skips(sample.stocks(spark, sf_dir), rules, CODES)


def q_code_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, CODES).candidates().select("code", "full_code", "name", "board", "list_date")


def q_industry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = scan(spark, sf_dir)
    cycles = scr.aggregated(over.bars, over.members(), (), {}, cycle=True)
    return industry.industry_stats(over.members().select("code", "industry").join(cycles, "code", "left"))


def flat(hits: DataFrame) -> DataFrame:
    return hits.select("code", "full_code", "name", "board", "strategy", "evidence.*")


def q_strategy(strategy_id: str, given: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat(scr.screen(scan(spark, sf_dir), strategies.strategy(strategy_id), given))


def q_dsl_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(scr.screen(scan(spark, sf_dir), strategies.custom(OWN)))


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scr.diagnose(scan(spark, sf_dir), strategies.strategy("low_flat_limit_up"))


def q_diagnose_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = strategies.strategy("low_flat_limit_up").predicate.filters()
    return diagnosis(spark, sf_dir).select("code", "matched", *(F.col("gates")[g].alias(g) for g in gates), F.array_join("failed_gates", ",").alias("failed_gates"), F.col("metrics.barsAnalyzed").alias("bars_analyzed"))


def q_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scr.tiers(diagnosis(spark, sf_dir)).select("code", "tier", "last_date")


def q_near_miss_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scr.near_misses(scr.diagnose(scan(spark, sf_dir), strategies.strategy("low_flat_breakout"), BREAKOUT), 10)
    return found.select("code", F.array_join("failed_gates", ",").alias("failed_gates"), F.col("metrics.drawdownFromHigh").alias("drawdown"))


def q_bars_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_bars = sample.bars(spark, sf_dir)
    fresh = all_bars.where("date >= '20000101'").withColumn("close", F.col("close") * 2)
    return bar_ops.merge(all_bars.where("date < '20010101'"), fresh).select("code", "date", "close")


def q_refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_bars = sample.bars(spark, sf_dir)
    moved = F.col("close") * F.when(F.substring("code", -1, 1) == "3", 1.01).otherwise(1.0)
    plan = bar_ops.refresh_plan(all_bars.where("date < '20010101'"), all_bars.where("date >= '20001201'").withColumn("close", moved))
    return plan.select("code", "action", "overlap")


SERIES = """
num AS MATERIALIZED (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY code) AS n, lag(close) OVER w AS prev
  FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)
), ret AS MATERIALIZED (
  SELECT *, n - 1 - i AS r, CASE WHEN pre_close > 0 THEN close / pre_close - 1 WHEN prev > 0 THEN close / prev - 1 END AS ret FROM num
), x AS (
  SELECT code, i, 1.0::DOUBLE AS idx FROM ret WHERE i = 0
  UNION ALL
  SELECT ret.code, ret.i, x.idx * greatest(1e-9::DOUBLE, 1 + coalesce(ret.ret, 0)) FROM x JOIN ret ON ret.code = x.code AND ret.i = x.i + 1
), members AS (
  SELECT * FROM stocks WHERE NOT (contains(name, 'ST') OR contains(name, '退')) AND board <> 'bse' AND list_date <> '' AND list_date < '20001231'
), s AS MATERIALIZED (
  SELECT ret.*, x.idx, m.float_cap, m.total_cap,
         CASE WHEN avg(volume) OVER b > 0 THEN volume / avg(volume) OVER b ELSE 0 END AS surge,
         last_value(idx) OVER f AS cur, last_value(close) OVER f AS cur_close, max(idx) OVER f AS top,
         CASE WHEN m.board = 'main' AND contains(m.name, 'ST') THEN 0.048 WHEN m.board = 'main' THEN 0.098 WHEN m.board = 'bse' THEN 0.298 ELSE 0.198 END AS lim
  FROM ret JOIN x ON x.code = ret.code AND x.i = ret.i JOIN members m ON m.code = ret.code
  WINDOW b AS (PARTITION BY ret.code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
         f AS (PARTITION BY ret.code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), cycles AS (
  SELECT m.code, m.industry, coalesce(1 - any_value(cur) / max(idx), 0) AS d,
         coalesce(count(*) FILTER (WHERE r < 730 AND idx <= cur) / nullif(count(*) FILTER (WHERE r < 730), 0), 1) AS p
  FROM members m LEFT JOIN s ON s.code = m.code GROUP BY ALL
), stats AS (
  SELECT industry, count(*) AS members, median(d) AS med_drawdown, median(p) AS med_pos, avg(CASE WHEN d >= 0.6 THEN 1.0 ELSE 0.0 END) AS deep_share
  FROM cycles WHERE industry IS NOT NULL GROUP BY industry
)
"""


def r(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def filter_sql(given: dict[str, dict]) -> dict[str, str]:
    """For each filter a query that gives code, passed and its evidence."""

    def p(f: str) -> dict:
        return resolved(merged([FILTERS[f].params]), given.get(f))

    ma = p("ma_stabilization")
    a, b = ma["maStabWindow"], ma["maSlopeBars"]
    bo, bl, fb, dry, cool, lu = (p(f) for f in ("platform_breakout", "bars_since_low", "flat_base", "volume_dry_up", "cooldown_pullback", "volume_limit_up"))
    vol, lp, dd, cap, amount, turn = (p(f) for f in ("volatility_regime", "low_percentile", "deep_drawdown", "market_cap_band", "amount_liquidity", "turnover_band"))
    clear, place = p("industry_clearance"), p("industry_position")
    base = bo["baseWindowBars"]
    sma = lambda k: f"CASE WHEN max(n) >= {k} THEN avg(idx) FILTER (WHERE r < {k}) END"
    after = max(cool["minBarsAfterLimitUp"], cool["cooldownBars"] + 1)
    return {
        "deep_drawdown": f"SELECT code, 1 - cur / max(idx) >= {dd['minDrawdownFromHigh']} AS passed, {r('1 - cur / max(idx)', 4)} AS drawdownFromHigh FROM s GROUP BY code, cur",
        "low_percentile": f"SELECT code, q <= {lp['maxPercentile']} AS passed, {r('q', 4)} AS percentileInWindow FROM (SELECT code, count(*) FILTER (WHERE idx <= cur) / count(*) AS q FROM s WHERE r < {lp['percentileWindowBars']} GROUP BY code)",
        "bars_since_low": f"SELECT code, r >= {bl['minBarsSinceLow']} AND cur / idx - 1 <= {bl['maxPctAboveLow']} AS passed, CAST(r AS DOUBLE) AS barsSinceLow, {r('cur / idx - 1', 4)} AS pctAboveLow FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY idx, i) AS k FROM s WHERE r < {bl['lowLookbackBars']}) WHERE k = 1",
        "flat_base": f"""SELECT code, coalesce(net <= {fb['maxFlatRangeChange']} AND spread <= {fb['maxFlatMaSpread']}, false) AS passed, {r('net', 4)} AS flatNetChange, {r('spread', 4)} AS flatMaSpread
          FROM (SELECT code, net, CASE WHEN d IS NOT NULL AND net IS NOT NULL THEN (greatest(a, b, c, d) - least(a, b, c, d)) / least(a, b, c, d) END AS spread
          FROM (SELECT code, abs(any_value(cur) / max(idx) FILTER (WHERE r = {fb['flatWindowBars']}) - 1) AS net, {sma(5)} AS a, {sma(10)} AS b, {sma(20)} AS c, {sma(60)} AS d FROM s GROUP BY code))""",
        "platform_breakout": f"""SELECT m.code, k IS NOT NULL AS passed, date AS breakoutDate, {r('surge', 2)} AS breakoutSurge, CAST(r AS DOUBLE) AS barsSinceBreakout, {r('cur / base_max - 1', 4)} AS baseToClosePct
          FROM (SELECT DISTINCT code FROM s) m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY code ORDER BY i DESC) AS k FROM (
            SELECT *, lag(idx) OVER w AS one, lag(idx, {base}) OVER w AS first, max(idx) OVER (w ROWS BETWEEN {base} PRECEDING AND 1 PRECEDING) AS base_max, min(idx) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low
            FROM s WINDOW w AS (PARTITION BY code ORDER BY date))
          WHERE i >= {max(5, base)} AND r BETWEEN {bo['minBarsAfterBreakout']} AND {bo['breakoutWindowBars']} AND abs(one / first - 1) <= {bo['maxBaseRangeChange']}
            AND idx >= base_max * (1 + {bo['minBreakoutMargin']}::DOUBLE) AND surge >= {bo['minBreakoutSurge']} AND low >= base_max * (1 - {bo['maxBaseGiveback']}::DOUBLE)) q ON q.code = m.code AND k = 1""",
        "ma_stabilization": f"""SELECT code, coalesce(now / past - 1 >= {ma['minMaSlope']} AND (cur >= now OR NOT {ma['requireCloseAboveMa']}), false) AS passed, {r('now / past - 1', 4)} AS maSlope, {r('cur / now - 1', 4)} AS closeVsMaPct
          FROM (SELECT code, any_value(cur) AS cur, CASE WHEN max(n) >= {a + b} THEN avg(idx) FILTER (WHERE r < {a}) END AS now, CASE WHEN max(n) >= {a + b} THEN avg(idx) FILTER (WHERE r >= {b} AND r < {a + b}) END AS past FROM s GROUP BY code)""",
        "volatility_regime": f"SELECT code, coalesce(v BETWEEN {vol['minAnnualVol']} AND {vol['maxAnnualVol']}, false) AS passed, {r('v', 4)} AS annualVol FROM (SELECT code, stddev_samp(ret) FILTER (WHERE r < {vol['volWindow']}) * sqrt(252) AS v FROM s GROUP BY code)",
        "volume_limit_up": f"""SELECT m.code, k IS NOT NULL AS passed, date AS limitUpDate, {r('ret', 4)} AS limitUpPct, {r('surge', 2)} AS limitUpVolumeSurge
          FROM (SELECT DISTINCT code FROM s) m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY code ORDER BY i DESC) AS k FROM s WHERE ret >= lim AND surge >= {lu['minVolumeSurge']} AND i >= 5 AND r BETWEEN {lu['minBarsAfterLimitUp']} AND {lu['limitUpWindowBars']}) q ON q.code = m.code AND k = 1""",
        "cooldown_pullback": f"""SELECT m.code, k IS NOT NULL AS passed, date AS cooldownRefDate, {r('cv / volume', 4)} AS cooldownVolumeRatio, CAST(r AS DOUBLE) AS daysSinceLimitUp
          FROM (SELECT DISTINCT code FROM s) m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY code ORDER BY i DESC) AS k FROM (
            SELECT *, min(idx) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low, avg(volume) FILTER (WHERE r < {cool['cooldownBars']}) OVER (PARTITION BY code) AS cv FROM s)
          WHERE ret >= lim AND surge >= {cool['minVolumeSurge']} AND i >= 5 AND r BETWEEN {after} AND {cool['limitUpWindowBars']} AND low < idx AND cv <= {cool['maxCooldownVolumeRatio']} * volume) q ON q.code = m.code AND k = 1""",
        "volume_dry_up": f"""SELECT code, coalesce(q <= {dry['maxDryUpRatio']}, false) AS passed, {r('q', 4)} AS dryUpVolumeRatio
          FROM (SELECT code, avg(volume) FILTER (WHERE r < {dry['dryUpBars']}) / nullif(avg(volume) FILTER (WHERE r >= {dry['dryUpBars']} AND r < {dry['dryUpBars'] + dry['referenceWindowBars']}), 0) AS q FROM s GROUP BY code)""",
        "industry_clearance": f"""SELECT m.code, coalesce(med_drawdown >= {clear['minIndustryMedDrawdown']} AND deep_share >= {clear['minIndustryDeepShare']} AND members >= {clear['minIndustryMembers']}, false) AS passed, m.industry,
          {r('med_drawdown', 4)} AS industryMedDrawdown, {r('deep_share', 4)} AS industryDeepShare, CAST(members AS DOUBLE) AS industryMembers FROM (SELECT * FROM members WHERE code IN (SELECT code FROM s)) m LEFT JOIN stats ON stats.industry = m.industry""",
        "industry_position": f"""SELECT m.code, coalesce(med_pos <= {place['maxIndustryMedPos']} AND members >= {place['minIndustryMembers']}, false) AS passed, m.industry, {r('med_pos', 4)} AS industryMedPos, CAST(members AS DOUBLE) AS industryMembers
          FROM (SELECT * FROM members WHERE code IN (SELECT code FROM s)) m LEFT JOIN stats ON stats.industry = m.industry""",
        "market_cap_band": f"SELECT code, total_cap / 1e8 >= {cap['minCapYi']} AS passed, {r('total_cap / 1e8', 1)} AS marketCapYi FROM (SELECT DISTINCT code, total_cap FROM s)",
        "amount_liquidity": f"SELECT code, q >= {amount['minMedianAmountYi']} AS passed, {r('q', 3)} AS medianAmountYi FROM (SELECT code, median(amount) / 1e8 AS q FROM s WHERE r < {amount['liquidityWindowBars']} GROUP BY code)",
        "turnover_band": f"SELECT code, q >= {turn['minTurnoverPct']} AS passed, {r('q', 3)} AS medianTurnoverPct FROM (SELECT code, median(volume * 100 / (float_cap / cur_close)) * 100 AS q FROM s WHERE r < {turn['turnoverWindowBars']} GROUP BY code)",
    }


def oracle_sql() -> dict[str, str]:
    head = f"WITH RECURSIVE {sample.SQL}"
    full = f"{head}, {SERIES}"
    plain, wide = filter_sql(GIVEN), filter_sql({"platform_breakout": BREAKOUT})
    listed = ", ".join(f"'{c}'" for c in CODES)
    reason = "CASE WHEN contains(name, 'ST') OR contains(name, '退') THEN 'st-or-delisting' WHEN board = 'bse' THEN 'bse' WHEN list_date = '' OR list_date >= '20001231' THEN 'recent-or-unknown-listing' WHEN list_date < '19920102' THEN 'too-old-listing' END"
    ends = "ends AS (SELECT m.code, m.full_code, m.name, m.board, s.close, s.n AS barsAnalyzed, s.date AS last_date FROM members m JOIN s ON s.code = m.code AND s.r = 0)"

    def joined(ids: list[str], sql: dict[str, str]) -> str:
        parts = ", ".join(f"f_{f} AS ({sql[f]})" for f in ids)
        return f"{full}, {ends}, {parts}", "ends e " + " ".join(f"JOIN f_{f} ON f_{f}.code = e.code" for f in ids)

    def screened(strategy_id: str, given: dict) -> str:
        s = strategies.strategy(strategy_id)
        ids = s.predicate.filters()
        sql = filter_sql({f: {p.name: given[p.name] for p in FILTERS[f].params if p.name in given} for f in ids})
        with_, from_ = joined(ids, sql)
        cols = ", ".join(f"f_{f}.* EXCLUDE (code, passed)" for f in ids)
        return f"{with_} SELECT e.code, full_code, name, board, '{strategy_id}' AS strategy, {cols}, close, barsAnalyzed FROM {from_} WHERE barsAnalyzed >= {s.least(s.resolve(given))} AND {' AND '.join(f'f_{f}.passed' for f in ids)}"

    classic = strategies.strategy("low_flat_limit_up").predicate.filters()
    with_, from_ = joined(classic, wide)
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT f_{f}.passed THEN '{f}' END" for f in classic) + ")"
    matched = " AND ".join(f"f_{f}.passed" for f in classic)
    count = " + ".join(f"CAST(NOT f_{f}.passed AS INTEGER)" for f in classic)
    out_ids = strategies.strategy("low_flat_breakout").predicate.filters()
    out_with, out_from = joined(out_ids, wide)
    out_failed = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT f_{f}.passed THEN '{f}' END" for f in out_ids) + ")"
    out_count = " + ".join(f"CAST(NOT f_{f}.passed AS INTEGER)" for f in out_ids)
    own = OWN.filters()
    own_with, own_from = joined(own, wide)
    dd, vr, lu = "f_deep_drawdown.passed", "f_volatility_regime.passed", "f_volume_limit_up.passed"
    one = f"({dd} AND {vr})"
    after_one, after_two = f"NOT {one}", f"NOT {one} AND {lu}"
    dry = "f_volume_dry_up"
    queries = {
        "bars": f"{head} SELECT code, date, close, pre_close, volume, amount FROM bars",
        "returns": f"{full} SELECT code, date, i, n, ret FROM ret",
        "chained_index": f"{full} SELECT ret.code, ret.date, idx FROM ret JOIN x ON x.code = ret.code AND x.i = ret.i",
        "limit_up_days": f"""{full} SELECT code, date, ret, surge FROM (SELECT ret.code, date, ret, CASE WHEN avg(volume) OVER b > 0 THEN volume / avg(volume) OVER b ELSE 0 END AS surge,
          CASE WHEN board = 'main' AND contains(name, 'ST') THEN 0.048 WHEN board = 'main' THEN 0.098 WHEN board = 'bse' THEN 0.298 ELSE 0.198 END AS lim
          FROM ret JOIN stocks ON stocks.code = ret.code WINDOW b AS (PARTITION BY ret.code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE ret >= lim""",
        **{f"filter_{f}": f"{full} {sql}" for f, sql in plain.items()},
        "universe_skips": f"""{head}, m AS (SELECT code, {reason} AS skip_reason FROM stocks) SELECT skip_reason, count(*) AS n FROM m WHERE skip_reason IS NOT NULL GROUP BY 1
          UNION ALL SELECT 'code-filtered', count(*) FILTER (WHERE code NOT IN ({listed})) FROM m WHERE skip_reason IS NULL""",
        "code_whitelist": f"{full} SELECT code, full_code, name, board, list_date FROM members WHERE code IN ({listed})",
        "industry_stats": f"{full} SELECT * FROM stats",
        "low_flat_limit_up": screened("low_flat_limit_up", LOOSE_LIMIT_UP),
        "flat_base_low": screened("flat_base_low", {}),
        "low_flat_breakout": screened("low_flat_breakout", LOOSE_BREAKOUT),
        "dsl_or_not": f"""{own_with} SELECT e.code, full_code, name, board, 'custom' AS strategy, drawdownFromHigh, CASE WHEN {dd} THEN annualVol END AS annualVol,
          CASE WHEN {after_one} THEN limitUpDate END AS limitUpDate, CASE WHEN {after_one} THEN limitUpPct END AS limitUpPct, CASE WHEN {after_one} THEN limitUpVolumeSurge END AS limitUpVolumeSurge,
          CASE WHEN {after_two} THEN dryUpVolumeRatio END AS dryUpVolumeRatio, close, barsAnalyzed
          FROM {own_from} WHERE barsAnalyzed >= 240 AND ({one} OR NOT {lu} OR {dry}.passed)""",
        "diagnose_gates": f"{with_} SELECT e.code, {matched} AS matched, {', '.join(f'f_{f}.passed AS {f}' for f in classic)}, {failed} AS failed_gates, barsAnalyzed AS bars_analyzed FROM {from_} WHERE barsAnalyzed >= 240",
        "tiers": f"{with_} SELECT e.code, CASE WHEN {matched} THEN 'hit' WHEN {count} = 1 THEN 'near' ELSE 'other' END AS tier, last_date FROM {from_} WHERE barsAnalyzed >= 240",
        "near_miss_topk": f"{out_with} SELECT e.code, {out_failed} AS failed_gates, drawdownFromHigh AS drawdown FROM {out_from} WHERE barsAnalyzed >= 240 AND {out_count} = 1 ORDER BY coalesce(drawdownFromHigh, 0) DESC, e.code LIMIT 10",
        "bars_merge": f"{head} SELECT code, date, CASE WHEN date >= '20000101' THEN close * 2 ELSE close END AS close FROM bars",
        "refresh_plan": f"""{head}, o AS (SELECT * FROM bars WHERE date < '20010101'), f AS (SELECT code, date, close * CASE WHEN code LIKE '%3' THEN 1.01::DOUBLE ELSE 1 END AS close FROM bars WHERE date >= '20001201'),
          j AS (SELECT f.code, count(o.close) AS overlap, max(abs(f.close / o.close - 1)) AS drift, min(f.date) AS first FROM f LEFT JOIN o ON o.code = f.code AND o.date = f.date GROUP BY 1), t AS (SELECT code, max(date) AS tail FROM o GROUP BY 1)
          SELECT j.code, CASE WHEN tail IS NULL THEN 'load' WHEN coalesce(drift > 0.001, false) OR overlap = 0 AND first <= tail THEN 'reload' ELSE 'merge' END AS action, overlap FROM j LEFT JOIN t ON t.code = j.code""",
    }
    return queries | source_queries.oracle_sql(head, full, wide)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "bars": q_bars,
        "returns": q_returns,
        "chained_index": q_chained_index,
        "limit_up_days": q_limit_up_days,
        **{f"filter_{f}": q_filter(f) for f in FILTERS},
        "universe_skips": q_universe_skips,
        "code_whitelist": q_code_whitelist,
        "industry_stats": q_industry_stats,
        "low_flat_limit_up": q_strategy("low_flat_limit_up", LOOSE_LIMIT_UP),
        "flat_base_low": q_strategy("flat_base_low", {}),
        "low_flat_breakout": q_strategy("low_flat_breakout", LOOSE_BREAKOUT),
        "dsl_or_not": q_dsl_or_not,
        "diagnose_gates": q_diagnose_gates,
        "tiers": q_tiers,
        "near_miss_topk": q_near_miss_topk,
        "bars_merge": q_bars_merge,
        "refresh_plan": q_refresh_plan,
        **source_queries.queries(),
    }
