"""Queries over vendors' payloads, boards, files and rules, with payloads written from the sample tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import api
from tickloom.functions import market, numeric
from tickloom.operators import bars as bar_ops
from tickloom.operators import universe as uni
from tickloom.plans import screen as scr
from tickloom.plans import strategies
from tickloom.sources import sample, vendors
from tickloom.streaming import bars as stream

#: From this day on the second page of a paged history has other closes.
LATER = "20000101"
RULES = uni.UniverseRules(sample.AS_OF)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, page and the entry of each sample security, in the vendor's names; every fifth is listed again on page 9."""
    s = sample.stocks(spark, sf_dir)
    entry = F.struct(
        F.col("code").alias("f12"),
        F.col("name").alias("f14"),
        F.concat_ws("-", F.substring("list_date", 1, 4), F.substring("list_date", 5, 2), F.substring("list_date", 7, 2)).alias("f26"),
        F.coalesce(F.concat(F.lit(" "), "industry", F.lit(" ")), F.lit("-")).alias("f100"),
        F.col("total_cap").alias("f20"),
        F.when(F.col("code").endswith("4"), -1.0).otherwise(F.col("float_cap")).alias("f21"),
    )
    first = s.select("code", F.pmod(F.substring("code", -2, 2).cast("int"), F.lit(3)).alias("page"), entry.alias("e"))
    again = first.where(F.col("code").endswith("5")).select("code", F.lit(9).alias("page"), F.col("e").withField("f14", F.concat(F.col("e.f14"), F.lit(" again"))).alias("e"))
    return first.unionAll(again)


def pages(rows: DataFrame) -> DataFrame:
    """Listing pages; on odd pages the list of entries is an object of numbered ones."""
    by_page = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("code", "e"))).alias("all"))
    listed = F.transform("all", lambda x: x["e"])
    numbered = F.map_from_entries(F.transform("all", lambda x, i: F.struct(i.cast("string"), x["e"])))
    as_list, as_object = (F.to_json(F.struct(F.struct(v.alias("diff")).alias("data"))) for v in (listed, numbered))
    return by_page.select("page", F.when(F.col("page") % 2 == 1, as_object).otherwise(as_list).alias("body"))


def q_parse_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.stocks(pages(entries(spark, sf_dir))).select("code", "full_code", "name", "board", "list_date", "industry", "total_cap", "float_cap")


def dashed(date: str) -> F.Column:
    return F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))


def by_security(rows: DataFrame, value: F.Column, page: int = 0) -> DataFrame:
    return rows.groupBy(market.full_code(F.col("code")).alias("full_code")).agg(F.sort_array(F.collect_list(value)).alias("all")).select("full_code", F.lit(page).alias("page"), "all")


def texts(*names: str) -> list[F.Column]:
    return [F.col(n).cast("string") for n in names]


def q_parse_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", dashed("date"), *texts("open", "close", "high", "low", "volume", "amount"))
    found = by_security(sample.bars(spark, sf_dir), line)
    body = F.to_json(F.struct(F.struct(F.concat(F.array(F.lit("bad,1,1,1,1,1"), F.lit("2000-01-01,1")), "all").alias("klines")).alias("data")))
    return vendors.eastmoney(found.select("full_code", "page", body.alias("body"))).select("code", "date", "close", "volume", "amount")


def q_parse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.bars(spark, sf_dir).withColumn("volume", F.when(F.col("date").endswith("13"), -1.0).otherwise(F.col("volume")))
    entry = F.struct(dashed("date").alias("day"), *(c.alias(n) for n, c in zip(("open", "high", "low", "close", "volume"), texts("open", "high", "low", "close", "volume"), strict=True)))
    body = F.concat(F.lit("/*x*/\nvar _=("), F.to_json("all"), F.lit(");"))
    return vendors.sina(by_security(rows, entry).select("full_code", "page", body.alias("body"))).select("code", "date", "close", "volume")


def q_parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.bars(spark, sf_dir)
    cells = F.array(dashed("date"), *texts("open", "close", "high", "low", "volume"))
    later = rows.where(F.col("date") >= LATER).withColumn("close", F.col("close") * 2)
    both = [(by_security(rows, cells), "day"), (by_security(later, cells, 1), "hfqday")]
    key = market.vendor_symbol(F.col("full_code"))
    bodies = [found.select("full_code", "page", F.to_json(F.struct(F.create_map(key, F.struct(F.col("all").alias(name))).alias("data"))).alias("body")) for found, name in both]
    return vendors.window(vendors.tencent(bodies[0].unionAll(bodies[1])), "19950101").select("code", "date", "close")


def board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as boards of industries, regions as concepts."""
    found = []
    for kind, name, key, label in (("industry", "nation", "n_nationkey", "n_name"), ("concept", "region", "r_regionkey", "r_name")):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        entry = F.struct(F.concat(F.lit("BK"), F.col(key).cast("string")).alias("f12"), F.concat(F.col(label), F.lit(" ")).alias("f14"))
        found.append(pages(rows.select(F.col(key).cast("string").alias("code"), F.lit(1).alias("page"), entry.alias("e"))).select(F.lit(kind).alias("kind"), "page", "body"))
    return found[0].unionAll(found[1])


def q_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendors.boards(board_pages(spark, sf_dir))


def q_board_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vendors.boards(board_pages(spark, sf_dir))
    suggested = vendors.suggest_boards(known, " N_2", 4).select(F.lit("suggested").alias("how"), "name")
    return vendors.find_boards(known, " NATION_7 ").select(F.lit("found").alias("how"), "name").unionAll(suggested)


def q_board_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    entry = F.struct(sample.code(F.col("s_suppkey")).alias("f12"), F.col("s_name").alias("f14"))
    rows = s.where("s_nationkey < 5").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_nationkey").cast("int").alias("page"), entry.alias("e"))
    return vendors.members(pages(rows))


def q_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sample.stocks(spark, sf_dir)
    full, code = F.col("full_code"), F.col("code")
    return s.select("code", market.vendor_symbol(full).alias("symbol"), market.security_id(full).alias("security_id"), market.exchange_of(code).alias("exchange"), market.limit_of(F.col("board"), F.col("name")).alias("least_limit"), market.is_special(F.col("name")).alias("special"))


def q_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, dates and tags as vendors write them."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    number = F.when(k % 5 == 0, "").when(k % 5 == 1, "-").when(k % 5 == 2, "1e3").otherwise(F.col("s_acctbal").cast("string"))
    tag = F.when(k % 3 == 0, F.concat(F.lit(" "), "s_name", F.lit(" "))).when(k % 3 == 1, "-")
    date = F.concat(F.lit("on 2001/"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/07T00:00"))
    read = numeric.number(number)
    return s.select(k.alias("key"), read.alias("number"), numeric.positive(read).alias("positive"), market.tag(tag).alias("tag"), market.date_digits(date).alias("date"), numeric.half_up(F.col("s_acctbal").cast("double"), 1).alias("half_up"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was loaded of the sample's securities, as if some were never asked for and others lately."""
    k = F.substring("code", -1, 1).cast("int")
    tails = sample.bars(spark, sf_dir).groupBy("code").agg(F.max("date").alias("last"))
    rows = sample.stocks(spark, sf_dir).select("code").where(k > 1).join(tails, "code", "left")
    return rows.select("code", F.when(k % 2 == 0, sample.AS_OF).otherwise("20011230").alias("fetched_at"), F.when(k == 3, "19990101").otherwise("19920101").alias("start_date"), F.when(k != 5, F.when(k == 7, sample.AS_OF).otherwise(F.col("last"))).alias("tail"))


def q_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.acquisition(sample.stocks(spark, sf_dir), files(spark, sf_dir), "19930101", api.expected_trading_day(sample.AS_OF), sample.AS_OF)


def q_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each security and month the last bar that landed."""
    rows = sample.bars(spark, sf_dir).select("code", F.substring("date", 1, 6).alias("month"), "date", "close")
    return bar_ops.latest(rows, ["code", "month"], "date").select("code", "month", "close")


def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By board, the securities in, those that lack bars of the year, and the most that may."""
    members = uni.universe(sample.stocks(spark, sf_dir), RULES)
    have = sample.bars(spark, sf_dir).where("date >= '20011001'").select("code", F.lit(1).alias("one")).distinct()
    counted = members.join(have, "code", "left").groupBy("board").agg(F.count(F.lit(1)).alias("securities"), F.count(F.when(F.col("one").isNull(), 1)).alias("missing"))
    return counted.withColumn("most", F.greatest(F.lit(10), F.floor(F.col("securities") / 10)).cast("long"))


def q_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of a scan as a whole: securities of each tier and the last day."""
    found = scr.tiers(scr.diagnose(scr.Scan(sample.bars(spark, sf_dir), sample.stocks(spark, sf_dir), RULES), strategies.strategy("flat_base_low")))
    return found.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("last_date").alias("last_date"))


def q_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.list_sources(spark).select("id", "adjusted", "industry", "market_cap", "amount")


def q_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.list_filters(spark).select("id", "requiresIndustry", "requiresMarketCap", "requiresAmount", F.size("params").cast("long").alias("params"))


def q_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy with the sources that can serve it."""
    able = [(s.id, v.id) for s in strategies.STRATEGIES.values() for v in vendors.SOURCES.values() if not v.lacks(s.needs)]
    return api.list_strategies(spark).select("id", "predicate").join(spark.createDataFrame(able, "id string, source string"), "id")


def q_weekly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.weekly_volume(sample.bars(spark, sf_dir)).select("code", F.date_format("window.start", "yyyyMMdd").alias("begin"), "volume", "bars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (q_parse_listing, q_parse_klines, q_parse_calls, q_parse_pages, q_boards, q_board_lookup, q_board_members, q_symbols, q_readings, q_acquisition, q_latest, q_health, q_report_counts, q_sources, q_filters, q_strategies, q_weekly_volume)
    return {q.__name__[2:]: q for q in own}


def oracle_sql(head: str, series: str, measures: dict[str, str]) -> dict[str, str]:
    """head: CTEs of the sample; series: those of derived series too; measures: a query for each filter."""
    ids = strategies.STRATEGIES["flat_base_low"].predicate.filters()
    parts = ", ".join(f"f_{f} AS ({measures[f]})" for f in ids)
    from_ = "ends e " + " ".join(f"JOIN f_{f} ON f_{f}.code = e.code" for f in ids)
    misses = " + ".join(f"CAST(NOT f_{f}.passed AS INTEGER)" for f in ids)
    least = strategies.STRATEGIES["flat_base_low"].least(strategies.STRATEGIES["flat_base_low"].resolve({}))
    exchange = "CASE WHEN code LIKE '6%' THEN 'SH' WHEN code LIKE '4%' OR code LIKE '8%' OR code LIKE '92%' THEN 'BJ' ELSE 'SZ' END"
    sign = "['60', '30', '68', '83'][s_suppkey % 4 + 1] || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 4, '0') ELSE CAST(s_suppkey AS VARCHAR) END"
    return {
        "parse_listing": f"""{head} SELECT code, full_code, CASE WHEN code LIKE '%5' THEN name || ' again' ELSE name END AS name, board, list_date, industry, total_cap, CASE WHEN code NOT LIKE '%4' THEN float_cap END AS float_cap
          FROM stocks WHERE length(code) = 6""",
        "parse_klines": f"{head} SELECT code, date, close, volume, amount FROM bars",
        "parse_calls": f"{head} SELECT code, date, close, volume / 100 AS volume FROM bars WHERE date NOT LIKE '%13'",
        "parse_pages": f"{head} SELECT code, date, CASE WHEN date >= '{LATER}' THEN close * 2 ELSE close END AS close FROM bars WHERE date >= '19950101'",
        "boards": "SELECT 'BK' || n_nationkey AS board_id, n_name || ' ' AS name, 'industry' AS kind FROM nation UNION ALL SELECT 'BK' || r_regionkey, r_name || ' ', 'concept' FROM region",
        "board_lookup": """WITH b AS (SELECT n_name || ' ' AS name FROM nation UNION ALL SELECT r_name || ' ' FROM region)
          SELECT 'found' AS how, name FROM b WHERE trim(name) = 'NATION_7' UNION ALL SELECT 'suggested', name FROM (SELECT DISTINCT name FROM b WHERE contains(name, 'N_2') ORDER BY name LIMIT 4)""",
        "board_members": f"SELECT DISTINCT code FROM (SELECT {sign} AS code FROM supplier WHERE s_nationkey < 5) WHERE length(code) = 6",
        "symbols": f"""{head} SELECT code, lower({exchange}) || code AS symbol, CASE WHEN {exchange} = 'SH' THEN '1.' ELSE '0.' END || code AS security_id, {exchange} AS exchange,
          CASE WHEN board = 'main' AND contains(name, 'ST') THEN 0.048 WHEN board = 'main' THEN 0.098 WHEN board = 'bse' THEN 0.298 ELSE 0.198 END::DOUBLE AS least_limit, contains(name, 'ST') OR contains(name, '退') AS special FROM stocks""",
        "readings": """WITH n AS (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 1000 ELSE s_acctbal END::DOUBLE AS number FROM supplier)
          SELECT s_suppkey AS key, number, CASE WHEN number > 0 THEN number END AS positive, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS tag,
          '2001' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') || '07' AS date, floor(s_acctbal::DOUBLE * 10 + 0.5) / 10 AS half_up FROM n""",
        "acquisition": f"""{head}, t AS (SELECT code, max(date) AS last FROM bars GROUP BY code), f AS (
          SELECT s.code, CAST(right(s.code, 1) AS INTEGER) AS k, last FROM stocks s LEFT JOIN t ON t.code = s.code),
          h AS (SELECT code, k, CASE WHEN k % 2 = 0 THEN '{sample.AS_OF}' ELSE '20011230' END AS fetched, CASE WHEN k <> 5 THEN CASE WHEN k = 7 THEN '{sample.AS_OF}' ELSE last END END AS tail FROM f)
          SELECT code, CASE WHEN k <= 1 THEN 'load' WHEN k = 3 THEN 'backfill' WHEN coalesce(tail, '') >= '{sample.AS_OF}' OR fetched >= '{sample.AS_OF}' THEN 'hit' WHEN tail IS NULL THEN 'retry' ELSE 'refresh' END AS action FROM h""",
        "latest": f"{head} SELECT code, date[1:6] AS month, arg_max(close, date) AS close FROM bars GROUP BY ALL",
        "health": f"""{series} SELECT board, count(*) AS securities, count(*) FILTER (WHERE code NOT IN (SELECT code FROM bars WHERE date >= '20011001')) AS missing, greatest(10, count(*) // 10) AS most FROM members GROUP BY board""",
        "report_counts": f"""{series}, ends AS (SELECT m.code, s.n AS bars_analyzed, s.date AS last_date FROM members m JOIN s ON s.code = m.code AND s.r = 0), {parts}
          SELECT CASE {misses} WHEN 0 THEN 'hit' WHEN 1 THEN 'near' ELSE 'other' END AS tier, count(*) AS n, max(last_date) AS last_date FROM {from_} WHERE bars_analyzed >= {least} GROUP BY 1""",
        "sources": "SELECT * FROM (VALUES ('sina', 'forward', true, true, false), ('eastmoney', 'backward', true, true, true), ('tencent', 'backward', true, true, false)) t(id, adjusted, industry, market_cap, amount)",
        "filters": """SELECT id, id IN ('industry_clearance', 'industry_position') AS requiresIndustry, id IN ('market_cap_band', 'turnover_band') AS requiresMarketCap, id = 'amount_liquidity' AS requiresAmount, CAST(n AS BIGINT) AS params
          FROM (VALUES ('deep_drawdown', 1), ('low_percentile', 2), ('bars_since_low', 3), ('flat_base', 3), ('platform_breakout', 7), ('ma_stabilization', 4), ('volatility_regime', 3), ('volume_limit_up', 3), ('cooldown_pullback', 5), ('volume_dry_up', 3),
          ('industry_clearance', 3), ('industry_position', 2), ('market_cap_band', 2), ('amount_liquidity', 2), ('turnover_band', 3)) t(id, n)""",
        "strategies": """SELECT t.id, predicate, source FROM (VALUES ('low_flat_limit_up', 'deep_drawdown AND low_percentile AND flat_base AND volume_limit_up AND cooldown_pullback'), ('flat_base_low', 'low_percentile AND flat_base'), ('low_flat_breakout', 'deep_drawdown AND bars_since_low AND platform_breakout AND ma_stabilization')) t(id, predicate), (VALUES ('sina'), ('eastmoney'), ('tencent')) s(source)""",
        "weekly_volume": f"""{head} SELECT code, strftime(time_bucket(INTERVAL 7 DAYS, strptime(date, '%Y%m%d'), TIMESTAMP '1970-01-01'), '%Y%m%d') AS begin, sum(volume) AS volume, count(*) AS bars FROM bars GROUP BY ALL""",
    }
