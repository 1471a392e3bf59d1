"""Bars and securities made from the sample tables lineitem, supplier, nation and region.

A supplier is a security, its ship dates are days. Sums are taken in whole cents and hundredths, so that every engine
gets the same doubles whatever the order of its additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.market import board_of, full_code

#: The day that ages are counted from; after the last bar of any sample.
AS_OF = "20011231"
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)
PREFIXES = ("60", "30", "68", "83")


def pick(values: tuple, key: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def code(key: F.Column) -> F.Column:
    text = key.cast("string")
    return F.concat(pick(PREFIXES, key), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("k")
    days = items.groupBy(F.col("l_suppkey").alias("k"), F.date_format("l_shipdate", "yyyyMMdd").alias("date")).agg(
        F.count("*").alias("items"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discount"),
        F.sum(F.round("l_quantity").cast("long")).alias("pieces"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
    )
    ret = (F.col("discount") / (F.col("items") * 100.0) - 0.05) * pick(SCALES, k)
    close = F.col("cents") / (F.col("pieces") * 10000.0)
    priced = days.select(code(k).alias("code"), "date", close.alias("close"), (close / (1 + ret)).alias("pre_close"), (F.col("pieces") * 1000.0).alias("volume"), (F.col("cents") * 10.0).alias("amount"))
    return priced.select("code", "date", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", "volume", "amount", "pre_close")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some are under special treatment, to be delisted, or without an industry."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    k, c = F.col("s_suppkey"), code(F.col("s_suppkey"))
    name = F.when(k % 17 == 3, F.concat(F.lit("*ST "), "s_name")).when(k % 29 == 5, F.concat("s_name", F.lit("退"))).otherwise(F.col("s_name"))
    rows = read("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    cap = (F.abs("s_acctbal") + 1) * 1e6
    return rows.select(
        c.alias("code"),
        full_code(c).alias("full_code"),
        name.alias("name"),
        board_of(c).alias("board"),
        F.date_format(F.date_sub(F.to_date(F.lit(AS_OF), "yyyyMMdd"), (k * 53 % 4000).cast("int")), "yyyyMMdd").alias("list_date"),
        F.when(k % 11 != 7, F.col("r_name")).alias("industry"),
        cap.alias("total_cap"),
        (cap * 0.6).alias("float_cap"),
    )


#: The same in SQL: CTEs g, bars and stocks.
SQL = f"""
g AS (
  SELECT l_suppkey AS k, strftime(l_shipdate, '%Y%m%d') AS date, count(*) AS items,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS pieces,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem GROUP BY 1, 2
), bars AS MATERIALIZED (
  SELECT ['60', '30', '68', '83'][k % 4 + 1] || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS code, date,
         cents / (pieces * 10000.0::DOUBLE) AS close,
         (cents / (pieces * 10000.0::DOUBLE)) / (1 + (discount / (items * 100.0::DOUBLE) - 0.05::DOUBLE) * [0.25::DOUBLE, 0.5, 1, 2, 4][k % 5 + 1]) AS pre_close,
         pieces * 1000.0::DOUBLE AS volume, cents * 10.0::DOUBLE AS amount
  FROM g
), stocks AS MATERIALIZED (
  SELECT c AS code, c || CASE WHEN c LIKE '6%' THEN '.SH' WHEN c LIKE '4%' OR c LIKE '8%' OR c LIKE '92%' THEN '.BJ' ELSE '.SZ' END AS full_code,
         CASE WHEN k % 17 = 3 THEN '*ST ' || s_name WHEN k % 29 = 5 THEN s_name || '退' ELSE s_name END AS name,
         CASE WHEN c LIKE '68%' THEN 'star' WHEN c LIKE '6%' OR c LIKE '00%' THEN 'main' WHEN c LIKE '30%' THEN 'chinext' ELSE 'bse' END AS board,
         strftime(DATE '2001-12-31' - CAST(k * 53 % 4000 AS INTEGER), '%Y%m%d') AS list_date,
         CASE WHEN k % 11 <> 7 THEN r_name END AS industry,
         (abs(s_acctbal) + 1) * 1e6::DOUBLE AS total_cap, (abs(s_acctbal) + 1) * 1e6::DOUBLE * 0.6::DOUBLE AS float_cap
  FROM (SELECT *, s_suppkey AS k, ['60', '30', '68', '83'][s_suppkey % 4 + 1] || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 4, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS c FROM supplier)
  LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)
"""
