"""Vendors' payloads as DataFrames.

A fetch stage lands raw responses as text; everything after that is here. Pages of a listing: page (order), body. Daily
bars: full_code, page (order, later ones win), body. Series of different vendors are adjusted in different ways and
never mixed, so each source's bars are stored by themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.market import board_of, date_digits, full_code, tag, vendor_symbol
from tickloom.functions.numeric import finite, number, positive
from tickloom.operators.bars import latest

#: The vendor's names of an entry's fields (code, market, name, listing day, industry, capitalisations).
ENTRY = "struct<f12: string, f13: string, f14: string, f26: string, f100: string, f20: double, f21: double>"
PRICES = ("open", "close", "high", "low")
BARS = ("code", "date", "open", "high", "low", "close", "volume", "amount", "pre_close")


@dataclass(frozen=True)
class Source:
    """What a source has, how its prices are adjusted, and how its bars are read."""

    id: str
    about: str
    adjusted: str
    parse: Callable[[DataFrame], DataFrame]
    industry: bool = True
    market_cap: bool = True
    amount: bool = False

    def lacks(self, needs: frozenset[str]) -> list[str]:
        """What of a strategy's needs the source can't give."""
        have = {"industry": self.industry, "market_cap": self.market_cap, "amount": self.amount}
        return [k for k, ok in have.items() if k in needs and not ok]


def listed(pages: DataFrame, entry: str = ENTRY) -> DataFrame:
    """page, place and the entries of listing pages, whose list is an array or an object of entries."""
    as_list = F.from_json("body", f"data struct<diff: array<{entry}>>")["data"]["diff"]
    as_object = F.map_values(F.from_json("body", f"data struct<diff: map<string, {entry}>>")["data"]["diff"])
    return pages.select("page", F.posexplode(F.coalesce(as_list, as_object)).alias("place", "e")).select("page", "place", "e.*")


def stocks(pages: DataFrame) -> DataFrame:
    """Securities of the listing; codes that aren't six digits of a known board are left out, the last entry wins."""
    rows = listed(pages).withColumn("code", F.coalesce("f12", F.lit("")))
    rows = rows.where(F.col("code").rlike(r"^\d{6}$") & board_of(F.col("code")).isNotNull())
    found = rows.select(
        "code",
        full_code(F.col("code")).alias("full_code"),
        F.coalesce("f14", F.lit("")).alias("name"),
        board_of(F.col("code")).alias("board"),
        F.coalesce(date_digits(F.col("f26")), F.lit("")).alias("list_date"),
        tag(F.col("f100")).alias("industry"),
        positive(F.col("f20")).alias("total_cap"),
        positive(F.col("f21")).alias("float_cap"),
        F.struct("page", "place").alias("order"),
    )
    return latest(found, ["code"], "order")


def valid(rows: DataFrame, least_volume: float | None, lot: float = 1.0) -> DataFrame:
    """Bars with a whole date and positive finite prices, and with volume in lots; the last of a day wins."""
    ok = F.length("date") == 8
    for p in PRICES:
        ok = ok & finite(F.col(p)) & (F.col(p) > 0)
    ok = ok & finite(F.col("volume"))
    if least_volume is not None:
        ok = ok & (F.col("volume") >= least_volume)
    kept = rows.where(F.coalesce(ok, F.lit(False))).withColumns({"volume": F.col("volume") / lot, "amount": F.when(finite(F.col("amount")), F.col("amount")), "pre_close": F.lit(None).cast("double"), "code": F.substring_index("full_code", ".", 1)})
    return latest(kept.select(*BARS, F.struct("page", "place").alias("order")), ["code", "date"], "order").select(*BARS)


def cells(row: Column, start: int) -> dict[str, Column]:
    """date, prices and volume of a row of texts in the order date, open, close, high, low, volume."""
    names = ("open", "close", "high", "low", "volume")
    return {"date": F.regexp_replace(F.get(row, F.lit(0)), r"\D", "")} | {n: number(F.get(row, F.lit(start + i))) for i, n in enumerate(names)}


def eastmoney(payloads: DataFrame) -> DataFrame:
    lines = F.from_json("body", "data struct<klines: array<string>>")["data"]["klines"]
    rows = payloads.select("full_code", "page", F.posexplode(lines).alias("place", "line")).withColumn("row", F.split("line", ",")).where(F.size("row") >= 6)
    return valid(rows.withColumns(cells(F.col("row"), 1) | {"amount": number(F.get("row", F.lit(6)))}), None)


def sina(payloads: DataFrame) -> DataFrame:
    """A list of objects wrapped in a call; volume is in shares."""
    text = F.regexp_extract("body", r"(?s)\((\[.*\])\)", 1)
    rows = F.from_json(text, "array<struct<day: string, open: string, high: string, low: string, close: string, volume: string>>")
    flat = payloads.select("full_code", "page", F.posexplode(rows).alias("place", "e"))
    values = {"date": F.regexp_replace("e.day", r"\D", "")} | {n: number(F.col(f"e.{n}")) for n in (*PRICES, "volume")}
    return valid(flat.withColumns(values | {"amount": F.lit(None).cast("double")}), 0.0, 100.0)


def tencent(payloads: DataFrame) -> DataFrame:
    """Rows of texts under the symbol, adjusted ones first if there are any."""
    data = F.from_json("body", "data map<string, struct<hfqday: array<array<string>>, day: array<array<string>>>>")["data"]
    own = data[vendor_symbol(F.col("full_code"))]
    flat = payloads.select("full_code", "page", F.posexplode(F.coalesce(own["hfqday"], own["day"])).alias("place", "row"))
    return valid(flat.withColumns(cells(F.col("row"), 1) | {"amount": F.lit(None).cast("double")}), 0.0)


SOURCES: dict[str, Source] = {
    s.id: s
    for s in (
        Source("sina", "Daily bars of up to 1023 days; no traded value.", "forward", sina),
        Source("eastmoney", "Daily bars of any length, with traded value.", "backward", eastmoney, amount=True),
        Source("tencent", "Daily bars in pages of 640; closes aren't market prices; no traded value.", "backward", tencent),
    )
}


def register(new: Source) -> Source:
    """Adds a source; its bars are stored by themselves like those of the others."""
    if new.id in SOURCES:
        raise ValueError(f"there is a source {new.id!r} already")
    SOURCES[new.id] = new
    return new


def source(source_id: str) -> Source:
    if source_id not in SOURCES:
        raise ValueError(f"unknown source {source_id!r}; there are {', '.join(SOURCES)}")
    return SOURCES[source_id]


def window(bars: DataFrame, start: str) -> DataFrame:
    return bars.where(F.col("date") >= start)


BOARD = "struct<f12: string, f14: string>"


def boards(pages: DataFrame) -> DataFrame:
    """board_id, name, kind of listing pages that carry a kind (industry or concept)."""
    kinds = pages.select("kind", "page", "body")
    found = [listed(kinds.where(F.col("kind") == k), BOARD).select(F.coalesce("f12", F.lit("")).alias("board_id"), F.coalesce("f14", F.lit("")).alias("name"), F.lit(k).alias("kind")) for k in ("industry", "concept")]
    return found[0].unionAll(found[1])


def find_boards(boards_: DataFrame, name: str) -> DataFrame:
    return boards_.where(F.trim("name") == name.strip())


def suggest_boards(boards_: DataFrame, keyword: str, most: int = 10) -> DataFrame:
    return boards_.where(F.col("name").contains(keyword.strip())).select("name").distinct().orderBy("name").limit(most)


def members(pages: DataFrame) -> DataFrame:
    """The distinct six-digit codes of a board's member pages, or of several boards'."""
    return listed(pages, BOARD).select(F.col("f12").alias("code")).where(F.col("code").rlike(r"^\d{6}$")).distinct()
