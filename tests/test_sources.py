"""Payloads, the store, the stream, reports and the command line."""

from __future__ import annotations

import json

import pytest

from tests.bars import STOCKS, breakout_series, day, stock
from tickloom import api, cli
from tickloom.operators.bars import latest
from tickloom.sources import fetch, vendors
from tickloom.sources.store import BARS, Store, legacy_bars
from tickloom.streaming.bars import merge_stream


def payloads(spark, *found: tuple[str, int, str]):
    return spark.createDataFrame(list(found), "full_code string, page int, body string")


def test_listing(spark):
    entry = {"f12": "600001", "f13": 1, "f14": "甲", "f26": 20100102, "f100": " 钢铁 ", "f20": 5e9, "f21": "-"}
    pages = [
        (1, json.dumps({"data": {"total": 3, "diff": [entry, entry | {"f12": "12345"}, entry | {"f12": "300001", "f100": "-", "f26": "2011-03-04"}]}})),
        (2, json.dumps({"data": {"diff": {"0": entry | {"f14": "乙", "f20": -1}, "1": entry | {"f12": "920001"}, "2": entry | {"f12": "100001"}}}})),
        (3, json.dumps({"data": None})),
    ]
    got = {r.code: r for r in vendors.stocks(spark.createDataFrame(pages, "page int, body string")).collect()}
    assert set(got) == {"600001", "300001", "920001"}
    a = got["600001"]
    assert (a.full_code, a.name, a.board, a.list_date, a.industry, a.total_cap, a.float_cap) == ("600001.SH", "乙", "main", "20100102", "钢铁", None, None)
    assert got["300001"].industry is None and got["300001"].list_date == "20110304" and got["920001"].full_code == "920001.BJ"


def test_bars_with_amounts(spark):
    lines = ["2024-01-02,10,11,12,9,100,5000,1", "2024-01-03,10,0,12,9,100,5000", "2024-01-04,10,11,12,9,-5,x", "2024-01-05,10,11,12,9", "bad,10,11,12,9,1,1", "2024-01-08,10,11,12,9,,1"]
    got = vendors.eastmoney(payloads(spark, ("600001.SH", 0, json.dumps({"data": {"klines": lines}})), ("600002.SH", 0, "{}"))).orderBy("date").collect()
    assert [(r.code, r.date, r.open, r.close, r.high, r.low, r.volume, r.amount) for r in got] == [("600001", "20240102", 10, 11, 12, 9, 100, 5000), ("600001", "20240104", 10, 11, 12, 9, -5, None), ("600001", "20240108", 10, 11, 12, 9, 0, 1)]


def test_bars_in_a_call(spark):
    body = '/*x*/\nvar _=([{"day":"2024-01-02","open":"10","high":"12","low":"9","close":"11","volume":"6220383"},{"day":"2024-01-03","open":"10","high":"12","low":"9","close":"11","volume":"-1"}]);'
    (r,) = vendors.sina(payloads(spark, ("600001.SH", 0, body), ("600002.SH", 0, "nothing"))).collect()
    assert (r.date, r.volume, r.amount, r.pre_close) == ("20240102", 62203.83, None, None)


def test_bars_in_pages(spark):
    def body(key: str, data: list) -> str:
        return json.dumps({"data": {"sz300001": {key: data, "other": 1}}})

    found = vendors.tencent(payloads(spark, ("300001.SZ", 0, body("hfqday", [["2024-01-03", "10", "11", "12", "9", "5"], ["2024-01-04", "10", "11", "12", "9", "6", {"a": 1}]])), ("300001.SZ", 1, body("day", [["2024-01-03", "10", "12", "12", "9", "7"]]))))
    assert {r.date: (r.close, r.volume) for r in found.collect()} == {"20240103": (12, 7), "20240104": (11, 6)}


def test_boards(spark):
    page = lambda *names: json.dumps({"data": {"diff": [{"f12": f"BK{n}", "f14": n} for n in names]}})
    known = vendors.boards(spark.createDataFrame([("industry", 1, page("核电", "核能核电 ")), ("concept", 1, page("核能核电"))], "kind string, page int, body string"))
    assert {(r.name, r.kind) for r in vendors.find_boards(known, " 核能核电").collect()} == {("核能核电 ", "industry"), ("核能核电", "concept")}
    assert len(vendors.suggest_boards(known, "核", 2).collect()) == 2


def test_capabilities():
    assert vendors.source("sina").lacks(frozenset({"amount", "industry", "limit"})) == ["amount"]
    with pytest.raises(ValueError, match="unknown source"):
        vendors.source("other")
    with pytest.raises(ValueError, match="amount"):
        api.check_source(api.chosen(predicate="amount_liquidity"), "sina")
    for both in ({}, {"strategy": "flat_base_low", "predicate": "flat_base"}):
        with pytest.raises(ValueError):
            api.chosen(**both)
    with pytest.raises(ValueError):
        api.Settings.of(historyBars=10)
    assert api.Settings.of().history_start("20300101") == "20260805"
    assert [api.expected_trading_day(d) for d in ("20240105", "20240106", "20240107", "20240108")] == ["20240105", "20240105", "20240105", "20240108"]


def test_fetching():
    now, slept = [0.0], []
    limiter = fetch.RateLimiter(60, lambda: now[0], slept.append)
    for _ in range(3):
        limiter.wait()
    assert slept == [1.0, 2.0]
    tries = []

    def fails(url: str, timeout: float) -> str:
        tries.append(url)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert fetch.fetch("u", fetch.RateLimiter(6000, lambda: 0.0, lambda s: None), read=fails, sleep=lambda s: None) == "ok"
    with pytest.raises(ValueError):
        fetch.fetch("u", fetch.RateLimiter(6000), read=lambda u, t: int("x"), sleep=lambda s: None)
    hosts = fetch.Hosts(("a", "b"))
    assert hosts.ask(lambda h: {"b": "ok"}[h]) == "ok" and hosts.good == "b"
    assert [k for k, _ in fetch.pages(lambda k: "x" * (100 if k < 3 else 5), len)] == [1, 2, 3]
    assert [k for k, _ in fetch.pages(lambda k: "x" * 100, len, total=lambda b: 200)] == [1, 2]
    assert len(list(fetch.backwards(lambda end: end, lambda b: (640, b.replace("-", "")), "20991229"))) == 3


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.bars("sina").count() == 0 and store.versions("stocks") == []
    one = spark.createDataFrame([("600001", "20240102", 1.0, 1.0, 1.0, 1.0, 1.0, None, None)], BARS)
    for _ in range(3):
        store.write_bars("sina", one)
    assert store.versions("bars/source=sina/year=2024") == [2, 3] and store.bars("sina").collect() == one.collect()
    (tmp_path / "store/bars/source=sina/year=2024/v=9").mkdir()  # a writer that never finished
    assert store.bars("sina").count() == 1
    landed = spark.createDataFrame([("600001", "20240102", 1.0, 1.0, 1.0, 1.0, 5.0, None, None, 1), ("600001", "20240102", 1.0, 1.0, 1.0, 1.0, 6.0, None, None, 2), ("600002", "20240102", 1.0, 1.0, 1.0, 1.0, 7.0, None, None, 1)], f"{BARS}, seq long")
    landed.write.parquet(str(tmp_path / "landed"))
    query = merge_stream(spark, str(tmp_path / "landed"), store, "sina", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None and {r.code: r.volume for r in store.bars("sina").collect()} == {"600001": 6.0, "600002": 7.0}


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, None)], "k string, o int, v int")
    assert {r.k: r.v for r in latest(rows, ["k"], "o").collect()} == {"a": 5, "b": None}


def test_legacy_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"code": "600001.SH", "bars": [["20240102", 1, 2, 0.5, 1.5, 100, None], ["20240103", 1, 2, 0.5, 1.5, 100, 1.4, 9e6]]}))
    got = legacy_bars(spark, str(tmp_path / "a.json")).orderBy("date").collect()
    assert [(r.code, r.close, r.volume, r.pre_close, r.amount) for r in got] == [("600001", 1.5, 100, None, None), ("600001", 1.5, 100, 1.4, 9e6)]


def test_command_line(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"))
    store.write("stocks", spark.createDataFrame([stock("600001"), stock("600002"), stock("600003", name="ST x")], STOCKS))
    lines = {c: [f"{day(i)},{x},{x},{x},{x},{v}" for i, (x, v) in enumerate(zip(*breakout_series(h), strict=True))] for c, h in (("600001", 0.28), ("600002", 0.6))}
    payloads(spark, *((f"{c}.SH", 0, json.dumps({"data": {"klines": k}})) for c, k in lines.items())).write.parquet(str(tmp_path / "landed"))
    common = ["--store", str(tmp_path / "store"), "--source", "eastmoney", "--today", "20220401"]
    assert cli.main(["sync", *common, "--landed", str(tmp_path / "landed")], spark) == 0
    assert "2 with bars" in capsys.readouterr().out
    out = tmp_path / "out"
    assert cli.main(["scan", *common, "--strategy", "low_flat_breakout", "--params", "requireCloseAboveMa=true,minBars=200", "--out", str(out)], spark) == 0
    made = json.loads((out / "20220401-low_flat_breakout-full-market.json").read_text())
    assert [h["code"] for h in made["hits"]] == ["600001"] and made["nearMisses"][0]["failedGates"] == ["deep_drawdown"]
    assert made["skipped"] == {"st-or-delisting": 1} and made["evaluated"] == 2 and made["summary"]["others"] == 0
    text = (out / "20220401-low_flat_breakout-full-market.md").read_text()
    hit, miss = text.split("## Hits")[1].split("## One gate short")
    assert "| 600001 | Test" in hit and "pass 平台放量突破 (breakoutDate 2022" in hit and "600002" not in hit
    assert "| 600002 | Test" in miss and "| 距高点回撤 |" in miss and "fail 距高点回撤 (drawdownFromHigh" in miss and "| st-or-delisting | 1 |" in miss
    for bad in (["--params", "nothing=1"], ["--codes", "abc"], ["--strategy", "none"], ["--predicate", '{"all": []}'], ["--params", "minBars=x"]):
        assert cli.main(["scan", *common, *bad], spark) == 2
    assert cli.main(["scan", *common, "--predicate", '{"not": "deep_drawdown"}', "--codes", "600002", "--out", str(out)], spark) == 0
    for what, n in (("strategies", 3), ("filters", 15), ("sources", 3)):
        capsys.readouterr()
        assert cli.main([what], spark) == 0 and len(capsys.readouterr().out.strip().splitlines()) == n


def test_merging_touches_only_the_years_of_new_bars(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    bar = lambda code, date, x: (code, date, x, x, x, x, 1.0, None, None)
    frame = lambda *rows: spark.createDataFrame(list(rows), BARS)
    store.write_bars("sina", frame(bar("600001", "20231229", 1.0), bar("600001", "20240102", 2.0), bar("600002", "20231229", 3.0)))
    before = sorted(p.name for p in tmp_path.rglob("year=2023/**/*.parquet"))
    store.merge_bars("sina", frame(bar("600001", "20240102", 9.0), bar("600001", "20240103", 4.0)))
    assert sorted(p.name for p in tmp_path.rglob("year=2023/**/*.parquet")) == before
    got = {(r.code, r.date): r.close for r in store.bars("sina").collect()}
    assert got == {("600001", "20231229"): 1.0, ("600001", "20240102"): 9.0, ("600001", "20240103"): 4.0, ("600002", "20231229"): 3.0}
    assert store.bars("sina", "20240101").count() == 2 and store.years("sina") == ["2023", "2024"]
    new = frame(bar("600001", "20240105", 7.0))
    store.merge_bars("sina", new, instead_of=new.select("code"))
    assert {(r.code, r.date) for r in store.bars("sina").collect()} == {("600001", "20240105"), ("600002", "20231229")}


def test_a_damaged_version_is_passed_over(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("stocks", spark.createDataFrame([stock("600001")], STOCKS))
    store.write("stocks", spark.createDataFrame([stock("600002")], STOCKS))
    for p in (tmp_path / "stocks/v=2").glob("*.parquet"):
        p.write_bytes(b"damaged")
    for p in (tmp_path / "stocks/v=2").glob(".*.crc"):
        p.unlink()
    with pytest.warns(UserWarning, match="can't be read"):
        assert [r.code for r in store.stocks().collect()] == ["600001"]


def test_sync_refreshes_and_names_restated_histories(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"))
    store.write("stocks", spark.createDataFrame([stock("600001"), stock("600002")], STOCKS))
    common = ["sync", "--store", str(tmp_path / "store"), "--source", "eastmoney"]

    def land(name: str, today: str, days: dict[str, dict[str, float]], *more: str) -> str:
        body = lambda d: json.dumps({"data": {"klines": [f"{k},{x},{x},{x},{x},100" for k, x in d.items()]}})
        payloads(spark, *((f"{c}.SH", 0, body(d)) for c, d in days.items())).write.parquet(str(tmp_path / name))
        assert cli.main([*common, "--today", today, "--landed", str(tmp_path / name), *more], spark) == 0
        return capsys.readouterr().out

    def plan(today: str) -> dict[str, int]:
        assert cli.main([*common, "--today", today, "--plan"], spark) == 0
        return json.loads(capsys.readouterr().out)

    assert plan("20240103") == {"load": 2}
    land("a", "20240103", {"600001": {"20240102": 10.0, "20240103": 10.0}, "600002": {"20240102": 5.0, "20240103": 5.0}})
    assert plan("20240103") == {"hit": 2} and plan("20240104") == {"refresh": 2}
    said = land("b", "20240104", {"600001": {"20240103": 10.0, "20240104": 11.0}, "600002": {"20240103": 2.5, "20240104": 2.6}})
    assert "restated" in said and "600002" in said and "600001" not in said.split("restated")[1]
    close = lambda: {(r.code, r.date): r.close for r in store.bars("eastmoney").collect()}
    assert close()["600002", "20240103"] == 5.0 and ("600002", "20240104") not in close() and close()["600001", "20240104"] == 11.0
    assert plan("20240105") == {"refresh": 2}
    land("c", "20240104", {"600002": {"20240103": 2.5, "20240104": 2.6}}, "--refresh")
    assert {k: x for k, x in close().items() if k[0] == "600002"} == {("600002", "20240103"): 2.5, ("600002", "20240104"): 2.6}


def test_a_scan_of_securities_without_bars_fails(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path))
    store.write("stocks", spark.createDataFrame([stock(f"6000{i:02d}") for i in range(12)], STOCKS))
    assert cli.main(["scan", "--store", str(tmp_path), "--today", "20240105", "--out", str(tmp_path / "out")], spark) == 1
    assert "no bars of 12 of 12" in capsys.readouterr().err


def test_time_limit(spark):
    import time

    def slow(it):
        time.sleep(60)
        yield from it

    began = time.time()
    with pytest.raises(TimeoutError), api.limited(spark, 1500):
        spark.range(1).mapInArrow(slow, "id long").collect()
    assert time.time() - began < 40
    with api.limited(spark, 60_000):
        assert spark.range(3).count() == 3


def test_registering(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import filters
    from tickloom.plans.params import Param

    own = filters.Filter("many_bars", "Has many bars.", (Param("leastOwnBars", 10, 1, 1000, True),), lambda p: F.col("bars_analyzed") >= p["leastOwnBars"], lambda p: {"ownBars": F.col("bars_analyzed").cast("double")})
    try:
        filters.register(own)
        with pytest.raises(ValueError):
            filters.register(own)
        assert api.chosen(predicate={"not": "many_bars"}).predicate.filters() == ["many_bars"]
        vendors.register(vendors.Source("files", "Landed files.", "none", vendors.eastmoney))
        assert api.Settings.of(dataSource="files").values["dataSource"] == "files"
        with pytest.raises(ValueError):
            vendors.register(vendors.Source("files", "Landed files.", "none", vendors.eastmoney))
    finally:
        filters.FILTERS.pop("many_bars", None)
        vendors.SOURCES.pop("files", None)


def test_text_report():
    from tickloom import report

    hit = {"code": "600001", "name": "Name", "board": "main", "evidence": {"drawdownFromHigh": 0.7, "annualVol": None, "close": 3.0}}
    text = report.text([hit], "flat_base_low", "sina", 9, {"bse": 2}, ["a note"])
    assert "9 securities scanned, 1 matched" in text and "drawdownFromHigh" in text and "annualVol" not in text and '{"bse": 2}' in text and "Note: a note" in text
    assert "No security matched" in report.text([], "x", "sina", 9, {})
