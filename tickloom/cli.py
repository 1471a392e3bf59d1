"""The command line: sync, scan, strategies, filters, sources, help.

Securities and bars are read from a store (sources/store.py). sync takes payloads that the fetch stage has landed as
Parquet: listing pages (page, body) and daily bars (full_code, page, body).
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import api, report
from tickloom.operators.bars import acquisition, mergeable
from tickloom.operators.universe import too_many_failures, universe, whitelisted
from tickloom.plans import screen as scr
from tickloom.sources import vendors
from tickloom.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tickloom", description="Screens daily price and volume histories.")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("strategies", "filters", "sources", "help"):
        sub.add_parser(name)
    for name in ("sync", "scan"):
        p = sub.add_parser(name)
        p.add_argument("--store", required=True, help="folder of stored securities and bars")
        p.add_argument("--source", default="sina", choices=list(vendors.SOURCES))
        p.add_argument("--codes", help="six-digit codes with commas between")
        p.add_argument("--board", help="a board's name; needs --boards and --members")
        p.add_argument("--boards", help="landed pages of boards (kind, page, body)")
        p.add_argument("--members", help="landed pages of members (board_id, page, body)")
        p.add_argument("--today", default=datetime.now().strftime("%Y%m%d"), help="yyyyMMdd")
        p.add_argument("--history-bars", type=int, default=800)
        p.add_argument("--min-list-days", type=int, default=365)
        p.add_argument("--max-list-days", type=int, default=0)
    sub.choices["sync"].add_argument("--listing", help="landed pages of the listing")
    sub.choices["sync"].add_argument("--landed", help="landed daily bars")
    sub.choices["sync"].add_argument("--refresh", action="store_true", help="landed bars replace all stored ones of their securities")
    sub.choices["sync"].add_argument("--plan", action="store_true", help="only say what securities need: load, backfill, retry, refresh, hit")
    scan = sub.choices["scan"]
    scan.add_argument("--strategy", help="a strategy's id; low_flat_limit_up without a predicate")
    scan.add_argument("--predicate", help="a predicate in JSON")
    scan.add_argument("--params", default="", help="k=v,k2=v2")
    scan.add_argument("--top", type=int, default=30)
    scan.add_argument("--out", default="reports")
    scan.add_argument("--timeout-ms", type=int, default=1_800_000)
    return top


def codes_of(raw: str | None) -> list[str] | None:
    """Six-digit codes; an argument that holds none is an error rather than the whole market."""
    if raw is None or not raw.strip():
        return None
    found = [c for c in (x.strip() for x in raw.split(",")) if re.fullmatch(r"\d{6}", c)]
    if not found:
        raise ValueError(f"no six-digit code in {raw!r}")
    return found


def scope(spark: SparkSession, args: argparse.Namespace) -> tuple[list[str] | DataFrame | None, str, str]:
    """The codes to restrict to, a label, and a name for files."""
    if (codes := codes_of(args.codes)) is not None:
        return codes, f"{len(codes)} codes", f"codes-{len(codes)}"
    if not args.board:
        return None, "whole market", "full-market"
    known = vendors.boards(spark.read.parquet(args.boards))
    found = vendors.find_boards(known, args.board)
    ids = found.select("board_id").distinct()
    if found.isEmpty():
        like = [r.name for r in vendors.suggest_boards(known, args.board, 8).collect()]
        raise ValueError(f"no board {args.board!r}" + (f"; there are {', '.join(like)}" if like else ""))
    pages = spark.read.parquet(args.members).join(ids, "board_id", "left_semi")
    return vendors.members(pages), args.board, args.board


def given_params(raw: str, docs: dict[str, api.Param]) -> dict[str, object]:
    out: dict[str, object] = {}
    for part in filter(None, raw.split(",")):
        key, eq, value = (x.strip() for x in part.partition("="))
        if not eq or not key:
            raise ValueError(f"parameters are written k=v,k2=v2; this is {part!r}")
        if key not in docs:
            raise ValueError(f"unknown parameter {key}; there are {', '.join(docs)}")
        out[key] = docs[key].parse(value)
    return out


def settings_of(args: argparse.Namespace) -> api.Settings:
    given = {"scanTimeoutMs": args.timeout_ms} if args.command == "scan" else {}
    return api.Settings.of(historyBars=args.history_bars, minListDays=args.min_list_days, maxListDays=args.max_list_days, dataSource=args.source, **given)


def sync(spark: SparkSession, args: argparse.Namespace) -> str:
    """Stores landed securities and merges landed bars; fails if most securities of the universe had none.

    Securities whose history the source has restated are left as they are and named, to be landed anew with --refresh.
    """
    store, settings = Store(spark, args.store), settings_of(args)
    if args.listing:
        store.write("stocks", vendors.stocks(spark.read.parquet(args.listing)))
    codes, label, _ = scope(spark, args)
    wanted = whitelisted(universe(store.stocks(), settings.rules(args.today)), codes)
    n, start = wanted.count(), settings.history_start(args.today)
    if args.plan:
        plan = acquisition(wanted, store.files(args.source), start, api.expected_trading_day(args.today), args.today)
        return json.dumps({r.action: r.n for r in plan.groupBy("action").agg(F.count("*").alias("n")).orderBy("action").collect()})
    again: list[str] = []
    if args.landed:
        payloads = spark.read.parquet(args.landed)
        new = vendors.window(vendors.source(args.source).parse(payloads), start).join(wanted.select("code"), "code", "left_semi").persist()
        asked = wanted.select("code").join(payloads.select(F.substring_index("full_code", ".", 1).alias("code")).distinct(), "code", "left_semi")
        if args.refresh:
            store.merge_bars(args.source, new, instead_of=new.select("code").distinct())
        else:
            ready, restated = mergeable(store.bars(args.source), new)
            again = [r.code for r in restated.orderBy("code").collect()]  # codes of securities, a few thousand at most
            store.merge_bars(args.source, ready if not again else new.where(~F.col("code").isin(again)).select(*ready.columns))
            asked = asked.where(~F.col("code").isin(again)) if again else asked
        new.unpersist()
        store.note_files(args.source, asked, args.today, start)
    missing = lacking(wanted, store.bars(args.source))
    if args.landed:
        healthy(missing, n)
    said = f"; restated, to be landed anew with --refresh: {', '.join(again)}" if again else ""
    return f"{label}: {n} securities, {n - missing} with bars from {args.source}{said}"


def lacking(wanted: DataFrame, bars: DataFrame) -> int:
    return wanted.join(bars.select("code").distinct(), "code", "left_anti").count()


def healthy(missing: int, securities: int) -> None:
    """Fails if so many securities have no bars that results would say little about the market."""
    if too_many_failures(missing, securities):
        raise RuntimeError(f"no bars of {missing} of {securities} securities; the source may be down")


def scan(spark: SparkSession, args: argparse.Namespace) -> str:
    store, settings = Store(spark, args.store), settings_of(args)
    predicate = json.loads(args.predicate) if args.predicate else None
    strategy = api.chosen(args.strategy or (None if predicate is not None else "low_flat_limit_up"), predicate)
    params = strategy.resolve(given_params(args.params, strategy.params))
    api.check_source(strategy, args.source)
    codes, label, slug = scope(spark, args)
    rules = settings.rules(args.today)
    bars = store.bars(args.source, settings.history_start(args.today))
    over = scr.Scan(vendors.window(bars, settings.history_start(args.today)), store.stocks(), rules, tuple(codes) if isinstance(codes, list) else codes)
    with api.limited(spark, settings.values["scanTimeoutMs"]):
        candidates = over.candidates()
        missing = lacking(candidates, over.bars)
        healthy(missing, candidates.count())
        made = report.build(scr.diagnose(over, strategy, params), store.stocks(), rules, strategy.id, params, args.source, label, datetime.now().isoformat(timespec="seconds"), codes, args.top)
    if missing:
        made.skipped["no-bars"] = missing
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    name = f"{args.today}-{strategy.id}-{slug}"
    (out / f"{name}.md").write_text(report.markdown(made), encoding="utf-8")
    (out / f"{name}.json").write_text(report.as_json(made), encoding="utf-8")
    return f"{out / name}.md: {len(made.hits)} hits, {len(made.near)} near misses, {made.others} others"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "help":
        parser().print_help()
        return 0
    spark = spark or SparkSession.builder.appName("tickloom").getOrCreate()
    try:
        if args.command in ("sync", "scan"):
            print({"sync": sync, "scan": scan}[args.command](spark, args))
        else:
            listing = {"strategies": api.list_strategies, "filters": api.list_filters, "sources": api.list_sources}[args.command](spark)
            for row in listing.select(F.to_json(F.struct("*"))).collect():
                print(row[0])
    except (ValueError, RuntimeError, TimeoutError) as bad:
        print(bad, file=sys.stderr)
        return 2 if isinstance(bad, ValueError) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
