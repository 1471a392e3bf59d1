"""Series for tests: bars of made-up securities, as plain rows."""

from __future__ import annotations

from datetime import date, timedelta

STOCK = {"code": "600001", "full_code": "600001.SH", "name": "Test", "board": "main", "list_date": "20100101", "industry": None, "total_cap": None, "float_cap": None}
STOCKS = "code string, full_code string, name string, board string, list_date string, industry string, total_cap double, float_cap double"
BARS = "code string, date string, close double, volume double, amount double, pre_close double"


def day(i: int) -> str:
    return (date(2020, 1, 1) + timedelta(days=i)).strftime("%Y%m%d")


def stock(code: str, **other) -> tuple:
    row = STOCK | {"code": code, "full_code": f"{code}.SH"} | other
    return tuple(row[c.split()[0]] for c in STOCKS.split(", "))


def rows(code: str, close: list[float], volume: list[float], amount: list | None = None, pre: list | None = None) -> list[tuple]:
    n = len(close)
    return [(code, day(i), float(close[i]), float(volume[i]), (amount or [None] * n)[i], (pre or [None] * n)[i]) for i in range(n)]


def by_returns(code: str, ret: list[float], volume: list[float]) -> list[tuple]:
    """Bars whose returns are exactly as given, the first bar's included."""
    close, at = [], 10.0
    for r in ret:
        at *= 1 + r
        close.append(at)
    return [(code, day(i), c, float(volume[i]), None, c / (1 + r)) for i, (c, r) in enumerate(zip(close, ret, strict=True))]


def limit_up_series() -> tuple[list[float], list[float]]:
    close = [10 * 0.28 ** (i / 649) for i in range(650)]
    for i in range(650, 740):
        close.append(2.8 * (1.001 if i % 2 == 0 else 0.999))
    close.append(close[739] * 1.1)
    close += [3.02 - 0.3 * (j / 14) for j in range(15)]
    close += [2.72 * (1.0005 if i % 2 == 0 else 0.9995) for i in range(756, 800)]
    volume = [1000.0] * 740 + [3500.0] + [1500 - 40 * j for j in range(15)] + [300.0] * 44
    return close, volume


def flat_series() -> tuple[list[float], list[float]]:
    close = limit_up_series()[0][:740]
    close += [2.8 - 0.08 * (j / 14) for j in range(15)]
    close += [2.72 * (1.0005 if i % 2 == 0 else 0.9995) for i in range(755, 800)]
    return close, [1000.0] * 800


def breakout_series(h: float = 0.28) -> tuple[list[float], list[float]]:
    base = 10 * h
    close = [10 * h ** (i / 649) for i in range(650)]
    close += [base * (1.001 if i % 2 == 0 else 0.999) for i in range(650, 789)]
    close += [base * 1.06] * 11
    volume = [1000.0] * 800
    volume[789] = 3000.0
    return close, volume
