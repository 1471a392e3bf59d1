"""Rules of the market: boards, exchanges, daily limits, special treatment, and what vendors call a security."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least return of a limit-up day by board, and for special treatment on the main board.
LIMITS = {"main": 0.098, "chinext": 0.198, "star": 0.198, "bse": 0.298}
SPECIAL_LIMIT = 0.048


def board_of(code: Column) -> Column:
    """The board of a six-digit code; null where there is none, which keeps the security out."""
    return (
        F.when(code.startswith("68"), "star")
        .when(code.startswith("6"), "main")
        .when(code.startswith("00"), "main")
        .when(code.startswith("30"), "chinext")
        .when(code.rlike("^(4|8|92)"), "bse")
    )


def exchange_of(code: Column) -> Column:
    return F.when(code.startswith("6"), "SH").when(code.rlike("^(4|8|92)"), "BJ").otherwise("SZ")


def full_code(code: Column) -> Column:
    return F.concat(code, F.lit("."), exchange_of(code))


def limit_of(board: Column, name: Column) -> Column:
    """The return from which on a day counts as limit-up."""
    by_board = F.coalesce(*[F.when(board == b, F.lit(x)) for b, x in LIMITS.items()])
    return F.when((board == "main") & name.contains("ST"), F.lit(SPECIAL_LIMIT)).otherwise(by_board)


def is_special(name: Column) -> Column:
    """Special treatment, or about to be delisted."""
    return name.contains("ST") | name.contains("退")


def vendor_symbol(full: Column) -> Column:
    """600962.SH as sh600962."""
    return F.concat(F.lower(F.substring_index(full, ".", -1)), F.substring_index(full, ".", 1))


def security_id(full: Column) -> Column:
    """600962.SH as 1.600962; other exchanges have 0."""
    return F.concat(F.when(full.endswith(".SH"), "1.").otherwise("0."), F.substring_index(full, ".", 1))


def date_digits(raw: Column) -> Column:
    """The first eight digits of a date in any notation."""
    return F.substring(F.regexp_replace(raw.cast("string"), r"\D", ""), 1, 8)


def tag(raw: Column) -> Column:
    """A trimmed text; null for an empty one or a dash."""
    t = F.trim(raw)
    return F.when((t != "") & (t != "-"), t)
