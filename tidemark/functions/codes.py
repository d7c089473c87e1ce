"""Security-code classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boards by code prefix; Beijing names go by suffix.
BOARD_PREFIXES = {
    "main": ("600", "601", "603", "605", "000", "001", "002", "003"),
    "gem": ("300", "301", "302"),
    "star": ("688", "689"),
}
# Market buckets by suffix and two-digit prefix.
BUCKETS = {
    "sz_main_00": ("00", ".SZ"), "sz_gem_30": ("30", ".SZ"),
    "sh_main_60": ("60", ".SH"), "sh_star_68": ("68", ".SH"),
}
LOT = 100
ANY_SIZE_MINIMUM = {"star": 200, "bj": 100}


def board(code: Column) -> Column:
    """main / gem / star / bj, null for a code on none of them."""
    upper = F.upper(code)
    out = F.when(upper.endswith(".BJ"), F.lit("bj"))
    for name, prefixes in BOARD_PREFIXES.items():
        out = out.when(F.substring(upper, 1, 3).isin(*prefixes), F.lit(name))
    return out


def market_bucket(code: Column) -> Column:
    upper = F.upper(F.trim(code))
    out = F.when(upper.endswith(".BJ"), F.lit("bj"))
    for name, (prefix, suffix) in BUCKETS.items():
        out = out.when(upper.startswith(prefix) & upper.endswith(suffix), F.lit(name))
    return out.otherwise(F.lit("other"))


def any_size_minimum(code: Column) -> Column:
    """Smallest free-size declaration, null where whole lots are required."""
    named, out = board(code), None
    for name, minimum in ANY_SIZE_MINIMUM.items():
        out = F.when(named == name, F.lit(minimum)) if out is None else out.when(named == name, F.lit(minimum))
    return out


def valid_buy_lot(quantity: Column, code: Column) -> Column:
    minimum = any_size_minimum(code)
    return F.when(minimum.isNull(), quantity % LOT == 0).otherwise(quantity >= minimum)


def lot_quantity(money: Column, price: Column, code: Column) -> Column:
    """Largest declarable quantity a sum of money buys; 0 where none fits."""
    minimum = any_size_minimum(code)
    shares = F.floor(F.try_divide(money, price))
    declared = F.when(minimum.isNull(), shares - shares % LOT).otherwise(shares)
    return F.coalesce(F.when(shares >= F.coalesce(minimum, F.lit(LOT)), declared), F.lit(0)).cast("long")
