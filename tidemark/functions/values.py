"""Scalar value rules: canonical text, fees, shares, dividend tax."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .times import months_after_rolling

TICK_TOLERANCE = 0.005
HALF_TICK = 0.005
LIMIT_NOISE = 1e-9
STAMP_DUTY_CUTOVER = "20230828"
DIVIDEND_TAX_CUTOVER = "20150908"
DIVIDEND_TAX_FLOOR = "20130101"


def canonical(value: Column, kind: T.DataType | None = None) -> Column:
    """One text per value: ``1.0``, ``1`` and ``1e0`` agree, empty markers are ''.

    Every digit counts: a number is written out plainly, whatever its length.
    Only exponents beyond three digits keep a power, of one fixed form. A known
    ``kind`` of column picks the cheapest form when the plan is made.
    """
    text = F.trim(value.cast("string"))
    if isinstance(kind, (T.IntegralType, T.DateType, T.BooleanType)):
        return F.coalesce(value.cast("string"), F.lit(""))
    if isinstance(kind, T.DecimalType):
        short = F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if kind.scale else text
        return F.when(text.isNull(), F.lit("")).when(value == 0, F.lit("0")).otherwise(short)
    empty = text.isNull() | F.lower(text).isin("nan", "none", "nat", "")
    # Only a text that begins like a number can be one.
    numeric = F.instr(F.lit("+-.0123456789"), F.substring(text, 1, 1)) > 0
    plain = text.rlike(r"^(0|-?[1-9]\d*|-?(0|[1-9]\d*)\.\d*[1-9])$")
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,8})?$")
    return F.when(empty, F.lit("")).when(~numeric, text).when(plain, text).when(number, _written_out(text)).otherwise(text)


def _written_out(text: Column) -> Column:
    """A decimal number without leading or trailing zeros and without an exponent."""

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def spell(sign: Column, significant: Column, point: Column) -> Column:
        size = F.length(significant)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), significant)
        large = F.concat(significant, F.repeat(F.lit("0"), point - size))
        mixed = F.concat(F.substring(significant, F.lit(1), point), F.lit("."), F.substring(significant, point + 1, size))
        far = F.concat(F.lit("0."), significant, F.lit("e"), point.cast("string"))
        body = F.when(F.abs(point) > 999, far).when(point <= 0, small).when(point >= size, large).otherwise(mixed)
        return F.when(size == 0, F.lit("0")).otherwise(F.concat(F.when(sign == "-", F.lit("-")).otherwise(F.lit("")), body))

    def places(parts: Column) -> Column:
        # The decimal point stands behind this many of the digits from the first that is not zero.
        point = F.length(parts["whole"]) - (F.length(parts["digits"]) - F.length(parts["stripped"])) + parts["exponent"]
        return F.struct(parts["sign"].alias("sign"), F.regexp_replace(parts["stripped"], "0+$", "").alias("significant"), point.alias("point"))

    def strip(parts: Column) -> Column:
        digits = F.concat(parts["whole"], parts["fraction"])
        return F.struct(parts["sign"].alias("sign"), parts["whole"].alias("whole"), digits.alias("digits"), F.regexp_replace(digits, "^0+", "").alias("stripped"), F.coalesce(parts["power"].try_cast("int"), F.lit(0)).alias("exponent"))

    groups = ("sign", "whole", "fraction", "power")
    parsed = F.struct(*(F.regexp_extract(text, r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", i + 1).alias(name) for i, name in enumerate(groups)))
    return let(parsed, lambda p: let(strip(p), lambda q: let(places(q), lambda v: spell(v["sign"], v["significant"], v["point"]))))


def digest_number(*parts: Column) -> Column:
    """A number of 60 bits from the MD5 of the parts' texts, for draws that any engine can repeat."""
    text = F.concat_ws("|", *(part.cast("string") for part in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: Fixed value: the prime that numbers of draws are taken modulo.
DRAW_PRIME = 2_147_483_647


def start_number(text: str) -> int:
    """:func:`draw_start` of one text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % (DRAW_PRIME - 1) + 1


def draw_factor(seed: int, draw: int) -> int:
    """The factor of one draw, from the MD5 of seed and draw."""
    return start_number(f"{seed}|{draw}")


def draw_start(*parts: Column) -> Column:
    """The number of whatever is drawn for, from the MD5 of its parts; never 0."""
    return F.pmod(digest_number(*parts), F.lit(DRAW_PRIME - 1)) + 1


def usable_price(value: Column) -> Column:
    """A finite positive number, else null."""
    number = value.cast("double")
    return F.when((number > 0) & ~F.isnan(number) & (number < float("inf")), number)


@dataclass(frozen=True)
class Profile:
    """Account terms: costs in basis points, permissions."""

    commission_bps: float = 2.5
    min_commission: float = 5.0
    transfer_fee_bps: float = 0.1
    stamp_duty_bps_before: float = 10.0
    stamp_duty_bps_after: float = 5.0
    slippage_bps: float = 10.0
    permitted_boards: tuple[str, ...] | None = None


def trade_fee(notional: Column, profile: Profile) -> Column:
    commission = F.greatest(notional * profile.commission_bps / 10_000.0, F.lit(profile.min_commission))
    return commission + notional * profile.transfer_fee_bps / 10_000.0


def stamp_duty(notional: Column, action: Column, trade_date: Column, profile: Profile) -> Column:
    """Sell-side only; the rate changed on one day. ``trade_date`` is YYYYMMDD."""
    bps = F.when(trade_date >= STAMP_DUTY_CUTOVER, F.lit(profile.stamp_duty_bps_after)).otherwise(F.lit(profile.stamp_duty_bps_before))
    return F.when(action == "sell", notional * bps / 10_000.0).otherwise(F.lit(0.0))


def price_reset(last_close: Column, pre_close: Column) -> Column:
    return F.round(F.abs(pre_close - last_close), 6) > TICK_TOLERANCE


def share_multiplier(last_close: Column, pre_close: Column, cash: Column) -> Column:
    """Shares per share implied by an opening reset; null when none change."""
    ratio = F.try_divide(last_close - cash, pre_close)
    cash_only = (cash > 0) & (F.round(last_close - cash - pre_close, 6) <= TICK_TOLERANCE)
    refused = F.raise_error(F.lit("reset implies an invalid share multiplier")).cast("double")
    valid = F.when(ratio > 0, ratio).otherwise(refused)
    return F.when(price_reset(last_close, pre_close) & ~cash_only, valid)


def whole_shares(quantity: Column, ratio: Column) -> Column:
    return F.floor(F.round(quantity * F.coalesce(ratio, F.lit(1.0)), 6)).cast("long")


def dividend_tax_rate(acquired: Column, sold: Column, record_date: Column) -> Column:
    """Final rate by holding period under the rule of the record date (dates)."""
    old = record_date < F.to_date(F.lit(DIVIDEND_TAX_CUTOVER), "yyyyMMdd")
    refused = F.raise_error(F.lit("holding period or record date outside the tax rules")).cast("double")
    bad = (sold <= acquired) | (record_date < F.to_date(F.lit(DIVIDEND_TAX_FLOOR), "yyyyMMdd"))
    return (
        F.when(bad, refused)
        .when(sold <= months_after_rolling(acquired, 1), F.lit(0.20))
        .when(sold <= months_after_rolling(acquired, 12), F.lit(0.10))
        .when(old, F.lit(0.05))
        .otherwise(F.lit(0.0))
    )


def dividend_tax_withheld(record_date: Column) -> Column:
    """Share of the income already withheld when it was paid."""
    return F.when(record_date < F.to_date(F.lit(DIVIDEND_TAX_CUTOVER), "yyyyMMdd"), F.lit(0.05)).otherwise(F.lit(0.0))
