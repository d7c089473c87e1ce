"""Order pricing against a day's bar, without account state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import board, valid_buy_lot
from ..functions.values import HALF_TICK, LIMIT_NOISE, Profile, share_multiplier, stamp_duty, trade_fee, usable_price
from .panel import last_close


def session_price(session: Column, action: Column, limit_price: Column) -> Column:
    """Price a session order meets before slippage and gates."""
    opening, closing = usable_price(F.col("open")), usable_price(F.col("close"))
    average = F.try_divide(usable_price(F.col("amount")), usable_price(F.col("vol")))
    better = F.when(opening.isNotNull(), F.when(action == "buy", F.least(opening, limit_price)).otherwise(F.greatest(opening, limit_price)))
    return F.when(session == "open", opening).when(session == "close", closing).when(limit_price.isNull(), average).otherwise(better)


def with_bars(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Orders joined with their day's bar; ``has_bar`` tells a missing one."""
    return orders.join(bars.withColumn("has_bar", F.lit(True)), ["trade_date", "ts_code"], "left").na.fill(False, ["has_bar"])


def price_orders(orders: DataFrame, bars: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Status, reason and fill price of each order under the stateless gates.

    Gates apply in order: permitted board, bar present, halt, usable price, buy
    lot, adverse price limit, locked day, limit price reached.
    """
    df = with_bars(orders, bars)
    action, session, limit_price = F.col("action"), F.col("session"), F.col("limit_price")
    buy = action == "buy"
    base = session_price(session, action, limit_price)
    slipped = base * (1.0 + F.when(buy, 1.0).otherwise(-1.0) * profile.slippage_bps / 10_000.0)
    limit = usable_price(F.when(buy, F.col("up_limit")).otherwise(F.col("down_limit")))
    high, low = usable_price(F.col("high")), usable_price(F.col("low"))
    reaches = F.when(buy, slipped >= limit - LIMIT_NOISE).otherwise(slipped <= limit + LIMIT_NOISE)
    locked = (F.abs(high - limit) < HALF_TICK) & (F.abs(low - limit) < HALF_TICK)
    touched = F.when(buy, low <= limit_price + HALF_TICK).otherwise(high >= limit_price - HALF_TICK)
    intraday = session == "intraday"
    allowed = board(F.col("ts_code")).isin(*profile.permitted_boards) if profile.permitted_boards else F.lit(True)
    reason = (
        F.when(buy & ~F.coalesce(allowed, F.lit(False)), "board_not_permitted")
        .when(~F.col("has_bar"), "missing_execution_price")
        .when(F.coalesce("is_suspended", F.lit(False)), "suspended")
        .when(base.isNull(), "missing_execution_price")
        .when(buy & ~valid_buy_lot(F.col("quantity"), F.col("ts_code")), "invalid_buy_lot")
        .when(limit.isNull(), "missing_daily_price_limit")
        .when(~intraday & reaches, "unfilled_price_limit")
        .when(intraday & (high.isNull() | low.isNull()), "missing_execution_price")
        .when(intraday & locked, "unfilled_locked")
        .when(intraday & limit_price.isNotNull() & ~touched, "unfilled_limit")
    )
    held = F.when(buy, F.least(slipped, limit)).otherwise(F.greatest(slipped, limit))
    price = F.when(~intraday, slipped).when(limit_price.isNull(), held).otherwise(base)
    priced = df.withColumns({"reason": reason, "fill_price": F.when(reason.isNull(), price)})
    return priced.withColumn("status", F.when(F.col("reason").isNull(), "filled").otherwise("rejected"))


def add_fees(fills: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """``fee`` (commission floor plus transfer fee) and sell-side ``stamp_duty``."""
    notional = F.col("price") * F.col("quantity")
    return fills.withColumns({
        "notional": notional, "fee": trade_fee(notional, profile),
        "stamp_duty": stamp_duty(notional, F.col("action"), F.col("trade_date"), profile),
    })


def share_multipliers(daily: DataFrame, cash: DataFrame) -> DataFrame:
    """Ex-date share multiplier per (code, day); null where shares do not change."""
    carried = last_close(daily)
    joined = carried.join(cash, ["trade_date", "ts_code"], "left")
    ratio = share_multiplier(F.col("last_close"), usable_price(F.col("pre_close")), F.coalesce("cash_per_share", F.lit(0.0)))
    return joined.withColumn("multiplier", ratio)
