"""Opening-auction bars: volume correction, cleaning, price recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import market_bucket

# 09:30 bars of two market buckets overstate the auction.
FACTORS = {"sz_main_00": 0.76, "sz_gem_30": 0.58}
RULE = "minute_0930_to_live_stk_auction_by_market_bucket"
PRICE_TOLERANCE = 0.005


def correct_auction(minutes: DataFrame, factors: dict[str, float] = FACTORS) -> DataFrame:
    """Add corrected volume and amount; only the 09:30 bar is scaled."""
    bucket = market_bucket(F.col("ts_code"))
    opening = F.coalesce(F.substring("trade_time", 1, 19).contains("09:30"), F.lit(False))
    factor = F.lit(1.0)
    for name, value in factors.items():
        factor = F.when(opening & (bucket == name), F.lit(value)).otherwise(factor)
    return minutes.withColumns({
        "auction_market_bucket": bucket, "auction_open_bar": opening, "auction_factor": factor,
        "vol_pit": F.col("vol").cast("double") * factor, "amount_pit": F.col("amount").cast("double") * factor,
        "auction_correction_rule": F.when(factor != 1.0, F.lit(RULE)).otherwise(F.lit("")),
    })


def auction_classes(auction: DataFrame) -> DataFrame:
    """Label every auction row: unobserved, no_trade, source, derived or an error."""
    price, vol, amount = (F.col(name).cast("double") for name in ("price", "vol", "amount"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    present = finite(vol) & finite(amount) & (vol >= 0) & (amount >= 0)
    recovered = F.try_divide(amount, vol)
    good_price = finite(price) & (price > 0)
    close_to = F.abs(price - recovered) <= PRICE_TOLERANCE + 1e-9 * F.abs(recovered)
    label = (
        F.when(price.isNull() & vol.isNull() & amount.isNull(), "unobserved")
        .when(present & (vol == 0) & (amount == 0), "no_trade")
        .when(~F.coalesce(present & (vol > 0) & (amount > 0), F.lit(False)), "inconsistent")
        .when(good_price & ~close_to, "price_mismatch")
        .when(good_price, "source")
        .otherwise("derived")
    )
    return auction.withColumns({"price_class": label, "recovered_price": recovered})


def clean_auction(auction: DataFrame) -> DataFrame:
    """Drop unobserved rows, blank prices without trades, recover missing ones.

    Inconsistent quantities or clearing prices fail the job when the rows are
    read; :func:`auction_quality` counts them without failing.
    """
    labelled = auction_classes(auction)
    broken = F.raise_error(F.concat(F.lit("auction row "), F.col("price_class"), F.lit(" "), F.col("ts_code"))).cast("double")
    price = (
        F.when(F.col("price_class") == "source", F.col("price").cast("double"))
        .when(F.col("price_class") == "derived", F.col("recovered_price"))
        .when(F.col("price_class") == "no_trade", F.lit(None).cast("double"))
        .otherwise(broken)
    )
    kept = labelled.where(F.col("price_class") != "unobserved").withColumn("price", price)
    return kept.withColumns({"vol": F.col("vol").cast("double"), "amount": F.col("amount").cast("double")}).drop("recovered_price")


def auction_quality(auction: DataFrame) -> DataFrame:
    """Rows per price class."""
    return auction_classes(auction).groupBy("price_class").agg(F.count(F.lit(1)).alias("rows"))
