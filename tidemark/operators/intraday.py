"""Minute bars reduced to one row per stock-day.

A (code, day) holds one bar per grid label, at most 241 rows, so its ordered
window is small whatever the table size; a heavy code spreads over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import market_bucket
from ..functions.times import date_text, market_time
from .auction import correct_auction
from .ordered import day_quantiles, keep_last

DAY = ["ts_code", "trade_date"]
BARS_PER_DAY = 241
SEALED_SHARE = 0.5
TINY = 1e-12


def _clock(column: str = "trade_time"):
    return F.substring(column, 12, 5)


def intraday_flow(minutes: DataFrame) -> DataFrame:
    """Tick-rule order flow between contiguous minutes of a stock-day.

    The auction has no earlier bar and the first bar after lunch is not
    contiguous; Beijing names and days without volume are left out.
    """
    bars = minutes.where(~F.col("ts_code").endswith(".BJ"))
    order = Window.partitionBy(*DAY).orderBy("trade_time")
    bars = bars.withColumns({"_prev": F.lag("close").over(order), "_prev_hour": F.lag(F.substring("trade_time", 12, 2)).over(order)})
    lunch = (F.col("_prev_hour") == "11") & (F.substring("trade_time", 12, 2) == "13")
    contiguous = F.coalesce((F.col("close") > 0) & (F.col("_prev") > 0) & ~lunch, F.lit(False))
    sign = F.when(contiguous, F.signum(F.col("close") - F.col("_prev"))).otherwise(0.0)
    day = bars.groupBy(*DAY).agg(
        F.sum(sign * F.col("vol")).alias("_sv"), F.sum("vol").alias("_v"),
        F.sum(sign * F.col("amount")).alias("_sa"), F.sum("amount").alias("_a"),
        F.count_if(contiguous).alias("nret"), F.count_if(F.col("vol") <= 0).alias("_zero"),
    )
    zero_share = F.col("_zero") / F.lit(float(BARS_PER_DAY))
    return day.where(F.col("_v") > 0).select(
        *DAY, (F.col("_sv") / F.col("_v")).alias("ofi_1d"), (F.col("_sa") / F.greatest("_a", F.lit(TINY))).alias("ofi_amt_1d"),
        "nret", zero_share.alias("zero_share"), (zero_share >= SEALED_SHARE).alias("sealed_limit"),
    )


def intraday_stats(minutes: DataFrame) -> DataFrame:
    """Realised moments, segment returns and volume profile of a stock-day.

    Returns run from the first traded bar, whose first return starts at its
    open. The three normalised moments are null on a day that never moved.
    """
    clock = _clock()
    on_grid = clock.between("09:30", "11:30") | clock.between("13:01", "15:00")
    bars = minutes.where(~F.col("ts_code").endswith(".BJ") & on_grid)
    bad = ~((F.col("open") > 0) & (F.col("close") > 0)) | F.col("open").isNull() | F.col("close").isNull()
    refused = F.raise_error(F.lit("minute bar without a positive price")).cast("double")
    order = Window.partitionBy(*DAY).orderBy("trade_time")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumns({
        "_close": F.when(bad, refused).otherwise(F.col("close")), "_clock": clock,
        "_traded": F.sum(F.when(F.col("vol") > 0, 1).otherwise(0)).over(upto), "_before": F.lag("close").over(order),
    })
    bars = bars.withColumn("_was", F.lag("_traded").over(order))
    path = F.col("_traded") > 0
    starts = path & (F.coalesce("_was", F.lit(0)) == 0)
    ret = F.when(path, F.log(F.col("_close") / F.when(starts, F.col("open")).otherwise(F.col("_before"))))
    bars = bars.withColumns({"_r": ret, "_start": starts})
    r = F.col("_r")
    last_by = lambda limit: F.max_by("_close", F.when(path & (F.col("_clock") <= limit), F.col("trade_time")))
    day = bars.groupBy(*DAY).agg(
        F.sum("vol").alias("_v"), F.sum("amount").alias("_a"), F.count(F.lit(1)).alias("n_bars"), F.count("_r").alias("_n"),
        F.sum(r * r).alias("_rv"), F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("_down"), F.sum(F.when(r > 0, r * r).otherwise(0.0)).alias("_up"),
        F.sum(r * r * r).alias("_r3"), F.sum(r * r * r * r).alias("_r4"),
        F.max(F.when(F.col("_start"), F.col("open"))).alias("_open"),
        last_by("10:00").alias("_p10"), last_by("14:30").alias("_p1430"), last_by("15:00").alias("_pc"),
        F.sum(F.when(F.col("_clock") <= "10:00", F.col("vol")).otherwise(0.0)).alias("_v_open"),
        F.sum(F.when(F.col("_clock") > "14:30", F.col("vol")).otherwise(0.0)).alias("_v_close"),
    )
    day = day.where(F.col("_v") > 0).withColumns({
        "_p10": F.coalesce("_p10", "_open"), "_p1430": F.coalesce("_p1430", "_open"), "_pc": F.coalesce("_pc", "_open"),
    })
    rv, moved = F.col("_rv"), F.col("_rv") > 0
    return day.select(
        *DAY, rv.alias("rv"),
        F.when(moved, F.col("_down") / rv).alias("rv_down_share"),
        F.when(moved, F.sqrt("_n") * F.col("_r3") / F.pow(rv, 1.5)).alias("rsk"),
        F.when(moved, F.col("_n") * F.col("_r4") / (rv * rv)).alias("rku"),
        (F.col("_up") - F.col("_down")).alias("sjv"),
        (F.col("_p10") / F.col("_open") - 1).alias("ret_open30"), (F.col("_p1430") / F.col("_p10") - 1).alias("ret_mid"),
        (F.col("_pc") / F.col("_p1430") - 1).alias("ret_close30"), (F.col("_pc") * F.col("_v") / F.col("_a") - 1).alias("vwap_dev"),
        (F.col("_v_open") / F.col("_v")).alias("vol_open30_share"), (F.col("_v_close") / F.col("_v")).alias("vol_close30_share"), "n_bars",
    )


def path_bars(minutes: DataFrame) -> DataFrame:
    """Bars of each stock-day from its first traded bar on."""
    upto = Window.partitionBy(*DAY).orderBy("trade_time").rowsBetween(Window.unboundedPreceding, 0)
    marked = minutes.withColumn("_traded", F.sum(F.when(F.col("vol") > 0, 1).otherwise(0)).over(upto))
    return marked.where(F.col("_traded") > 0).drop("_traded")


def last_at_labels(minutes: DataFrame, labels: dict[str, str], default: str = "open") -> DataFrame:
    """Close at or before each ``HH:MM`` label, else the path's first open."""
    path = path_bars(minutes)
    opening = F.min_by(default, F.col("trade_time"))
    picks = [
        F.coalesce(F.max_by("close", F.when(_clock() <= label, F.col("trade_time"))), opening).alias(name) for name, label in labels.items()
    ]
    return path.groupBy(*DAY).agg(*picks)


def auction_alignment(minutes: DataFrame, auctions: DataFrame, daily: DataFrame) -> DataFrame:
    """Quantiles per bucket and day of minute/auction and minute/daily ratios.

    The 09:30 bar, as served and corrected, is set against the auction; the
    day's minute sum against the daily bar.
    """
    corrected = correct_auction(minutes)
    opening = corrected.where("auction_open_bar").select(*DAY, F.col("vol").alias("_raw"), F.col("vol_pit").alias("_pit"), F.col("amount").alias("_amount"))
    against = opening.join(auctions.select(*DAY, F.col("vol").alias("_auction"), F.col("amount").alias("_auction_amount")), DAY)
    sums = minutes.groupBy(*DAY).agg(F.sum("vol").alias("_sum_vol"), F.sum("amount").alias("_sum_amount"))
    whole = sums.join(daily.select(*DAY, F.col("vol").alias("_day_vol"), F.col("amount").alias("_day_amount")), DAY)
    shape = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.alias("ratio"))
    left = against.select(*DAY, F.explode(F.array(
        shape("raw_vol", F.try_divide("_raw", "_auction")), shape("corrected_vol", F.try_divide("_pit", "_auction")),
        shape("raw_amount", F.try_divide("_amount", "_auction_amount")))).alias("m"))
    right = whole.select(*DAY, F.explode(F.array(
        shape("sum_vol", F.try_divide("_sum_vol", "_day_vol")), shape("sum_amount", F.try_divide("_sum_amount", "_day_amount")))).alias("m"))
    rows = left.unionByName(right).select("trade_date", market_bucket(F.col("ts_code")).alias("bucket"), "m.metric", "m.ratio").where("ratio is not null")
    groups = ["trade_date", "bucket", "metric"]
    cuts = day_quantiles(rows, groups, "ratio", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("names"))
    return cuts.join(counts, groups)


def minute_sums(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Mean ratio of summed minute volume and amount to the daily table, by market bucket.

    ``daily`` has the totals ``vol`` and ``amount`` of each stock-day; days that
    either side lacks are left out.
    """
    sums = bars.groupBy("ts_code", "trade_date").agg(F.sum("vol").alias("_v"), F.sum("amount").alias("_a"))
    both = sums.join(daily.select("ts_code", "trade_date", "vol", "amount"), ["ts_code", "trade_date"])
    return both.groupBy(market_bucket(F.col("ts_code")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("stock_days"), F.avg(F.try_divide("_v", "vol")).alias("vol_ratio"), F.avg(F.try_divide("_a", "amount")).alias("amount_ratio"))


def normalise_minutes(df: DataFrame, trade_date: str | None = None, order: str = "row_no") -> DataFrame:
    """Trim, date and stamp minute bars, keep the last of each (code, time)."""
    code, time = F.trim("ts_code"), F.trim(F.col("trade_time").cast("string"))
    out = df.withColumns({"ts_code": code, "trade_time": time})
    stamp = market_time(F.col("trade_time"))
    day = F.coalesce(date_text(stamp), F.lit(""))
    if "trade_date" in df.columns:
        given = F.trim("trade_date")
        day = F.when(F.coalesce(given, F.lit("")) == "", day).otherwise(given)
    out = out.withColumns({"trade_date": day, "available_at": stamp, "available_at_rule": F.lit("source:trade_time_bar_close")})
    out = out.where(F.col("trade_date") == trade_date) if trade_date else out
    return keep_last(out, ["ts_code", "trade_time"], order)


def validate_minutes(df: DataFrame, expected: DataFrame, min_rows: int) -> DataFrame:
    """Per day: duplicates, wrong dates, unreadable clocks, missing edge bars, codes."""
    stamp = market_time(F.col("trade_time"))
    rows = df.groupBy("trade_date", "ts_code", "trade_time").agg(F.count(F.lit(1)).alias("_n"), F.first(stamp).alias("_at"))
    per_code = rows.groupBy("trade_date", "ts_code").agg(
        F.sum("_n").alias("_rows"), F.sum(F.col("_n") - 1).alias("_dupes"), F.count_if(F.col("_at").isNull()).alias("_unreadable"),
        F.count_if(F.coalesce(date_text(F.col("_at")) != F.col("trade_date"), F.lit(False))).alias("_wrong"),
        F.max(F.when(_clock() == "09:30", 1).otherwise(0)).alias("_open"), F.max(F.when(_clock() == "15:00", 1).otherwise(0)).alias("_close"),
    )
    want = expected.select("trade_date", "ts_code").distinct().withColumn("_want", F.lit(1))
    both = per_code.join(want, ["trade_date", "ts_code"], "full_outer")
    return both.groupBy("trade_date").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_dupes"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_unreadable"), F.lit(0)).alias("unreadable"), F.coalesce(F.sum("_wrong"), F.lit(0)).alias("wrong_date"),
        F.count_if(F.col("_open") == 0).alias("without_open"), F.count_if(F.col("_close") == 0).alias("without_close"),
        F.count_if(F.col("_rows") < min_rows).alias("short_codes"),
        F.count_if(F.col("_rows").isNull()).alias("missing_codes"), F.count_if(F.col("_want").isNull()).alias("extra_codes"),
    )
