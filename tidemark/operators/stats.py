"""Performance statistics of equity curves, return series and fills.

Curves and series have one row per (run, trading day), so a run's ordered
window is bounded by the calendar. Fills are only ever aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import inside
from .style import TRADING_DAYS, curve_returns

RUN = "run_id"


def compounded(value: Column) -> Column:
    """Product of (1 + r) minus one, as a combinable aggregate.

    Logs carry the product; signs and a total loss are tracked apart, so
    returns at or below -100 % keep their exact meaning.
    """
    growth = 1 + value
    size = F.exp(F.sum(F.when(growth != 0, F.log(F.abs(growth)))))
    wiped = F.count_if(growth == 0) > 0
    odd = F.count_if(growth < 0) % 2 == 1
    return F.when(F.count(value) == 0, F.lit(0.0)).when(wiped, F.lit(-1.0)).otherwise(F.when(odd, -F.coalesce(size, F.lit(1.0))).otherwise(F.coalesce(size, F.lit(1.0))) - 1)


def compound(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys).agg(compounded(F.col("value")).alias("compounded"), F.count("value").alias("days"))


def running_growth(value: Column, order) -> Column:
    """Cumulative product of (1 + r) along an ordered window (r > -1)."""
    return F.exp(F.sum(F.log1p(value)).over(order))


def drawdown_path(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Equity compounded from 1 and its fall below the running peak, opening included."""
    order = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    path = series.withColumn("equity", running_growth(F.col(value), order))
    peak = F.greatest(F.lit(1.0), F.max("equity").over(order))
    return path.withColumn("drawdown", (peak - F.col("equity")) / peak).withColumn("cumulative", F.col("equity") - 1)


def curve_drawdown(curve: DataFrame) -> DataFrame:
    order = Window.partitionBy(RUN).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest("initial_equity", F.max("equity").over(order))
    return curve.withColumn("drawdown", F.coalesce(F.try_divide(peak - F.col("equity"), peak), F.lit(0.0)))


def sharpe(value: Column) -> Column:
    """Annualised mean over deviation; 0 where it is not defined."""
    ratio = F.try_divide(F.avg(value), F.stddev_samp(value)) * F.lit(TRADING_DAYS**0.5)
    return F.coalesce(F.when(F.count(value) >= 2, ratio), F.lit(0.0))


def plain_stats(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Annualised mean, deviation and their ratio; fewer than two days measure none."""
    enough = F.count("value") >= 2
    excess = F.avg("value") * TRADING_DAYS
    error = F.stddev_samp("value") * F.lit(TRADING_DAYS**0.5)
    return series.groupBy(*keys).agg(
        F.count("value").alias("days"), F.when(enough, excess).alias("plain_excess"), F.when(enough, error).alias("tracking_error"),
        F.when(enough, F.try_divide(excess, error)).alias("information_ratio"))


def gross_exposure(curve: DataFrame) -> DataFrame:
    """(equity - cash) / equity per day; days without a cash split are left out."""
    gross = F.when(F.col("equity") > 0, (F.col("equity") - F.col("cash")) / F.col("equity")).otherwise(0.0)
    return curve.where("cash is not null").select(RUN, "trade_date", gross.alias("gross"))


_filled = lambda: F.col("status") == "filled"
_notional = lambda: F.coalesce(F.col("price"), F.lit(0.0)) * F.coalesce(F.col("quantity"), F.lit(0))


def fill_totals(fills: DataFrame, keys: Sequence[str] = (RUN,)) -> DataFrame:
    """Counts, notional, costs and realised results per run, in one aggregate."""
    realized = F.when(_filled(), F.col("realized_pnl"))
    return fills.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("order_count"), F.count(realized).alias("trade_count"), F.count_if(realized > 0).alias("wins"),
        F.sum(F.when(_filled(), _notional()).otherwise(0.0)).alias("traded_notional"),
        F.sum(F.when(_filled(), F.coalesce("commission", F.lit(0.0))).otherwise(0.0)).alias("fees_paid"),
        F.sum(F.when(_filled(), F.coalesce("stamp_duty", F.lit(0.0))).otherwise(0.0)).alias("stamp_duty_paid"),
        F.coalesce(F.sum(realized), F.lit(0.0)).alias("long_pnl"),
    )


def return_stats(curve: DataFrame, fills: DataFrame) -> DataFrame:
    """One summary row per run from its curve and its orders."""
    returns = curve_returns(curve)
    base = curve_drawdown(curve).groupBy(RUN).agg(
        F.min_by("initial_equity", "trade_date").alias("initial_cash"), F.max_by("equity", "trade_date").alias("final_equity"),
        F.greatest(F.lit(0.0), F.max("drawdown")).alias("max_drawdown"), F.count(F.lit(1)).alias("replay_days"))
    risk = returns.groupBy(RUN).agg(sharpe(F.col("value")).alias("sharpe"))
    gross = gross_exposure(curve).groupBy(RUN).agg(
        F.avg("gross").alias("avg_gross"), F.max("gross").alias("max_gross"), F.count_if(F.col("gross") == 0).alias("zero_position_days"))
    total = F.when(F.col("initial_cash") > 0, F.col("final_equity") / F.col("initial_cash") - 1).otherwise(0.0)
    out = base.join(risk, RUN, "left").join(gross, RUN, "left").join(fill_totals(fills), RUN, "left")
    years = F.greatest("replay_days", F.lit(1)) / F.lit(float(TRADING_DAYS))
    return out.withColumn("total_return", total).withColumns({
        "annualized_return": F.when(total > -1, F.pow(1 + total, 1 / years) - 1).otherwise(-1.0),
        "win_rate": F.coalesce(F.try_divide("wins", "trade_count"), F.lit(0.0)),
        "turnover": F.when(F.col("initial_cash") > 0, F.col("traded_notional") / F.col("initial_cash")).otherwise(0.0),
        "long_return": F.when(F.col("initial_cash") > 0, F.col("long_pnl") / F.col("initial_cash")).otherwise(0.0),
    })


def sub_windows(curve: DataFrame, fills: DataFrame, windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """The summary per calendar window (``label, lo, hi``), chained on closes.

    Days meet windows once for each day of the calendar. A day outside every
    window fails.
    """
    def labels(rows: DataFrame, day: str) -> DataFrame:
        return inside(rows.select(day).distinct(), windows.select("label", "lo", "hi"), day, "lo", "hi")

    placed = curve.join(F.broadcast(labels(curve, "trade_date")), "trade_date", "left")
    placed = placed.withColumn("label", F.coalesce("label", F.raise_error(F.lit("a day lies outside the windows"))))
    order = Window.partitionBy(RUN).orderBy("trade_date")
    rows = placed.withColumn("_before", F.coalesce(F.lag("equity").over(order), F.col("initial_equity")))
    rows = rows.withColumn("value", F.when(F.col("_before") > 0, F.col("equity") / F.col("_before") - 1))
    block = Window.partitionBy(RUN, "label").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_open", F.first("_before").over(block)).withColumn("_peak", F.greatest("_open", F.max("equity").over(block)))
    cut = rows.groupBy(RUN, "label").agg(
        F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count(F.lit(1)).alias("trade_days"),
        F.first("_open").alias("opening"), F.max_by("equity", "trade_date").alias("closing"), sharpe(F.col("value")).alias("sharpe"),
        F.greatest(F.lit(0.0), F.max(F.try_divide(F.col("_peak") - F.col("equity"), "_peak"))).alias("max_drawdown"),
        ((start > F.first("lo")) | (end < F.first("hi"))).alias("partial"), F.first("initial_equity").alias("_initial"))
    filled = fills.where(_filled())
    done = filled.join(F.broadcast(labels(filled, "fill_date")), "fill_date").groupBy(RUN, "label").agg(
        F.sum(_notional()).alias("_traded"), F.count("realized_pnl").alias("trade_count"))
    joined = cut.join(done, [RUN, "label"], "left")
    return joined.select(
        RUN, "label", "start", "end", "trade_days", "partial", "opening", "closing",
        F.when(F.col("opening") > 0, F.col("closing") / F.col("opening") - 1).otherwise(0.0).alias("return"), "sharpe", "max_drawdown",
        F.when(F.col("_initial") > 0, F.coalesce("_traded", F.lit(0.0)) / F.col("_initial")).otherwise(0.0).alias("turnover"),
        F.coalesce("trade_count", F.lit(0).cast("long")).alias("trade_count"))


def growth_by_day(series: DataFrame) -> DataFrame:
    """Log growth of one series up to every calendar day, gaps carried.

    One row per calendar day, whatever reads it: two lookups give the
    compounded return of any span. Returns must exceed -100 %.
    """
    span = series.agg(F.date_sub(F.min("trade_date"), 1).alias("lo"), F.max("trade_date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    order = Window.orderBy("day")
    value = F.coalesce(F.log1p("value"), F.lit(0.0))
    return days.join(series.withColumnRenamed("trade_date", "day"), "day", "left").select("day", F.sum(value).over(order).alias("growth"), F.count("value").over(order).alias("seen"))


def attach_benchmark(windows: DataFrame, benchmark: DataFrame, active: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Benchmark and excess per window; with a baseline, active excess as well.

    The benchmark is looked up by the window's two end days. A run's own series
    joins its windows by run; a run has one row per trading day.
    """
    keys = [RUN, "label"]
    path = growth_by_day(benchmark)
    edge = path.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    clamp = lambda day: F.least(F.greatest(day, F.col("_first")), F.col("_last"))
    at = lambda tag: F.broadcast(path.select(F.col("day").alias(f"_{tag}"), F.col("growth").alias(f"_g_{tag}"), F.col("seen").alias(f"_n_{tag}")))
    placed = windows.join(F.broadcast(edge)).withColumns({"_a": clamp(F.date_sub("start", 1)), "_b": clamp(F.col("end"))})
    placed = placed.join(at("a"), "_a", "left").join(at("b"), "_b", "left")
    covered = F.col("_n_b") > F.col("_n_a")
    out = placed.withColumn("benchmark_return", F.when(covered, F.exp(F.col("_g_b") - F.col("_g_a")) - 1)).select(*windows.columns, "benchmark_return")
    out = out.withColumn("excess_return", F.col("return") - F.col("benchmark_return"))

    def folded(series: DataFrame, value: Column) -> DataFrame:
        return inside(series, windows.select(*keys, "start", "end"), "trade_date", "start", "end", [RUN]).groupBy(*keys).agg(value)

    if active is not None:
        out = out.join(folded(active, (F.avg("value") * TRADING_DAYS).alias("active_excess_return")), keys, "left")
    if baseline is not None:
        out = out.join(folded(baseline, compounded(F.col("value")).alias("baseline_return")), keys, "left")
    return out


def cost_sensitivity(summary: DataFrame, slippage_bps: float) -> DataFrame:
    """Cost per basis point, break-even slippage, excess at twice the slippage."""
    per_bp = F.coalesce(F.col("turnover"), F.lit(0.0)) * 1e-4
    excess = F.col("excess_return")
    traded = excess.isNotNull() & (per_bp != 0)
    return summary.withColumns({
        "cost_per_bp_per_side": per_bp,
        "breakeven_extra_slippage_bps": F.when(traded & (excess > 0), F.try_divide(excess, per_bp)),
        "excess_at_2x_slippage": F.when(excess.isNotNull(), F.when(per_bp == 0, excess).otherwise(excess - slippage_bps * per_bp)),
        "cost_reason": F.when(excess.isNull(), "no_benchmark_excess").when(per_bp == 0, "no_turnover").when(excess <= 0, "excess_not_positive"),
    })


def activity(curve: DataFrame, fills: DataFrame, start: Column, end: Column) -> DataFrame:
    """Turnover over the slice's opening equity, round trips, mean gross, fees."""
    inside = F.col("trade_date").between(start, end)
    gross = F.when(F.col("equity") > 0, (F.col("equity") - F.col("cash")) / F.col("equity")).otherwise(0.0)
    rows = curve.groupBy(RUN).agg(
        F.count_if(inside).alias("trade_days"),
        F.coalesce(F.max_by("equity", F.when(F.col("trade_date") < start, F.col("trade_date"))), F.min_by("initial_equity", "trade_date")).alias("opening_equity"),
        F.avg(F.when(inside & F.col("cash").isNotNull(), gross)).alias("mean_gross")).where("trade_days > 0")
    done = fills.where(_filled() & F.col("fill_date").between(start, end)).groupBy(RUN).agg(
        F.sum(_notional()).alias("_traded"), F.count("realized_pnl").alias("round_trips"),
        F.sum(F.coalesce("commission", F.lit(0.0)) + F.coalesce("stamp_duty", F.lit(0.0))).alias("fees"))
    return rows.join(done, RUN, "left").select(
        RUN, "trade_days", "opening_equity", F.coalesce(F.try_divide("_traded", "opening_equity"), F.lit(0.0)).alias("turnover"),
        F.coalesce("round_trips", F.lit(0).cast("long")).alias("round_trips"), "mean_gross", F.coalesce("fees", F.lit(0.0)).alias("fees"))


def pnl_concentration(fills: DataFrame, top: int = 5) -> DataFrame:
    """Gains, losses, and the share of gains in the best trades and best name.

    ``row_number() <= top`` is cut inside every map task before the shuffle, so
    a run with most of the fills sends only its candidates.
    """
    realized = fills.where(_filled() & F.col("realized_pnl").isNotNull())
    order = Window.partitionBy(RUN).orderBy(F.col("realized_pnl").desc())
    best = realized.where("realized_pnl > 0").select(RUN, "realized_pnl").withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= top)
    tops = best.groupBy(RUN).agg(F.sum("realized_pnl").alias("_top"))
    names = realized.groupBy(RUN, "ts_code").agg(F.sum("realized_pnl").alias("_name"))
    per_run = names.groupBy(RUN).agg(F.max("_name").alias("_best"))
    sums = realized.groupBy(RUN).agg(
        F.sum(F.greatest("realized_pnl", F.lit(0.0))).alias("gross_gains"), F.sum(F.least("realized_pnl", F.lit(0.0))).alias("gross_losses"))
    joined = sums.join(tops, RUN, "left").join(per_run, RUN)
    gains = F.col("gross_gains")
    return joined.select(
        RUN, "gross_gains", "gross_losses", (gains + F.col("gross_losses")).alias("net_realized"),
        F.when(gains > 0, F.col("_top") / gains).alias("top5_share"), F.when(gains > 0, F.col("_best") / gains).alias("top_name_share"))


def order_lifecycle(fills: DataFrame) -> DataFrame:
    """Entry and exit orders by outcome."""
    side = F.when(F.col("action").isin("sell", "reduce", "close", "exit"), "exit").otherwise("entry")
    return fills.groupBy(RUN, side.alias("side")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_filled()).alias("filled"), F.count_if(F.col("status") == "rejected").alias("rejected"))


def reject_reasons(fills: DataFrame, top: int = 6) -> DataFrame:
    """Most frequent reasons per run; reasons are a short vocabulary."""
    counts = fills.where("reason is not null and reason <> ''").groupBy(RUN, "reason").agg(F.count(F.lit(1)).alias("orders"))
    order = Window.partitionBy(RUN).orderBy(F.col("orders").desc(), "reason")
    return counts.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top)


def daily_orders(fills: DataFrame) -> DataFrame:
    """Orders, fills and filled amount per run and day."""
    return fills.groupBy(RUN, "fill_date").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(_filled()).alias("filled"), F.sum(F.when(_filled(), _notional()).otherwise(0.0)).alias("amount"))


def weekly_returns(curve: DataFrame) -> DataFrame:
    """Week-end equity against the previous week's, by ISO week."""
    week = F.date_trunc("week", "trade_date").cast("date")
    ends = curve.groupBy(RUN, week.alias("_week")).agg(
        F.max("trade_date").alias("week_end"), F.max_by("equity", "trade_date").alias("_equity"), F.min_by("initial_equity", "trade_date").alias("_initial"))
    order = Window.partitionBy(RUN).orderBy("_week")
    start = F.coalesce(F.lag("_equity").over(order), F.col("_initial"))
    return ends.withColumn("_start", start).where("_start > 0").select(RUN, "week_end", (F.col("_equity") / F.col("_start") - 1).alias("weekly_return"))


def holder(strategy: DataFrame, benchmark: DataFrame, baseline: DataFrame, start: Column, end: Column) -> DataFrame:
    """Compounded strategy, benchmark and baseline over a span, and differences."""
    cut = lambda df: df.where(F.col("trade_date").between(start, end))
    own, base = compound(cut(strategy), [RUN]), compound(cut(baseline), [RUN])
    market = cut(benchmark).agg(compounded(F.col("value")).alias("benchmark_return"))
    joined = own.withColumnRenamed("compounded", "strategy_return").join(base.select(RUN, F.col("compounded").alias("baseline_return")), RUN, "left")
    joined = joined.join(F.broadcast(market))
    return joined.withColumns({
        "over_benchmark": F.col("strategy_return") - F.col("benchmark_return"), "over_baseline": F.col("strategy_return") - F.col("baseline_return")})


def active_daily(strategy: DataFrame, baseline: DataFrame, legs: DataFrame) -> DataFrame:
    """Day by day: strategy, baseline, active, its path, and the factor legs."""
    active = strategy.join(baseline.withColumnRenamed("value", "baseline"), [RUN, "trade_date"], "left").withColumn("active", F.col("value") - F.col("baseline"))
    path = drawdown_path(active, [RUN], "active").withColumnRenamed("value", "strategy")
    return path.join(F.broadcast(legs), "trade_date", "left").drop("equity")


def curve_lines(strategy: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Cumulative and drawdown lines of every series on the strategy's own days."""
    days = strategy.select(RUN, "trade_date")
    out = strategy.withColumn("line", F.lit("strategy"))
    for name, series in others.items():
        keys = [RUN, "trade_date"] if RUN in series.columns else ["trade_date"]
        out = out.unionByName(days.join(series, keys).select(RUN, "trade_date", "value").withColumn("line", F.lit(name)))
    path = drawdown_path(out, [RUN, "line"])
    return path.select(RUN, "line", "trade_date", "cumulative", (F.lit(0.0) - F.col("drawdown")).alias("drawdown"))


def thin(curve: DataFrame, keys: Sequence[str], points: int) -> DataFrame:
    """Keep about ``points`` evenly spaced days of each line, both ends included."""
    order = Window.partitionBy(*keys).orderBy("trade_date")
    placed = curve.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    step = (F.col("_n") - 1) / F.lit(float(points - 1))
    near = F.floor(F.col("_i") / step)
    keep = (F.col("_n") <= points) | (F.rint(near * step) == F.col("_i")) | (F.rint((near + 1) * step) == F.col("_i"))
    return placed.where(keep).drop("_i", "_n")
