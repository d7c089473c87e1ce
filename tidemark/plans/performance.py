"""Performance statistics and readings of the order-priority books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import DRAW_PRIME
from ..operators import calendar as cal_ops, inference, stats, style
from ..registry import query
from .adapters import FILLS_SQL, SERIES_SQL, curve, fills, market_legs, r, series, with_sql
from .screening import OLS_SQL, active_rows

RUN = "run_id"


def day_text(df, *names):
    for name in names or ("trade_date",):
        df = df.withColumn(name, F.date_format(name, "yyyyMMdd"))
    return df


def rr(places=6, **named):
    return [r(F.col(column), places).alias(alias) for alias, column in named.items()]


def keep(*names, places=6):
    return [r(F.col(name), places).alias(name) for name in names]


def baseline(spark, sf):
    return series(spark, sf).select(RUN, "trade_date", F.col("base").alias("value"))


def benchmark(spark, sf):
    return market_legs(spark, sf).select("trade_date", F.col("market").alias("value"))


SHARPE_SQL = "coalesce(case when count(v) >= 2 then avg(v) / nullif(stddev_samp(v), 0) * sqrt(244.0) end, 0)"
PATH_SQL = """pk as (select *, greatest(initial_equity, max(equity) over (partition by run_id order by trade_date)) as peak from curve)"""


@query("sta01_return_summary", with_sql(SERIES_SQL, FILLS_SQL, PATH_SQL, f"""b as (select run_id, 1000000.0 as i, arg_max(equity, trade_date) as e, greatest(0, max((peak - equity) / peak)) as dd, count(*) as n, avg((equity - cash) / equity) as g, max((equity - cash) / equity) as mg,
    count(*) filter (where (equity - cash) / equity = 0) as zd from pk group by run_id), s as (select run_id, {SHARPE_SQL.replace('v)', 'value)')} as sharpe from series group by run_id),
  f as (select run_id, count(*) as oc, count(realized_pnl) as tc, count(*) filter (where realized_pnl > 0) as wins, sum(case when status = 'filled' then price * quantity else 0 end) as tn,
    sum(case when status = 'filled' then commission else 0 end) as fp, sum(case when status = 'filled' then stamp_duty else 0 end) as sd from fills group by run_id)""") + """
select run_id, round(e, 3) as final_equity, round(e / i - 1, 8) as total_return, round(pow(e / i, 244.0 / n) - 1, 8) as annualized_return, round(sharpe, 7) as sharpe, round(dd, 8) as max_drawdown, n as replay_days,
  round(g, 8) as avg_gross, round(mg, 8) as max_gross, zd as zero_position_days, oc as order_count, tc as trade_count, round(wins / tc, 8) as win_rate, round(tn / i, 5) as turnover, round(fp, 2) as fees_paid, round(sd, 2) as stamp_duty_paid
from b join s using (run_id) join f using (run_id)""")
def _(spark, sf):
    out = stats.return_stats(curve(spark, sf), fills(spark, sf))
    return out.select(RUN, *keep("final_equity", places=3), *keep("total_return", "annualized_return", "max_drawdown", "avg_gross", "max_gross", "win_rate", places=8), *keep("sharpe", places=7),
                      "replay_days", "zero_position_days", "order_count", "trade_count", *keep("turnover", places=5), *keep("fees_paid", "stamp_duty_paid", places=2))


@query("sta02_compounded", with_sql(SERIES_SQL) + "select run_id, round(product(1 + value) - 1, 8) as compounded, count(*) as days from series group by all")
def _(spark, sf):
    return stats.compound(series(spark, sf), [RUN]).select(RUN, *keep("compounded", places=8), "days")


DD_SQL = """path as (select run_id, trade_date, exp(sum(ln(1 + value)) over w) as e from series window w as (partition by run_id order by trade_date)),
  dd as (select *, greatest(1, max(e) over (partition by run_id order by trade_date)) as pk from path)"""


@query("sta03_running_drawdown", with_sql(SERIES_SQL, DD_SQL) + "select run_id, strftime(trade_date, '%Y%m%d') as trade_date, round(e, 7) as equity, round((pk - e) / pk, 8) as drawdown from dd")
def _(spark, sf):
    return day_text(stats.drawdown_path(series(spark, sf), [RUN])).select(RUN, "trade_date", *keep("equity", places=7), *keep("drawdown", places=8))


@query("sta04_sharpe", with_sql(SERIES_SQL) + "select run_id, round(avg(value) / stddev_samp(value) * sqrt(244.0), 7) as sharpe from series group by all")
def _(spark, sf):
    return series(spark, sf).groupBy(RUN).agg(r(stats.sharpe(F.col("value")), 7).alias("sharpe"))


@query("sta05_plain_stats", with_sql(SERIES_SQL) + """
select run_id, count(*) as days, round(avg(value - base) * 244, 8) as plain_excess, round(stddev_samp(value - base) * sqrt(244.0), 8) as tracking_error, round(avg(value - base) * 244 / (stddev_samp(value - base) * sqrt(244.0)), 7) as information_ratio from series group by all""")
def _(spark, sf):
    active = series(spark, sf).withColumn("value", F.col("value") - F.col("base"))
    return stats.plain_stats(active, [RUN]).select(RUN, "days", *keep("plain_excess", "tracking_error", places=8), *keep("information_ratio", places=7))


YEARS_SQL = """win as (select cast(y as varchar) as label, make_date(y, 1, 1) as lo, make_date(y, 12, 31) as hi from (select unnest(generate_series(1995, 2001)) as y)),
  yr as (select c.*, label, lo, hi, lag(equity, 1, 1000000.0) over (partition by run_id order by trade_date) as before from curve c join win on trade_date between lo and hi),
  yo as (select *, first(before) over (partition by run_id, label order by trade_date) as opening from yr),
  yp as (select *, greatest(opening, max(equity) over (partition by run_id, label order by trade_date)) as peak, equity / before - 1 as v from yo),
  ys as (select run_id, label, min(trade_date) as s, max(trade_date) as t, count(*) as days, any_value(opening) as opening, arg_max(equity, trade_date) as closing, coalesce(avg(v) / nullif(stddev_samp(v), 0) * sqrt(244.0), 0) as sharpe,
    greatest(0, max((peak - equity) / peak)) as dd, any_value(lo) as lo, any_value(hi) as hi from yp group by all),
  yf as (select run_id, cast(year(fill_date) as varchar) as label, sum(price * quantity) as traded, count(realized_pnl) as tc from fills where status = 'filled' group by all)"""


def windows(spark, sf):
    tiles = cal_ops.step_windows(spark, "1995-01-01", 12, 7)
    return tiles.select(F.date_format("step_start", "yyyy").alias("label"), F.col("step_start").alias("lo"), F.col("step_end").alias("hi"))


def yearly(spark, sf):
    return stats.sub_windows(curve(spark, sf), fills(spark, sf), windows(spark, sf), F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"))


@query("sta06_year_buckets", with_sql(SERIES_SQL, FILLS_SQL, YEARS_SQL) + """
select run_id, label, strftime(s, '%Y%m%d') as start, strftime(t, '%Y%m%d') as "end", days as trade_days, (hi > date '2001-08-01' or lo < date '1995-01-01') as partial, round(closing / opening - 1, 8) as "return", round(sharpe, 6) as sharpe,
  round(dd, 8) as max_drawdown, round(coalesce(traded, 0) / 1000000.0, 5) as turnover, coalesce(tc, 0) as trade_count from ys left join yf using (run_id, label)""")
def _(spark, sf):
    out = day_text(yearly(spark, sf), "start", "end")
    return out.select(RUN, "label", "start", "end", "trade_days", "partial", *keep("return", "max_drawdown", places=8), *keep("sharpe"), *keep("turnover", places=5), "trade_count")


@query("sta07_benchmark_years", with_sql(SERIES_SQL, FILLS_SQL, YEARS_SQL, "ym as (select run_id, label, product(1 + market) - 1 as bm from ys join mkt on trade_date between s and t group by all)",
       "ya as (select run_id, cast(year(trade_date) as varchar) as label, avg(value - base) * 244 as ae, product(1 + base) - 1 as br from series group by all)") + """
select run_id, label, round(bm, 8) as benchmark_return, round(closing / opening - 1 - bm, 8) as excess_return, round(ae, 8) as active_excess_return, round(br, 8) as baseline_return from ys join ym using (run_id, label) join ya using (run_id, label)""")
def _(spark, sf):
    s = series(spark, sf)
    active = s.select(RUN, "trade_date", (F.col("value") - F.col("base")).alias("value"))
    out = stats.attach_benchmark(yearly(spark, sf), benchmark(spark, sf), active, baseline(spark, sf))
    return out.select(RUN, "label", *keep("benchmark_return", "excess_return", "active_excess_return", "baseline_return", places=8))


@query("sta08_cost_sensitivity", with_sql(SERIES_SQL, FILLS_SQL, """b as (select run_id, product(1 + value) - 1 as own from series group by all), m as (select product(1 + market) - 1 as mk from mkt),
   f as (select run_id, sum(price * quantity) / 1000000.0 as t from fills where status = 'filled' group by all), x as (select run_id, own - mk as ex, t * 1e-4 as pb from b, m join f using (run_id))""").replace("from b, m join f using (run_id)", "from b join f using (run_id), m") + """
select run_id, round(pb, 8) as cost_per_bp_per_side, round(case when ex > 0 then ex / pb end, 6) as breakeven_extra_slippage_bps, round(ex - 10 * pb, 7) as excess_at_2x_slippage, case when ex <= 0 then 'excess_not_positive' end as cost_reason from x""")
def _(spark, sf):
    summary = stats.return_stats(curve(spark, sf), fills(spark, sf))
    market = benchmark(spark, sf).agg(stats.compounded(F.col("value")).alias("_m"))
    out = stats.cost_sensitivity(summary.join(F.broadcast(market)).withColumn("excess_return", F.col("total_return") - F.col("_m")), 10.0)
    return out.select(RUN, *keep("cost_per_bp_per_side", places=8), *keep("breakeven_extra_slippage_bps"), *keep("excess_at_2x_slippage", places=7), "cost_reason")


@query("sta09_window_activity", with_sql(SERIES_SQL, FILLS_SQL, """o as (select run_id, arg_max(equity, trade_date) as opening from curve where trade_date < date '1998-01-01' group by all),
   c as (select run_id, count(*) as trade_days, avg((equity - cash) / equity) as g from curve where trade_date between date '1998-01-01' and date '1998-12-31' group by all),
   f as (select run_id, sum(price * quantity) as tn, count(realized_pnl) as rt, sum(commission + stamp_duty) as fees from fills where status = 'filled' and fill_date between date '1998-01-01' and date '1998-12-31' group by all)""") + """
select run_id, trade_days, round(opening, 3) as opening_equity, round(tn / opening, 6) as turnover, rt as round_trips, round(g, 8) as mean_gross, round(fees, 2) as fees from o join c using (run_id) join f using (run_id)""")
def _(spark, sf):
    out = stats.activity(curve(spark, sf), fills(spark, sf), F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return out.select(RUN, "trade_days", *keep("opening_equity", places=3), *keep("turnover"), "round_trips", *keep("mean_gross", places=8), *keep("fees", places=2))


@query("sta10_pnl_concentration", with_sql(FILLS_SQL, """z as (select * from fills where status = 'filled' and realized_pnl is not null), g as (select run_id, sum(greatest(realized_pnl, 0)) as gg, sum(least(realized_pnl, 0)) as gl from z group by all),
   t as (select run_id, sum(realized_pnl) as t5 from (select *, row_number() over (partition by run_id order by realized_pnl desc) as p from z) where p <= 5 group by all),
   n as (select run_id, max(s) as best from (select run_id, ts_code, sum(realized_pnl) as s from z group by all) group by all)""") + """
select run_id, round(gg, 2) as gross_gains, round(gl, 2) as gross_losses, round(t5 / gg, 8) as top5_share, round(best / gg, 8) as top_name_share from g join t using (run_id) join n using (run_id)""")
def _(spark, sf):
    out = stats.pnl_concentration(fills(spark, sf))
    return out.select(RUN, *keep("gross_gains", "gross_losses", places=2), *keep("top5_share", "top_name_share", places=8))


@query("sta11_order_lifecycle", with_sql(FILLS_SQL) + """
select run_id, case action when 'sell' then 'exit' else 'entry' end as side, count(*) as total, count(*) filter (where status = 'filled') as filled, count(*) filter (where status = 'rejected') as rejected from fills group by all""")
def _(spark, sf):
    return stats.order_lifecycle(fills(spark, sf))


@query("sta11_reject_reasons", with_sql(FILLS_SQL) + """
select run_id, reason, orders, place from (select run_id, reason, count(*) as orders, row_number() over (partition by run_id order by count(*) desc, reason) as place from fills where reason is not null group by run_id, reason) where place <= 3""")
def _(spark, sf):
    return stats.reject_reasons(fills(spark, sf), 3)


@query("sta11_daily_orders", with_sql(FILLS_SQL) + """
select run_id, strftime(fill_date, '%Y%m%d') as fill_date, count(*) as orders, count(*) filter (where status = 'filled') as filled, round(sum(case when status = 'filled' then price * quantity else 0 end), 2) as amount from fills group by all""")
def _(spark, sf):
    return day_text(stats.daily_orders(fills(spark, sf)), "fill_date").select(RUN, "fill_date", "orders", "filled", *keep("amount", places=2))


@query("sta12_weekly_returns", with_sql(SERIES_SQL, "w as (select run_id, isoyear(trade_date) * 100 + week(trade_date) as wk, max(trade_date) as week_end, arg_max(equity, trade_date) as e from curve group by all)") + """
select run_id, strftime(week_end, '%Y%m%d') as week_end, round(e / lag(e, 1, 1000000.0) over (partition by run_id order by wk) - 1, 8) as weekly_return from w""")
def _(spark, sf):
    return day_text(stats.weekly_returns(curve(spark, sf)), "week_end").select(RUN, "week_end", *keep("weekly_return", places=8))


@query("sta13_holder_readings", with_sql(SERIES_SQL, "s as (select run_id, product(1 + value) - 1 as a, product(1 + base) - 1 as b from series where trade_date between date '1997-01-01' and date '1999-12-31' group by all)",
       "m as (select product(1 + market) - 1 as k from mkt where trade_date between date '1997-01-01' and date '1999-12-31')") + """
select run_id, round(a, 8) as strategy_return, round(k, 8) as benchmark_return, round(b, 8) as baseline_return, round(a - k, 8) as over_benchmark, round(a - b, 8) as over_baseline from s, m""")
def _(spark, sf):
    out = stats.holder(series(spark, sf), benchmark(spark, sf), baseline(spark, sf), F.lit("1997-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return out.select(RUN, *keep("strategy_return", "benchmark_return", "baseline_return", "over_benchmark", "over_baseline", places=8))


@query("sta14_active_daily", with_sql(SERIES_SQL, """p as (select *, value - base as active, exp(sum(ln(1 + value - base)) over (partition by run_id order by trade_date)) as e from series),
   q as (select *, greatest(1, max(e) over (partition by run_id order by trade_date)) as pk from p)""") + """
select run_id, strftime(trade_date, '%Y%m%d') as trade_date, round(value, 8) as strategy, round(base, 8) as baseline, round(active, 8) as active, round(e - 1, 7) as cumulative, round((pk - e) / pk, 8) as drawdown, round(market, 8) as market, round(size, 8) as size
from q left join mkt using (trade_date)""")
def _(spark, sf):
    out = stats.active_daily(series(spark, sf).select(RUN, "trade_date", "value"), baseline(spark, sf), market_legs(spark, sf))
    return day_text(out).select(RUN, "trade_date", *keep("strategy", "baseline", "active", "drawdown", "market", "size", places=8), *keep("cumulative", places=7))


@query("st10_curve_lines", with_sql(SERIES_SQL, """l as (select run_id, 'strategy' as line, trade_date, value from series union all select run_id, 'baseline', trade_date, base from series union all select run_id, 'benchmark', trade_date, market from series join mkt using (trade_date)),
   p as (select *, exp(sum(ln(1 + value)) over (partition by run_id, line order by trade_date)) as e from l), q as (select *, greatest(1, max(e) over (partition by run_id, line order by trade_date)) as pk from p)""") + """
select run_id, line, strftime(trade_date, '%Y%m%d') as trade_date, round(e - 1, 7) as cumulative, round((pk - e) / pk, 8) as drawdown from q""")
def _(spark, sf):
    out = stats.curve_lines(series(spark, sf).select(RUN, "trade_date", "value"), {"baseline": baseline(spark, sf), "benchmark": benchmark(spark, sf)})
    return day_text(out).select(RUN, "line", "trade_date", *keep("cumulative", places=7), r(-F.col("drawdown"), 8).alias("drawdown"))


@query("st11_gross_exposure", with_sql(SERIES_SQL) + "select run_id, strftime(trade_date, '%Y%m%d') as trade_date, round((equity - cash) / equity, 6) as gross from curve")
def _(spark, sf):
    return day_text(stats.gross_exposure(curve(spark, sf))).select(RUN, "trade_date", *keep("gross"))


@query("top04_thinned_curve", with_sql(SERIES_SQL, """i as (select run_id, trade_date, row_number() over (partition by run_id order by trade_date) - 1 as k, count(*) over (partition by run_id) as n from series)""") + """
select run_id, strftime(trade_date, '%Y%m%d') as trade_date from i where n <= 60 or k in (select cast(round_even(x * ((i.n - 1) / 59.0), 0) as bigint) from (select unnest(generate_series(0, 59)) as x))""")
def _(spark, sf):
    return day_text(stats.thin(series(spark, sf), [RUN], 60)).select(RUN, "trade_date")


# -- readings ---------------------------------------------------------------------

ZQ = 1.6448536269514715


@query("tst01_residual_reading", with_sql(SERIES_SQL, OLS_SQL) + f"""
select run_id, n as days, round(n / 244.0, 8) as years, round(intercept * 244, 7) as residual_excess, round(sqrt(rss / (n - 3)) * sqrt(244.0), 8) as residual_tracking_error, round(intercept * sqrt(244.0) / sqrt(rss / (n - 3)), 6) as residual_information_ratio,
  round({ZQ} / sqrt(n / 244.0), 8) as threshold from fit""")
def _(spark, sf):
    out = inference.residual_reading(active_rows(spark, sf), [RUN], "y", ["market", "size"], 0.05)
    return out.select(RUN, "days", *keep("years", "residual_tracking_error", "threshold", places=8), *keep("residual_excess", places=7), *keep("residual_information_ratio"))


@query("tst02_pooled_reading", with_sql(SERIES_SQL, OLS_SQL, "rd as (select n / 244.0 as y, intercept * sqrt(244.0) / sqrt(rss / (n - 3)) as ir from fit), p as (select count(*) as measured, sum(y) as years, sum(y * ir) / sum(y) as ratio from rd)",
       "zz as (select *, ratio * sqrt(years) as z from p)", "simpson as (select any_value(z) / 3000.0 * sum(case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-0.5 * pow(z * i / 1000.0, 2)) / sqrt(2 * pi())) as area from zz, (select unnest(generate_series(0, 1000)) as i))") + """
select measured, cast(0 as bigint) as unmeasured, round(years, 7) as years, round(ratio, 6) as pooled_ratio, round(z, 6) as z, round(0.5 - area, 7) as p_value from zz, simpson""")
def _(spark, sf):
    out = inference.pooled(inference.residual_reading(active_rows(spark, sf), [RUN], "y", ["market", "size"], 0.05))
    return out.select("measured", "unmeasured", *keep("years", "p_value", places=7), *keep("pooled_ratio", "z"))


# Resampled means: 2,000 draws of 20-day blocks whose starts are digests of (series, draw, block).
DRAWN_SQL = ("bp as (select run_id, value - base as v, row_number() over (partition by run_id order by trade_date) as i from series)",
             "cum as (select run_id, i, sum(v) over (partition by run_id order by i) as s from bp union all select distinct run_id, 0, 0.0 from bp)")


def means_sql(starts: str) -> str:
    return starts + """,
     be as (select bs.run_id, days, draw, sum(b.s - a.s) / days as e from bs join cum a on a.run_id = bs.run_id and a.i = st join cum b on b.run_id = bs.run_id and b.i = st + len group by bs.run_id, days, draw)"""


def drawn_sql(points: str) -> str:
    """Draws of every (run_id, days) of a table: the mean of blocks within the first ``days`` days."""
    return means_sql(f"""bs as (select run_id, days, draw, blk, cast('0x' || substr(md5(run_id || '|' || draw || '|' || blk), 1, 15) as bigint) % (days - 19) as st, least(20, days - blk * 20) as len
       from {points}, (select unnest(range(2000)) as draw), (select unnest(range(1000)) as blk) where blk * 20 < days)""")


def stepped_sql(points: str) -> str:
    """The same with starts by steps from one digest of each run."""
    return means_sql(f"""b1 as (select run_id, days, draw, blk, (cast('0x' || substr(md5(run_id), 1, 15) as bigint) % {DRAW_PRIME - 1} + 1 + draw * {inference.DRAW_STEP} + blk * {inference.BLOCK_STEP}) % {DRAW_PRIME} as z
       from {points}, (select unnest(range(2000)) as draw), (select unnest(range(1000)) as blk) where blk * 20 < days),
     b2 as (select *, (z * z + {inference.MIX}) % {DRAW_PRIME} as y from b1),
     bs as (select run_id, days, draw, ((y * y + z) % {DRAW_PRIME}) * (days - 19) // {DRAW_PRIME} as st, least(20, days - blk * 20) as len from b2)""")


@query("tst03_block_bootstrap", with_sql(SERIES_SQL, *DRAWN_SQL, "pt as (select run_id, count(*) as days from bp group by run_id)", drawn_sql("pt")) + """
select run_id, round(quantile_cont(e, 0.1) * 244, 7) as lower_bound, days from be group by run_id, days""")
def _(spark, sf):
    s = series(spark, sf).withColumn("value", F.col("value") - F.col("base"))
    return inference.block_bootstrap(s, [RUN], F.col(RUN), 0.9).select(RUN, *keep("lower_bound", places=7), "days")


@query("tst04_seed_mean", with_sql(SERIES_SQL, "g0 as (select run_id, year(trade_date) as yy, avg(value) as v0, avg(base) as b0 from series group by run_id, year(trade_date))",
       "g as (select run_id, yy, v0, case when run_id like '1%' and yy = 1997 then null else b0 end as b1 from g0)") + """
select cast(yy as bigint) as y, count(*) as members, round(avg(v0), 9) as v, case when count(b1) = count(*) then round(avg(b1), 9) end as b from g group by yy""")
def _(spark, sf):
    g = series(spark, sf).groupBy(RUN, F.year("trade_date").cast("long").alias("y")).agg(F.avg("value").alias("v"), F.avg("base").alias("b"))
    g = g.withColumn("b", F.when(~(F.col(RUN).startswith("1") & (F.col("y") == 1997)), F.col("b")))
    return inference.seed_mean(g, ["y"], ["v", "b"], RUN).select("y", "members", *keep("v", "b", places=9))


# A run's own and its base returns as two members of one book.
@query("tst04_aligned_mean", with_sql(SERIES_SQL) + """
select run_id, strftime(trade_date, '%Y%m%d') as trade_date, round((value + base) / 2, 9) as value from series where value is not null and base is not null""")
def _(spark, sf):
    both = series(spark, sf).where("value is not null and base is not null")
    members = F.explode(F.array(*[F.struct(F.lit(name).alias("member"), F.col(name).alias("value")) for name in ("value", "base")])).alias("m")
    mean = inference.aligned_mean(both.select(RUN, "trade_date", members).select(RUN, "trade_date", "m.*"), [RUN], "member")
    return mean.select(RUN, F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), *keep("value", places=9))


@query("tst05_mandate", with_sql(SERIES_SQL, OLS_SQL) + """
select run_id, array_to_string(list_filter([case when sqrt(rss / (n - 3) * 244) > 0.18 then 'tracking_error_above_cap' end, case when b1 not between -0.02 and 0.02 then 'beta_outside_band' end], lambda x: x is not null), '|') as reasons from fit""")
def _(spark, sf):
    fit = style.factor_ols(active_rows(spark, sf), [RUN], "y", ["market", "size"])
    return inference.mandate(fit, 0.18, -0.02, 0.02).select(RUN, F.array_join("reasons", "|").alias("reasons"))


@query("tst06_detectable_excess", with_sql(SERIES_SQL) + "select run_id, round(2.12 * stddev_samp(value - base) * sqrt(244.0) / sqrt(122 / 244.0), 7) as mde from series group by all")
def _(spark, sf):
    plain = stats.plain_stats(series(spark, sf).withColumn("value", F.col("value") - F.col("base")), [RUN])
    return plain.select(RUN, r(inference.detectable_excess(F.col("tracking_error"), 122), 7).alias("mde"))


@query("tst07_stressed_excess", with_sql(SERIES_SQL, FILLS_SQL, "f as (select run_id, sum(price * quantity) / 1000000.0 as t from fills where status = 'filled' group by all)", "s as (select run_id, avg(value - base) * 244 as p, count(*) as n from series group by all)") + """
select run_id, round(p - 2.0 * 10 * t * 1e-4 / (n / 244.0), 7) as stressed from s join f using (run_id)""")
def _(spark, sf):
    plain = stats.plain_stats(series(spark, sf).withColumn("value", F.col("value") - F.col("base")), [RUN])
    totals = stats.fill_totals(fills(spark, sf)).select(RUN, (F.col("traded_notional") / 1000000.0).alias("turnover"))
    joined = plain.join(totals, RUN)
    return joined.select(RUN, r(inference.stressed_excess(F.col("plain_excess"), F.col("days"), F.col("turnover"), 3.0, 10.0), 7).alias("stressed"))


@query("tst08_condition_table", with_sql(SERIES_SQL, PATH_SQL, "b as (select run_id, greatest(0, max((peak - equity) / peak)) as dd from pk group by all)") + """
select run_id, case when dd > 0.6 then 'max_drawdown_above_limit' else '' end as reasons from b""")
def _(spark, sf):
    summary = stats.return_stats(curve(spark, sf), fills(spark, sf))
    return inference.judge(summary, inference.nomination_rules(0.6)).select(RUN, F.array_join("reasons", "|").alias("reasons"))


STEP_SQL = """steps as (select i + 1 as step, cast(date '1996-01-01' + to_months(cast(i * 6 as integer)) as date) as a, cast(date '1996-01-01' + to_months(cast((i + 1) * 6 as integer)) - interval 1 day as date) as b from (select unnest(generate_series(0, 7)) as i)),
  ent as (select run_id, step, count(*) as days, avg(value - base) * 244 as pe, product(1 + value - base) - 1 as cp from series join steps on trade_date between a and b group by all)"""


def entries(spark, sf):
    steps = cal_ops.step_windows(spark, "1996-01-01", 6, 8)
    active = series(spark, sf).select(RUN, "trade_date", (F.col("value") - F.col("base")).alias("value"))
    return inference.step_entries(active, steps, [RUN])


@query("tst09_step_record", with_sql(SERIES_SQL, STEP_SQL) + "select run_id, step, days, round(pe, 7) as plain_excess, round(cp, 8) as compounded from ent")
def _(spark, sf):
    return entries(spark, sf).select(RUN, "step", "days", *keep("plain_excess", places=7), *keep("compounded", places=8))


@query("tst09_contiguous_steps", with_sql(SERIES_SQL, STEP_SQL) + "select run_id, count(*) as steps from ent group by all")
def _(spark, sf):
    return inference.contiguous(entries(spark, sf), [RUN])


@query("tst10_candidate_changes", with_sql(SERIES_SQL, STEP_SQL, "l as (select *, days % 3 <> lag(days % 3) over (partition by run_id order by step) as moved from ent)") + "select run_id, count(*) filter (where moved) as changes from l group by all")
def _(spark, sf):
    return inference.candidate_changes(entries(spark, sf).withColumn("fingerprint", F.col("days") % 3), [RUN])


@query("tst11_first_transition", with_sql(SERIES_SQL, *DRAWN_SQL, "tot as (select run_id, count(*) as n from bp group by run_id)", "pt as (select run_id, unnest(range(120, n + 1, 120)) as days from tot)", stepped_sql("pt"),
       "bnd as (select run_id, days, quantile_cont(e, 0.05) * 244 as lo, quantile_cont(e, 0.95) * 244 as hi from be group by run_id, days)",
       "eq as (select run_id, trade_date, row_number() over w as days, exp(sum(ln(1 + value)) over w) as a, exp(sum(ln(1 + value - base)) over w) as b from series window w as (partition by run_id order by trade_date))",
       "dd as (select *, 1 - a / greatest(1, max(a) over w) as ad, 1 - b / greatest(1, max(b) over w) as bd from eq window w as (partition by run_id order by trade_date))",
       """ev as (select dd.*, lo, hi, case when ad > 0.7 then 'account_drawdown_exceeded' when bd > 0.7 then 'active_drawdown_exceeded' when hi < 0 then 'kill_upper_bound_below_zero' when lo > 0 then 'confirm_lower_bound_above_zero' end as reason
         from dd left join bnd on bnd.run_id = dd.run_id and bnd.days = dd.days)""") + """
select run_id, days, case when reason = 'confirm_lower_bound_above_zero' then 'confirmed' else 'killed' end as status, strftime(trade_date, '%Y%m%d') as trade_date, reason,
  round(ad, 7) as account_drawdown, round(bd, 7) as active_drawdown, round(lo, 7) as confirm_lower_bound, round(hi, 7) as kill_upper_bound
from ev where reason is not null qualify row_number() over (partition by run_id order by days) = 1""")
def _(spark, sf):
    paths = series(spark, sf).select(RUN, "trade_date", F.col("value").alias("account"), (F.col("value") - F.col("base")).alias("active"))
    out = inference.first_transition(paths, [RUN], max_drawdown=0.7, active_max_drawdown=0.7, checkpoint_days=120, kill_confidence=0.95, confirm_confidence=0.95)
    bounds = keep("account_drawdown", "active_drawdown", "confirm_lower_bound", "kill_upper_bound", places=7)
    return out.select(RUN, "days", "status", F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), "reason", *bounds)


@query("tst12_forward_slice", with_sql(SERIES_SQL, "x as (select * from series where trade_date between date '2000-01-01' and date '2000-12-31')",
       "h as (select run_id, product(1 + value) - 1 as a, product(1 + base) - 1 as b, count(*) as n, avg(value - base) * 244 as pe, stddev_samp(value - base) * sqrt(244.0) as te from x group by all)",
       "d as (select run_id, e, greatest(1, max(e) over (partition by run_id order by trade_date)) as pk from (select run_id, trade_date, exp(sum(ln(1 + value - base)) over (partition by run_id order by trade_date)) as e from x))") + """
select run_id, n as days, round(a, 8) as strategy_return, round(a - b, 8) as over_baseline, round(pe, 7) as plain_excess, round(pe / te, 6) as information_ratio, round(dd, 8) as active_max_drawdown from h join (select run_id, greatest(0, max((pk - e) / pk)) as dd from d group by run_id) using (run_id)""")
def _(spark, sf):
    lo, hi = F.lit("2000-01-01").cast("date"), F.lit("2000-12-31").cast("date")
    s = series(spark, sf).where(F.col("trade_date").between(lo, hi))
    active = s.withColumn("value", F.col("value") - F.col("base"))
    base = s.select(RUN, "trade_date", F.col("base").alias("value"))
    held = stats.holder(s, benchmark(spark, sf), base, lo, hi).select(RUN, "strategy_return", "over_baseline")
    worst = stats.drawdown_path(active, [RUN]).groupBy(RUN).agg(F.greatest(F.lit(0.0), F.max("drawdown")).alias("active_max_drawdown"))
    out = stats.plain_stats(active, [RUN]).join(held, RUN).join(worst, RUN)
    return out.select(RUN, "days", *keep("strategy_return", "over_baseline", "active_max_drawdown", places=8), *keep("plain_excess", places=7), *keep("information_ratio"))
