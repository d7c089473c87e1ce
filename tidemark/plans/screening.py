"""Signal screens and style analytics over the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screen as ops, style
from ..registry import query
from ..session import materialise
from .adapters import DAILY_SQL, POSITIONS_SQL, SERIES_SQL, daily, market_legs, positions, r, series, with_sql

KEYS = ["trade_date", "ts_code"]
HORIZONS = (1, 5, 10, 20)
STEPS = tuple(zip(HORIZONS, (0, *HORIZONS)))
MIN = 8


def day_text(df):
    return df.withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))


def reversal(panel):
    """The scored signal: shrinking volume, on most names and dates."""
    return panel.where("(k * 7 + mi) % 10 <> 0").select(*KEYS, (-F.round(F.col("vol"), 0)).alias("score"))


# The grid: every (date, name) bar with next-day gates, forward returns and score.
_AHEAD = sorted({1, *(h + 1 for h in HORIZONS)})
_RETURNS = ", ".join(f"n{h + 1}.adj_open / n1.adj_open - 1 as ret_{h}, n{h + 1}.adj_open / n{before + 1}.adj_open - 1 as step_{h}" for h, before in STEPS)
_JOINS = " ".join(f"left join base n{i} on n{i}.ts_code = b.ts_code and n{i}.di = b.di + {i}" for i in _AHEAD)
GRID_SQL = f"""d as (select *, dense_rank() over (order by trade_date) as di from daily),
  sig as (select ts_code, di, -ROUND(vol, 0) as score from d where (k * 7 + mi) % 10 <> 0),
  base as (select d.trade_date, d.di, d.ts_code, d.k, case when open > 0 then open * adj_factor end as adj_open, coalesce(open >= up_limit, false) as at_limit, is_suspended, ln(circ_mv) as log_mv, score from d left join sig using (ts_code, di)),
  grid as (select b.*, n1.adj_open as entry_open, coalesce(n1.at_limit, false) as limit_next, coalesce(n1.is_suspended, false) as suspended_next,
     n1.adj_open is not null and not coalesce(n1.is_suspended, false) and not coalesce(n1.at_limit, false) as tradable_next,
     {_RETURNS}, p.score as score_before
   from base b {_JOINS} left join base p on p.ts_code = b.ts_code and p.di = b.di - 1)"""
NEUTRAL_SQL = """nr as (select *, case when score is not null and log_mv is not null then rank() over (partition by di, score is null or log_mv is null order by score) + (count(*) over (partition by di, score is null or log_mv is null, score) - 1) / 2.0 end as rk from grid),
  nf as (select di, avg(rk) as ms, avg(log_mv) as mx, covar_pop(rk, log_mv) / nullif(var_pop(log_mv), 0) as beta from nr where rk is not null group by di),
  neut as (select nr.*, case when rk is not null then (rk - ms) - (log_mv - mx) * coalesce(beta, 0) end as neutral from nr left join nf using (di))"""
TOP_SQL = """cnt as (select di, count(*) as n from neut where tradable_next and score is not null group by di),
  pos as (select trade_date, di, ts_code, row_number() over (partition by di order by score desc, ts_code) as p from neut where tradable_next and score is not null),
  tops as (select pos.*, p <= ceil(n * 0.1) as is_top from pos join cnt using (di)),
  full_grid as (select neut.*, coalesce(is_top, false) as is_top from neut left join (select di, ts_code, is_top from tops) t using (di, ts_code))"""
_PAIRS = " union all ".join(
    f"select trade_date, di, '{metric}' as metric, {h} as horizon, {score} as a, {value}_{h} as b from full_grid"
    for h in HORIZONS for metric, score, value in (("ic", "score", "ret"), ("ic_marginal", "score", "step"), ("ic_size_neutral", "neutral", "ret")))
PAIRS_SQL = f"""pairs as (select trade_date, di, 'autocorr' as metric, 0 as horizon, score as a, score_before as b from full_grid union all {_PAIRS}),
  ranked as (select *, rank() over (partition by metric, horizon, di order by a) + (count(*) over (partition by metric, horizon, di, a) - 1) / 2.0 as ra,
     rank() over (partition by metric, horizon, di order by b) + (count(*) over (partition by metric, horizon, di, b) - 1) / 2.0 as rb from pairs where a is not null and b is not null),
  ics as (select metric, horizon, trade_date, di, count(*) as pairs, case when count(*) >= 8 then (count(*) * sum(ra * rb) - sum(ra) * sum(rb)) / nullif(sqrt((count(*) * sum(ra * ra) - sum(ra) * sum(ra)) * (count(*) * sum(rb * rb) - sum(rb) * sum(rb))), 0) end as ic from ranked group by all)"""
SUMMARY = """count(v) as n_days, avg(v) as mean, stddev_samp(v) as std, avg(v) / nullif(stddev_samp(v), 0) as ratio, avg(v) / nullif(stddev_samp(v), 0) * sqrt(count(v) / max(h)) as t_stat, avg(case when v > 0 then 1.0 else 0.0 end) as positive_share"""
SCREEN_SQL = (DAILY_SQL, GRID_SQL, NEUTRAL_SQL, TOP_SQL, PAIRS_SQL)


def panel_once(spark, sf):
    """The monthly panel written once: a screen reads it several times."""
    return materialise(daily(spark, sf))


def grid(spark, sf):
    """The screen's grid, written once for the aggregates that follow."""
    return ops.prepare(panel_once(spark, sf), reversal, HORIZONS)


@query("scr01_signal_contract", with_sql(DAILY_SQL, "x as (select trade_date, 'k' || cast(k % 2 as varchar) as ts_code, sum(vol) as score from daily group by trade_date, k % 2)") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, score from x""")
def _(spark, sf):
    half = lambda n: F.sum(F.when(F.col("k") % 2 == n, F.col("vol"))).alias(f"k{n}")
    wide = daily(spark, sf).groupBy("trade_date").agg(half(0), half(1))
    return day_text(ops.check_signal(ops.long_signal(wide)))


@query("scr02_pruned_views", with_sql(DAILY_SQL) + "select ts_code, round(max(pb), 6) as pb from daily where trade_date between date '1997-01-01' and date '1997-12-01' group by all")
def _(spark, sf):
    from ..sources.views import Views
    views = Views({"daily": daily(spark, sf)})
    return views.load("daily", ["trade_date", "ts_code", "pb"], "1997-01-01", "1997-12-01").groupBy("ts_code").agg(r(F.max("pb")).alias("pb"))


@query("scr03_wide_pivot", with_sql(DAILY_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, round(sum(case when k % 3 = 0 then vol end), 2) as "c0", round(sum(case when k % 3 = 1 then vol end), 2) as "c1", round(sum(case when k % 3 = 2 then vol end), 2) as "c2" from daily group by trade_date""")
def _(spark, sf):
    d = daily(spark, sf).groupBy("trade_date", F.concat(F.lit("c"), (F.col("k") % 3).cast("string")).alias("ts_code")).agg(F.sum("vol").alias("vol"))
    wide = ops.wide_table(d, "vol", ["c0", "c1", "c2"])
    return day_text(wide).select("trade_date", *[r(F.col(c), 2).alias(c) for c in ("c0", "c1", "c2")])


@query("scr04_panel_features", with_sql(DAILY_SQL, GRID_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(adj_open, 6) as adj_open, at_limit, is_suspended as suspended, round(log_mv, 6) as log_mv, tradable_next from grid""")
def _(spark, sf):
    return day_text(ops.build_panel(daily(spark, sf))).select(*KEYS, r(F.col("adj_open")).alias("adj_open"), "at_limit", "suspended", r(F.col("log_mv")).alias("log_mv"), "tradable_next")


FORWARD = [f"{kind}_{h}" for h in HORIZONS for kind in ("ret", "step")]


@query("scr05_forward_returns", with_sql(DAILY_SQL, GRID_SQL) + f"""
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, {", ".join(f"round({c}, 7) as {c}" for c in FORWARD)} from grid""")
def _(spark, sf):
    out = ops.forward_returns(panel_once(spark, sf), HORIZONS)
    return day_text(out).select(*KEYS, *[r(F.col(c), 7).alias(c) for c in FORWARD])


@query("scr06_average_rank", with_sql(DAILY_SQL, "v as (select trade_date, ts_code, case when pb > 0 then vol - vol % 20 end as v from daily)") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, case when v is not null then rank() over (partition by trade_date, v is null order by v) + (count(*) over (partition by trade_date, v) - 1) / 2.0 end :: double as rank from v""")
def _(spark, sf):
    from ..operators.ordered import day_rank
    d = daily(spark, sf).select(*KEYS, F.when(F.col("pb") > 0, F.col("vol") - F.col("vol") % 20).alias("v"))
    return day_text(d.withColumn("rank", day_rank(["trade_date"], "v"))).select(*KEYS, "rank")


@query("scr06_whole_rank", with_sql(DAILY_SQL, "v as (select trade_date, ts_code, case when pb > 0 then vol - vol % 20 end as v from daily)") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, case when v is not null then rank() over (partition by v is null order by v) + (count(*) over (partition by v) - 1) / 2.0 end :: double as rank, count(v) over () as names from v where v is not null""")
def _(spark, sf):
    from ..operators.ordered import average_rank
    d = daily(spark, sf).select(*KEYS, F.when(F.col("pb") > 0, F.col("vol") - F.col("vol") % 20).alias("v")).where("v is not null")
    return day_text(average_rank(d, [], "v", "rank", count_name="names")).select(*KEYS, "rank", "names")


@query("scr07_rank_ic", with_sql(*SCREEN_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, metric, cast(horizon as bigint) as horizon, pairs, round(ic, 8) as ic from ics""")
def _(spark, sf):
    ic = ops.metric_ics(grid(spark, sf), HORIZONS, MIN)
    return day_text(ic).select("trade_date", "metric", F.col("horizon").cast("long").alias("horizon"), "pairs", r(F.col("ic"), 8).alias("ic"))


@query("scr08_size_neutral", with_sql(DAILY_SQL, GRID_SQL, NEUTRAL_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(neutral, 7) as neutral from neut""")
def _(spark, sf):
    return day_text(grid(spark, sf)).select(*KEYS, r(F.col("neutral"), 7).alias("neutral"))


@query("scr09_top_selection", with_sql(DAILY_SQL, GRID_SQL, NEUTRAL_SQL, TOP_SQL) + "select strftime(trade_date, '%Y%m%d') as trade_date, ts_code from full_grid where is_top")
def _(spark, sf):
    return day_text(grid(spark, sf).where("is_top")).select(*KEYS)


@query("scr10_series_summary", with_sql(*SCREEN_SQL, "s as (select metric, horizon, ic as v, greatest(horizon, 1) as h, date_trunc('month', trade_date) as m from ics where ic is not null)",
       f"a as (select metric, horizon, {SUMMARY} from s group by all)", "b as (select metric, horizon, m, avg(v) as v from s group by all)",
       "c as (select metric, horizon, avg(case when v > 0 then 1.0 else 0.0 end) as pms, count(*) as n_months from b group by all)") + """
select metric, cast(horizon as bigint) as horizon, n_days, round(mean, 8) as mean, round(std, 8) as std, round(ratio, 7) as ratio, round(t_stat, 6) as t_stat, round(positive_share, 8) as positive_share,
  round(pms, 8) as positive_month_share, n_months from a join c using (metric, horizon)""")
def _(spark, sf):
    ic = ops.metric_ics(grid(spark, sf), HORIZONS, MIN)
    out = ops.summarise(ic, ["metric", "horizon"], "ic", F.greatest("horizon", F.lit(1)))
    return out.select("metric", F.col("horizon").cast("long").alias("horizon"), "n_days", r(F.col("mean"), 8).alias("mean"), r(F.col("std"), 8).alias("std"), r(F.col("ratio"), 7).alias("ratio"),
                      r(F.col("t_stat")).alias("t_stat"), r(F.col("positive_share"), 8).alias("positive_share"), r(F.col("positive_month_share"), 8).alias("positive_month_share"), "n_months")


@query("scr11_marginal_decay", with_sql(*SCREEN_SQL) + """
select cast(horizon as bigint) as horizon, round(avg(ic) filter (where metric = 'ic'), 8) as ic, round(avg(ic) filter (where metric = 'ic_marginal'), 8) as ic_marginal from ics where metric in ('ic', 'ic_marginal') group by all""")
def _(spark, sf):
    ic = ops.metric_ics(grid(spark, sf), HORIZONS, MIN).where("metric in ('ic', 'ic_marginal')")
    pick = lambda name: r(F.avg(F.when(F.col("metric") == name, F.col("ic"))), 8).alias(name)
    return ic.groupBy(F.col("horizon").cast("long").alias("horizon")).agg(pick("ic"), pick("ic_marginal"))


_EXCESS = ", ".join(f"avg(ret_{h}) filter (where is_top) - avg(ret_{h}) filter (where score is not null) as x{h}" for h in HORIZONS)
EXCESS_SQL = f"""ex as (select trade_date, di, count(*) filter (where score is not null and tradable_next) as usable, count(*) filter (where is_top) as top_count, {_EXCESS} from full_grid group by all)"""
EXCESS_ROWS_SQL = "xs as (" + " union all ".join(f"select trade_date, top_count, {h} as horizon, {h} as h, case when usable >= 8 and top_count > 0 then x{h} end as v from ex" for h in HORIZONS) + ")"


@query("scr12_top_excess", with_sql(DAILY_SQL, GRID_SQL, NEUTRAL_SQL, TOP_SQL, EXCESS_SQL, EXCESS_ROWS_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, top_count, cast(horizon as bigint) as horizon, round(v, 7) as excess from xs""")
def _(spark, sf):
    out = ops.top_excess(grid(spark, sf), HORIZONS, MIN)
    return day_text(out).select("trade_date", "top_count", F.col("horizon").cast("long").alias("horizon"), r(F.col("excess"), 7).alias("excess"))


@query("scr13_turnover", with_sql(DAILY_SQL, GRID_SQL, NEUTRAL_SQL, TOP_SQL) + """
select cast(a.di as bigint) as di, round(avg(case when b.is_top then 0.0 else 1.0 end), 8) as new_share, count(*) as top_count from full_grid a left join full_grid b on a.ts_code = b.ts_code and b.di = a.di - 1 where a.is_top and a.di > 1 group by all""")
def _(spark, sf):
    out = ops.top_turnover(grid(spark, sf), first_di=1)
    return out.select(F.col("di").cast("long").alias("di"), r(F.col("new_share"), 8).alias("new_share"), "top_count")


@query("scr14_coverage", with_sql(DAILY_SQL, GRID_SQL, """c as (select di, count(score) as scored, count(*) filter (where score is not null and adj_open is not null) as sb, count(adj_open) as bars, count(*) filter (where score is not null and entry_open is not null) as e,
    count(*) filter (where score is not null and entry_open is not null and limit_next) as l, count(*) filter (where score is not null and (entry_open is null or suspended_next)) as u from grid group by di)""") + """
select count(*) filter (where scored > 0) as days_scored, round(avg(scored) filter (where scored > 0), 6) as names_per_day, round(avg(sb / bars) filter (where scored > 0), 8) as universe_share,
 round(sum(l) / sum(e), 8) as limit_excluded_share, round(sum(u) / sum(scored), 8) as unavailable_share from c""")
def _(spark, sf):
    out = ops.coverage(grid(spark, sf))
    return out.select("days_scored", r(F.col("names_per_day")).alias("names_per_day"), *[r(F.col(c), 8).alias(c) for c in ("universe_share", "limit_excluded_share", "unavailable_share")])


@query("scr15_screen_report", with_sql(*SCREEN_SQL, EXCESS_SQL, "s as (select horizon, metric, ic as v, horizon as h, date_trunc('month', trade_date) as m from ics where ic is not null and metric <> 'autocorr')",
       f"a as (select horizon, metric, {SUMMARY} from s group by all)", EXCESS_ROWS_SQL,
       f"x as (select horizon, {SUMMARY} from xs where v is not null group by all)", "t as (select avg(top_count) as tn from ex where usable >= 8)") + """
select cast(a.horizon as bigint) as horizon, a.n_days, round(a.mean, 8) as ic_mean, round(a.ratio, 7) as icir, round(a.t_stat, 6) as t_stat, round(m.mean, 8) as ic_marginal, round(n.mean, 8) as ic_size_neutral, round(n.ratio, 7) as icir_size_neutral,
  round(x.mean, 8) as top_excess_mean, round(x.positive_share, 8) as top_excess_hit, round(x.t_stat, 6) as top_excess_t_stat, round(t.tn, 6) as top_names_mean
from a join a m on m.metric = 'ic_marginal' and m.horizon = a.horizon join a n on n.metric = 'ic_size_neutral' and n.horizon = a.horizon join x on x.horizon = a.horizon, t where a.metric = 'ic'""")
def screen_report(spark, sf):
    out = ops.run_screen(panel_once(spark, sf), reversal, HORIZONS, min_names=MIN)
    digits = {"icir": 7, "icir_size_neutral": 7, "t_stat": 6, "top_excess_t_stat": 6, "top_names_mean": 6}
    names = ("ic_mean", "icir", "t_stat", "ic_marginal", "ic_size_neutral", "icir_size_neutral", "top_excess_mean", "top_excess_hit", "top_excess_t_stat", "top_names_mean")
    return out.select(F.col("horizon").cast("long").alias("horizon"), "n_days", *[r(F.col(c), digits.get(c, 8)).alias(c) for c in names])


@query("scr16_view_guard", with_sql(DAILY_SQL) + "select count(*) as rows, strftime(max(trade_date), '%Y%m%d') as last_day from daily where trade_date <= date '1999-06-01'")
def _(spark, sf):
    from ..sources.views import Views
    visible = daily(spark, sf).where("trade_date <= date '1999-06-01'")
    views = Views.open({"daily": visible}, {"kind": "decision", "decision_time": "1999-06-01 09:25:00"})
    return views.load("daily", ["trade_date"]).agg(F.count(F.lit(1)).alias("rows"), F.date_format(F.max("trade_date"), "yyyyMMdd").alias("last_day"))


# -- style ----------------------------------------------------------------------

PCT_SQL = "pct as (select *, close / lag(close) over (partition by ts_code order by trade_date) - 1 as pct_chg from daily)"


def with_pct(spark, sf):
    from pyspark.sql import Window
    own = Window.partitionBy("ts_code").orderBy("trade_date")
    return materialise(daily(spark, sf).withColumn("pct_chg", F.col("close") / F.lag("close").over(own) - 1))


SPREAD_SQL = """q as (select {g}, quantile_cont(prior, 0.3) as lo, quantile_cont(prior, 0.7) as hi, count(*) as n from {t} where prior is not null and pct_chg is not null group by all),
  sp as (select {g2}, any_value(n) as names, avg(pct_chg) filter (where prior >= hi) - avg(pct_chg) filter (where prior <= lo) as spread from {t} join q using ({g}) where prior is not null and pct_chg is not null group by all having any_value(n) >= {m})"""


@query("st01_spread_factor", with_sql(DAILY_SQL, PCT_SQL, "p as (select trade_date, pct_chg, lag(circ_mv) over (partition by ts_code order by trade_date) as prior from pct)",
       SPREAD_SQL.format(g="trade_date", g2="trade_date", t="p", m=10)) + "select strftime(trade_date, '%Y%m%d') as trade_date, round(spread, 8) as spread, names from sp")
def _(spark, sf):
    out = style.spread_factor(with_pct(spark, sf), "circ_mv", min_names=10)
    return day_text(out).select("trade_date", r(F.col("spread"), 8).alias("spread"), "names")


@query("st02_factor_legs", with_sql(DAILY_SQL, PCT_SQL, "w as (select *, dense_rank() over (order by trade_date) as di from pct where right(ts_code, 3) <> '.BJ' and ts_code not like '688%')",
       "z as (select *, case when count(turnover_rate) over ww >= 10 then avg(turnover_rate) over ww end as tm from w window ww as (partition by ts_code order by di range between 19 preceding and current row))",
       "y as (select trade_date, pct_chg, lag(circ_mv) over o as cap, lag(pb) over o as ppb, lag(tm) over o as t from z window o as (partition by ts_code order by di))",
       "p as (select 'size' as leg, -1.0 as sign, trade_date, pct_chg, cap as prior from y union all select 'value', 1.0, trade_date, pct_chg, case when ppb > 0 then 1 / ppb end from y union all select 'turnover', -1.0, trade_date, pct_chg, t from y)",
       SPREAD_SQL.format(g="leg, trade_date", g2="leg, trade_date, sign", t="p", m=10)) + "select leg, strftime(trade_date, '%Y%m%d') as trade_date, round(sign * spread, 8) as value, names from sp")
def _(spark, sf):
    out = style.factor_legs(with_pct(spark, sf), ["main", "gem"], min_names=10)
    return day_text(out).select("leg", "trade_date", r(F.col("value"), 8).alias("value"), "names")


OLS_SQL = """j as (select run_id, value - base as y, market, size from series join mkt using (trade_date)),
 m as (select run_id, count(*) as n, avg(y) as my, avg(market) as m1, avg(size) as m2, covar_pop(y, market) as cy1, covar_pop(y, size) as cy2, var_pop(market) as c11, var_pop(size) as c22, covar_pop(market, size) as c12, var_pop(y) as cyy from j group by all),
 b as (select *, (cy1 * c22 - cy2 * c12) / (c11 * c22 - c12 * c12) as b1, (cy2 * c11 - cy1 * c12) / (c11 * c22 - c12 * c12) as b2 from m),
 fit as (select *, my - b1 * m1 - b2 * m2 as intercept, n * (cyy - b1 * cy1 - b2 * cy2) as rss, n * cyy as tss from b)"""


def active_rows(spark, sf):
    return series(spark, sf).select("run_id", "trade_date", (F.col("value") - F.col("base")).alias("y")).join(F.broadcast(market_legs(spark, sf)), "trade_date")


@query("st03_factor_ols", with_sql(SERIES_SQL, OLS_SQL) + "select run_id, n, round(intercept, 9) as intercept, round(b1, 6) as beta_market, round(b2, 6) as beta_size from fit")
def _(spark, sf):
    fit = style.factor_ols(active_rows(spark, sf), ["run_id"], "y", ["market", "size"])
    return fit.select("run_id", "n", r(F.col("intercept"), 9).alias("intercept"), r(F.col("beta_market")).alias("beta_market"), r(F.col("beta_size")).alias("beta_size"))


@query("st04_tracking_error", with_sql(SERIES_SQL, OLS_SQL) + "select run_id, round(sqrt(rss / (n - 3) * 244), 8) as tracking_error, round(1 - rss / tss, 8) as r2 from fit")
def _(spark, sf):
    fit = style.factor_ols(active_rows(spark, sf), ["run_id"], "y", ["market", "size"])
    return fit.select("run_id", r(F.col("tracking_error"), 8).alias("tracking_error"), r(F.col("r2"), 8).alias("r2"))


@query("st05_benchmark_series", "select strftime(l_shipdate, '%Y%m%d') as trade_date, round(l_tax * 100 / 100.0, 8) as value, l_orderkey from lineitem where l_suppkey = 3")
def _(spark, sf):
    from ..sources.tables import table
    rows = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"), F.col("l_suppkey").cast("string").alias("ts_code"), (F.col("l_tax") * 100).cast("string").alias("pct_chg"), "l_orderkey")
    named = rows.withColumn("trade_date", F.struct("trade_date", "l_orderkey"))
    out = style.benchmark_returns(named, "3")
    return out.select(F.date_format("trade_date.trade_date", "yyyyMMdd").alias("trade_date"), r(F.col("value"), 8).alias("value"), F.col("trade_date.l_orderkey").alias("l_orderkey"))


@query("st06_curve_returns", with_sql(SERIES_SQL) + "select run_id, strftime(trade_date, '%Y%m%d') as trade_date, round(value, 7) as value from series")
def _(spark, sf):
    from .adapters import curve
    return day_text(style.curve_returns(curve(spark, sf))).select("run_id", "trade_date", r(F.col("value"), 7).alias("value"))


VALUED_SQL = """rk as (select trade_date, ts_code, close, (rank() over (partition by trade_date order by circ_mv) + (count(*) over (partition by trade_date, circ_mv) - 1) / 2.0) / count(*) over (partition by trade_date) as rs,
    (rank() over (partition by trade_date order by pb) + (count(*) over (partition by trade_date, pb) - 1) / 2.0) / count(*) over (partition by trade_date) as rp,
    (rank() over (partition by trade_date order by turnover_rate) + (count(*) over (partition by trade_date, turnover_rate) - 1) / 2.0) / count(*) over (partition by trade_date) as rt from daily),
  v as (select h.run_id, h.trade_date, h.ts_code, quantity * close as val, rs, rp, rt, quantity * close / sum(quantity * close) over (partition by h.run_id, h.trade_date) as w, sum(quantity * close) over (partition by h.run_id, h.trade_date) as gross
    from held h join rk using (trade_date, ts_code))"""


@query("st07_style_tilts", with_sql(DAILY_SQL, POSITIONS_SQL, VALUED_SQL, "d as (select run_id, trade_date, sum(w * (rs - 0.5) * 2) as s, sum(w * (rp - 0.5) * 2) as p, sum(w * (rt - 0.5) * 2) as t, count(*) as n, max(gross) as g from v group by all)") + """
select run_id, count(*) as days, round(avg(s), 7) as tilt_size, round(avg(p), 7) as tilt_pb, round(avg(t), 7) as tilt_turnover, round(avg(n), 6) as avg_names, round(avg(g), 2) as avg_long_gross from d group by all""")
def _(spark, sf):
    out = style.style_tilts(style.valued_holdings(positions(spark, sf), panel_once(spark, sf)))
    return out.select("run_id", "days", *[r(F.col(c), 7).alias(c) for c in ("tilt_size", "tilt_pb", "tilt_turnover")], r(F.col("avg_names")).alias("avg_names"), r(F.col("avg_long_gross"), 2).alias("avg_long_gross"))


@query("st08_industry_weights", with_sql(DAILY_SQL, POSITIONS_SQL, VALUED_SQL, "vint as (select distinct trade_date as vintage from daily where mi % 6 = 1)",
       "lab as (select v.*, (select max(vintage) from vint where vintage <= v.trade_date) as vt from v)",
       "ind as (select run_id, case when d.ts_code is null or d.k % 13 = 0 then '未分类' else 'I' || cast((d.k + d.mi // 6) % 12 as varchar) end as industry, sum(w) as sw from lab left join daily d on d.ts_code = lab.ts_code and d.trade_date = lab.vt group by all)",
       "n as (select run_id, count(distinct trade_date) as days from v group by all)") + """
select run_id, industry, round(sw / days, 8) as weight, place from (select *, row_number() over (partition by run_id order by sw desc, industry) as place from ind join n using (run_id)) where place <= 8""")
def _(spark, sf):
    d = panel_once(spark, sf)
    name = F.when(F.col("k") % 13 != 0, F.concat(F.lit("I"), ((F.col("k") + F.floor(F.col("mi") / 6)) % 12).cast("string")))
    vintages = d.where("mi % 6 = 1").select(F.col("trade_date").alias("vintage"), "ts_code", name.alias("l1_name"))
    out = style.industry_weights(style.valued_holdings(positions(spark, sf), d), vintages)
    return out.select("run_id", "industry", r(F.col("weight"), 8).alias("weight"), "place")


@query("st09_active_series", with_sql(SERIES_SQL) + "select run_id, strftime(trade_date, '%Y%m%d') as trade_date, round(value - base, 8) as value from series")
def _(spark, sf):
    s = series(spark, sf)
    base = s.select("run_id", "trade_date", F.col("base").alias("value"))
    return day_text(style.active_series(s.select("run_id", "trade_date", "value"), base, ["run_id", "trade_date"])).select("run_id", "trade_date", r(F.col("value"), 8).alias("value"))


@query("st12_feature_panel", with_sql(DAILY_SQL, """f0 as (select *, close / lag(close) over o - 1 as ret, close / lag(close, 5) over o - 1 as ret_5, close / lag(close, 20) over o - 1 as ret_20, lead(close, 5) over o / close - 1 as fwd, dense_rank() over (order by trade_date) as di from daily window o as (partition by ts_code order by trade_date)),
  f as (select *, case when count(ret) over w >= 20 then stddev_samp(ret) over w end as vol_20 from f0 window w as (partition by ts_code order by di rows between 19 preceding and current row)),
  s as (select trade_date, avg(ret_5) as m5, stddev_samp(ret_5) as s5, avg(ret_20) as m20, stddev_samp(ret_20) as s20, avg(vol_20) as mv, stddev_samp(vol_20) as sv, median(fwd) as med from f group by all)""") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round((ret_5 - m5) / nullif(s5, 0), 6) as z_ret_5, round((ret_20 - m20) / nullif(s20, 0), 6) as z_ret_20, round((vol_20 - mv) / nullif(sv, 0), 6) as z_vol_20,
 case when fwd is not null then case when fwd > med then 1.0 else 0.0 end end :: double as label from f join s using (trade_date)""")
def _(spark, sf):
    out = style.feature_panel(panel_once(spark, sf))
    return day_text(out).select(*KEYS, *[r(F.col(c)).alias(c) for c in ("z_ret_5", "z_ret_20", "z_vol_20")], "label")


@query("st12_fit_score")
def _(spark, sf):
    panel = materialise(style.feature_panel(panel_once(spark, sf)))
    scored = style.fit_score(panel, ["z_ret_5", "z_ret_20", "z_vol_20"], F.lit("1999-12-01").cast("date"))
    return day_text(style.equal_budget(scored, 5, 200000.0)).select(*KEYS, r(F.col("score")).alias("score"), "budget")
