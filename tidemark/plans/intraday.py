"""Minute-bar reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intraday as ops
from ..registry import query
from ..sources.tables import table
from .adapters import MINUTES_SQL, minutes, r, with_sql

SIGN_SQL = """lagged as (select *, lag(close) over w as prev, lag(substr(trade_time, 12, 2)) over w as prev_hour from minutes where ts_code not like '%.BJ' window w as (partition by ts_code, trade_date order by trade_time)),
  signed as (select *, coalesce(close > 0 and prev > 0 and not (prev_hour = '11' and substr(trade_time, 12, 2) = '13'), false) as cont from lagged)"""


@query("ag01_order_flow", with_sql(MINUTES_SQL, SIGN_SQL) + """
select ts_code, trade_date, round(sum(case when cont then sign(close - prev) else 0 end * vol) / sum(vol), 8) as ofi_1d,
  round(sum(case when cont then sign(close - prev) else 0 end * amount) / greatest(sum(amount), 1e-12), 8) as ofi_amt_1d,
  count(*) filter (where cont) as nret, round(count(*) filter (where vol <= 0) / 241.0, 8) as zero_share, count(*) filter (where vol <= 0) / 241.0 >= 0.5 as sealed_limit
from signed group by all having sum(vol) > 0""")
def _(spark, sf):
    out = ops.intraday_flow(minutes(spark, sf))
    return out.select("ts_code", "trade_date", r(F.col("ofi_1d"), 8).alias("ofi_1d"), r(F.col("ofi_amt_1d"), 8).alias("ofi_amt_1d"), "nret", r(F.col("zero_share"), 8).alias("zero_share"), "sealed_limit")


PATH_SQL = """g as (select *, substr(trade_time, 12, 5) as hm, sum(case when vol > 0 then 1 else 0 end) over (partition by ts_code, trade_date order by trade_time) as traded from minutes where ts_code not like '%.BJ'),
  pth as (select *, lag(close) over (partition by ts_code, trade_date order by trade_time) as prev, row_number() over (partition by ts_code, trade_date order by trade_time) = 1 as first from g where traded > 0),
  rets as (select *, ln(close / case when first then open else prev end) as r from pth),
  m as (select ts_code, trade_date, sum(r * r) as rv, sum(case when r < 0 then r * r else 0 end) as dn, sum(case when r > 0 then r * r else 0 end) as up, sum(r * r * r) as r3, sum(r * r * r * r) as r4, count(*) as n,
    max(case when first then open end) as po, arg_max(close, trade_time) filter (where hm <= '10:00') as p10, arg_max(close, trade_time) filter (where hm <= '14:30') as p14, arg_max(close, trade_time) as pc from rets group by all),
  d as (select ts_code, trade_date, sum(vol) as v, sum(amount) as a, count(*) as n_bars, sum(case when hm <= '10:00' then vol else 0 end) as vo, sum(case when hm > '14:30' then vol else 0 end) as vc from g group by all having sum(vol) > 0)"""


@query("ag02_realised_stats", with_sql(MINUTES_SQL, PATH_SQL) + """
select ts_code, trade_date, round(rv, 8) as rv, round(case when rv > 0 then dn / rv end, 8) as rv_down_share, round(case when rv > 0 then sqrt(n) * r3 / pow(rv, 1.5) end, 7) as rsk,
  round(case when rv > 0 then n * r4 / (rv * rv) end, 7) as rku, round(up - dn, 8) as sjv, round(coalesce(p10, po) / po - 1, 8) as ret_open30,
  round(coalesce(p14, po) / coalesce(p10, po) - 1, 8) as ret_mid, round(pc / coalesce(p14, po) - 1, 8) as ret_close30, round(pc * v / a - 1, 8) as vwap_dev,
  round(vo / v, 8) as vol_open30_share, round(vc / v, 8) as vol_close30_share, n_bars from m join d using (ts_code, trade_date)""")
def _(spark, sf):
    out = ops.intraday_stats(minutes(spark, sf))
    sharp = {"rsk": 7, "rku": 7}
    return out.select(*[c if c in ("ts_code", "trade_date", "n_bars") else r(F.col(c), sharp.get(c, 8)).alias(c) for c in out.columns])


@query("ag03_path_bars", with_sql(MINUTES_SQL, PATH_SQL) + "select ts_code, trade_date, count(*) as bars, min(trade_time) as first_bar from pth group by all")
def _(spark, sf):
    path = ops.path_bars(minutes(spark, sf).where("ts_code not like '%.BJ'"))
    return path.groupBy("ts_code", "trade_date").agg(F.count(F.lit(1)).alias("bars"), F.min("trade_time").alias("first_bar"))


@query("ag04_label_prices", with_sql(MINUTES_SQL, PATH_SQL) + "select ts_code, trade_date, coalesce(p10, po) as p1000, coalesce(p14, po) as p1430, pc as p1500 from m")
def _(spark, sf):
    return ops.last_at_labels(minutes(spark, sf).where("ts_code not like '%.BJ'"), {"p1000": "10:00", "p1430": "14:30", "p1500": "15:00"})


AUCT_SQL = """auct as (select ts_code, trade_date, sum(vol) * 0.4 + 1 as vol, sum(amount) * 0.4 + 1 as amount, sum(vol) / 100.0 + 1 as dv, sum(amount) / 1000.0 + 1 as da from minutes group by all)"""


@query("ag05_auction_alignment", with_sql(MINUTES_SQL, AUCT_SQL, """o as (select trade_date, case when ts_code like '00%' then 'sz_main_00' when ts_code like '30%' then 'sz_gem_30' when ts_code like '60%' then 'sh_main_60' else 'bj' end as bucket,
   m.vol / a.vol as rawv, m.vol * case when ts_code like '00%' then 0.76 when ts_code like '30%' then 0.58 else 1 end / a.vol as corv, m.amount / a.amount as rawa from minutes m join auct a using (ts_code, trade_date) where trade_time like '%09:30%'),
  s as (select trade_date, case when ts_code like '00%' then 'sz_main_00' when ts_code like '30%' then 'sz_gem_30' when ts_code like '60%' then 'sh_main_60' else 'bj' end as bucket, sum(m.vol) / any_value(a.dv) as sv, sum(m.amount) / any_value(a.da) as sa from minutes m join auct a using (ts_code, trade_date) group by trade_date, ts_code),
  u as (select trade_date, bucket, 'raw_vol' as metric, rawv as ratio from o union all select trade_date, bucket, 'corrected_vol', corv from o union all select trade_date, bucket, 'raw_amount', rawa from o
    union all select trade_date, bucket, 'sum_vol', sv from s union all select trade_date, bucket, 'sum_amount', sa from s)""") + """
select trade_date, bucket, metric, round(quantile_cont(ratio, 0.1), 6) as p10, round(quantile_cont(ratio, 0.5), 6) as median, round(quantile_cont(ratio, 0.9), 6) as p90, count(*) as names from u group by all""")
def _(spark, sf):
    bars = minutes(spark, sf)
    sums = bars.groupBy("ts_code", "trade_date").agg(F.sum("vol").alias("v"), F.sum("amount").alias("a"))
    auct = sums.select("ts_code", "trade_date", (F.col("v") * 0.4 + 1).alias("vol"), (F.col("a") * 0.4 + 1).alias("amount"))
    day = sums.select("ts_code", "trade_date", (F.col("v") / 100.0 + 1).alias("vol"), (F.col("a") / 1000.0 + 1).alias("amount"))
    out = ops.auction_alignment(bars, auct, day)
    return out.select("trade_date", "bucket", "metric", *[r(F.col(c)).alias(c) for c in ("p10", "median", "p90")], "names")


# Daily totals from the events themselves, a stock-day in seven without, some off by a tenth.
TOTALS_SQL = """dt as (select cast(ts as date) as d, user_id % 10 as c, sum(cast(regexp_extract(props, '"k": *([0-9]+)', 1) as double)) as v, sum(greatest(value, 0.01)) as a, count(*) as n from events group by all),
  totals as (select case when c = 9 then '83000' || c || '.BJ' when c % 3 = 0 then '00000' || c || '.SZ' when c % 3 = 1 then '30000' || c || '.SZ' else '60000' || c || '.SH' end as ts_code,
    strftime(d, '%Y%m%d') as trade_date, v * case when n % 5 = 0 then 1.1 else 1.0 end as vol, a as amount from dt where n % 7 <> 0)"""


def daily_totals(spark, sf):
    c = F.col("c")
    parts = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("trade_date"), (F.col("user_id") % 10).alias("c")).agg(
        F.sum(F.get_json_object("props", "$.k").cast("double")).alias("v"), F.sum(F.greatest("value", F.lit(0.01))).alias("amount"), F.count(F.lit(1)).alias("n"))
    text = c.cast("string")
    code = (F.when(c == 9, F.concat(F.lit("83000"), text, F.lit(".BJ"))).when(c % 3 == 0, F.concat(F.lit("00000"), text, F.lit(".SZ")))
            .when(c % 3 == 1, F.concat(F.lit("30000"), text, F.lit(".SZ"))).otherwise(F.concat(F.lit("60000"), text, F.lit(".SH"))))
    return parts.where("n % 7 <> 0").select(code.alias("ts_code"), "trade_date", (F.col("v") * F.when(F.col("n") % 5 == 0, 1.1).otherwise(1.0)).alias("vol"), "amount")


@query("ag06_minute_sum_vs_daily", with_sql(MINUTES_SQL, TOTALS_SQL) + """
select case when ts_code like '00%' then 'sz_main_00' when ts_code like '30%' then 'sz_gem_30' when ts_code like '60%' then 'sh_main_60' else 'bj' end as bucket, count(*) as stock_days,
 round(avg(sv / nullif(dv, 0)), 6) as vol_ratio, round(avg(sa / nullif(da, 0)), 6) as amount_ratio from (select ts_code, trade_date, sum(m.vol) as sv, sum(m.amount) as sa, any_value(t.vol) as dv, any_value(t.amount) as da from minutes m join totals t using (ts_code, trade_date) group by all) group by all""")
def _(spark, sf):
    out = ops.minute_sums(minutes(spark, sf), daily_totals(spark, sf))
    return out.select("bucket", "stock_days", r(F.col("vol_ratio")).alias("vol_ratio"), r(F.col("amount_ratio")).alias("amount_ratio"))


@query("ag07_minute_normalise", """
with e as (select event_id, 'U' || cast(user_id % 10 as varchar) as ts_code, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as trade_time, value from events)
select ts_code, trade_time, replace(left(trade_time, 10), '-', '') as trade_date, arg_max(value, event_id) as close, trade_time as available_at, 'source:trade_time_bar_close' as available_at_rule from e group by all""")
def _(spark, sf):
    raw = table(spark, sf, "events").select(
        F.concat(F.lit(" U"), (F.col("user_id") % 10).cast("string"), F.lit(" ")).alias("ts_code"), F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm:ss ").alias("trade_time"),
        F.col("value").alias("close"), F.col("event_id").alias("row_no"))
    out = ops.normalise_minutes(raw)
    return out.select("ts_code", "trade_time", "trade_date", "close", F.col("available_at").cast("string").alias("available_at"), "available_at_rule")


@query("ag08_minute_validation", with_sql(MINUTES_SQL, """raw as (select trade_date, ts_code, trade_time from minutes union all select trade_date, ts_code, trade_time from minutes where event_id % 50 = 0),
   pc as (select trade_date, ts_code, count(*) as rows, count(*) - count(distinct trade_time) as dupes, bool_or(trade_time like '%09:30:%') as o, bool_or(trade_time like '%15:00:%') as c from raw group by all),
   want as (select distinct trade_date, '60000' || cast(n as varchar) || '.SH' as ts_code from minutes, (select unnest([2, 5, 7]) as n))""") + """
select trade_date, cast(coalesce(sum(rows), 0) as bigint) as rows, cast(coalesce(sum(dupes), 0) as bigint) as duplicates, cast(0 as bigint) as unreadable, cast(0 as bigint) as wrong_date,
 count(*) filter (where not o) as without_open, count(*) filter (where not c) as without_close, count(*) filter (where rows < 30) as short_codes,
 count(*) filter (where rows is null) as missing_codes, count(*) filter (where w is null) as extra_codes from pc full join (select *, 1 as w from want) using (trade_date, ts_code) group by all""")
def _(spark, sf):
    bars = minutes(spark, sf)
    raw = bars.unionByName(bars.where("event_id % 50 = 0"))
    days = bars.select("trade_date").distinct()
    want = days.withColumn("ts_code", F.explode(F.array(*[F.lit(f"60000{n}.SH") for n in (2, 5, 7)])))
    return ops.validate_minutes(raw, want, 30)
