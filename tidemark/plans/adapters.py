"""Domain-shaped views over the star-schema tables.

Each view exists twice: as a DataFrame and as the SQL the oracle starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import rounded
from ..sources.tables import table


def text_of(stamp):
    """Stamps leave a query as text, so no client zone can shift them."""
    return stamp.cast("timestamp_ntz").cast("string")


r = rounded


# -- dated events with availability ------------------------------------------

DATASET_NAMES = ("margin", "kpl_list", "report_rc", "daily_info", "stk_holdertrade", "index_global", "fut_basic")
DOMAIN_NAMES = ("events", "events", "events", "macro", "events", "macro", "macro")

NOTICES_SQL = """notices as (
  select o_orderkey as id, o_custkey as code_no, 'C' || cast(o_custkey as varchar) as ts_code,
    (['margin','kpl_list','report_rc','daily_info','stk_holdertrade','index_global','fut_basic'])[o_orderkey % 7 + 1] as dataset,
    (['events','events','events','macro','events','macro','macro'])[o_orderkey % 7 + 1] as domain,
    cast(o_orderdate as date) as event_day,
    strftime(o_orderdate, '%Y%m%d') as event_date,
    case when o_orderkey % 211 = 0 then null else
      o_orderdate + to_days(cast(left(o_orderpriority, 1) as integer))
        + to_hours(cast(o_orderkey % 24 as integer)) + to_minutes(cast(o_orderkey % 60 as integer)) end as available_at,
    case when o_orderkey % 10 = 0 then
      o_orderdate + to_days(cast(left(o_orderpriority, 1) as integer))
        + to_hours(cast(o_orderkey % 24 + o_orderkey % 7 - 2 as integer)) + to_minutes(cast(o_orderkey % 60 as integer))
        + to_milliseconds(case when o_orderkey % 20 = 0 then 500 else 0 end) end as seen_at,
    o_totalprice as amount, o_orderpriority as priority, o_orderstatus as status
  from orders)"""


def notices(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    lag = F.substring("o_orderpriority", 1, 1).cast("int")
    hours, minutes = (key % 24).cast("int"), (key % 60).cast("int")
    published = F.col("o_orderdate") + F.make_dt_interval(lag, hours, minutes)
    half = F.when(key % 20 == 0, F.lit(0.5)).otherwise(F.lit(0.0)).cast("decimal(18,6)")
    seen = F.col("o_orderdate") + F.make_dt_interval(lag, (hours + key % 7 - 2).cast("int"), minutes, half)
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (key % 7 + 1).cast("int"))
    return orders.select(
        key.alias("id"), F.col("o_custkey").alias("code_no"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ts_code"),
        pick(DATASET_NAMES).alias("dataset"), pick(DOMAIN_NAMES).alias("domain"),
        F.to_date("o_orderdate").alias("event_day"), F.date_format("o_orderdate", "yyyyMMdd").alias("event_date"),
        F.when(key % 211 != 0, published).alias("available_at"), F.when(key % 10 == 0, seen).alias("seen_at"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )


# Weekdays between the first and last order date, ten days of margin either side.
CALENDAR_SQL = """calendar as (
  select cast(d as date) as cal_date, isodow(d) <= 5 as is_open
  from (select unnest(generate_series(min(o_orderdate) - interval 10 day, max(o_orderdate) + interval 40 day, interval 1 day)) as d from orders))"""


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    span = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    days = span.select(F.explode(F.sequence(F.date_sub("lo", 10), F.date_add("hi", 40))).alias("cal_date"))
    return days.select("cal_date", (F.weekday("cal_date") < 5).alias("is_open"))


# -- disclosure rows with several dates ------------------------------------------

FILINGS_SQL = """filings as (
  select o_orderkey as id, 'C' || cast(o_custkey % 500 as varchar) as ts_code,
    strftime(date_trunc('quarter', o_orderdate) - interval 1 day, '%Y%m%d') as end_date,
    case when o_orderkey % 5 = 0 then '' else strftime(o_orderdate, '%Y%m%d') end as ann_date,
    case when o_orderkey % 3 = 0 then null else strftime(o_orderdate + to_days(cast(o_orderkey % 4 as integer)), '%Y%m%d') end as f_ann_date,
    case when o_orderkey % 4 = 0 then strftime(o_orderdate + to_days(cast(o_orderkey % 30 as integer)), '%Y%m%d') end as actual_date,
    strftime(o_orderdate + interval 20 day, '%Y%m%d') as pre_date,
    case when o_orderkey % 2 = 0 then strftime(o_orderdate + interval 9 day, '%Y%m%d') end as imp_ann_date,
    case o_orderkey % 3 when 0 then '实施' when 1 then '实施 ' else '预案' end as div_proc,
    o_totalprice as amount, o_orderkey % 3 as update_flag
  from orders)"""


def filings(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = lambda days: F.date_format(F.date_add(F.to_date("o_orderdate"), days), "yyyyMMdd")
    quarter = F.date_sub(F.trunc("o_orderdate", "quarter"), 1)
    return table(spark, sf, "orders").select(
        key.alias("id"), F.concat(F.lit("C"), (F.col("o_custkey") % 500).cast("string")).alias("ts_code"),
        F.date_format(quarter, "yyyyMMdd").alias("end_date"),
        F.when(key % 5 == 0, F.lit("")).otherwise(text(F.lit(0))).alias("ann_date"),
        F.when(key % 3 != 0, text((key % 4).cast("int"))).alias("f_ann_date"),
        F.when(key % 4 == 0, text((key % 30).cast("int"))).alias("actual_date"),
        text(F.lit(20)).alias("pre_date"),
        F.when(key % 2 == 0, text(F.lit(9))).alias("imp_ann_date"),
        F.when(key % 3 == 0, F.lit("实施")).when(key % 3 == 1, F.lit("实施 ")).otherwise(F.lit("预案")).alias("div_proc"),
        F.col("o_totalprice").alias("amount"), (key % 3).alias("update_flag"),
    )


def with_sql(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


# -- names, daily and minute bars --------------------------------------------

def code_sql(key: str) -> str:
    """Security-style code of a number: board prefix, number, exchange."""
    number = f"lpad(cast({key} as varchar), cast(greatest(3, length(cast({key} as varchar))) as integer), '0')"
    return (
        f"case {key} % 6 when 0 then '000' || {number} || '.SZ' when 1 then '002' || {number} || '.SZ' when 2 then '300' || {number} || '.SZ' "
        f"when 3 then '600' || {number} || '.SH' when 4 then '688' || {number} || '.SH' else '830' || {number} || '.BJ' end"
    )


def code_of(key):
    number = F.lpad(key.cast("string"), 12, "0")
    trimmed = F.when(F.length(key.cast("string")) >= 3, key.cast("string")).otherwise(F.substring(number, 10, 3))
    part, out = key % 6, None
    for rest, (prefix, suffix) in enumerate((("000", ".SZ"), ("002", ".SZ"), ("300", ".SZ"), ("600", ".SH"), ("688", ".SH"), ("830", ".BJ"))):
        named = F.concat(F.lit(prefix), trimmed, F.lit(suffix))
        out = F.when(part == rest, named) if out is None else out.when(part == rest, named)
    return out


# One bar per supplier and month: the "trading day" is the month's first day.
DAILY_SQL = f"""prices as (select l_suppkey as k, cast(date_trunc('month', l_shipdate) as date) as trade_date, l_extendedprice / l_quantity as p,
    l_quantity as q, l_extendedprice as e, l_discount as d from lineitem),
  agg as (select k, trade_date, min(p) as low, max(p) as high, avg(p) as close, sum(q) as vol, sum(e) as amount, avg(d) as disc, count(*) as n,
    year(trade_date) * 12 + month(trade_date) as mi from prices group by all),
  daily as (select a.k, {code_sql('a.k')} as ts_code, trade_date, low, high, close, 0.7 * close + 0.3 * low as open, vol, amount, mi,
    (s_acctbal + 2000) * close as circ_mv, case when n % 7 = 0 then -1.0 else 1.0 + 20 * disc end as pb, vol / (1000 + a.k % 7 * 100) as turnover_rate,
    case when (a.k + mi) % 11 = 0 then 0.7 * close + 0.3 * low else high * 1.1 end as up_limit, low * 0.9 as down_limit,
    (a.k + mi) % 17 = 0 as is_suspended, 1.0 + (a.k % 3) * (mi - 23940) * 0.01 as adj_factor,
    case when (a.k + mi) % 13 = 0 then 0.9 else 1.0 end * lag(close) over (partition by a.k order by trade_date) as pre_close
    from agg a join supplier on s_suppkey = a.k)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    price = F.col("l_extendedprice") / F.col("l_quantity")
    bars = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.trunc("l_shipdate", "month").alias("trade_date")).agg(
        F.min(price).alias("low"), F.max(price).alias("high"), F.avg(price).alias("close"), F.sum("l_quantity").alias("vol"),
        F.sum("l_extendedprice").alias("amount"), F.avg("l_discount").alias("disc"), F.count(F.lit(1)).alias("n"),
    )
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    k, mi = F.col("k"), F.year("trade_date") * 12 + F.month("trade_date")
    open_price = 0.7 * F.col("close") + 0.3 * F.col("low")
    own = Window.partitionBy("k").orderBy("trade_date")
    reset = F.when((k + mi) % 13 == 0, 0.9).otherwise(1.0)
    return bars.join(names, "k").select(
        "k", code_of(k).alias("ts_code"), "trade_date", "low", "high", "close", open_price.alias("open"), "vol", "amount", mi.cast("long").alias("mi"),
        ((F.col("s_acctbal") + 2000) * F.col("close")).alias("circ_mv"),
        F.when(F.col("n") % 7 == 0, -1.0).otherwise(1.0 + 20 * F.col("disc")).alias("pb"),
        (F.col("vol") / (1000 + k % 7 * 100)).alias("turnover_rate"),
        F.when((k + mi) % 11 == 0, open_price).otherwise(F.col("high") * 1.1).alias("up_limit"), (F.col("low") * 0.9).alias("down_limit"),
        ((k + mi) % 17 == 0).alias("is_suspended"), (1.0 + (k % 3) * (mi - 23940) * 0.01).alias("adj_factor"),
        (reset * F.lag("close").over(own)).alias("pre_close"),
    )


# Event clocks scaled onto the 241 minute labels 09:30, 09:31-11:30, 13:01-15:00; a bar sums all events of its slot.
MINUTES_SQL = """grid as (select event_id, user_id % 10 as c, cast(ts as date) as d, ts,
    cast((hour(ts) * 60 + minute(ts)) * 241 // 1440 as bigint) as slot, greatest(value, 0.01) as close, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as double) as vol from events),
  lowest as (select c, d, slot, arg_max(close, event_id) as close, sum(vol) as vol, min(event_id) as event_id from grid group by all),
  minutes as (select case when c = 9 then '83000' || c || '.BJ' when c % 3 = 0 then '00000' || c || '.SZ' when c % 3 = 1 then '30000' || c || '.SZ' else '60000' || c || '.SH' end as ts_code,
    strftime(d, '%Y%m%d') as trade_date,
    strftime(d + to_minutes(cast(case when slot <= 120 then 570 + slot else 660 + slot end as integer)), '%Y-%m-%d %H:%M:%S') as trade_time,
    coalesce(lag(close) over (partition by c, d order by slot), close) as open, close, vol, close * vol as amount, event_id from lowest)"""


def minutes(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    ts, c, slot = F.col("ts"), F.col("c"), F.col("slot")
    grid = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 10).alias("c"), F.to_date(ts).alias("d"),
        F.floor((F.hour(ts) * 60 + F.minute(ts)) * 241 / 1440).cast("int").alias("slot"), F.greatest("value", F.lit(0.01)).alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("vol"),
    )
    low = grid.groupBy("c", "d", "slot").agg(
        F.max_by("close", "event_id").alias("close"), F.sum("vol").alias("vol"), F.min("event_id").alias("event_id")
    )
    before = F.lag("close").over(Window.partitionBy("c", "d").orderBy("slot"))
    text = c.cast("string")
    code = (
        F.when(c == 9, F.concat(F.lit("83000"), text, F.lit(".BJ"))).when(c % 3 == 0, F.concat(F.lit("00000"), text, F.lit(".SZ")))
        .when(c % 3 == 1, F.concat(F.lit("30000"), text, F.lit(".SZ"))).otherwise(F.concat(F.lit("60000"), text, F.lit(".SH")))
    )
    at = F.col("d").cast("timestamp_ntz") + F.make_dt_interval(mins=F.when(slot <= 120, 570 + slot).otherwise(660 + slot))
    return low.select(
        code.alias("ts_code"), F.date_format("d", "yyyyMMdd").alias("trade_date"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("trade_time"),
        F.coalesce(before, "close").alias("open"), "close", "vol", (F.col("close") * F.col("vol")).alias("amount"), "event_id",
    )


# -- return series, curves and fills ------------------------------------------

# One series per order priority; a day's return comes from its cents, so it is exact.
SERIES_SQL = """cents as (select o_orderpriority as run_id, cast(o_orderdate as date) as trade_date, cast(sum(cast(ROUND(o_totalprice * 100) as bigint)) as bigint) as c from orders group by all),
  series as (select run_id, trade_date, (c % 40000 - 19900) / 1000000.0 as value, (c % 30000 - 15000) / 1500000.0 as base, c from cents),
  mkt as (select trade_date, (cast(sum(c) as bigint) % 20000 - 9950) / 1000000.0 as market, (cast(sum(c) as bigint) % 7919 - 3959) / 1000000.0 as size from cents group by all),
  curve as (select run_id, trade_date, 1000000.0 as initial_equity, 1000000.0 * exp(sum(ln(1 + value)) over w) as equity,
     1000000.0 * exp(sum(ln(1 + value)) over w) * (c % 7) / 10.0 as cash, value, base from series window w as (partition by run_id order by trade_date))"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    days = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run_id"), F.to_date("o_orderdate").alias("trade_date")).agg(F.sum(cents).alias("c"))
    return days.select("run_id", "trade_date", ((F.col("c") % 40000 - 19900) / 1000000.0).alias("value"), ((F.col("c") % 30000 - 15000) / 1500000.0).alias("base"), "c")


def market_legs(spark: SparkSession, sf: str) -> DataFrame:
    total = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("trade_date")).agg(total.alias("t"))
    return days.select("trade_date", ((F.col("t") % 20000 - 9950) / 1000000.0).alias("market"), ((F.col("t") % 7919 - 3959) / 1000000.0).alias("size"))


def curve(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("trade_date")
    equity = 1000000.0 * F.exp(F.sum(F.log(1 + F.col("value"))).over(order))
    return series(spark, sf).withColumns({"initial_equity": F.lit(1000000.0), "equity": equity}).withColumn("cash", F.col("equity") * (F.col("c") % 7) / 10.0)


FILLS_SQL = """fills as (select o_orderpriority as run_id, 'S' || cast(l_partkey % 500 as varchar) as ts_code, l_partkey % 500 as symbol_no,
    case when l_returnflag = 'A' or (l_returnflag = 'N' and l_orderkey % 2 = 0) then 'buy' else 'sell' end as action, cast(l_quantity as bigint) as quantity,
    l_extendedprice / l_quantity as price, cast(l_shipdate as date) as fill_date, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    case when l_linestatus = 'F' then 'filled' else 'rejected' end as status,
    case when l_linestatus <> 'F' then (['suspended', 'invalid_buy_lot', 'unfilled_limit', 'cash'])[l_linenumber % 4 + 1] end as reason,
    case when l_linestatus = 'F' and not (l_returnflag = 'A' or (l_returnflag = 'N' and l_orderkey % 2 = 0)) then (l_extendedprice / l_quantity - 1500) * l_quantity end as realized_pnl,
    l_extendedprice * 0.00025 as commission, l_extendedprice * 0.0005 as stamp_duty
  from lineitem join orders on o_orderkey = l_orderkey)"""


def fills(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("run_id"))
    buy = (F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & (F.col("l_orderkey") % 2 == 0))
    price, filled = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_linestatus") == "F"
    reasons = F.array(*[F.lit(name) for name in ("suspended", "invalid_buy_lot", "unfilled_limit", "cash")])
    return table(spark, sf, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "run_id", F.concat(F.lit("S"), (F.col("l_partkey") % 500).cast("string")).alias("ts_code"), (F.col("l_partkey") % 500).alias("symbol_no"),
        F.when(buy, "buy").otherwise("sell").alias("action"), F.col("l_quantity").cast("long").alias("quantity"), price.alias("price"),
        F.to_date("l_shipdate").alias("fill_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(filled, "filled").otherwise("rejected").alias("status"),
        F.when(~filled, F.element_at(reasons, (F.col("l_linenumber") % 4 + 1).cast("int"))).alias("reason"),
        F.when(filled & ~buy, (price - 1500) * F.col("l_quantity")).alias("realized_pnl"),
        (F.col("l_extendedprice") * 0.00025).alias("commission"), (F.col("l_extendedprice") * 0.0005).alias("stamp_duty"))


# Three holdings per run and date of the monthly panel, as a symbol -> quantity map.
POSITIONS_SQL = """held as (select 'R' || cast(k % 3 as varchar) as run_id, trade_date, ts_code, (k % 5 + 1) * 100 as quantity from daily where (k + mi) % 9 = 0)"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings rows; the map form is tested on fixtures, where books are small."""
    rows = daily(spark, sf).where("(k + mi) % 9 = 0")
    return rows.select(F.concat(F.lit("R"), (F.col("k") % 3).cast("string")).alias("run_id"), "trade_date", "ts_code", ((F.col("k") % 5 + 1) * 100).alias("quantity"))


# Filled lines as trades in the monthly panel's names: three books, board-lot sizes.
TRADES_SQL = f"""trades as (select 'B' || cast(l_linenumber % 3 as varchar) as run_id, {code_sql('l_suppkey')} as ts_code, cast(date_trunc('month', l_shipdate) as date) as trade_date,
    case when l_returnflag = 'A' or (l_returnflag = 'N' and l_orderkey % 2 = 0) then 'buy' else 'sell' end as action, cast(l_quantity as bigint) * 100 as quantity, l_extendedprice / l_quantity as price,
    l_orderkey, l_linenumber, l_partkey from lineitem where l_linestatus = 'F')"""
TRADE_ORDER = ["trade_date", "l_orderkey", "l_linenumber", "l_partkey"]


def trades(spark: SparkSession, sf: str) -> DataFrame:
    buy = (F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & (F.col("l_orderkey") % 2 == 0))
    return table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(
        F.concat(F.lit("B"), (F.col("l_linenumber") % 3).cast("string")).alias("run_id"), code_of(F.col("l_suppkey")).alias("ts_code"), F.trunc("l_shipdate", "month").alias("trade_date"),
        F.when(buy, "buy").otherwise("sell").alias("action"), (F.col("l_quantity").cast("long") * 100).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_orderkey", "l_linenumber", "l_partkey")
