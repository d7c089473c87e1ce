"""Point-in-time views over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import asof, calendar as cal_ops
from ..registry import query
from ..sources.tables import table
from .adapters import CALENDAR_SQL, NOTICES_SQL, calendar, notices, r, text_of, with_sql

WHEN = "1998-06-15 09:25:00"
SEEN_LATER = "case when seen_at > available_at then seen_at else available_at end"


@query("pit01_visible_window", with_sql(NOTICES_SQL) + f"""
select id, dataset, cast(available_at as varchar) as available_at from notices
where {SEEN_LATER} <= timestamp '{WHEN}' and {SEEN_LATER} >= timestamp '{WHEN}' - interval 6 month""")
def _(spark, sf):
    start = asof.window_start(asof.at(WHEN), 6)
    seen = asof.visible_window(notices(spark, sf), start, asof.at(WHEN), first_seen="seen_at")
    return seen.select("id", "dataset", text_of(F.col("available_at")).alias("available_at"))


@query("pit01_hidden_counts", with_sql(NOTICES_SQL) + """
select dataset, count(*) as rows, count(*) - count(available_at) as unreadable from notices group by all""")
def _(spark, sf):
    return asof.hidden_counts(notices(spark, sf))


@query("pit02_forward_events", with_sql(NOTICES_SQL) + f"""
select id from notices where available_at <= timestamp '{WHEN}'
  and (available_at >= timestamp '1998-03-15 09:25:00' or event_day + interval 400 day >= date '1998-03-15')""")
def _(spark, sf):
    df = notices(spark, sf).withColumn("float_date", F.date_add("event_day", 400))
    return asof.visible_window(df, asof.window_start(asof.at(WHEN), 3), asof.at(WHEN), forward="float_date").select("id")


@query("pit03_registry_floor", with_sql(NOTICES_SQL) + f"""
select dataset, count(*) as rows, min(event_date) as first_day from notices
where available_at <= timestamp '{WHEN}' and available_at >= case when dataset = 'fut_basic' then timestamp '1990-01-01' else timestamp '1998-03-15 09:25:00' end
group by all""")
def _(spark, sf):
    start = asof.window_floor(F.col("dataset"), asof.window_start(asof.at(WHEN), 3), ["fut_basic", "opt_basic", "cb_basic"])
    seen = asof.visible_window(notices(spark, sf), start, asof.at(WHEN))
    return seen.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.min("event_date").alias("first_day"))


@query("pit04_domain_windows", with_sql(NOTICES_SQL) + f"""
select domain, count(*) as rows from notices where available_at <= timestamp '{WHEN}'
 and available_at >= timestamp '{WHEN}' - case domain when 'macro' then interval 24 month else interval 6 month end group by all""")
def _(spark, sf):
    when = asof.at(WHEN)
    start = F.when(F.col("domain") == "macro", asof.window_start(when, 24)).otherwise(asof.window_start(when, 6))
    return asof.visible_window(notices(spark, sf), start, when).groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))


@query("pit05_first_seen_join", with_sql(NOTICES_SQL, "o as (select id, min(seen_at) as seen from notices where seen_at is not null group by all)",
       "c as (select id, case when seen = date_trunc('second', seen) then seen else date_trunc('second', seen) + interval 1 second end as seen from o)") + """
select n.id, cast(case when c.seen > n.available_at then c.seen end as varchar) as first_seen_at from notices n left join c using (id)""")
def _(spark, sf):
    df = notices(spark, sf)
    observed = df.where("seen_at is not null").select("id", "seen_at")
    joined = asof.attach_first_seen(df.drop("seen_at"), observed, ["id"])
    return joined.select("id", text_of(F.col("first_seen_at")).alias("first_seen_at"))


@query("pit06_event_store_asof", with_sql(NOTICES_SQL) + f"""
select strftime(available_at, '%Y%m') as available_month, dataset, count(*) as rows, max(id) as last_id from notices
where available_at <= timestamp '{WHEN}' and strftime(available_at, '%Y%m') between '199712' and '199806'
  and (seen_at is null or seen_at <= timestamp '{WHEN}') group by all""")
def _(spark, sf):
    from ..sources.events import read_asof
    store = notices(spark, sf).withColumn("available_month", F.date_format("available_at", "yyyyMM"))
    seen = read_asof(store, asof.at(WHEN), "199712", first_seen="seen_at")
    return seen.groupBy("available_month", "dataset").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("last_id"))


def nodes_values() -> str:
    rows = [f"('{n.name}', '{n.start}', {n.minutes}, {list(n.weekdays)}::integer[])" for n in catalog.NODES]
    return "nodes(node, clock, minutes, weekdays) as (values " + ", ".join(rows) + ")"


INSTANCES_SQL = """inst as (select node, cast(d as date) as day, d + cast(clock || ':00' as time) - time '00:00:00' as start0, minutes, clock, d, weekdays from nodes,
   (select unnest(generate_series((select min(o_orderdate) - interval 1 day from orders), (select max(o_orderdate) + interval 60 day from orders), interval 1 day)) as d)
   where len(weekdays) = 0 or list_contains(weekdays, cast(isodow(d) as integer))),
  instances as (select node, day, d + to_hours(cast(left(clock, 2) as integer)) + to_minutes(cast(right(clock, 2) as integer)) as start,
    d + to_hours(cast(left(clock, 2) as integer)) + to_minutes(cast(right(clock, 2) as integer) + minutes) as ready from inst)""".replace(
    ", d + cast(clock || ':00' as time) - time '00:00:00' as start0", "")


def span(spark, sf) -> tuple[str, str]:
    row = table(spark, sf, "orders").agg(
        F.date_sub(F.to_date(F.min("o_orderdate")), 1).cast("string"), F.date_add(F.to_date(F.max("o_orderdate")), 60).cast("string")
    ).first()
    return row[0], row[1]


@query("pit07_node_instances", with_sql(nodes_values(), INSTANCES_SQL) + """
select node, cast(day as varchar) as day, cast(start as varchar) as start, cast(ready as varchar) as ready from instances""")
def _(spark, sf):
    lo, hi = span(spark, sf)
    inst = asof.node_instances(spark, lo, hi)
    return inst.select("node", F.col("day").cast("string").alias("day"), text_of(F.col("start")).alias("start"), text_of(F.col("ready")).alias("ready"))


ASSIGN_SQL = """assigned as (select *, case when domain = 'events' and dataset = 'margin' then ['cn_preopen_margin_backfill_0905', 'cn_preopen_margin_retry_0915']
   when dataset = 'kpl_list' then ['cn_evening_full', 'cn_preopen_board_backfill_0850'] when dataset = 'report_rc' then ['cn_nightly_text_full']
   when dataset = 'stk_holdertrade' then ['cn_nightly_disclosure_full'] when dataset = 'index_global' then ['cn_nightly_global_full']
   else ['cn_evening_full'] end as nodes from notices)"""


@query("pit08_node_assignment", with_sql(NOTICES_SQL, ASSIGN_SQL) + """
select domain, dataset, array_to_string(nodes, '|') as nodes, count(*) as rows from assigned group by all""")
def _(spark, sf):
    counts = notices(spark, sf).groupBy("domain", "dataset").agg(F.count(F.lit(1)).alias("rows"))
    return asof.assign_nodes(counts, spark).select("domain", "dataset", F.array_join("nodes", "|").alias("nodes"), "rows")


@query("pit09_visible_cutoff", with_sql(NOTICES_SQL, ASSIGN_SQL, nodes_values(), INSTANCES_SQL,
       "n as (select distinct domain, dataset, unnest(nodes) as node from assigned)") + f"""
select domain, dataset, cast(max(start) as varchar) as cutoff from n left join (select * from instances where ready <= timestamp '{WHEN}') i using (node) group by all""")
def _(spark, sf):
    assigned = asof.assign_nodes(notices(spark, sf).select("domain", "dataset").distinct(), spark)
    cut = asof.visible_cutoff(assigned, asof.node_instances(spark, *span(spark, sf)), asof.at(WHEN))
    return cut.withColumn("cutoff", text_of(F.col("cutoff")))


@query("pit10_next_boundary", with_sql(NOTICES_SQL, ASSIGN_SQL, nodes_values(), INSTANCES_SQL,
       "n as (select distinct domain, dataset, unnest(nodes) as node from assigned)") + f"""
select domain, dataset, cast(min(ready) as varchar) as boundary from n left join (select * from instances where ready > timestamp '{WHEN}') i using (node) group by all""")
def _(spark, sf):
    assigned = asof.assign_nodes(notices(spark, sf).select("domain", "dataset").distinct(), spark)
    ahead = asof.next_boundary(assigned, asof.node_instances(spark, *span(spark, sf)), asof.at(WHEN))
    return ahead.withColumn("boundary", text_of(F.col("boundary")))


VISIBLE_SQL = """rel as (select a.id, min(i.ready) as ready from (select id, available_at, unnest(nodes) as node from assigned where available_at is not null) a
     join instances i on i.node = a.node and i.start >= a.available_at and i.start < a.available_at + interval 12 day group by a.id),
   shown as (select a.*, case when a.seen_at > rel.ready then a.seen_at else rel.ready end as visible_at from assigned a left join rel using (id))"""


def shown(spark, sf):
    assigned = asof.assign_nodes(notices(spark, sf), spark)
    return asof.visible_at(assigned, spark, *span(spark, sf), first_seen="seen_at")


@query("pit11_visible_at", with_sql(NOTICES_SQL, ASSIGN_SQL, nodes_values(), INSTANCES_SQL, VISIBLE_SQL) + """
select id, dataset, cast(visible_at as varchar) as visible_at from shown""")
def _(spark, sf):
    return shown(spark, sf).select("id", "dataset", text_of(F.col("visible_at")).alias("visible_at"))


@query("pit12_asof_view", with_sql(NOTICES_SQL, ASSIGN_SQL, nodes_values(), INSTANCES_SQL, VISIBLE_SQL) + f"""
select id, dataset, event_date, amount from shown where visible_at <= timestamp '{WHEN}'""")
def _(spark, sf):
    return asof.asof_view(shown(spark, sf), asof.at(WHEN)).select("id", "dataset", "event_date", "amount")


@query("pit13_asof_delta", with_sql(NOTICES_SQL, ASSIGN_SQL, nodes_values(), INSTANCES_SQL, VISIBLE_SQL) + f"""
select id, dataset, cast(visible_at as varchar) as visible_at from shown where visible_at > timestamp '1998-06-01 09:25:00' and visible_at <= timestamp '{WHEN}'""")
def _(spark, sf):
    fresh = asof.asof_delta(shown(spark, sf), asof.at("1998-06-01 09:25:00"), asof.at(WHEN))
    return fresh.select("id", "dataset", text_of(F.col("visible_at")).alias("visible_at"))


@query("pit14_latest_vintage", with_sql(NOTICES_SQL, "v as (select id, ts_code, date_trunc('month', event_day) as vintage from notices)") + f"""
select id, ts_code from v where vintage = (select max(vintage) from v where vintage <= timestamp '{WHEN}')""")
def _(spark, sf):
    vintages = notices(spark, sf).select("id", "ts_code", F.trunc("event_day", "month").alias("vintage"))
    return asof.latest_vintage(vintages, asof.at(WHEN)).select("id", "ts_code")


@query("pit15_bars_visible", """
with bars as (select l_suppkey as code, cast(l_shipdate as date) as trade_date, avg(l_extendedprice / l_quantity) as close from lineitem group by all),
 dec as (select o_orderkey as id, o_custkey % (select count(*) from supplier) as code, o_orderdate + interval '9 hours 25 minutes' as inference_at from orders),
 b as (select *, trade_date + interval '17 hours 30 minutes' as available_at from bars)
select id, strftime(b.trade_date, '%Y%m%d') as last_bar, round(b.close, 6) as close
from dec asof left join b on dec.code = b.code and dec.inference_at >= b.available_at""")
def _(spark, sf):
    from ..operators import stamps
    names = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    bars = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    bars = stamps.stamp_contract(bars, catalog.CONTRACTS["daily"])
    decisions = table(spark, sf, "orders").join(F.broadcast(names)).select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % F.col("n")).alias("code"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(9), mins=F.lit(25))).alias("inference_at"))
    found = asof.asof_join(decisions, bars, ["code"], "inference_at", "available_at", ["trade_date", "close"])
    return found.select("id", F.col("trade_date").alias("last_bar"), r(F.col("close")).alias("close"))


@query("pit15_duplicate_bars", """
select l_suppkey as code, strftime(l_shipdate, '%Y%m%d') as trade_date, count(*) as copies from lineitem group by all having count(*) > 1""")
def _(spark, sf):
    bars = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"))
    return asof.duplicate_keys(bars, ["code", "trade_date"])


@query("pit16_missing_months", with_sql(NOTICES_SQL, """have as (select distinct dataset, strftime(available_at, '%Y%m') as available_month from notices
   where available_at is not null and month(available_at) <> 1 + length(dataset) % 12)""") + """
select d.dataset, strftime(m, '%Y%m') as available_month from (select distinct dataset from have) d,
  (select unnest(generate_series(date '1996-01-01', date '1999-12-31', interval 1 month)) as m)
where (d.dataset, strftime(m, '%Y%m')) not in (select (dataset, available_month) from have)""")
def _(spark, sf):
    built = notices(spark, sf).where(F.col("available_at").isNotNull() & (F.month("available_at") != 1 + F.length("dataset") % 12))
    have = built.select("dataset", F.date_format("available_at", "yyyyMM").alias("available_month"))
    return asof.missing_months(have, "1996-01-01", "1999-12-31")


@query("pit17_excluded_columns", with_sql(NOTICES_SQL) + """
select dataset, count(amount) as amounts, count(status) as statuses from (
  select dataset, case when dataset <> 'margin' then amount end as amount, case when dataset <> 'report_rc' then status end as status from notices) group by all""")
def _(spark, sf):
    from ..sources.lake import union_datasets
    excluded = {"margin": ["amount"], "report_rc": ["status"]}
    df = notices(spark, sf)
    parts = {name: asof.drop_excluded(df.where(F.col("dataset") == name).drop("dataset"), name, excluded)
             for name in ("margin", "kpl_list", "report_rc", "daily_info", "stk_holdertrade", "index_global", "fut_basic")}
    union = union_datasets(parts)
    return union.groupBy("dataset").agg(F.count("amount").alias("amounts"), F.count("status").alias("statuses"))


@query("pit18_minute_window", """
with e as (select event_id, strftime(ts, '%Y%m%d') as trade_date, ts, value from events where ts <= timestamp '2024-01-20 11:00:00')
select event_id, trade_date, value from e where trade_date in (select distinct trade_date from e order by 1 desc limit 5)""")
def _(spark, sf):
    bars = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.col("ts").alias("available_at"), F.lit("source:trade_time_bar_close").alias("available_at_rule"), "value")
    return asof.minutes_window(bars, 5, asof.at("2024-01-20 11:00:00"))


@query("cal01_open_days", with_sql(CALENDAR_SQL) + "select cast(cal_date as varchar) as cal_date from calendar where is_open and cal_date between date '1996-01-01' and date '1999-12-31'")
def _(spark, sf):
    return cal_ops.open_days(calendar(spark, sf), "1996-01-01", "1999-12-31").select(F.col("cal_date").cast("string").alias("cal_date"))


@query("cal02_latest_published", with_sql(CALENDAR_SQL) + """
select 'daily' as rule, cast(max(cal_date) as varchar) as trade_date from calendar where is_open and cal_date + interval 19 hour <= timestamp '1998-06-15 09:25:00'
union all select 'margin', cast(max(c.cal_date) as varchar) from calendar c where c.is_open and
  (select min(n.cal_date) from calendar n where n.is_open and n.cal_date > c.cal_date) + interval 9 hour <= timestamp '1998-06-15 09:25:00'""")
def _(spark, sf):
    days, when = calendar(spark, sf), asof.at(WHEN)
    rules = {"daily": catalog.OFFICIAL["day_19"], "margin": catalog.OFFICIAL["next_open_09"]}
    parts = [cal_ops.latest_published(days, rule, when).select(F.lit(name).alias("rule"), F.col("trade_date").cast("string").alias("trade_date")) for name, rule in rules.items()]
    return parts[0].unionByName(parts[1])


@query("cal03_month_windows", """
with m as (select unnest(generate_series(date_trunc('month', cast(min(o_orderdate) as date)), cast(max(o_orderdate) as date), interval 1 month)) as f,
   min(cast(o_orderdate as date)) as lo, max(cast(o_orderdate as date)) as hi from orders)
select strftime(greatest(f, lo), '%Y%m%d') as window_start, strftime(least(last_day(f), hi), '%Y%m%d') as window_end,
  strftime(last_day(date_trunc('quarter', f) + interval 2 month), '%Y%m%d') as quarter_end, count(o_orderkey) as orders
from m left join orders on cast(o_orderdate as date) between greatest(f, lo) and least(last_day(f), hi) group by all""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    lo, hi = orders.agg(F.to_date(F.min("o_orderdate")).cast("string"), F.to_date(F.max("o_orderdate")).cast("string")).first()
    tiles = cal_ops.month_windows(spark, lo, hi)
    counts = orders.groupBy(F.trunc("o_orderdate", "month").alias("_m")).agg(F.count(F.lit(1)).alias("orders"))
    joined = tiles.withColumn("_m", F.trunc("window_start", "month")).join(counts, "_m", "left")
    shape = lambda name: F.date_format(name, "yyyyMMdd").alias(name)
    return joined.select(shape("window_start"), shape("window_end"), shape("quarter_end"), F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))


@query("cal04_replay_days", with_sql(CALENDAR_SQL) + """
select cast(cal_date as varchar) as cal_date, day_no from (select cal_date, row_number() over (order by cal_date) as day_no from calendar
 where is_open and cal_date between date '1997-03-01' and date '1998-12-31') where day_no <= 250""")
def _(spark, sf):
    opens = cal_ops.open_days(calendar(spark, sf), "1997-03-01", "1998-12-31")
    return cal_ops.replay_days(opens, "1997-03-01", "1998-12-31", 250).select(F.col("cal_date").cast("string").alias("cal_date"), "day_no")
