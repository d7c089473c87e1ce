"""Availability stamping over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions.times import date_key, market_time
from ..operators import stamps
from ..registry import query
from ..sources.tables import table
from .adapters import CALENDAR_SQL, FILINGS_SQL, NOTICES_SQL, calendar, filings, notices, text_of, with_sql

OUT = "cast(available_at as varchar) as available_at, available_at_rule"


def shown(df, *columns):
    return df.select(*columns, text_of(F.col("available_at")).alias("available_at"), "available_at_rule")


BAD_DATES = "case when id % 97 = 0 then 'n/a' when id % 89 = 0 then ' ' || event_date || ' ' else event_date end"


def dated(spark, sf):
    bad = F.when(F.col("id") % 97 == 0, F.lit("n/a")).when(F.col("id") % 89 == 0, F.concat(F.lit(" "), "event_date", F.lit(" ")))
    return notices(spark, sf).select("id", bad.otherwise(F.col("event_date")).alias("trade_date"))


@query("av01_contract_stamp", with_sql(NOTICES_SQL, f"t as (select id, {BAD_DATES} as trade_date from notices)") + """
select id, cast(try_strptime(trim(trade_date), '%Y%m%d') + interval '17 hours 30 minutes' as varchar) as available_at,
  'contract_1730_from:trade_date' as available_at_rule from t""")
def _(spark, sf):
    return shown(stamps.stamp_contract(dated(spark, sf), catalog.CONTRACTS["daily"]), "id")


NEXT_OPEN_SQL = "nxt as (select c.cal_date, (select min(o.cal_date) from calendar o where o.is_open and o.cal_date > c.cal_date) as next_open from calendar c)"


@query("av02_official_stamp", with_sql(NOTICES_SQL, CALENDAR_SQL, NEXT_OPEN_SQL,
       f"t as (select id, try_strptime(trim({BAD_DATES}), '%Y%m%d') as d from notices)") + """
select id, 'next_open' as kind, cast(next_open + interval 9 hour as varchar) as available_at,
  case when d is null then 'missing_source_date' else 'official_next_trading_day_09_from:trade_date' end as available_at_rule
  from t left join nxt on cal_date = cast(d as date)
union all select id, 'next_day', cast(d + interval '1 day 8 hours 30 minutes' as varchar),
  case when d is null then 'missing_source_date' else 'official_next_day_0830_from:trade_date' end from t
union all select id, 'latest_only', cast(d + interval '23 hours 59 minutes 59 seconds' as varchar),
  case when d is null then 'missing_source_date' else 'conservative_date_eod' end from t""")
def _(spark, sf):
    df, cal = dated(spark, sf), calendar(spark, sf)
    kinds = {"next_open": catalog.OFFICIAL["next_open_09"], "next_day": catalog.OFFICIAL["next_day_0830"], "latest_only": catalog.OFFICIAL["latest_2230"]}
    parts = [shown(stamps.stamp_official(df, "trade_date", rule, cal), "id", F.lit(kind).alias("kind")) for kind, rule in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("av03_event_stamp", with_sql(FILINGS_SQL) + """
select id, cast(coalesce(try_strptime(ann_date, '%Y%m%d'), try_strptime(f_ann_date, '%Y%m%d')) + interval 19 hour as varchar) as available_at,
  case when try_strptime(ann_date, '%Y%m%d') is not null then 'official_19_from:trade_date'
       when try_strptime(f_ann_date, '%Y%m%d') is not null then 'fallback_conservative_from:f_ann_date'
       else 'missing_source_date' end as available_at_rule from filings""")
def _(spark, sf):
    return shown(stamps.stamp_event(filings(spark, sf), "ann_date", "f_ann_date", catalog.OFFICIAL["day_19"]), "id")


PERIODS = """select id, case id % 4 when 0 then event_date when 1 then left(event_date, 6)
  when 2 then left(event_date, 4) || 'Q' || cast(quarter(event_day) as varchar) else 'soon' end as period,
  case when id % 8 = 4 then '9:05' when id % 8 = 0 then '10:15:30' else '' end as clock, event_day from notices"""


@query("av04_macro_stamp", with_sql(NOTICES_SQL, f"t as ({PERIODS})") + """
select id, cast(case when id % 8 = 4 then event_day + interval '9 hours 5 minutes' when id % 8 = 0 then event_day + interval '10 hours 15 minutes 30 seconds'
   when id % 4 = 1 then last_day(event_day) + interval '31 days 23 hours 59 minutes 59 seconds'
   when id % 4 = 2 then last_day(cast(date_trunc('quarter', event_day) + interval 2 month as date)) + interval '45 days 23 hours 59 minutes 59 seconds' end as varchar) as available_at,
  case when id % 4 = 0 then 'source:period+clock' when id % 4 = 1 then 'conservative_month_end_plus_31d'
       when id % 4 = 2 then 'conservative_quarter_end_plus_45d' else 'missing_source_date' end as available_at_rule from t""")
def _(spark, sf):
    key = F.col("id")
    period = (
        F.when(key % 4 == 0, F.col("event_date")).when(key % 4 == 1, F.substring("event_date", 1, 6))
        .when(key % 4 == 2, F.concat(F.substring("event_date", 1, 4), F.lit("Q"), F.quarter("event_day").cast("string"))).otherwise("soon")
    )
    clock = F.when(key % 8 == 4, F.lit("9:05")).when(key % 8 == 0, F.lit("10:15:30")).otherwise("")
    df = notices(spark, sf).select("id", period.alias("period"), clock.alias("clock"))
    return shown(stamps.stamp_macro(df, "period", "clock"), "id")


@query("av05_board_stamp", with_sql(NOTICES_SQL) + """
select id, cast(case when id % 3 = 0 then event_day + interval '8 hours 31 minutes' else event_day + interval 16 hour end as varchar) as available_at,
  case when id % 3 = 0 then 'source:served_at' else 'official_16_from:trade_date' end as available_at_rule from notices""")
def _(spark, sf):
    served = F.when(F.col("id") % 6 == 0, F.concat("event_date", F.lit(" 08:31:00"))).when(
        F.col("id") % 3 == 0, F.concat(F.col("event_day").cast("string"), F.lit(" 08:31:00"))).otherwise(F.lit(""))
    df = notices(spark, sf).select("id", served.alias("served_at"), F.col("event_date").alias("trade_date"))
    return shown(stamps.stamp_board(df, "served_at", "trade_date", catalog.OFFICIAL["day_16"]), "id")


TEXT_ROWS_SQL = """t as (select id, event_day as d, cast(event_day as timestamp) as base,
  case id % 6 when 0 then event_day + interval '20 hours 10 minutes' when 1 then event_day + interval 400 day
    when 2 then cast(event_day as timestamp) when 3 then cast(event_day as timestamp) when 4 then event_day - interval 3 hour end as said,
  case when id % 6 = 2 then event_day + interval '1 day 1 hour' when id % 6 = 3 then event_day + interval 40 day end as seen from notices),
  u as (select *, case when seen is null then null when cast(seen as date) + interval '23 hours 15 minutes' <= seen
     then cast(seen as date) + interval '23 hours 15 minutes' else cast(seen as date) - interval '45 minutes' end as landed from t)"""


@query("av06_text_stamp", with_sql(NOTICES_SQL, TEXT_ROWS_SQL) + """
select id, cast(case id % 6 when 0 then said when 4 then said when 2 then landed else base + interval '23 hours 59 minutes 59 seconds' end as varchar) as available_at,
  case id % 6 when 0 then 'source:rec_time' when 4 then 'source:rec_time' when 1 then 'conservative_from:ann_date:implausible_rec_time'
    when 2 then 'first_seen_for_date_only_rec_time' when 3 then 'conservative_from:ann_date:date_only_rec_time'
    else 'conservative_from:ann_date' end as available_at_rule from u""")
def _(spark, sf):
    kind, day = F.col("id") % 6, F.col("event_day").cast("timestamp_ntz")
    shift = lambda days=0, hours=0, mins=0: day + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(mins))
    said = F.when(kind == 0, shift(0, 20, 10)).when(kind == 1, shift(400)).when(kind.isin(2, 3), day).when(kind == 4, shift(0, -3))
    seen = F.when(kind == 2, shift(1, 1)).when(kind == 3, shift(40))
    df = notices(spark, sf).select("id", F.col("event_date").alias("ann_date"), F.date_format(said, "yyyy-MM-dd HH:mm:ss").alias("rec_time"), seen.alias("seen"))
    node = next(n for n in catalog.NODES if n.name == catalog.TEXT)
    return shown(stamps.stamp_text(df, "ann_date", "rec_time", "seen", node), "id")


@query("av07_minute_stamp", """select event_id, strftime(ts, '%Y%m%d') as trade_date, cast(date_trunc('second', ts) as varchar) as available_at,
  'source:trade_time_bar_close' as available_at_rule from events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("trade_time"))
    return shown(stamps.stamp_minutes(df), "event_id", "trade_date")


@query("av08_auction_stamp", with_sql(NOTICES_SQL) + """
select id, cast(event_day + interval '9 hours 29 minutes' as varchar) as available_at,
 'official_auction_0929_from:trade_date' as available_at_rule from notices""")
def _(spark, sf):
    df = notices(spark, sf).select("id", F.col("event_date").alias("trade_date"))
    return shown(stamps.stamp_auction(df), "id")


D = "try_strptime({0}, '%Y%m%d') + interval 18 hour"


@query("av09_statement_rules", with_sql(FILINGS_SQL) + f"""
select id, 'income_vip' as dataset, cast(coalesce({D.format('f_ann_date')}, {D.format('ann_date')}) as varchar) as available_at,
  case when f_ann_date is not null then 'source:f_ann_date_or_ann_date' when ann_date <> '' then 'source:f_ann_date_or_ann_date:ann_date'
    else 'missing_source_date' end as available_at_rule from filings
union all select id, 'forecast_vip', cast({D.format('ann_date')} as varchar), case when ann_date <> '' then 'source:ann_date' else 'missing_source_date' end from filings
union all select id, 'dividend', cast(case when trim(div_proc) = '实施' and imp_ann_date is null then null
   else coalesce({D.format('imp_ann_date')}, {D.format('ann_date')}) end as varchar),
  case when (trim(div_proc) = '实施' and imp_ann_date is null) or (imp_ann_date is null and ann_date = '') then 'missing_announcement_date_not_pit_visible'
    when imp_ann_date is not null then 'source:imp_ann_date_or_ann_date' else 'source:imp_ann_date_or_ann_date:ann_date' end from filings
union all select id, 'disclosure_date', cast(case when actual_date > ann_date then {D.format('actual_date')}
    else coalesce({D.format('ann_date')}, {D.format('pre_date')}) end as varchar),
  case when actual_date > ann_date then 'source:actual_date' when ann_date <> '' then 'source:ann_date_or_pre_date'
    else 'source:ann_date_or_pre_date:pre_date' end from filings""")
def _(spark, sf):
    df, out = filings(spark, sf), None
    for dataset in ("income_vip", "forecast_vip", "dividend", "disclosure_date"):
        part = shown(stamps.stamp_fundamental(dataset, df), "id", F.lit(dataset).alias("dataset"))
        out = part if out is None else out.unionByName(part)
    return out


@query("av10_latest_statement", with_sql(FILINGS_SQL, f"""
s as (select ts_code, end_date, max(coalesce({D.format('f_ann_date')}, {D.format('ann_date')})) as latest from filings group by all),
j as (select f.*, s.latest, {D.format('f.ann_date')} as own from filings f left join s using (ts_code, end_date))""") + """
select id, 'fina_indicator_vip' as dataset, cast(case when latest > own then latest else own end as varchar) as available_at,
  case when latest > own then 'fallback_joined_statement_available_at' when own is null then 'missing_source_date' else 'source:ann_date' end as available_at_rule from j
union all select id, 'fina_audit', cast(coalesce(own, latest) as varchar),
  case when own is not null then 'source:ann_date' when latest is not null then 'fallback_joined_statement_available_at' else 'missing_source_date' end from j""")
def _(spark, sf):
    df = filings(spark, sf)
    joined = stamps.join_latest_statement(df, stamps.stamp_fundamental("income_vip", df))
    parts = [
        shown(stamps.stamp_fundamental(name, joined, "latest_statement_at"), "id", F.lit(name).alias("dataset"))
        for name in ("fina_indicator_vip", "fina_audit")
    ]
    return parts[0].unionByName(parts[1])


@query("av11_schedule_split", with_sql(FILINGS_SQL) + """
select id, ann_date, actual_date from filings
union all select id, ann_date, null from filings where ann_date <> '' and actual_date > ann_date""")
def _(spark, sf):
    return stamps.split_schedule(filings(spark, sf)).select("id", "ann_date", "actual_date")


@query("av12_business_key", with_sql(FILINGS_SQL) + """
select id, '{"dataset":"dividend","values":{"ann_date":"' || ann_date || '","div_proc":"' || trim(div_proc) || '","end_date":"' || end_date
  || '","ts_code":"' || ts_code || '"}}' as business_key from filings""")
def _(spark, sf):
    key = stamps.business_key("dividend", ["ts_code", "end_date", "ann_date", "div_proc"])
    return filings(spark, sf).select("id", key.alias("business_key"))


@query("av13_mixed_timestamps", """
select event_id, cast(case event_id % 5 when 4 then null when 3 then date_trunc('second', ts) + interval 8 hour when 2 then date_trunc('second', ts) + interval '2 hours 30 minutes' else date_trunc('second', ts) end as varchar) as market_at from events""")
def _(spark, sf):
    text, kind = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id") % 5
    spelled = (
        F.when(kind == 0, text).when(kind == 1, F.concat(F.translate(text, " ", "T"), F.lit("+08:00")))
        .when(kind == 2, F.concat(text, F.lit("+05:30"))).when(kind == 3, F.concat(F.translate(text, " ", "T"), F.lit("Z")))
        .otherwise(F.lit("not a time"))
    )
    return table(spark, sf, "events").select("event_id", text_of(market_time(spelled)).alias("market_at"))


@query("av14_date_key", with_sql(NOTICES_SQL) + """
select id, case id % 4 when 3 then '' else event_date end as day_key from notices""")
def _(spark, sf):
    key = F.col("id") % 4
    spelled = (
        F.when(key == 0, F.col("event_date")).when(key == 1, F.col("event_day").cast("string"))
        .when(key == 2, F.concat(F.col("event_day").cast("string"), F.lit(" 00:00:00"))).otherwise(F.substring("event_date", 1, 6))
    )
    return notices(spark, sf).select("id", date_key(spelled).alias("day_key"))


@query("av15_restamp_report", with_sql(NOTICES_SQL) + """
select strftime(event_day, '%Y%m') as month, count(*) as rows, count(*) filter (where id % 11 <> 0) as moved
from notices group by all""")
def _(spark, sf):
    from ..functions.times import at_clock
    clock = F.when(F.col("id") % 11 == 0, at_clock(F.col("event_day"), "19:00")).otherwise(at_clock(F.col("event_day"), "17:30"))
    held = notices(spark, sf).select(
        "id", F.col("event_date").alias("trade_date"), F.date_format("event_day", "yyyyMM").alias("month"),
        clock.alias("available_at"), F.lit("official_19_from:trade_date").alias("available_at_rule"),
    )
    _, report = stamps.restamp(held, lambda df: stamps.stamp_official(df, "trade_date", catalog.OFFICIAL["day_19"]), "month")
    return report


@query("av16_normalise_columns", "select o_orderkey as \"OrderKey\", o_totalprice as \"Price\" from orders")
def _(spark, sf):
    served = table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "ORDERKEY", "o_totalprice": "PRICE"})
    return stamps.normalise_columns(served, ["OrderKey", "Price", "Absent"], required=["orderkey"])


@query("av17_macro_contract", with_sql(NOTICES_SQL) + """
select id, dataset, cast(case when dataset in ('daily_info', 'fut_basic') then event_day + interval '17 hours 30 minutes' else event_day + interval '23 hours 59 minutes 59 seconds' end as varchar) as available_at,
  case dataset when 'daily_info' then 'contract_1730_from:trade_date' when 'fut_basic' then 'contract_1730_from:list_date' else 'conservative_date_eod' end as available_at_rule
from notices where domain = 'macro'""")
def _(spark, sf):
    macro = notices(spark, sf).where("domain = 'macro'").select(
        "id", "dataset", F.when(F.col("dataset") != "fut_basic", F.col("event_date")).alias("trade_date"),
        F.when(F.col("dataset") == "fut_basic", F.col("event_date")).alias("list_date"),
    )
    raw = macro.withColumn("_d", F.coalesce("trade_date", "list_date"))
    raw = stamps.stamp_macro(raw, "_d").drop("_d")
    return shown(stamps.apply_close_contracts(raw, spark), "id", "dataset")
