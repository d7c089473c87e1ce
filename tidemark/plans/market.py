"""Panels, joins, universe and scalar price rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, values
from ..operators import asof, auction, membership, orders as order_ops, panel, universe, units
from ..registry import query
from ..sources.tables import table
from .adapters import DAILY_SQL, FILINGS_SQL, MINUTES_SQL, code_of, code_sql, daily, filings, minutes, r, with_sql

KEYS = ["trade_date", "ts_code"]


def day_text(df):
    return df.withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))


def sides(spark, sf):
    d = daily(spark, sf)
    basic = d.where("k % 10 <> 9").select(*KEYS, "close", "turnover_rate", "pb", "circ_mv")
    limits = d.where("k % 8 <> 7").select(*KEYS, "pre_close", "up_limit", "down_limit")
    adjust = d.where("k % 9 <> 8").select(*KEYS, "adj_factor")
    halts = d.where("(k + mi) % 17 <= 1").select(*KEYS, F.when(F.col("is_suspended"), "S").otherwise("R").alias("suspend_type"))
    return d.select(*KEYS, "open", "close", "vol"), basic, limits, adjust, halts


@query("j01_daily_panel", with_sql(DAILY_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(open, 6) as open, round(vol, 2) as vol,
  case when k % 10 <> 9 and trade_date < date '2000-05-01' then round(turnover_rate, 6) end as turnover_rate,
  case when k % 8 <> 7 then round(up_limit, 6) end as up_limit,
  case when k % 9 <> 8 and trade_date < date '2000-06-01' then round(adj_factor, 6) end as adj_factor, is_suspended
from daily where trade_date < date '2000-06-01'""")
def _(spark, sf):
    seen = {"daily": F.col("trade_date") < "2000-06-01", "daily_basic": F.col("trade_date") < "2000-05-01", "adj_factor": F.col("trade_date") < "2000-06-01"}
    out = panel.daily_panel(*sides(spark, sf), visible=seen)
    return day_text(out).select(*KEYS, r(F.col("open")).alias("open"), r(F.col("vol"), 2).alias("vol"), r(F.col("turnover_rate")).alias("turnover_rate"),
                                r(F.col("up_limit")).alias("up_limit"), r(F.col("adj_factor")).alias("adj_factor"), "is_suspended")


@query("j02_halt_flag", with_sql(DAILY_SQL) + """
select strftime(trade_date, '%Y%m') as month, count(*) as rows, count(*) filter (where is_suspended) as halted from daily group by all""")
def _(spark, sf):
    d, _, _, _, halts = sides(spark, sf)
    flagged = panel.halt_flag(d, halts)
    return flagged.groupBy(F.date_format("trade_date", "yyyyMM").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_suspended").alias("halted"))


MEMBER_SQL = """spans as (select 'C' || cast(o_custkey as varchar) as ts_code, 'G' || cast(o_orderkey % 12 as varchar) as l1_code,
    strftime(o_orderdate, '%Y%m%d') as in_date,
    case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then 'None' else strftime(o_orderdate + interval 400 day, '%Y%m%d') end as out_date from orders)"""


def spans(spark, sf):
    key = F.col("o_orderkey")
    out = F.when(key % 3 == 0, "").when(key % 3 == 1, "None").otherwise(F.date_format(F.date_add(F.to_date("o_orderdate"), 400), "yyyyMMdd"))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ts_code"), F.concat(F.lit("G"), (key % 12).cast("string")).alias("l1_code"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("in_date"), out.alias("out_date"))


@query("j03_membership_asof", with_sql(MEMBER_SQL) + """
select ts_code, l1_code from (select *, row_number() over (partition by ts_code order by in_date desc, out_date desc, l1_code desc) as rn from spans
 where in_date <= '19990615' and (out_date in ('', 'None') or out_date > '19990615')) where rn = 1""")
def _(spark, sf):
    return membership.membership_asof(spans(spark, sf).select("ts_code", "in_date", "out_date", "l1_code"), F.lit("19990615"))


@query("j04_classification_switch", with_sql(MEMBER_SQL) + """
select ts_code, case when day = '20220105' then 'N' || l1_code else l1_code end as l1_code, case when day = '20220105' then 'new ' else 'old ' end || l1_code as l1_name, day from (
 select *, row_number() over (partition by day, ts_code order by in_date desc, out_date desc, l1_code desc) as rn from spans, (values ('20011201'), ('20220105')) v(day)
 where in_date <= day and (out_date in ('', 'None') or out_date > day)) where rn = 1""")
def _(spark, sf):
    df = spans(spark, sf).select("ts_code", "in_date", "out_date", "l1_code")
    names = df.select("l1_code").distinct().withColumn("l1_name", F.concat(F.lit("old "), "l1_code"))
    newer = df.withColumns({"l1_name": F.concat(F.lit("new "), "l1_code"), "l1_code": F.concat(F.lit("N"), "l1_code")})
    parts = [membership.industry_asof(df, newer, names, day).withColumn("day", F.lit(day.replace("-", ""))) for day in ("2001-12-01", "2022-01-05")]
    return parts[0].unionByName(parts[1])


@query("j05_names_asof", with_sql(MEMBER_SQL) + """
select ts_code, arg_max(name, in_date || '|' || name) as name from (select ts_code, in_date, 'N' || l1_code as name,
   case when l1_code = 'G3' then null when l1_code = 'G4' then '29990101' else in_date end as ann_date from spans)
where in_date <= '19981231' and (ann_date is null or ann_date <= '19981231') group by ts_code""")
def _(spark, sf):
    df = spans(spark, sf).select("ts_code", F.col("in_date").alias("start_date"), F.concat(F.lit("N"), "l1_code").alias("name"),
                                 F.when(F.col("l1_code") == "G3", None).when(F.col("l1_code") == "G4", "29990101").otherwise(F.col("in_date")).alias("ann_date"))
    return membership.names_asof(df, F.lit("19981231"))


@query("j06_members_before", with_sql(DAILY_SQL, "w as (select trade_date as section, ts_code from daily where mi % 3 = 0 and circ_mv > 100000 and pb > 0)") + """
select strftime(d.trade_date, '%Y%m%d') as entry_day, d.ts_code, strftime(s.section, '%Y%m%d') as section, w.ts_code is not null as is_member
from daily d join (select trade_date, (select max(section) from w where section < t.trade_date) as section from (select distinct trade_date from daily) t) s using (trade_date)
left join w on w.section = s.section and w.ts_code = d.ts_code where d.trade_date >= date '1995-06-01'""")
def _(spark, sf):
    d = daily(spark, sf)
    weights = d.where("mi % 3 = 0 and circ_mv > 100000 and pb > 0").select("trade_date", F.col("ts_code").alias("con_code"))
    trips = d.where("trade_date >= date '1995-06-01'").select(F.col("trade_date").alias("entry_day"), "ts_code")
    shape = lambda name: F.date_format(name, "yyyyMMdd").alias(name)
    return membership.members_before(trips, weights).select(shape("entry_day"), "ts_code", shape("section"), "is_member")


@query("j07_last_close", with_sql(DAILY_SQL, "u as (select *, case when is_suspended then null else close end as c2 from daily)") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(last_value(c2 ignore nulls) over (partition by ts_code order by trade_date rows between unbounded preceding and 1 preceding), 6) as last_close from u""")
def _(spark, sf):
    d = daily(spark, sf).withColumn("close", F.when(~F.col("is_suspended"), F.col("close")))
    return day_text(panel.last_close(d)).select(*KEYS, r(F.col("last_close")).alias("last_close"))


@query("j08_exact_minute_price", with_sql(MINUTES_SQL) + """
select e.event_id, m.close as price from (select event_id, date_trunc('minute', ts) as t, user_id % 10 as c from events) e
left join minutes m on m.trade_time = strftime(e.t, '%Y-%m-%d %H:%M:%S') and substr(m.ts_code, 6, 1) = cast(e.c as varchar)""")
def _(spark, sf):
    bars = minutes(spark, sf).select(F.substring("ts_code", 6, 1).alias("ts_code"), F.col("trade_time").cast("timestamp_ntz").alias("minute"), "close")
    bars = bars.withColumn("available_at", F.col("minute"))
    orders = table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).cast("string").alias("ts_code"), F.col("ts").alias("execute_at"))
    return panel.price_at(orders, bars).select("event_id", "price")


@query("j10_candidate_codes", with_sql(FILINGS_SQL) + """
select distinct ts_code from filings where ann_date between '19980301' and '19980310' or f_ann_date between '19980301' and '19980310' or actual_date between '19980301' and '19980310'""")
def _(spark, sf):
    return panel.candidate_codes(filings(spark, sf), ["ann_date", "f_ann_date", "actual_date"], F.lit("19980301"), F.lit("19980310"))


@query("j11_prior_day", with_sql(DAILY_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(lag(pb) over (partition by ts_code order by trade_date), 6) as prior_pb,
 round(lag(circ_mv) over (partition by ts_code order by trade_date), 3) as prior_circ_mv from daily""")
def _(spark, sf):
    out = panel.prior_day(daily(spark, sf), ["pb", "circ_mv"])
    return day_text(out).select(*KEYS, r(F.col("prior_pb")).alias("prior_pb"), r(F.col("prior_circ_mv"), 3).alias("prior_circ_mv"))


@query("j12_reproduction", with_sql(DAILY_SQL, "a as (select trade_date, ts_code, vol, n2 from (select *, mi as n2 from daily) where k % 20 <> 3)",
       "b as (select trade_date, ts_code, case when mi % 19 = 0 then vol + 1 else vol end as vol, mi as n2 from daily where k % 25 <> 4)") + """
select 'vol' as leg, count(*) filter (where a.ts_code is not null and b.ts_code is not null and a.vol is distinct from b.vol) as differing,
  count(*) filter (where a.ts_code is null or b.ts_code is null) as missing from a full join b on a.trade_date = b.trade_date and a.ts_code = b.ts_code
union all select 'n2', count(*) filter (where a.ts_code is not null and b.ts_code is not null and a.n2 is distinct from b.n2),
  count(*) filter (where a.ts_code is null or b.ts_code is null) from a full join b on a.trade_date = b.trade_date and a.ts_code = b.ts_code""")
def _(spark, sf):
    d = daily(spark, sf).withColumn("n2", F.col("mi"))
    a = d.where("k % 20 <> 3").select(*KEYS, "vol", "n2")
    b = d.where("k % 25 <> 4").select(*KEYS, F.when(F.col("mi") % 19 == 0, F.col("vol") + 1).otherwise(F.col("vol")).alias("vol"), "n2")
    return panel.reproduction(a, b, KEYS, ["vol", "n2"])


@query("j13_pass_through_screen", with_sql(DAILY_SQL) + """
select ts_code, count(*) as rows from daily where not regexp_full_match(ts_code, '[0-9]{6}\\.(SH|SZ|BJ)') or ts_code in (select ts_code from daily where circ_mv > 300000) group by all
union all select 'IDX' || cast(k % 4 as varchar), count(*) from daily group by all""")
def _(spark, sf):
    d = daily(spark, sf)
    allowed = d.where("circ_mv > 300000").select("ts_code")
    rows = d.select("ts_code").unionByName(d.select(F.concat(F.lit("IDX"), (F.col("k") % 4).cast("string")).alias("ts_code")))
    return panel.apply_screen(rows, allowed).groupBy("ts_code").agg(F.count(F.lit(1)).alias("rows"))


@query("j14_span_daily", with_sql(DAILY_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(close, 6) as close from daily where trade_date between date '1997-01-01' and date '1998-12-01'""")
def _(spark, sf):
    d = daily(spark, sf).select(*KEYS, "close")
    slots = [d.where(F.year("trade_date") <= 1997), d.where(F.year("trade_date") > 1997)]
    out = panel.span_daily(slots, F.lit("1997-01-01").cast("date"), F.lit("1998-12-01").cast("date"))
    return day_text(out).select(*KEYS, r(F.col("close")).alias("close"))


# -- universe -------------------------------------------------------------------

LISTING_SQL = f"""listing as (select s_suppkey as k, {code_sql('s_suppkey')} as ts_code, s_nationkey,
   strftime(date '1990-01-01' + to_days(cast(s_suppkey * 37 % 3000 as integer)), '%Y%m%d') as list_date,
   case when s_suppkey % 5 = 0 then strftime(date '1999-01-01' + to_days(cast(s_suppkey * 13 % 900 as integer)), '%Y%m%d') when s_suppkey % 5 = 1 then 'None' else '' end as delist_date,
   case when s_suppkey % 9 = 0 then '*ST ' || s_name when s_suppkey % 23 = 0 then null else s_name end as name from supplier)"""


def listing(spark, sf):
    k = F.col("s_suppkey")
    start = lambda base, mult, mod: F.date_format(F.date_add(F.lit(base).cast("date"), (k * mult % mod).cast("int")), "yyyyMMdd")
    return table(spark, sf, "supplier").select(
        k.alias("k"), code_of(k).alias("ts_code"), "s_nationkey", start("1990-01-01", 37, 3000).alias("list_date"),
        F.when(k % 5 == 0, start("1999-01-01", 13, 900)).when(k % 5 == 1, "None").otherwise("").alias("delist_date"),
        F.when(k % 9 == 0, F.concat(F.lit("*ST "), "s_name")).when(k % 23 != 0, F.col("s_name")).alias("name"))


def listed(spark, sf):
    df = listing(spark, sf)
    return universe.universe_asof({"L": df.where("k % 5 <> 0"), "D": df.where("k % 5 = 0 or k % 7 = 0"), "P": df.where("k % 11 = 0")}, F.lit("20000615"))


@query("uni01_listed_universe", with_sql(LISTING_SQL) + "select ts_code, list_date from listing where list_date <= '20000615' and (delist_date in ('', 'None') or delist_date > '20000615')")
def _(spark, sf):
    return listed(spark, sf).select("ts_code", "list_date")


@query("uni02_screened_universe", with_sql(LISTING_SQL, DAILY_SQL, "b as (select * from daily where trade_date = (select max(trade_date) from daily where trade_date + interval 18 hour <= timestamp '2000-06-15 09:25:00'))") + """
select l.ts_code from listing l join b on b.ts_code = l.ts_code where list_date <= '20000615' and (delist_date in ('', 'None') or delist_date > '20000615')
 and l.name is not null and upper(name) not like '%ST%' and list_date <= strftime(date '2000-06-15' - interval 700 day, '%Y%m%d')
 and l.k % 6 in (0, 1, 2, 3) and circ_mv / 1e4 between 10 and 2000 and close <= 2000""")
def _(spark, sf):
    from .. import catalog
    from ..operators.stamps import stamp_contract
    names = listed(spark, sf).drop("name").join(membership.names_asof(
        listing(spark, sf).where("name is not null").select("ts_code", F.regexp_replace("name", "Supplier", "Name").alias("name"), F.col("list_date").alias("start_date"), F.lit(None).cast("string").alias("ann_date")),
        F.lit("20000615")), "ts_code", "left")
    basics = day_text(daily(spark, sf)).select(*KEYS, "close", "circ_mv")
    newest = universe.latest_basics(stamp_contract(basics, catalog.CONTRACTS["daily_basic"]), asof.at("2000-06-15 09:25:00"))
    screen = universe.Screen(listed_days=700, boards=("main", "gem"), min_cap=10, max_cap=2000, max_price=2000)
    return universe.screen_universe(names, newest, screen, "2000-06-15")


@query("uni03_board", with_sql(LISTING_SQL) + "select ts_code, case k % 6 when 2 then 'gem' when 4 then 'star' when 5 then 'bj' else 'main' end as board from listing")
def _(spark, sf):
    return listing(spark, sf).select("ts_code", codes.board(F.col("ts_code")).alias("board"))


@query("uni04_market_bucket", with_sql(LISTING_SQL) + """select ts_code, case k % 6 when 0 then 'sz_main_00' when 1 then 'sz_main_00' when 2 then 'sz_gem_30' when 3 then 'sh_main_60' when 4 then 'sh_star_68' else 'bj' end as bucket from listing""")
def _(spark, sf):
    return listing(spark, sf).select("ts_code", codes.market_bucket(F.col("ts_code")).alias("bucket"))


@query("uni05_code_types", with_sql(LISTING_SQL) + """
select case when k % 6 = 5 then 'BJ' when k % 5 = 0 then 'B_share_like' when k % 5 = 1 then 'fund_or_etf_like' else 'A_share_like' end as kind, count(*) as codes from listing group by all""")
def _(spark, sf):
    k, code = F.col("k"), F.col("ts_code")
    spelled = F.when(k % 6 == 5, code).when(k % 5 == 0, F.concat(F.lit("200"), F.substring(code, 4, 30))).when(k % 5 == 1, F.concat(F.lit("159"), F.substring(code, 4, 30))).otherwise(code)
    twice = listing(spark, sf).select(spelled.alias("ts_code"), "k")
    return universe.code_types(twice.unionByName(twice))


@query("uni06_active_years", with_sql(LISTING_SQL, "d as (select ts_code, cast(strptime(list_date, '%Y%m%d') as date) as b, cast(try_strptime(delist_date, '%Y%m%d') as date) as e from listing)",
       "c as (select ts_code, greatest(b, date '1995-03-01') as b, least(coalesce(e, date '2001-06-30'), date '2001-06-30') as e from d)") + """
select ts_code, cast(y as bigint) as year, cast(greatest(b, make_date(y, 1, 1)) as varchar) as window_start, cast(least(e, make_date(y, 12, 31)) as varchar) as window_end
from c, (select unnest(generate_series(1995, 2001)) as y) where b <= e and y between year(b) and year(e)""")
def _(spark, sf):
    days = listing(spark, sf).select("ts_code", F.to_date("list_date", "yyyyMMdd").alias("list_day"),
                                     F.when(F.length("delist_date") == 8, F.to_date(F.when(F.length("delist_date") == 8, F.col("delist_date")), "yyyyMMdd")).alias("delist_day"))
    years = universe.active_years(days, "1995-03-01", "2001-06-30")
    return years.select("ts_code", F.col("year").cast("long").alias("year"), F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query("uni07_tradable_next_open", with_sql(DAILY_SQL, "g as (select *, dense_rank() over (order by trade_date) as di from daily)") + """
select strftime(a.trade_date, '%Y%m%d') as trade_date, a.ts_code, coalesce(b.ts_code is not null and not b.is_suspended and b.open < b.up_limit, false) as tradable_next
from g a left join g b on b.ts_code = a.ts_code and b.di = a.di + 1""")
def _(spark, sf):
    from ..operators.screen import build_panel
    return day_text(build_panel(daily(spark, sf))).select(*KEYS, "tradable_next")


# -- units and auctions ---------------------------------------------------------

@query("sc01_unit_normalisation", with_sql(DAILY_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(vol * 100, 2) as vol, round(amount * 1000, 0) as amount, round(turnover_rate * 0.01, 8) as turnover_rate, round(circ_mv * 10000, 0) as circ_mv from daily""")
def _(spark, sf):
    out, _ = units.normalise_units(daily(spark, sf))
    return day_text(out).select(*KEYS, r(F.col("vol"), 2).alias("vol"), r(F.col("amount"), 0).alias("amount"), r(F.col("turnover_rate"), 8).alias("turnover_rate"), r(F.col("circ_mv"), 0).alias("circ_mv"))


COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}


def inventory_sql(*tables):
    rows = [f"""select '{name}' as file, '{column}' as "column", count({column}) as filled from {name}""" for name in tables for column in COLUMNS[name]]
    return "inv as (" + " union all ".join(rows) + ")"


INVENTORY_SQL = inventory_sql("orders", "customer", "lineitem", "supplier")


def inventory(spark, sf):
    return units.column_inventory({(name, None): table(spark, sf, name) for name in ("orders", "customer", "lineitem", "supplier")})


ORDER_RULES = (
    units.UnitRule("orders", None, ("o_totalprice",), source_unit="CNY"), units.UnitRule("orders", None, ("*key",), semantic="identifier"),
    units.UnitRule("orders", None, ("o_order*",), semantic="categorical"), units.UnitRule("lineitem", None, ("*",), source_unit="unknown", status="unknown"),
    units.UnitRule("lineitem", None, ("l_tax",), source_unit="decimal"), units.UnitRule("customer", None, ("c_acct???",), source_unit="CNY"),
)


@query("sc02_unit_registry", with_sql(INVENTORY_SQL) + """
select file, "column", filled, case when file = 'orders' then case when "column" = 'o_totalprice' then 'official' when "column" = 'o_orderkey' then 'overlap'
      when "column" like '%key' or "column" like 'o\\_order%' escape '\\' then 'official' else 'unresolved' end
   when file = 'lineitem' then case when "column" = 'l_tax' then 'official' else 'unknown' end
   when file = 'customer' and "column" = 'c_acctbal' then 'official' else 'unresolved' end as status from inv""")
def _(spark, sf):
    return units.match_columns(inventory(spark, sf), units.rule_table(spark, ORDER_RULES)).select("file", "column", "filled", "status")


@query("sc03_auction_correction", with_sql(MINUTES_SQL) + """
select ts_code, trade_time, round(vol * case when trade_time like '%09:30%' then case when ts_code like '00%' then 0.76 when ts_code like '30%' then 0.58 else 1 end else 1 end, 6) as vol_pit,
  case when trade_time like '%09:30%' and (ts_code like '00%.SZ' or ts_code like '30%.SZ') then 'minute_0930_to_live_stk_auction_by_market_bucket' else '' end as auction_correction_rule from minutes""")
def _(spark, sf):
    return auction.correct_auction(minutes(spark, sf)).select("ts_code", "trade_time", r(F.col("vol_pit")).alias("vol_pit"), "auction_correction_rule")


AUCTION_SQL = """auct as (select l_orderkey * 10 + l_linenumber as id, l_partkey, case when l_partkey % 10 in (0, 1) then null when l_partkey % 10 = 3 then 0 else l_quantity end as vol,
   case when l_partkey % 10 in (0, 1) then null when l_partkey % 10 = 3 then 0 else l_extendedprice end as amount,
   case when l_partkey % 10 in (0, 1, 4) then null when l_partkey % 10 = 3 then 5.0 else l_extendedprice / l_quantity end as price from lineitem)"""


def auctions(spark, sf):
    part = F.col("l_partkey") % 10
    pick = lambda value: F.when(part.isin(0, 1), None).when(part == 3, 0.0).otherwise(F.col(value))
    price = F.when(part.isin(0, 1, 4), None).when(part == 3, 5.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").cast("string").alias("ts_code"),
                                               pick("l_quantity").alias("vol"), pick("l_extendedprice").alias("amount"), price.alias("price"))


@query("sc04_auction_clean", with_sql(AUCTION_SQL) + """
select id, price_class, count(*) as copies, round(max(price), 6) as price from (select id, case when l_partkey % 10 = 3 then 'no_trade' when l_partkey % 10 = 4 then 'derived' else 'source' end as price_class,
   case when l_partkey % 10 = 3 then null else amount / vol end as price from auct where l_partkey % 10 not in (0, 1)) group by all""")
def _(spark, sf):
    clean = auction.clean_auction(auctions(spark, sf))
    return clean.groupBy("id", "price_class").agg(F.count(F.lit(1)).alias("copies"), r(F.max("price")).alias("price"))


@query("sc04_auction_quality", with_sql(AUCTION_SQL) + """
select case when l_partkey % 10 in (0, 1) then 'unobserved' when l_partkey % 10 = 3 then 'no_trade' when l_partkey % 10 = 4 then 'derived' else 'source' end as price_class, count(*) as rows from auct group by all""")
def _(spark, sf):
    return auction.auction_quality(auctions(spark, sf))


# -- orders against bars --------------------------------------------------------

ORDERS_SQL = f"""sheet as (select o_orderkey as id, {code_sql('(o_orderkey % (select count(*) from supplier))')} as ts_code, cast(date_trunc('month', o_orderdate) as date) as trade_date,
   case when o_orderkey % 2 = 0 then 'buy' else 'sell' end as action, (['open', 'close', 'intraday'])[o_orderkey % 3 + 1] as session,
   case when o_orderkey % 6 in (2, 5) and o_orderkey % 4 < 2 then o_totalprice / 100 end as limit_price,
   case when o_orderkey % 13 = 0 then 150 else (o_orderkey % 9 + 1) * 100 end as quantity from orders)"""


def sheet(spark, sf):
    key = F.col("o_orderkey")
    names = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    df = table(spark, sf, "orders").join(F.broadcast(names))
    return df.select(
        key.alias("id"), code_of(key % F.col("n")).alias("ts_code"), F.trunc("o_orderdate", "month").alias("trade_date"),
        F.when(key % 2 == 0, "buy").otherwise("sell").alias("action"), F.element_at(F.array(F.lit("open"), F.lit("close"), F.lit("intraday")), (key % 3 + 1).cast("int")).alias("session"),
        F.when((key % 6).isin(2, 5) & (key % 4 < 2), F.col("o_totalprice") / 100).alias("limit_price"),
        F.when(key % 13 == 0, 150).otherwise((key % 9 + 1) * 100).cast("long").alias("quantity"))


BASE_SQL = """base as (select s.*, d.ts_code is not null as has_bar, d.is_suspended, d.high, d.low, case when action = 'buy' then d.up_limit else d.down_limit end as lim,
    case session when 'open' then d.open when 'close' then d.close else case when limit_price is null then d.amount / d.vol
      when action = 'buy' then least(d.open, limit_price) else greatest(d.open, limit_price) end end as px0
  from sheet s left join daily d on d.ts_code = s.ts_code and d.trade_date = s.trade_date),
  based as (select *, case when has_bar then px0 end as px, case when has_bar then px0 end * (1 + case when action = 'buy' then 10 else -10 end / 10000.0) as slipped from base)"""


@query("sc05_session_price", with_sql(ORDERS_SQL, DAILY_SQL, BASE_SQL) + "select id, round(px, 6) as price from based")
def _(spark, sf):
    joined = order_ops.with_bars(sheet(spark, sf), daily(spark, sf))
    return joined.select("id", r(order_ops.session_price(F.col("session"), F.col("action"), F.col("limit_price"))).alias("price"))


@query("sc06_fill_gate", with_sql(ORDERS_SQL, DAILY_SQL, BASE_SQL, """gated as (select *, case when action = 'buy' and right(ts_code, 3) = '.BJ' then 'board_not_permitted' when not has_bar then 'missing_execution_price'
   when is_suspended then 'suspended' when action = 'buy' and case when ts_code like '688%' then quantity < 200 else quantity % 100 <> 0 end then 'invalid_buy_lot'
   when session <> 'intraday' and case when action = 'buy' then slipped >= lim - 1e-9 else slipped <= lim + 1e-9 end then 'unfilled_price_limit'
   when session = 'intraday' and abs(high - lim) < 0.005 and abs(low - lim) < 0.005 then 'unfilled_locked'
   when session = 'intraday' and limit_price is not null and not case when action = 'buy' then low <= limit_price + 0.005 else high >= limit_price - 0.005 end then 'unfilled_limit' end as reason from based)""") + """
select id, reason, case when reason is null then 'filled' else 'rejected' end as status, round(case when reason is null then case when session <> 'intraday' then slipped when limit_price is not null then px
   when action = 'buy' then least(slipped, lim) else greatest(slipped, lim) end end, 6) as fill_price from gated""")
def _(spark, sf):
    priced = order_ops.price_orders(sheet(spark, sf), daily(spark, sf), values.Profile(permitted_boards=("main", "gem", "star")))
    return priced.select("id", "reason", "status", r(F.col("fill_price")).alias("fill_price"))


@query("sc07_fees", """
select l_orderkey * 10 + l_linenumber as id, l_partkey, round(greatest(l_extendedprice * 2.5 / 10000, 5) + l_extendedprice * 0.1 / 10000, 6) as fee,
  round(case when l_returnflag = 'R' then l_extendedprice * case when l_shipdate >= timestamp '1998-08-28' then 5 else 10 end / 10000 else 0 end, 6) as stamp_duty from lineitem""")
def _(spark, sf):
    fills = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("action"),
        F.date_format(F.add_months("l_shipdate", 300), "yyyyMMdd").alias("trade_date"), F.col("l_extendedprice").alias("price"), F.lit(1).alias("quantity"))
    return order_ops.add_fees(fills).select("id", "l_partkey", r(F.col("fee")).alias("fee"), r(F.col("stamp_duty")).alias("stamp_duty"))


RESET_SQL = "carried as (select *, lag(close) over (partition by ts_code order by trade_date) as last_close from daily)"


@query("sc08_share_multiplier", with_sql(DAILY_SQL, RESET_SQL, "c as (select *, case when k % 4 = 0 then last_close * 0.1 when k % 4 = 1 then 1.0 else 0 end as cash from carried where last_close is not null)") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(case when ROUND(abs(pre_close - last_close), 6) > 0.005 and not (cash > 0 and ROUND(last_close - cash - pre_close, 6) <= 0.005) then (last_close - cash) / pre_close end, 6) as multiplier,
  cast(floor(ROUND(1000 * coalesce(case when ROUND(abs(pre_close - last_close), 6) > 0.005 and not (cash > 0 and ROUND(last_close - cash - pre_close, 6) <= 0.005) then (last_close - cash) / pre_close end, 1), 6)) as bigint) as shares from c""")
def _(spark, sf):
    d = daily(spark, sf)
    carried = panel.last_close(d).where("last_close is not null")
    cash = carried.select(*KEYS, F.when(F.col("k") % 4 == 0, F.col("last_close") * 0.1).when(F.col("k") % 4 == 1, 1.0).otherwise(0.0).alias("cash_per_share"))
    out = order_ops.share_multipliers(d, cash).where("last_close is not null")
    return day_text(out).select(*KEYS, r(F.col("multiplier")).alias("multiplier"), values.whole_shares(F.lit(1000), F.col("multiplier")).alias("shares"))


@query("sc09_price_resets", with_sql(DAILY_SQL, RESET_SQL) + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(last_close, 6) as last_close, round(pre_close, 6) as pre_close from carried where pre_close <> last_close""")
def _(spark, sf):
    return day_text(panel.price_resets(daily(spark, sf))).select(*KEYS, r(F.col("last_close")).alias("last_close"), r(F.col("pre_close")).alias("pre_close"))


@query("sc10_canonical_value", """
select o_orderkey as id, case o_orderkey % 6 when 0 then cast(o_orderkey as varchar) when 1 then cast(o_orderkey as varchar) when 2 then '' when 3 then '' when 4 then o_orderpriority else
  regexp_replace(regexp_replace(cast(cast(o_totalprice as decimal(18,4)) as varchar), '0+$', ''), '\\.$', '') end as canon from orders""")
def _(spark, sf):
    key, text = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    spelled = (F.when(key == 0, F.concat(text, F.lit(".000"))).when(key == 1, F.concat(F.lit(" "), text)).when(key == 2, "NaN").when(key == 4, F.col("o_orderpriority"))
               .when(key == 5, F.concat(F.col("o_totalprice").cast("decimal(18,4)").cast("string"), F.lit("00"))))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), values.canonical(spelled).alias("canon"))


@query("sc11_lot_quantity", with_sql(ORDERS_SQL, "m as (select s.*, o_totalprice as money from sheet s join orders on o_orderkey = id)") + """
select id, cast(case when ts_code like '688%' then case when floor(money / 97.5) >= 200 then floor(money / 97.5) else 0 end
   when right(ts_code, 3) = '.BJ' then case when floor(money / 97.5) >= 100 then floor(money / 97.5) else 0 end
   else floor(money / 97.5) - floor(money / 97.5) % 100 end as bigint) as shares from m""")
def _(spark, sf):
    money = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("money"))
    df = sheet(spark, sf).join(money, "id")
    return df.select("id", codes.lot_quantity(F.col("money"), F.lit(97.5), F.col("ts_code")).alias("shares"))


TAX_SQL = """h as (select o_orderkey as id, cast(o_orderdate + interval 18 year as date) as a, cast(o_orderdate + interval 18 year as date) + cast(1 + o_orderkey % 500 as integer) as s,
   cast(o_orderdate + interval 18 year as date) + cast(o_orderkey % 40 as integer) as rec from orders),
 m as (select *, cast(a + interval 1 month as date) as m1, cast(a + interval 12 month as date) as m12 from h),
 e as (select *, case when day(m1) < day(a) then m1 + 1 else m1 end as e1, case when day(m12) < day(a) then m12 + 1 else m12 end as e12 from m)"""


@query("sc12_dividend_tax_rate", with_sql(TAX_SQL) + "select id, case when s <= e1 then 0.2 when s <= e12 then 0.1 when rec < date '2015-09-08' then 0.05 else 0.0 end :: double as rate from e")
def _(spark, sf):
    day = F.add_months(F.to_date("o_orderdate"), 216)
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.alias("id"), values.dividend_tax_rate(day, F.date_add(day, (1 + key % 500).cast("int")), F.date_add(day, (key % 40).cast("int"))).alias("rate"))
