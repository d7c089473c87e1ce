"""Executions, corporate actions, matched-random draws, ordered picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import DRAW_PRIME
from ..operators import calendar as cal_ops, executions as ops, pools, signals, text as text_ops, topk
from ..operators.screen import date_index
from ..registry import query
from ..session import materialise
from ..sources.tables import table
from .adapters import (
    CALENDAR_SQL, DAILY_SQL, FILINGS_SQL, FILLS_SQL, NOTICES_SQL, TRADE_ORDER, TRADES_SQL, calendar, daily, filings, fills, notices, r, trades, with_sql,
)
from .corpus import ANN_SQL, announcements
from .market import RESET_SQL

FILL_KEYS = ["run_id", "ts_code"]
FILL_ORDER = ["fill_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def day(name):
    return F.date_format(name, "yyyyMMdd").alias(name)


def fifo_sql(source: str, order: str, carry: str) -> str:
    """Interval-overlap form of first-in-first-out pairing."""
    return f"""f0 as (select *, sum(case when action = 'buy' then quantity else 0 end) over w as b, sum(case when action = 'sell' then quantity else 0 end) over w as s from {source}
     window w as (partition by run_id, ts_code order by {order} rows unbounded preceding)),
   f1 as (select *, s - greatest(0, max(s - b) over (partition by run_id, ts_code order by {order} rows unbounded preceding)) as e from f0),
   f2 as (select *, lag(e, 1, 0) over (partition by run_id, ts_code order by {order}) as e0 from f1),
   bb as (select run_id, ts_code, b - quantity as lo, b as hi, {carry} from f2 where action = 'buy'), ss as (select run_id, ts_code, e0 as lo, e as hi, {carry} from f2 where action = 'sell' and e > e0),
   hit as (select bb.run_id, bb.ts_code, least(bb.hi, ss.hi) - greatest(bb.lo, ss.lo) as qty, bb.lo as blo, bb as ent, ss as ext from bb join ss on bb.run_id = ss.run_id and bb.ts_code = ss.ts_code and bb.lo < ss.hi and ss.lo < bb.hi),
   left_over as (select bb.run_id, bb.ts_code, bb.hi - bb.lo - coalesce(m.q, 0) as qty, bb as ent from bb left join (select run_id, ts_code, blo, sum(qty) as q from hit group by all) m on m.run_id = bb.run_id and m.ts_code = bb.ts_code and m.blo = bb.lo),
   trips as (select run_id, ts_code, qty, ent, ext from hit union all select run_id, ts_code, qty, ent, null from left_over where qty > 0)"""


FILLED_SQL = "ff as (select * from fills where status = 'filled')"


@query("ex01_round_trips", with_sql(FILLS_SQL, FILLED_SQL, fifo_sql("ff", ", ".join(FILL_ORDER), "fill_date, price, l_orderkey, l_linenumber, l_partkey")) + """
select run_id, ts_code, cast(qty as bigint) as trip_quantity, strftime(ent.fill_date, '%Y%m%d') as entry_fill_date, ent.l_orderkey as entry_l_orderkey, round(ent.price, 4) as entry_price, strftime(ext.fill_date, '%Y%m%d') as exit_fill_date, round(ext.price, 4) as exit_price from trips""")
def _(spark, sf):
    out = ops.round_trips(fills(spark, sf).where("status = 'filled'"), FILL_KEYS, FILL_ORDER, ["fill_date", "price", "l_orderkey"])
    return out.select(*FILL_KEYS, "trip_quantity", day("entry_fill_date"), "entry_l_orderkey", r(F.col("entry_price"), 4).alias("entry_price"), day("exit_fill_date"), r(F.col("exit_price"), 4).alias("exit_price"))


@query("ex01_unpaired_sells", with_sql(FILLS_SQL, FILLED_SQL, fifo_sql("ff", ", ".join(FILL_ORDER), "fill_date")) + """
select run_id, ts_code, cast(max(s - b) as bigint) as unpaired_shares from f1 group by all having max(s - b) > 0""")
def _(spark, sf):
    return ops.unpaired_sells(fills(spark, sf).where("status = 'filled'"), FILL_KEYS, FILL_ORDER)


def curve_sql(source: str) -> str:
    """Cash and holdings of every run of a table of trades on every day."""
    return f"""dd as (select trade_date, row_number() over (order by trade_date) as di from (select distinct trade_date from daily)), rn as (select distinct run_id from {source}),
   fl as (select run_id, trade_date, sum(case when action = 'buy' then -1 else 1 end * price * quantity) as f from {source} group by all),
   ca as (select run_id, trade_date, di, 1e9 + sum(coalesce(f, 0)) over (partition by run_id order by di) as cash from rn cross join dd left join fl using (run_id, trade_date)),
   q as (select run_id, ts_code, trade_date, sum(case when action = 'buy' then quantity else -quantity end) as dq from {source} group by all),
   gr as (select run_id, ts_code, di, sum(coalesce(dq, 0)) over (partition by run_id, ts_code order by di) as qty from (select distinct run_id, ts_code from {source}) cross join dd left join q using (run_id, ts_code, trade_date)),
   cl as (select ts_code, di, last_value(close ignore nulls) over (partition by ts_code order by di) as close from (select distinct ts_code from daily) cross join dd left join daily using (ts_code, trade_date)),
   hv as (select run_id, di, sum(qty * coalesce(close, 0)) as h, count(*) filter (where qty <> 0) as n from gr left join cl using (ts_code, di) group by all)"""


@query("ex02_book_curve", with_sql(DAILY_SQL, TRADES_SQL, curve_sql("trades")) + """
select run_id, strftime(trade_date, '%Y%m%d') as trade_date, round(cash, 1) as cash, round(coalesce(h, 0), 1) as holdings, coalesce(n, 0) as names, round(cash + coalesce(h, 0), 1) as equity from ca left join hv using (run_id, di)""")
def _(spark, sf):
    out = ops.book_curve(trades(spark, sf), materialise(daily(spark, sf)), 1e9)
    return out.select("run_id", day("trade_date"), *[r(F.col(c), 1).alias(c) for c in ("cash", "holdings", "equity")], "names")


DECILE_SQL = "dec as (select *, cast(least(floor(rank() over (partition by trade_date order by circ_mv) / count(*) over (partition by trade_date) * 10), 9) as bigint) as decile from daily)"


@query("ex04_cap_decile", with_sql(DAILY_SQL, DECILE_SQL) + "select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, decile from dec")
def _(spark, sf):
    return ops.deciles(daily(spark, sf)).select(day("trade_date"), "ts_code", "decile")


BOARDS = ["main", "gem", "star"]
# All lines as one book.
BOOK_SQL = "tb as (select * replace ('B' as run_id) from trades)"


def book(spark, sf):
    return trades(spark, sf).withColumn("run_id", F.lit("B"))


TRIP_SQL = (DAILY_SQL, DECILE_SQL, TRADES_SQL, BOOK_SQL, fifo_sql("tb", ", ".join(TRADE_ORDER), "trade_date, price, l_orderkey, l_linenumber, l_partkey"),
            """tp as (select run_id, t.ts_code, qty, ent.trade_date as entry_day, ext.trade_date as exit_day, qty * ent.price as notional, ent.l_orderkey as o, ent.l_linenumber as l, ent.l_partkey as p, decile from trips t join dec d on d.ts_code = t.ts_code and d.trade_date = ent.trade_date)""")


TRIP_ID = ["entry_day", "ts_code", "quantity", "o", "l", "p"]


def matched_trips(spark, sf):
    ranked = materialise(ops.deciles(daily(spark, sf)))
    paired = ops.round_trips(book(spark, sf), FILL_KEYS, TRADE_ORDER, ["trade_date", "price", "l_orderkey", "l_linenumber", "l_partkey"])
    trips = paired.select(
        "ts_code", F.col("trip_quantity").alias("quantity"), F.col("entry_trade_date").alias("entry_day"), F.col("exit_trade_date").alias("exit_day"),
        (F.col("trip_quantity") * F.col("entry_price")).alias("notional"), F.col("entry_l_orderkey").alias("o"), F.col("entry_l_linenumber").alias("l"), F.col("entry_l_partkey").alias("p"))
    own = ranked.select(F.col("trade_date").alias("entry_day"), "ts_code", "decile")
    # Twins are numbered where the join leaves a name's trips of a day together.
    numbered = pools.twinned(trips.join(own, ["entry_day", "ts_code"]), TRIP_ID)
    return materialise(numbered, instead_of=[paired]), ranked


# Pools of names that are in the benchmark as the trip's own name is, by the section in force before the entry.
MEMBER_SQL = ("sec as (select trade_date as section, ts_code from daily where mi % 3 = 0 and circ_mv > 100000 and pb > 0)",
              "sday as (select trade_date, (select max(section) from sec where section < t.trade_date) as section from (select distinct trade_date from daily where trade_date >= date '1995-06-01') t)",
              "mem as (select d.*, w.ts_code is not null as member from daily d join sday using (trade_date) left join sec w on w.section = sday.section and w.ts_code = d.ts_code)")


@query("ex03_membership_pool", with_sql(*TRIP_SQL, *MEMBER_SQL) + """
select o, l, p, tp.ts_code, strftime(exit_day, '%Y%m%d') as exit_day, cast(qty as bigint) as quantity, m.member, (select count(*) from mem c where c.trade_date = tp.entry_day and c.member = m.member and c.ts_code <> tp.ts_code and right(c.ts_code, 3) <> '.BJ'
   and c.open * case when c.ts_code like '688%' then 200 else 100 end <= tp.notional and (tp.exit_day is null or exists (select 1 from mem x where x.trade_date = tp.exit_day and x.ts_code = c.ts_code))) as pool_size
from tp join mem m on m.trade_date = tp.entry_day and m.ts_code = tp.ts_code""")
def _(spark, sf):
    from ..operators import membership
    trips, ranked = matched_trips(spark, sf)
    weights = ranked.where("mi % 3 = 0 and circ_mv > 100000 and pb > 0").select("trade_date", F.col("ts_code").alias("con_code"))
    dated = ranked.where("trade_date >= date '1995-06-01'")
    marks = membership.members_before(dated.select(F.col("trade_date").alias("entry_day"), "ts_code"), weights)
    flagged = materialise(dated.join(marks.select(F.col("entry_day").alias("trade_date"), "ts_code", F.col("is_member").alias("member")), ["trade_date", "ts_code"]))
    own = flagged.select(F.col("trade_date").alias("entry_day"), "ts_code", "member")
    trips = materialise(trips.join(own, ["entry_day", "ts_code"]))
    days = date_index(flagged)
    return pools.pool_sizes(trips, pools.candidates(flagged, days, "member", BOARDS), days, "member").select("o", "l", "p", "ts_code", day("exit_day"), "quantity", "member", "pool_size")


@query("ex03_candidate_pool", with_sql(*TRIP_SQL) + """
select o, l, p, ts_code, strftime(exit_day, '%Y%m%d') as exit_day, cast(qty as bigint) as quantity, (select count(*) from dec c where c.trade_date = tp.entry_day and c.decile = tp.decile and c.ts_code <> tp.ts_code and right(c.ts_code, 3) <> '.BJ'
   and c.open * case when c.ts_code like '688%' then 200 else 100 end <= tp.notional and (tp.exit_day is null or exists (select 1 from daily x where x.trade_date = tp.exit_day and x.ts_code = c.ts_code))) as pool_size from tp""")
def _(spark, sf):
    trips, ranked = matched_trips(spark, sf)
    days = date_index(ranked)
    return pools.pool_sizes(trips, pools.candidates(ranked, days, "decile", BOARDS), days, "decile").select("o", "l", "p", "ts_code", day("exit_day"), "quantity", "pool_size")


DRAWS = 100


# Each trip's affordable names in order of cost; the pick of every draw by a digest of its own.
POOL_SQL = """tw as (select *, cast(qty as bigint) as quantity, row_number() over (partition by entry_day, ts_code, qty, o, l, p order by exit_day nulls last) as twin from tp),
   cd as (select tw.*, c.ts_code as code, c.open as pool_open, c.open * case when c.ts_code like '688%' then 200 else 100 end as cost from tw join dec c on c.trade_date = tw.entry_day and c.decile = tw.decile and c.ts_code <> tw.ts_code
     where right(c.ts_code, 3) <> '.BJ' and c.open > 0 and cost <= notional and (tw.exit_day is null or exists (select 1 from daily x where x.trade_date = tw.exit_day and x.ts_code = c.ts_code)))"""
DIGEST_SQL = f"""po as (select o, l, p, ts_code, quantity, notional, entry_day, exit_day, twin, count(*) as pool_size, list(code order by cost, code) as codes, list(pool_open order by cost, code) as opens from cd group by all),
   pk as (select po.*, draw, cast('0x' || substr(md5(concat_ws('|', '7', draw, entry_day, ts_code, quantity, o, l, p, twin)), 1, 15) as bigint) % pool_size + 1 as spot from po, (select unnest(range({DRAWS})) as draw))"""
# The baseline's picks: the trip's number times the draw's factor.
PICK_SQL = POOL_SQL + f""",
   po as (select o, l, p, ts_code, quantity, notional, entry_day, exit_day, twin, count(*) as pool_size, list(code order by cost, code) as codes, list(pool_open order by cost, code) as opens,
     cast('0x' || substr(md5(concat_ws('|', '7', entry_day, ts_code, quantity, o, l, p, twin)), 1, 15) as bigint) % {DRAW_PRIME - 1} + 1 as start from cd group by all),
   fa as (select draw, cast('0x' || substr(md5(concat_ws('|', '7', draw)), 1, 15) as bigint) % {DRAW_PRIME - 1} + 1 as factor from (select unnest(range({DRAWS})) as draw)),
   pk as (select po.*, draw, (start * factor % {DRAW_PRIME}) * pool_size // {DRAW_PRIME} + 1 as spot from po, fa)"""


@query("ex05_seeded_draw", with_sql(*TRIP_SQL, POOL_SQL, DIGEST_SQL) + """
select cast(draw as integer) as draw, o, l, p, ts_code, strftime(entry_day, '%Y%m%d') as entry_day, codes[spot] as drawn_code, pool_size,
  cast(case when codes[spot] like '688%' then floor(notional / opens[spot]) else floor(notional / opens[spot] / 100) * 100 end as bigint) as drawn_quantity from pk""")
def _(spark, sf):
    trips, ranked = matched_trips(spark, sf)
    days = date_index(ranked)
    # The day's text is made once for a trip, not for each of its draws.
    trips = trips.withColumn("entry_text", F.date_format("entry_day", "yyyyMMdd"))
    drawn = pools.draw_names(trips, pools.candidates(ranked, days, "decile", BOARDS), days, "decile", DRAWS, 7, TRIP_ID)
    return drawn.select("draw", "o", "l", "p", "ts_code", F.col("entry_text").alias("entry_day"), "drawn_code", "drawn_quantity", "pool_size")


# Daily profit of the drawn holdings: bought at the open unless halted or at the limit, valued by growth over the
# previous close, sold on the first day from the exit on which it is neither halted nor at its lower limit.
_FEE = "(greatest({0} * 2.5 / 10000.0, 5.0) + {0} * 0.1 / 10000.0)"
_SALE = f"({_FEE} + {{0}} * 10.0 / 10000.0)"
PROFIT_SQL = f"""ix as (select ts_code, di, open, pre_close, close, up_limit, down_limit, is_suspended, exp(sum(coalesce(ln(close / case when pre_close > 0 then pre_close end), 0)) over (partition by ts_code order by di)) as i from daily join dd using (trade_date)),
   ib as (select *, lag(i) over (partition by ts_code order by di) as before, min(case when not is_suspended and open > down_limit then di end) over (partition by ts_code order by di rows between current row and unbounded following) as out_di from ix),
   dp as (select draw, codes[spot] as code, a.di as f, b.di as t, case when codes[spot] like '688%' then floor(notional / opens[spot]) else floor(notional / opens[spot] / 100) * 100 end as n
     from pk join dd a on a.trade_date = entry_day left join dd b on b.trade_date = exit_day),
   bt as (select dp.*, e.open as o, e.close as c, n * e.close / e.i as base, x.out_di as x from dp join ib e on e.ts_code = code and e.di = f left join ib x on x.ts_code = code and x.di = t where not e.is_suspended and e.open < e.up_limit),
   sv as (select bt.*, case when x = f then n * c else base * m.before end as held, case when x = f then n * c else base * m.before * coalesce(m.open / case when m.pre_close > 0 then m.pre_close end, 1) end * 0.999 as v from bt join ib m on m.ts_code = code and m.di = x),
   gn as (select draw, di, sum(g) as pnl from (
     select draw, f as di, n * c - n * o * 1.001 - {_FEE.format("(n * o * 1.001)")} as g from bt
     union all select draw, x, v - held - {_SALE.format("v")} from sv
     union all select draw, m.di, base * (m.i - m.before) from bt join ib m on m.ts_code = code and m.di > f and (x is null or m.di < x)) group by all),
   eq as (select trade_date, di, cash + coalesce(h, 0) as equity from ca left join hv using (run_id, di)),
   cp as (select trade_date, di, coalesce(lag(equity) over (order by di), 1e9) as capital from eq),
   rt as (select trade_date, coalesce(sum(pnl / capital), 0) as s, coalesce(sum(pnl / capital * (pnl / capital)), 0) as ss from cp left join gn using (di) group by trade_date)"""


def drawn_book(spark, sf):
    """Daily profits of the draws, and the book's own curve."""
    trips, ranked = matched_trips(spark, sf)
    days = date_index(ranked)
    profit = pools.drawn_profit(trips, ranked, days, "decile", DRAWS, 7, TRIP_ID, BOARDS)
    return materialise(profit), ops.book_curve(book(spark, sf), ranked, 1e9)


@query("ex06_random_baseline", with_sql(*TRIP_SQL, PICK_SQL, curve_sql("tb"), PROFIT_SQL) + f"""
select strftime(trade_date, '%Y%m%d') as trade_date, round(s / {DRAWS}, 9) as value, round(sqrt(greatest(0.0, (ss - s * s / {DRAWS}) / {DRAWS - 1})), 7) as draw_sd from rt""")
def _(spark, sf):
    out = ops.baseline(*drawn_book(spark, sf), DRAWS)
    return out.select(day("trade_date"), r(F.col("value"), 9).alias("value"), r(F.col("draw_sd"), 7).alias("draw_sd"))


@query("ex06_draw_distribution", with_sql(*TRIP_SQL, PICK_SQL, curve_sql("tb"), PROFIT_SQL, "xs as (select fa.draw, exp(coalesce(sum(ln(1 + pnl / capital)), 0)) - 1 as x from fa left join (gn join cp using (di)) using (draw) group by fa.draw)",
       "ob as (select arg_max(equity, di) / 1e9 - 1 as observed from eq)") + """
select round(observed, 7) as observed, count(*) as draws, round(avg(x), 7) as mean, round(stddev_samp(x), 7) as sd, round(quantile_cont(x, 0.05), 7) as p05, round(quantile_cont(x, 0.95), 7) as p95, avg(case when x <= observed then 1.0 else 0.0 end) as share_at_or_below
from xs, ob group by observed""")
def _(spark, sf):
    out = ops.draw_distribution(*drawn_book(spark, sf), DRAWS)
    # Rounding goes through whole numbers, which have no NaN.
    kept = lambda c: F.when(F.isnan(c), F.col(c)).otherwise(r(F.col(c), 7)).alias(c)
    return out.select("draws", "share_at_or_below", *[kept(c) for c in ("observed", "mean", "sd", "p05", "p95")])


@query("ex07_carried_limit", with_sql(DAILY_SQL, "n as (select trade_date, ts_code, low, pre_close from daily where pre_close is not null)", "o as (select trade_date, arg_max(pre_close, ts_code) as other from n group by all)") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, floor(low / pre_close * other * 100 + 0.5) / 100 as carried from n join o using (trade_date)""")
def _(spark, sf):
    d = daily(spark, sf).where("pre_close is not null").select("trade_date", "ts_code", "low", "pre_close")
    other = d.groupBy("trade_date").agg(F.max_by("pre_close", "ts_code").alias("other"))
    return d.join(F.broadcast(other), "trade_date").select(day("trade_date"), "ts_code", ops.carried_limit(F.col("low"), F.col("pre_close"), F.col("other")).alias("carried"))


@query("ex08_sellable_shares", with_sql(DAILY_SQL, RESET_SQL, TRADES_SQL, BOOK_SQL, fifo_sql("tb", ", ".join(TRADE_ORDER), "trade_date, price, l_orderkey, l_linenumber, l_partkey"),
       "mu as (select ts_code, trade_date, last_close / pre_close as m from carried where last_close is not null and ROUND(abs(pre_close - last_close), 6) > 0.005)",
       "tq as (select ts_code, cast(qty as bigint) as quantity, ent.trade_date as e, ext.trade_date as x, ent.l_orderkey as o, ent.l_linenumber as l, ent.l_partkey as p, ext.l_orderkey as xo from trips where ext is not null)",
       "ls as (select tq.*, list([m, case when mu.trade_date = x then 1.0 else 0.0 end] order by mu.trade_date) filter (where m is not null) as ms from tq left join mu on mu.ts_code = tq.ts_code and mu.trade_date > e and mu.trade_date <= x group by all)") + """
select o, l, p, xo, ts_code, quantity, cast(coalesce(list_reduce(list_prepend([cast(quantity as double), 0.0], ms), lambda a, b: [case when b[2] = 1.0 then least(a[1], floor(ROUND(a[1] * b[1], 6))) else floor(ROUND(a[1] * b[1], 6)) end, 0.0])[1], quantity) as bigint) as sellable from ls""")
def _(spark, sf):
    from ..operators import panel
    paired = ops.round_trips(book(spark, sf), FILL_KEYS, TRADE_ORDER, ["trade_date", "l_orderkey", "l_linenumber", "l_partkey"]).where("exit_trade_date is not null")
    trips = paired.select("ts_code", F.col("trip_quantity").alias("quantity"), F.col("entry_trade_date").alias("entry_day"), F.col("exit_trade_date").alias("exit_day"),
                          F.col("entry_l_orderkey").alias("o"), F.col("entry_l_linenumber").alias("l"), F.col("entry_l_partkey").alias("p"), F.col("exit_l_orderkey").alias("xo"))
    from ..functions.values import share_multiplier
    carried = panel.last_close(daily(spark, sf)).where("last_close is not null")
    ratios = carried.withColumn("multiplier", share_multiplier(F.col("last_close"), F.col("pre_close"), F.lit(0.0)))
    return ops.sellable(trips, ratios, ["ts_code", "quantity", "entry_day", "exit_day", "o", "l", "p", "xo"]).select("o", "l", "p", "xo", "ts_code", "quantity", "sellable")


DIV_SQL = """dv as (select *, try_strptime(coalesce(imp_ann_date, case when trim(div_proc) <> '实施' then nullif(ann_date, '') end), '%Y%m%d') + interval 18 hour as available_at,
    strftime(try_strptime(pre_date, '%Y%m%d') - to_days(cast(id % 15 as integer)), '%Y%m%d') as ex_date, (id % 9) / 10.0 as cash, (id % 4) / 10.0 as bo from filings),
  la as (select *, row_number() over (partition by ts_code, end_date, ex_date order by available_at desc, ex_date desc, id desc) as rn from dv where div_proc = '实施' and ex_date between '19960101' and '19991231' and strftime(available_at, '%Y%m%d') <= ex_date)"""


def dividends(spark, sf):
    from ..operators import stamps
    key = F.col("id")
    ex = F.date_format(F.date_sub(F.to_date("pre_date", "yyyyMMdd"), (key % 15).cast("int")), "yyyyMMdd")
    rows = stamps.stamp_fundamental("dividend", filings(spark, sf)).withColumn("ex_date", ex)
    return rows.select("id", "ts_code", "end_date", "div_proc", "available_at", "ex_date", F.col("ex_date").alias("record_date"), F.lit("").alias("pay_date"), F.lit("").alias("div_listdate"),
                       F.lit(None).cast("string").alias("cash_div"), (key % 9 / 10.0).alias("cash_div_tax"), F.lit(None).cast("string").alias("stk_div"), (key % 4 / 10.0).alias("stk_bo_rate"), F.lit(0.0).alias("stk_co_rate"))


@query("ex09_corporate_actions", with_sql(FILINGS_SQL, DIV_SQL, "one as (select ts_code, end_date, ex_date, max(available_at) as av from la group by all)",
       "pk as (select la.ts_code, la.ex_date, la.end_date, max(struct_pack(c := cash, b := bo)) as v from la join one on la.ts_code = one.ts_code and la.end_date = one.end_date and la.ex_date = one.ex_date and la.available_at = one.av group by all)") + """
select ts_code, ex_date, count(*) as events, round(sum(v.c), 6) as cash_per_share, round(sum(v.b), 6) as stock_per_share, ex_date as record_date from pk where v.c > 0 or v.b > 0 group by all""".replace("count(*) as events, ", ""))
def _(spark, sf):
    rows = dividends(spark, sf)
    # Equal stamps of one event keep the larger amounts, on both sides.
    best = rows.groupBy("ts_code", "end_date", "ex_date", "div_proc", "available_at").agg(F.max(F.struct("cash_div_tax", "stk_bo_rate")).alias("v"))
    single = best.select("ts_code", "end_date", "ex_date", "div_proc", "available_at", F.col("ex_date").alias("record_date"), F.lit("").alias("pay_date"), F.lit("").alias("div_listdate"), F.lit(None).cast("string").alias("cash_div"),
                         F.col("v.cash_div_tax").alias("cash_div_tax"), F.lit(None).cast("string").alias("stk_div"), F.col("v.stk_bo_rate").alias("stk_bo_rate"), F.lit(0.0).alias("stk_co_rate"))
    out = ops.corporate_actions(single, "19960101", "19991231")
    return out.select("ts_code", "ex_date", r(F.col("cash_per_share")).alias("cash_per_share"), r(F.col("stock_per_share")).alias("stock_per_share"), "record_date")


@query("sc13_dividend_tax", with_sql(DAILY_SQL, TRADES_SQL, BOOK_SQL, fifo_sql("tb", ", ".join(TRADE_ORDER), "trade_date"),
       "lots as (select ts_code, qty, cast(ent.trade_date + interval 18 year as date) as a, cast(ext.trade_date + interval 18 year as date) as s from trips where ext is not null and ext.trade_date > ent.trade_date)",
       "ac as (select ts_code, cast(trade_date + interval 18 year as date) as x, 0.5 as cps from daily where mi % 6 = 0)",
       "j as (select lots.ts_code, qty * cps as inc, case when s <= cast(a + interval 1 month as date) then 0.2 when s <= cast(a + interval 12 month as date) then 0.1 when x < date '2015-09-08' then 0.05 else 0 end - case when x < date '2015-09-08' then 0.05 else 0 end as rt from lots join ac on ac.ts_code = lots.ts_code and x > a and x <= s)") + """
select ts_code, round(sum(inc), 2) as income, round(sum(inc * rt), 3) as tax from j group by all""")
def _(spark, sf):
    paired = ops.round_trips(book(spark, sf), FILL_KEYS, TRADE_ORDER, ["trade_date"]).where("exit_trade_date > entry_trade_date")
    lots = paired.select("ts_code", F.col("trip_quantity").alias("quantity"), F.add_months("entry_trade_date", 216).alias("acquired"), F.add_months("exit_trade_date", 216).alias("sold"))
    ex = F.add_months("trade_date", 216)
    actions = daily(spark, sf).where("mi % 6 = 0").select("ts_code", ex.alias("ex_day"), ex.alias("record_day"), F.lit(0.5).alias("cash_per_share"), F.lit(0.0).alias("bonus_per_share"))
    return ops.dividend_tax(lots, actions).select("ts_code", r(F.col("income"), 2).alias("income"), r(F.col("tax"), 3).alias("tax"))


COMPARE_SQL = """sm as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, action, quantity, price, commission, stamp_duty from fills where l_partkey % 11 <> 0),
  rl as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, action, case when l_partkey % 5 = 0 then 0 when l_partkey % 5 = 1 then quantity - 1 when l_partkey % 5 = 2 then quantity + 2 else quantity end as quantity, price * 1.001 as price, commission + 1 as commission, stamp_duty from fills where l_partkey % 13 <> 0),
  cm as (select coalesce(s.l_orderkey, t.l_orderkey) as l_orderkey, coalesce(s.l_partkey, t.l_partkey) as l_partkey, coalesce(s.l_linenumber, t.l_linenumber) as l_linenumber, coalesce(s.action, t.action) as action, s.l_orderkey is not null as ord, coalesce(s.quantity, 0) as sq, coalesce(t.quantity, 0) as rq, s.price as sp, t.price as rp,
    coalesce(t.commission, 0) + coalesce(t.stamp_duty, 0) - coalesce(s.commission, 0) - coalesce(s.stamp_duty, 0) as fee from sm s full join rl t on s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber and s.l_partkey = t.l_partkey and s.l_suppkey = t.l_suppkey and s.action = t.action)"""
CMP_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "action"]


@query("ex10_fill_comparison", with_sql(FILLS_SQL, COMPARE_SQL) + """
select l_orderkey, l_linenumber, l_partkey, case when not ord then 'off_sheet' when sq = rq and rq > 0 then 'filled' when sq = rq then 'none' when rq = 0 then 'missed' when rq < sq then 'partial' else 'extra' end as status,
  round(case when action = 'buy' then 1 else -1 end * (rp - sp) * 1e4 / sp, 5) as price_bp, round(fee, 5) as fee_cost, cast(greatest(sq - rq, 0) as bigint) as missed_quantity, round(greatest(sq - rq, 0) * coalesce(sp, 0), 3) as missed_notional from cm""")
def _(spark, sf):
    f = fills(spark, sf).select(*CMP_KEYS, "quantity", "price", "commission", "stamp_duty")
    part = F.col("l_partkey") % 5
    real = f.where("l_partkey % 13 <> 0").withColumns({
        "quantity": F.when(part == 0, 0).when(part == 1, F.col("quantity") - 1).when(part == 2, F.col("quantity") + 2).otherwise(F.col("quantity")), "price": F.col("price") * 1.001, "commission": F.col("commission") + 1})
    out = ops.compare_fills(f.where("l_partkey % 11 <> 0"), real, CMP_KEYS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "status", r(F.col("price_bp"), 5).alias("price_bp"), r(F.col("fee_cost"), 5).alias("fee_cost"), "missed_quantity", r(F.col("missed_notional"), 3).alias("missed_notional"))


@query("ex11_corrected_fills", """
with e as (select o_orderkey as key, strftime(o_orderdate, '%Y%m%d') as session, o_totalprice as price, o_custkey as quantity from orders where o_orderkey % 20 <> 0)
select key, session, round(price, 2) as price, quantity from e where key % 15 <> 0 union all
select o_orderkey, case when o_orderkey % 20 <> 0 then strftime(o_orderdate, '%Y%m%d') end, round(o_totalprice + 1, 2), cast(o_custkey % 7 as bigint) from orders where o_orderkey % 15 = 0 and o_custkey % 7 > 0""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyyMMdd").alias("session"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("quantity"))
    ledger = rows.where("key % 15 = 0").select("key", (F.col("price") + 1).alias("price"), (F.col("quantity") % 7).alias("quantity"))
    out = ops.apply_corrections(rows.where("key % 20 <> 0"), ledger, ledger, ["key"])
    return out.select("key", "session", r(F.col("price"), 2).alias("price"), "quantity")


@query("ex12_record_resolution", """
select o_orderkey as key, case when o_orderkey % 4 = 0 then 'own' when o_orderkey % 3 = 0 then null when day(o_orderdate) % 2 = 0 then 'session' when o_orderkey % 5 = 0 then 'not_traded' end as outcome from orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyyMMdd").alias("session"), (F.col("o_orderkey") % 3 != 0).alias("ordered"), (F.col("o_orderkey") % 5 == 0).alias("post_hoc"), F.dayofmonth("o_orderdate").alias("d"))
    own = rows.where("key % 4 = 0").select("key", F.lit("own").alias("outcome"))
    sessions = rows.where("d % 2 = 0").select("session", F.lit("session").alias("outcome")).distinct()
    return ops.resolve(rows, own, sessions, ["key"], "session").select("key", "outcome")


@query("ex13_due_days", with_sql(CALENDAR_SQL, "o as (select cal_date from calendar where is_open)") + """
select 'month' as period, strftime(min(cal_date), '%Y%m%d') as due from o group by date_trunc('month', cal_date) union all select 'quarter', strftime(min(cal_date), '%Y%m%d') from o group by date_trunc('quarter', cal_date)
union all select 'year', strftime(min(cal_date), '%Y%m%d') from o group by date_trunc('year', cal_date) union all select 'week', strftime(min(cal_date), '%Y%m%d') from o group by date_trunc('week', cal_date)""")
def _(spark, sf):
    opens, out = calendar(spark, sf).where("is_open").select("cal_date"), None
    for period in ("month", "quarter", "year", "week"):
        part = cal_ops.due_days(opens, period).select(F.lit(period).alias("period"), F.date_format("cal_date", "yyyyMMdd").alias("due"))
        out = part if out is None else out.unionByName(part)
    return out


@query("j09_twin_filings", with_sql(ANN_SQL, """m as (select *, nullif(regexp_extract(url, '(?:announcementId=|finalpage/[0-9]{4}-[0-9]{2}-[0-9]{2}/)([0-9]+)', 1), '') as fid, row_id % 6 as n from ann),
   tw as (select ts_code, ann_date, n, min(fid) as twin from m where fid is not null group by all)""") + "select row_id, coalesce('#' || coalesce(fid, twin), '~|' || ann_date || '|NoticeNo' || cast(n as varchar)) as filing from m left join tw using (ts_code, ann_date, n)")
def _(spark, sf):
    return text_ops.filing_ids(announcements(spark, sf), "row_id").select("row_id", "filing")


@query("top01_event_sort", with_sql(NOTICES_SQL) + "select row_number() over (order by available_at nulls first, dataset, ts_code, priority, id) as place, id from notices")
def _(spark, sf):
    from ..operators.ordered import Running, running
    df = notices(spark, sf).select("available_at", "dataset", "ts_code", F.col("priority").alias("business_key"), F.col("id").alias("version_rank"), "id")
    ordered = topk.sort_events(df).withColumn("_one", F.lit(1).cast("long"))
    return running(ordered, [], topk.EVENT_ORDER, {"place": Running("sum", "_one")}).select("place", "id")


@query("top02_latest_version", with_sql(FILINGS_SQL) + "select ts_code, end_date, update_flag, id from (select *, row_number() over (partition by ts_code, end_date order by update_flag desc, id desc) as rn from filings) where rn = 1")
def _(spark, sf):
    return topk.latest_version(filings(spark, sf), ["ts_code", "end_date"], tie=["id"]).select("ts_code", "end_date", "update_flag", "id")


@query("top03_top_n", with_sql(NOTICES_SQL) + "select dataset, id, place from (select dataset, id, row_number() over (partition by dataset order by amount desc, id) as place from notices) where place <= 8")
def _(spark, sf):
    return topk.top_n(notices(spark, sf), 8, F.col("amount").desc(), "id", group=["dataset"]).select("dataset", "id", "place")


@query("udf01_user_signal", with_sql(DAILY_SQL) + "select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(close / lag(close, 2) over (partition by ts_code order by trade_date) - 1, 8) as score from daily qualify lag(close, 2) over (partition by ts_code order by trade_date) is not null")
def _(spark, sf):
    signals.register_signal("momentum", signals.pandas_signal(lambda rows: rows["close"] / rows["close"].shift(2) - 1, ["close"]))
    return signals.compute_signal("momentum", daily(spark, sf)).select(day("trade_date"), "ts_code", r(F.col("score"), 8).alias("score"))


@query("udf02_fit_score", with_sql(DAILY_SQL, "m as (select date_trunc('quarter', trade_date) as qtr, avg(turnover_rate) as mu, count(*) as n, sum(turnover_rate) as s from daily group by all)",
       "h as (select qtr, sum(s) over w / sum(n) over w as mean from m window w as (order by qtr rows between unbounded preceding and 1 preceding))") + """
select strftime(trade_date, '%Y%m%d') as trade_date, ts_code, round(turnover_rate - mean, 6) as score from daily join h on h.qtr = date_trunc('quarter', trade_date) where mean is not null""")
def _(spark, sf):
    from pyspark.sql import Window

    def fit(rows):
        sums = rows.groupBy("fit_day").agg(F.sum("turnover_rate").alias("s"), F.count("turnover_rate").alias("n"))
        past = Window.orderBy("fit_day").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("fit_day", (F.sum("s").over(past) / F.sum("n").over(past)).alias("mean")).where("mean is not null")

    out = signals.fit_score(daily(spark, sf), "quarter", fit, lambda rows, model: rows.join(F.broadcast(model), "fit_day").withColumn("score", F.col("turnover_rate") - F.col("mean")))
    return out.select(day("trade_date"), "ts_code", r(F.col("score")).alias("score"))
