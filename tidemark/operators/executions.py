"""Executions: round trips, book curves and the matched-random baseline.

Fills of a symbol are ordered work of any size, so every running quantity goes
through :func:`running`, which splits a symbol that is too large for a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import board, lot_quantity
from ..functions.values import Profile, digest_number, trade_fee, usable_price
from ..session import discard
from .asof import asof_join
from .intervals import inside
from .ordered import Running, along, keep_last, lay_out, running, windowed
from .pools import minimum_cost
from .screen import date_index

DECILES = 10


def round_trips(fills: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """First-in-first-out pairs of buys and sells per key.

    Bought shares are laid end to end, and sold shares over them: sells that
    found nothing open are taken out by the running maximum of the shortfall.
    Each stretch between two neighbouring ends belongs to one buy and at most
    one sell. ``order`` must be unique per key; ``carry`` columns travel as
    ``entry_*`` and ``exit_*``. An open trip has null exit columns. Whoever stores
    the trips may do so ``instead_of`` them: the layout they are read from goes.
    """
    buy = F.col("action") == "buy"
    needed = [F.col(name) for name in dict.fromkeys([*keys, *order, *carry, "action"])]
    rows = fills.select(*needed, F.when(buy, F.col("quantity")).otherwise(0).cast("long").alias("_b"), F.when(buy, 0).otherwise(F.col("quantity")).cast("long").alias("_s"))
    laid = lay_out(rows, keys, order)
    summed = along(laid, keys, {"_B": Running("sum", "_b"), "_S": Running("sum", "_s")})
    short = along(summed.withColumn("_short", F.col("_S") - F.col("_B")), keys, {"_worst": Running("max", "_short")})
    lost = F.greatest(F.lit(0), F.col("_worst"))
    payload = F.struct(*[F.col(name) for name in carry])
    # The place ``_at`` of a layout ascends over all its tasks.
    ends = short.withColumn("_end", F.when(buy, F.col("_B")).otherwise(F.col("_S") - lost)).where("_end > 0").groupBy(*keys, "_end").agg(
        F.max(F.when(buy, payload)).alias("_entry"), F.min(F.when(~buy, F.struct(F.col("_at").alias("place"), payload.alias("_p")))).alias("_exit"))
    ends = ends.withColumn("_exit", F.col("_exit._p"))
    values = {"_from": Running("max", "_end", exclusive=True), "_entry": Running("last", "_entry"), "_exit": Running("last", "_exit")}
    ended = lay_out(ends, keys, ["_end"])
    discard(laid)
    closed = along(ended, keys, values, backwards=["_entry", "_exit"])
    pieces = closed.where("_entry is not null").withColumn("trip_quantity", F.col("_end") - F.coalesce("_from", F.lit(0)))
    trips = pieces.select(
        *keys, "trip_quantity", *[F.col(f"_entry.{name}").alias(f"entry_{name}") for name in carry],
        *[F.col(f"_exit.{name}").alias(f"exit_{name}") for name in carry])
    trips.scratch = ended.scratch
    return trips


def unpaired_sells(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sold shares no buy accounts for, per key."""
    buy = F.col("action") == "buy"
    signed = fills.withColumn("_d", F.when(buy, -F.col("quantity")).otherwise(F.col("quantity")).cast("long"))
    short = running(signed, keys, order, {"_short": Running("sum", "_d")})
    return short.groupBy(*keys).agg(F.greatest(F.lit(0), F.max("_short")).alias("unpaired_shares")).where("unpaired_shares > 0")


# -- book curves -------------------------------------------------------------------


def daily_positions(fills: DataFrame, days: DataFrame, run: str = "run_id") -> DataFrame:
    """Shares held at the end of each trading day (``days``: trade_date, di).

    Day totals come first, so the running window of a (run, symbol) is bounded
    by the calendar; a holding is expanded only over the days it is held.
    """
    signed = F.when(F.col("action") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    moves = fills.groupBy(run, "ts_code", "trade_date").agg(F.sum(signed).alias("_q")).join(F.broadcast(days), "trade_date")
    order = Window.partitionBy(run, "ts_code").orderBy("di")
    held = moves.withColumns({"quantity": F.sum("_q").over(order), "_next": F.lead("di").over(order)})
    last = days.agg(F.max("di").alias("_last"))
    spans = held.where("quantity <> 0").join(F.broadcast(last)).withColumn("di", F.explode(F.sequence(F.col("di"), F.coalesce(F.col("_next") - 1, F.col("_last")))))
    return spans.select(run, "ts_code", "di", "quantity")


def filled_closes(daily: DataFrame, days: DataFrame) -> DataFrame:
    """Close of every name on every day from its first bar, gaps carried."""
    bars = daily.select("trade_date", "ts_code", usable_price(F.col("close")).alias("close")).where("close is not null").join(F.broadcast(days), "trade_date")
    order = Window.partitionBy("ts_code").orderBy("di")
    last = days.agg(F.max("di").alias("_last"))
    spans = bars.withColumn("_next", F.lead("di").over(order)).join(F.broadcast(last))
    return spans.select("ts_code", F.explode(F.sequence(F.col("di"), F.coalesce(F.col("_next") - 1, F.col("_last")))).alias("di"), "close")


def book_curve(fills: DataFrame, daily: DataFrame, initial_cash: float, run: str = "run_id", profile: Profile | None = None) -> DataFrame:
    """Daily cash, holdings value and equity of each run.

    Cash is the opening balance less signed notional and costs; holdings are
    marked at the last usable close.
    """
    days = date_index(daily)
    notional = F.col("price") * F.col("quantity")
    cost = trade_fee(notional, profile) if profile else F.lit(0.0)
    flow = F.when(F.col("action") == "buy", -notional).otherwise(notional) - cost
    flows = fills.groupBy(run, "trade_date").agg(F.sum(flow).alias("_flow")).join(F.broadcast(days), "trade_date").drop("trade_date")
    grid = fills.select(run).distinct().join(F.broadcast(days))
    order = Window.partitionBy(run).orderBy("di")
    cash = grid.join(flows, [run, "di"], "left").withColumn("cash", F.lit(initial_cash) + F.coalesce(F.sum("_flow").over(order), F.lit(0.0)))
    held = daily_positions(fills, days, run).join(filled_closes(daily, days), ["ts_code", "di"], "left")
    value = held.groupBy(run, "di").agg(F.sum(F.col("quantity") * F.coalesce("close", F.lit(0.0))).alias("holdings"), F.count(F.lit(1)).alias("names"))
    out = cash.join(value, [run, "di"], "left").na.fill(0.0, ["holdings"]).na.fill(0, ["names"])
    return out.select(run, "trade_date", "cash", "holdings", "names", (F.col("cash") + F.col("holdings")).alias("equity"), F.lit(initial_cash).alias("initial_equity"))


# -- candidate pools ----------------------------------------------------------------


def deciles(daily: DataFrame, value: str = "circ_mv", name: str = "decile") -> DataFrame:
    """Decile of each day's cross-section by minimum rank; ties share a bucket."""
    window = Window.partitionBy("trade_date", F.col(value).isNull())
    share = F.rank().over(window.orderBy(value)) / F.count(F.lit(1)).over(window)
    ranked = daily.withColumn("_share", F.when(F.col(value).isNotNull(), share))
    return ranked.withColumn(name, F.least(F.floor(F.col("_share") * DECILES), F.lit(DECILES - 1)).cast("long")).drop("_share")


def pool_positions(trips: DataFrame, daily: DataFrame, bucket: str, boards: Sequence[str] | None = None) -> DataFrame:
    """Names open to each (entry day, exit day, bucket), numbered by cost.

    ``trips`` carry entry_day, exit_day and ``bucket``. A pool is built once per
    distinct combination, never per trip: a trip then owns the positions up to
    what its money buys, so no trip is ever paired with its candidates. The table
    has a row for each name and exit day: it is for few exit days; whole books
    go through :mod:`pools`.
    """
    combos = trips.select("entry_day", "exit_day", bucket).distinct()
    bars = daily.where(usable_price(F.col("open")).isNotNull())
    if boards is not None:
        bars = bars.where(board(F.col("ts_code")).isin(*boards))
    bars = bars.select(F.col("trade_date").alias("entry_day"), "ts_code", F.col(bucket), minimum_cost(F.col("open"), F.col("ts_code")).alias("cost"), F.col("open").alias("pool_open"))
    pool = combos.join(bars, ["entry_day", bucket])
    exits = daily.select(F.col("trade_date").alias("exit_day"), "ts_code")
    closed = pool.where("exit_day is not null").join(exits, ["exit_day", "ts_code"], "left_semi")
    both = closed.unionByName(pool.where("exit_day is null")).withColumn("_one", F.lit(1).cast("long"))
    keyed = both.withColumn("_exit", F.coalesce("exit_day", F.lit("9999-12-31").cast("date")))
    # A pool holds at most the names of one day.
    return windowed(keyed, ["entry_day", "_exit", bucket], ["cost", "ts_code"], {"place": Running("sum", "_one")}).drop("_one", "exit_day")


def affordable(trips: DataFrame, pool: DataFrame, bucket: str) -> DataFrame:
    """``pool_size`` of each trip: names its money buys, itself left out.

    The count is the place of the dearest affordable name, found as-of along
    cost; ``own_place`` is the trip's own place when it is among them.
    """
    keyed = trips.withColumn("_exit", F.coalesce("exit_day", F.lit("9999-12-31").cast("date")))
    keys = ["entry_day", "_exit", bucket]
    reach = asof_join(keyed, pool, keys, "notional", "cost", ["place"])
    own = pool.select(*keys, "ts_code", F.col("place").alias("own_place"))
    joined = reach.join(own, [*keys, "ts_code"], "left")
    mine = F.col("own_place") <= F.col("place")
    size = F.coalesce("place", F.lit(0)) - F.when(F.coalesce(mine, F.lit(False)), 1).otherwise(0)
    return joined.withColumn("pool_size", size.cast("long")).withColumn("own_place", F.when(mine, F.col("own_place"))).drop("place")


def draw(sized: DataFrame, pool: DataFrame, bucket: str, draws: int, seed: int, trip: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One uniformly picked replacement per (draw, trip) with a non-empty pool.

    The pick is a digest of (seed, draw, trip identity, twin), the same in any
    engine and after any retry. ``trip`` names the identity columns; the twins
    of one identity are numbered by exit, so each draws a name of its own. A
    pool, at most the names of one day, meets its trips as one list in order of
    cost, so no pick is shuffled to find its name. ``carry`` columns of the
    pool's names come along.
    """
    same = Window.partitionBy(*trip).orderBy(F.col("exit_day").asc_nulls_last())
    numbered = sized.withColumn("twin", F.row_number().over(same)).where("pool_size > 0")
    keys = ["entry_day", "_exit", bucket]
    name = F.struct("place", "ts_code", "pool_open", *carry)
    lists = pool.groupBy(*keys).agg(F.array_sort(F.collect_list(name), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("_names"))
    rows = numbered.join(lists, keys).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = F.pmod(digest_number(F.lit(seed), F.col("draw"), *map(F.col, trip), F.col("twin")), F.col("pool_size")) + 1
    place = F.when(F.col("own_place") <= picked, picked + 1).otherwise(picked)
    found = rows.withColumn("_name", F.element_at("_names", place.cast("int")))
    out = found.select(*sized.columns, "twin", "draw", F.col("_name.ts_code").alias("drawn_code"), F.col("_name.pool_open").alias("pool_open"), *[F.col(f"_name.{c}").alias(c) for c in carry])
    return out.withColumn("drawn_quantity", lot_quantity(F.col("notional"), F.col("pool_open"), F.col("drawn_code")))


def baseline(pnl: DataFrame, curve: DataFrame, draws: int) -> DataFrame:
    """Mean and cross-draw deviation of daily draw returns on the book's capital.

    ``curve`` is one book (trade_date, equity, initial_equity). A draw without
    holdings on a day returns zero that day.
    """
    order = Window.orderBy("trade_date")
    capital = curve.select("trade_date", F.coalesce(F.lag("equity").over(order), F.col("initial_equity")).alias("capital"))
    returns = pnl.join(F.broadcast(capital), "trade_date").withColumn("_r", F.col("pnl") / F.col("capital"))
    days = returns.groupBy("trade_date").agg(F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_ss"))
    whole = capital.join(days, "trade_date", "left").na.fill(0.0, ["_s", "_ss"])
    mean = F.col("_s") / draws
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("_ss") - draws * mean * mean) / max(draws - 1, 1)))
    return whole.select("trade_date", mean.alias("value"), (spread if draws > 1 else F.lit(0.0)).alias("draw_sd"))


def draw_distribution(pnl: DataFrame, curve: DataFrame, draws: int) -> DataFrame:
    """Where the book's compounded return stands among the draws': their mean, spread, tails, and the share at or below it.

    A draw that loses more than its capital in a day has no compounded return: it
    is NaN, above every number, and so are the mean and the spread.
    """
    order = Window.orderBy("trade_date")
    capital = curve.select("trade_date", F.coalesce(F.lag("equity").over(order), F.col("initial_equity")).alias("capital"))
    change = F.col("pnl") / F.col("capital")
    grown = F.when(change < -1, F.lit(float("nan"))).when(change == -1, F.lit(float("-inf"))).otherwise(F.log1p(change))
    per_draw = pnl.join(F.broadcast(capital), "trade_date").groupBy("draw").agg((F.exp(F.sum(grown)) - 1).alias("_x"))
    every = curve.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw")).join(per_draw, "draw", "left").withColumn("_x", F.coalesce("_x", F.lit(0.0)))
    own = curve.agg((F.max_by("equity", "trade_date") / F.min_by("initial_equity", "trade_date") - 1).alias("observed"))
    return every.join(F.broadcast(own)).groupBy("observed").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), F.percentile("_x", F.lit(0.05)).alias("p05"),
        F.percentile("_x", F.lit(0.95)).alias("p95"), F.avg(F.when(F.col("_x") <= F.col("observed"), 1.0).otherwise(0.0)).alias("share_at_or_below"))


def carried_limit(limit: Column, own_pre_close: Column, new_pre_close: Column) -> Column:
    """A limit price moved to another name at the same distance, on a whole cent."""
    usable = (own_pre_close > 0) & (new_pre_close > 0)
    bad = F.raise_error(F.lit("no usable previous close to carry a limit price")).cast("double")
    return F.when(limit.isNotNull(), F.when(usable, F.floor(limit / own_pre_close * new_pre_close * 100 + 0.5) / 100).otherwise(bad))


def sellable(trips: DataFrame, multipliers: DataFrame, trip: Sequence[str]) -> DataFrame:
    """Shares a lot can sell at its exit after the ex-dates it was held through.

    ``multipliers`` has (ts_code, trade_date, multiplier), at most one per name
    and day, so a trip's list is as short as its ex-dates. Each floor matters,
    hence an ordered fold. An exit on an ex-date sells no share it creates.
    """
    changes = multipliers.where("multiplier is not null").select("ts_code", F.col("trade_date").alias("_day"), "multiplier")
    hits = inside(changes, trips, "_day", "entry_day", "exit_day", ["ts_code"]).where("_day > entry_day")
    lists = hits.groupBy(*trip).agg(F.array_sort(F.collect_list(F.struct("_day", "multiplier"))).alias("_m"))
    joined = trips.join(lists, list(trip), "left")
    step = lambda held, m: F.floor(F.round(held * m["multiplier"], 6)).cast("long")
    fold = F.aggregate("_m", F.col("quantity").cast("long"), lambda held, m: F.when(m["_day"] == F.col("exit_day"), F.least(held, step(held, m))).otherwise(step(held, m)))
    return joined.withColumn("sellable", F.coalesce(fold, F.col("quantity").cast("long"))).drop("_m")


# -- corporate actions ---------------------------------------------------------------


def corporate_actions(events: DataFrame, start: str, end: str, stage: str = "实施") -> DataFrame:
    """Per-share distributions by (code, ex-date) inside a window.

    Implemented rows only, latest announcement per event; rows announced after
    their ex-date are dropped, same-day rows summed, and taxable rows must
    agree on one record date.
    """
    text = lambda name: F.coalesce(F.trim(F.col(name)), F.lit(""))
    number = lambda name: F.col(name).try_cast("double")
    rows = events.where(F.col("div_proc") == stage).withColumns({name: text(name) for name in ("ex_date", "record_date", "pay_date", "div_listdate")})
    rows = rows.where(F.col("ex_date").between(start, end) & (F.date_format("available_at", "yyyyMMdd") <= F.col("ex_date")))
    latest = keep_last(rows, ["ts_code", "end_date", "ex_date"], "available_at", "record_date")
    bonus, transfer = F.coalesce(number("stk_bo_rate"), F.lit(0.0)), F.coalesce(number("stk_co_rate"), F.lit(0.0))
    positive = lambda value: F.greatest(value, F.lit(0.0))
    shares = latest.withColumns({
        "cash_per_share": positive(F.coalesce(number("cash_div_tax"), number("cash_div"), F.lit(0.0))),
        "stock_per_share": positive(F.coalesce(number("stk_div"), bonus + transfer)), "bonus_per_share": positive(bonus)})
    shares = shares.where("cash_per_share > 0 or stock_per_share > 0")
    taxable = (F.col("cash_per_share") > 0) | (F.col("bonus_per_share") > 0)
    sums = shares.groupBy("ts_code", "ex_date").agg(
        F.sum("cash_per_share").alias("cash_per_share"), F.sum("stock_per_share").alias("stock_per_share"), F.sum("bonus_per_share").alias("bonus_per_share"),
        F.min(F.when(taxable, F.col("record_date"))).alias("_lo"), F.max(F.when(taxable, F.col("record_date"))).alias("_hi"), F.max("div_listdate").alias("div_listdate"))
    clash = F.raise_error(F.concat(F.lit("ambiguous record date: "), F.col("ts_code"), F.lit(" "), F.col("ex_date")))
    record = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi")).when(F.col("_hi").isNull(), "").otherwise(clash)
    return sums.withColumn("record_date", record).drop("_lo", "_hi")


def dividend_tax(lots: DataFrame, actions: DataFrame) -> DataFrame:
    """Tax due when lots are sold: income while held at the final rate less withheld.

    ``lots`` are round trips (ts_code, quantity, acquired, sold); a lot meets
    only the ex-dates of its own name inside its holding.
    """
    from ..functions.values import dividend_tax_rate, dividend_tax_withheld

    income = F.col("quantity") * (F.col("cash_per_share") + F.col("bonus_per_share"))
    joined = inside(actions, lots, "ex_day", "acquired", "sold", ["ts_code"]).where("ex_day > acquired")
    record = F.col("record_day")
    due = income * (dividend_tax_rate(F.col("acquired"), F.col("sold"), record) - dividend_tax_withheld(record))
    return joined.groupBy("ts_code").agg(F.sum(income).alias("income"), F.sum(due).alias("tax"))


# -- simulated against recorded ------------------------------------------------------


def compare_fills(simulated: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome of each key with signed price cost, fee cost and missed notional."""
    cols = ("quantity", "price", "commission", "stamp_duty")
    sim = simulated.select(*keys, F.lit(True).alias("_ordered"), *[F.col(c).alias(f"sim_{c}") for c in cols])
    real = recorded.select(*keys, *[F.col(c).alias(f"real_{c}") for c in cols])
    both = sim.join(real, list(keys), "full_outer").na.fill(0, ["sim_quantity", "real_quantity"])
    for side in ("sim", "real"):
        both = both.na.fill(0.0, [f"{side}_commission", f"{side}_stamp_duty"])
    sq, rq = F.col("sim_quantity"), F.col("real_quantity")
    status = (
        F.when(F.col("_ordered").isNull(), "off_sheet").when((sq == rq) & (rq > 0), "filled").when(sq == rq, "none").when(rq == 0, "missed").when(rq < sq, "partial").otherwise("extra"))
    gap = F.when(F.col("action") == "buy", 1.0).otherwise(-1.0) * (F.col("real_price") - F.col("sim_price"))
    missed = F.greatest(sq - rq, F.lit(0))
    return both.select(
        *keys, status.alias("status"), F.try_divide(gap * 1e4, F.col("sim_price")).alias("price_bp"), (gap * rq).alias("price_cost"),
        (F.col("real_commission") + F.col("real_stamp_duty") - F.col("sim_commission") - F.col("sim_stamp_duty")).alias("fee_cost"),
        missed.alias("missed_quantity"), (missed * F.coalesce("sim_price", F.lit(0.0))).alias("missed_notional"))


def apply_corrections(executions: DataFrame, corrected: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fills with corrected keys replaced by the ledger's outcome (none when zero)."""
    marks = corrected.select(*keys).distinct()
    kept = executions.join(marks, list(keys), "left_anti")
    named = executions.join(marks, list(keys), "left_semi").groupBy(*keys).agg(F.min("session").alias("session"))
    fixed = ledger.join(marks, list(keys), "left_semi").where("quantity > 0").join(named, list(keys), "left")
    return kept.unionByName(fixed.select(*kept.columns))


def resolve(orders: DataFrame, fill_records: DataFrame, session_records: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """What each key settles with: its own record, its session's, else post hoc."""
    own = fill_records.select(*keys, F.col("outcome").alias("_own"))
    session = session_records.select(day, F.col("outcome").alias("_session"))
    joined = orders.join(own, list(keys), "left").join(session, day, "left")
    fallback = F.when(F.col("ordered"), F.coalesce("_session", F.when(F.col("post_hoc"), "not_traded")))
    return joined.withColumn("outcome", F.coalesce("_own", fallback)).drop("_own", "_session")


