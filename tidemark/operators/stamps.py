"""Availability stamps: when each row became public, and under which rule."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import Clock, RefreshNode
from ..functions.times import (
    at_clock, compact_date, date_text, day_end, market_time, source_time,
)
from .calendar import nth_next_open, publication_stamp

MISSING_DATE = "missing_source_date"


def _stamped(df: DataFrame, stamp: Column, rule: Column) -> DataFrame:
    return df.withColumns({"available_at": stamp, "available_at_rule": rule})


def stamp_contract(df: DataFrame, contract: Clock) -> DataFrame:
    """Partition date plus lag at the contract clock; unreadable dates stay null."""
    stamp = at_clock(compact_date(F.col(contract.key)), contract.clock, contract.offset)
    return _stamped(df, stamp, F.lit(contract.label))


def _with_next_open(df: DataFrame, column: str, rule: Clock | None, calendar: DataFrame | None, name: str) -> DataFrame:
    if rule is None or rule.unit != "opens":
        return df.withColumn(name, F.lit(None).cast("date"))
    if calendar is None:
        raise ValueError(f"{rule.label} needs the trading calendar")
    steps = nth_next_open(calendar, rule.offset).select(F.col("cal_date").alias("_cal"), F.col("next_open").alias(name))
    return df.join(F.broadcast(steps), compact_date(F.col(column)) == F.col("_cal"), "left").drop("_cal")


def stamp_official(
    df: DataFrame, column: str, rule: Clock | None, calendar: DataFrame | None = None, is_new: bool = False
) -> DataFrame:
    """Official clock on the source date, a later calendar day or the N-th next open day."""
    joined = _with_next_open(df, column, rule, calendar, "_open")
    stamp, label = publication_stamp(compact_date(F.col(column)), rule, F.col("_open"), is_new)
    return _stamped(joined, stamp, label).drop("_open")


def stamp_event(
    df: DataFrame, column: str, fallback: str | None, rule: Clock | None, calendar: DataFrame | None = None
) -> DataFrame:
    """The primary date's stamp, else the fallback date's, marked as such."""
    trimmed = df.withColumn(column, F.trim(F.col(column)))
    joined = _with_next_open(trimmed, column, rule, calendar, "_open")
    stamp, label = publication_stamp(compact_date(F.col(column)), rule, F.col("_open"))
    if fallback is None:
        return _stamped(joined, stamp, label).drop("_open")
    joined = _with_next_open(joined, fallback, rule, calendar, "_open_fallback")
    second, _ = publication_stamp(compact_date(F.col(fallback)), rule, F.col("_open_fallback"))
    marked = F.when(stamp.isNotNull(), label).when(second.isNotNull(), F.lit(f"fallback_conservative_from:{fallback}")).otherwise(label)
    return _stamped(joined, F.coalesce(stamp, second), marked).drop("_open", "_open_fallback")


def period_stamp(text: Column) -> tuple[Column, Column]:
    """End of a day, month end + 31 days, or quarter end + 45 days, at day end."""
    trimmed = F.trim(text.cast("string"))
    day = compact_date(trimmed)
    month = F.when(trimmed.rlike(r"^\d{6}$"), F.last_day(F.try_to_date(F.concat(trimmed, F.lit("01")), "yyyyMMdd")))
    quarter_month = F.lpad((F.substring(trimmed, 6, 1).try_cast("int") * 3).cast("string"), 2, "0")
    quarter = F.when(
        trimmed.rlike(r"^\d{4}Q[1-4]$"),
        F.last_day(F.try_to_date(F.concat(F.substring(trimmed, 1, 4), quarter_month, F.lit("01")), "yyyyMMdd")),
    )
    stamp = F.coalesce(day_end(day), day_end(month, 31), day_end(quarter, 45))
    rule = (
        F.when(day.isNotNull(), F.lit("conservative_date_eod"))
        .when(month.isNotNull(), F.lit("conservative_month_end_plus_31d"))
        .when(quarter.isNotNull(), F.lit("conservative_quarter_end_plus_45d"))
        .otherwise(F.lit(MISSING_DATE))
    )
    return stamp, rule


def stamp_macro(df: DataFrame, column: str, time_column: str | None = None) -> DataFrame:
    """Period stamp of a macro table, or its own date and clock where both read."""
    if column not in df.columns:
        raise ValueError(f"macro table has no {column!r} column to stamp by")
    stamp, rule = period_stamp(F.col(column))
    if time_column is None:
        return _stamped(df, stamp, rule)
    clock = F.regexp_replace(F.trim(F.col(time_column).cast("string")), r"^(\d):", "0$1:")
    clock = F.when(clock.rlike(r"^\d{2}:\d{2}$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
    exact = F.concat_ws(" ", F.date_format(compact_date(F.col(column)), "yyyy-MM-dd"), clock).try_cast("timestamp_ntz")
    exact = F.when(compact_date(F.col(column)).isNotNull() & clock.rlike(r"^\d{2}:\d{2}:\d{2}$"), exact)
    label = F.when(exact.isNotNull(), F.lit(f"source:{column}+{time_column}")).otherwise(rule)
    return _stamped(df, F.coalesce(exact, stamp), label)


def stamp_board(
    df: DataFrame, time_column: str | None, column: str | None, rule: Clock | None, *, is_new: bool = False, static: bool = False
) -> DataFrame:
    """Source clock where present, else the official stamp of the date column."""
    stamp, label = F.lit(None).cast("timestamp_ntz"), F.lit("missing_source_time")
    if time_column:
        stamp = source_time(F.col(time_column))
        label = F.when(stamp.isNotNull(), F.lit(f"source:{time_column}")).otherwise(label)
    if column:
        official, official_label = publication_stamp(compact_date(F.col(column)), rule, None, is_new)
        label = F.when(stamp.isNull() & official.isNotNull(), official_label).otherwise(label)
        stamp = F.coalesce(stamp, official)
    if static and not time_column and not column:
        label = F.lit("static_reference_no_pit_time")
    return _stamped(df, stamp, label)


def landing_run(instant: Column, node: RefreshNode) -> Column:
    """Launch of the job instance at or before an instant."""
    launch = at_clock(F.to_date(instant), node.start)
    return F.when(launch <= instant, launch).otherwise(at_clock(F.date_sub(F.to_date(instant), 1), node.start))


def stamp_text(df: DataFrame, column: str, time_column: str, first_seen: str | None, node: RefreshNode, fallback_clock: str = "23:59:59") -> DataFrame:
    """Believe a text's clock only near its date; bare midnights fall back.

    A bare date takes the launch of the job that first received it when that is
    near the date too; everything else is stamped at the end of its date.
    """
    day = compact_date(F.col(column))
    said = source_time(F.col(time_column))
    midnight_of = day.cast("timestamp_ntz")

    def near(stamp: Column) -> Column:
        lag = F.timestamp_diff("SECOND", midnight_of, stamp) / 86400.0
        return F.coalesce(lag.between(-catalog.TEXT_DAYS_BEFORE, catalog.TEXT_DAYS_AFTER), F.lit(False))

    believable = said.isNotNull() & (day.isNull() | near(said))
    implausible = said.isNotNull() & day.isNotNull() & ~near(said)
    bare = believable & day.isNotNull() & (F.to_date(said).cast("timestamp_ntz") == said)
    landed = landing_run(F.col(first_seen), node) if first_seen else F.lit(None).cast("timestamp_ntz")
    received = bare & F.coalesce(near(landed), F.lit(False))
    stamp = F.when(believable & ~bare, said).when(received, landed).when(day.isNotNull(), at_clock(day, fallback_clock))
    fallback = f"conservative_from:{column}"
    rule = (
        F.when(believable & ~bare, F.lit(f"source:{time_column}"))
        .when(received, F.lit(f"first_seen_for_date_only_{time_column}"))
        .when(day.isNotNull() & implausible, F.lit(f"{fallback}:implausible_{time_column}"))
        .when(day.isNotNull() & bare, F.lit(f"{fallback}:date_only_{time_column}"))
        .when(day.isNotNull(), F.lit(fallback))
        .otherwise(F.lit("missing_source_time"))
    )
    return _stamped(df, stamp, rule)


def stamp_minutes(df: DataFrame, column: str = "trade_time") -> DataFrame:
    """A minute bar is public at its close."""
    closed = market_time(F.col(column).cast("string"))
    return _stamped(df.withColumn("trade_date", F.coalesce(date_text(closed), F.lit(""))), closed, F.lit("source:trade_time_bar_close"))


def stamp_auction(df: DataFrame, column: str = "trade_date") -> DataFrame:
    """Opening-auction rows are public at one official clock."""
    stamp = at_clock(compact_date(F.col(column)), catalog.AUCTION_CLOCK)
    return _stamped(df, stamp, F.lit("official_auction_0929_from:trade_date"))


def first_available(columns: Sequence[str], rule: str) -> tuple[Column, Column]:
    """Event-clock stamp of the first readable date; the rule names a fallback."""
    dates = [compact_date(F.col(name)) for name in columns]
    stamp = at_clock(F.coalesce(*dates), catalog.EVENT_CLOCK)
    label = F.lit(MISSING_DATE)
    for position in range(len(columns) - 1, -1, -1):
        named = rule if position == 0 else f"{rule}:{columns[position]}"
        label = F.when(dates[position].isNotNull(), F.lit(named)).otherwise(label)
    return stamp, label


STATEMENTS = ("income_vip", "balancesheet_vip", "cashflow_vip")
JOINED_RULE = "fallback_joined_statement_available_at"


def stamp_fundamental(dataset: str, df: DataFrame, latest: str | None = None) -> DataFrame:
    """Publication of one disclosure table.

    ``latest`` names a column with the latest statement announcement of the
    row's (code, period), as attached by :func:`join_latest_statement`.
    """
    joined = F.col(latest) if latest else F.lit(None).cast("timestamp_ntz")
    if dataset in STATEMENTS:
        return _stamped(df, *first_available(["f_ann_date", "ann_date"], "source:f_ann_date_or_ann_date"))
    if dataset in ("forecast_vip", "express_vip"):
        return _stamped(df, *first_available(["ann_date"], "source:ann_date"))
    if dataset == "fina_indicator_vip":
        stamp, rule = first_available(["ann_date"], "source:ann_date")
        later = F.coalesce(joined > stamp, F.lit(False))
        return _stamped(df, F.when(later, joined).otherwise(stamp), F.when(later, F.lit(JOINED_RULE)).otherwise(rule))
    if dataset in ("fina_audit", "fina_mainbz_vip"):
        stamp, rule = first_available(["ann_date"], "source:ann_date")
        filled = stamp.isNull() & joined.isNotNull()
        return _stamped(df, F.coalesce(stamp, joined), F.when(filled, F.lit(JOINED_RULE)).otherwise(rule))
    if dataset == "dividend":
        stamp, rule = first_available(["imp_ann_date", "ann_date"], "source:imp_ann_date_or_ann_date")
        unannounced = (F.coalesce(F.trim("div_proc"), F.lit("")) == "实施") & compact_date(F.col("imp_ann_date")).isNull()
        stamp = F.when(~unannounced, stamp)
        return _stamped(df, stamp, F.when(stamp.isNull(), F.lit("missing_announcement_date_not_pit_visible")).otherwise(rule))
    if dataset == "disclosure_date":
        stamp, rule = first_available(["ann_date", "pre_date"], "source:ann_date_or_pre_date")
        actual, announced = compact_date(F.col("actual_date")), compact_date(F.col("ann_date"))
        disclosed = actual.isNotNull() & (announced.isNull() | (actual > announced))
        return _stamped(
            df, F.when(disclosed, at_clock(actual, catalog.EVENT_CLOCK)).otherwise(stamp),
            F.when(disclosed, F.lit("source:actual_date")).otherwise(rule),
        )
    return _stamped(df, F.lit(None).cast("timestamp_ntz"), F.lit("unsupported_dataset"))


def latest_statements(stamped: DataFrame) -> DataFrame:
    """Latest announcement per (code, period) of stamped statements."""
    known = stamped.where(F.col("available_at").isNotNull())
    return known.groupBy("ts_code", "end_date").agg(F.max("available_at").alias("latest_statement_at"))


def join_latest_statement(df: DataFrame, statements: DataFrame) -> DataFrame:
    """Attach ``latest_statement_at`` by (code, period)."""
    return df.join(latest_statements(statements), ["ts_code", "end_date"], "left")


def split_schedule(df: DataFrame) -> DataFrame:
    """A schedule disclosed later becomes two versions: as announced, as realised."""
    announced, actual = compact_date(F.col("ann_date")), compact_date(F.col("actual_date"))
    versions = F.when(announced.isNotNull() & (actual > announced), F.array(F.lit(None).cast("string"), F.col("actual_date"))).otherwise(
        F.array(F.col("actual_date"))
    )
    return df.withColumn("actual_date", F.explode(versions))


def business_key(dataset: str, keys: Sequence[str]) -> Column:
    """Canonical JSON identity of a row: dataset and sorted key values as text."""
    values = F.struct(*[F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")).alias(key) for key in sorted(set(keys))])
    return F.to_json(F.struct(F.lit(dataset).alias("dataset"), values.alias("values")))


def normalise_columns(df: DataFrame, declared: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Map columns case-insensitively onto the declared names, drop the rest."""
    served: dict[str, str] = {}
    for name in df.columns:
        served.setdefault(name.lower(), name)
    missing = [name for name in required if name.lower() not in served]
    if missing:
        raise ValueError(f"table lacks {missing}; got {sorted(df.columns)}")
    return df.select(*[F.col(f"`{served[name.lower()]}`").alias(name) for name in declared if name.lower() in served])


def apply_close_contracts(union: DataFrame, spark, contracts: dict[str, Clock] | None = None) -> DataFrame:
    """Re-stamp the union's same-day macro rows at their close contract.

    The contracts are a fixed list of about twenty rows, joined as a broadcast.
    """
    chosen = contracts or catalog.MACRO_CONTRACTS
    rules = spark.createDataFrame(
        [(name, c.key, c.clock, c.offset, c.label) for name, c in chosen.items()],
        "dataset string, _key string, _clock string, _lag int, _rule string",
    )
    joined = union.join(F.broadcast(rules), "dataset", "left")
    present = sorted({c.key for c in chosen.values()} & set(union.columns))
    day = F.coalesce(*[F.when(F.col("_key") == key, compact_date(F.col(key))) for key in present])
    hours, minutes = (F.split("_clock", ":")[part].cast("int") for part in (0, 1))
    closing = day.cast("timestamp_ntz") + F.make_dt_interval(F.col("_lag"), hours, minutes)
    ruled = F.col("_rule").isNotNull()
    return _stamped(
        joined, F.when(ruled, closing).otherwise(F.col("available_at")),
        F.when(ruled, F.col("_rule")).otherwise(F.col("available_at_rule")),
    ).drop("_key", "_clock", "_lag", "_rule")


def restamp(df: DataFrame, stamp, partition: str) -> tuple[DataFrame, DataFrame]:
    """Recompute stamps; returns the re-stamped rows and rows moved per partition."""
    held = df.withColumns({"_old_at": F.col("available_at"), "_old_rule": F.col("available_at_rule")})
    fresh = stamp(held.drop("available_at", "available_at_rule"))
    moved = ~(F.col("_old_at").eqNullSafe(F.col("available_at")) & F.col("_old_rule").eqNullSafe(F.col("available_at_rule")))
    report = fresh.groupBy(partition).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(moved.cast("long")).alias("moved")
    )
    changed = report.where("moved > 0").select(partition)
    return fresh.drop("_old_at", "_old_rule").join(changed, partition, "left_semi"), report
