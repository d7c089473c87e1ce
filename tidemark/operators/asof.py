"""Point-in-time visibility: which rows a decision may see."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions.times import ceil_second
from .ordered import Running, running, windowed


def visible_from(available: Column, first_seen: Column | None = None) -> Column:
    """The later of publication and first receipt; null stamps stay hidden."""
    if first_seen is None:
        return available
    return F.when(first_seen > available, first_seen).otherwise(available)


def visible_window(
    df: DataFrame, start: Column, when: Column, *, first_seen: str | None = None, forward: str | None = None
) -> DataFrame:
    """Rows public by ``when`` that fell into the window.

    ``forward`` names a date column that also keeps a row whose event has not
    yet left the window, however early it was announced.
    """
    visible = visible_from(F.col("available_at"), F.col(first_seen) if first_seen else None)
    inside = visible >= start
    if forward:
        inside = inside | F.coalesce(F.col(forward) >= F.to_date(start), F.lit(False))
    return df.where((visible <= when) & inside)


def hidden_counts(df: DataFrame, group: str = "dataset") -> DataFrame:
    """Rows per dataset and how many carry no readable stamp."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("available_at").isNull()).alias("unreadable")
    )


def window_start(when: Column, months: int) -> Column:
    """Calendar months before an instant, clock kept."""
    return (when.cast("timestamp_ntz") - F.make_ym_interval(months=F.lit(months))).cast("timestamp_ntz")


def window_floor(dataset: Column, start: Column, registries: Sequence[str]) -> Column:
    """Registry tables live as long as their instruments: a fixed old floor."""
    return F.when(dataset.isin(*registries), F.lit(catalog.REGISTRY_FLOOR).cast("timestamp_ntz")).otherwise(start)


def attach_first_seen(df: DataFrame, observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the first receipt of each key where it is later than the stamp."""
    seen = observations.groupBy(*keys).agg(F.min("seen_at").alias("_seen"))
    joined = df.join(seen, list(keys), "left")
    rounded = ceil_second(F.col("_seen"))
    return joined.withColumn("first_seen_at", F.when(rounded > F.col("available_at"), rounded)).drop("_seen")


# -- refresh jobs -----------------------------------------------------------


def node_instances(spark: SparkSession, start: str, end: str, nodes: Sequence[catalog.RefreshNode] = catalog.NODES) -> DataFrame:
    """One row per job instance; days x jobs, so always small."""
    declared = spark.createDataFrame(
        [(n.name, n.start, n.minutes, list(n.weekdays)) for n in nodes],
        "node string, clock string, minutes int, weekdays array<int>",
    )
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    every = declared.withColumn("day", days)
    active = every.where((F.size("weekdays") == 0) | F.array_contains("weekdays", F.weekday("day") + 1))
    hour, minute = (F.split("clock", ":")[part].cast("int") for part in (0, 1))
    begin = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=minute)
    return active.select("node", "day", begin.alias("start"), (begin + F.make_dt_interval(mins=F.col("minutes"))).alias("ready"))


def dataset_nodes(spark: SparkSession) -> DataFrame:
    """Declared exceptions as rows; the domain default covers everything else."""
    rows = [(domain, dataset, list(names)) for (domain, dataset), names in catalog.DATASET_NODES.items()]
    return spark.createDataFrame(rows, "domain string, dataset string, nodes array<string>")


def assign_nodes(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Add ``nodes``: the jobs whose instances release a row of (domain, dataset)."""
    special = dataset_nodes(spark).withColumnRenamed("nodes", "_special")
    default = F.lit(None).cast("array<string>")
    for domain, names in catalog.DOMAIN_NODES.items():
        listed = F.array(*[F.lit(name) for name in names]).cast("array<string>")
        default = F.when(F.col("domain") == domain, listed).otherwise(default)
    evening = F.array(F.lit(catalog.EVENING))
    joined = df.join(F.broadcast(special), ["domain", "dataset"], "left")
    return joined.withColumn("nodes", F.coalesce("_special", default, evening)).drop("_special")


def visible_cutoff(assigned: DataFrame, instances: DataFrame, when: Column, lookback_days: int | None = None) -> DataFrame:
    """Start of the newest finished instance per assigned dataset, however old; ``lookback_days`` leaves out older ones."""
    finished = instances.where(F.col("ready") <= when)
    if lookback_days is not None:
        finished = finished.where(F.col("day") > F.date_sub(F.to_date(when), lookback_days))
    exploded = assigned.select("domain", "dataset", F.explode_outer("nodes").alias("node"))
    return exploded.join(F.broadcast(finished), "node", "left").groupBy("domain", "dataset").agg(F.max("start").alias("cutoff"))


def next_boundary(assigned: DataFrame, instances: DataFrame, when: Column) -> DataFrame:
    """Earliest instance that becomes ready strictly after ``when``."""
    ahead = instances.where(F.col("ready") > when)
    exploded = assigned.select("domain", "dataset", F.explode_outer("nodes").alias("node"))
    return exploded.join(F.broadcast(ahead), "node", "left").groupBy("domain", "dataset").agg(F.min("ready").alias("boundary"))


def release_table(instances: DataFrame, sets: Sequence[Sequence[str]], start: str, end: str) -> DataFrame:
    """Per job set and day, the day's instances and the next release after it.

    One row per (set, calendar day): an as-of lookup of any number of rows
    becomes an equi-join on the day with this table.
    """
    spark = instances.sparkSession
    members = spark.createDataFrame([("|".join(names), name) for names in sets for name in names], "_set string, node string")
    per_day = instances.join(F.broadcast(members), "node").groupBy("_set", "day").agg(
        F.collect_list(F.struct("start", "ready")).alias("runs"), F.min("ready").alias("_first_ready")
    )
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    grid = members.select("_set").distinct().select("_set", days)
    later = Window.partitionBy("_set").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return grid.join(per_day, ["_set", "day"], "left").select("_set", "day", "runs", F.min("_first_ready").over(later).alias("next_ready"))


def visible_at(
    df: DataFrame, spark: SparkSession, start: str, end: str, *, first_seen: str | None = None, horizon_days: int = 15
) -> DataFrame:
    """Add ``visible_at``: the first release covering the row's stamp.

    Rows carry ``nodes`` from :func:`assign_nodes`; a row without nodes is
    visible at its stamp. ``start``/``end`` bound the stamps. The broadcast
    side has one row per declared job set and calendar day, whatever the data.
    """
    until = (date.fromisoformat(end) + timedelta(days=horizon_days)).isoformat()
    declared = list(catalog.DATASET_NODES.values()) + list(catalog.DOMAIN_NODES.values())
    sets = sorted({tuple(names) for names in declared if names})
    table = release_table(node_instances(spark, start, until), sets, start, until).withColumnRenamed("day", "_day")
    stamped = df.withColumns({"_set": F.array_join("nodes", "|"), "_day": F.to_date("available_at")})
    joined = stamped.join(F.broadcast(table), ["_set", "_day"], "left")
    same_day = F.array_min(
        F.transform(F.filter("runs", lambda run: run["start"] >= F.col("available_at")), lambda run: run["ready"])
    )
    released = F.least(same_day, F.col("next_ready"))
    outside = (F.size("nodes") > 0) & F.col("available_at").isNotNull() & released.isNull()
    guarded = F.when(outside, F.raise_error(F.lit(f"stamp outside {start}..{end}")).cast("timestamp_ntz")).otherwise(released)
    base = F.when(F.size("nodes") == 0, F.col("available_at")).otherwise(guarded)
    seen = F.col(first_seen) if first_seen else F.lit(None).cast("timestamp_ntz")
    return joined.withColumn("visible_at", visible_from(base, seen)).drop("_set", "_day", "runs", "next_ready")


# -- views ------------------------------------------------------------------


def asof_view(df: DataFrame, when: Column, gates: Sequence[str] = ("available_at", "first_seen_at", "visible_at")) -> DataFrame:
    """Everything visible at ``when`` without the gating columns."""
    return df.where(F.col("visible_at") <= when).drop(*gates)


def asof_delta(df: DataFrame, after: Column, until: Column) -> DataFrame:
    """Rows that became visible in ``(after, until]``."""
    return df.where((F.col("visible_at") > after) & (F.col("visible_at") <= until))


def latest_vintage(df: DataFrame, when: Column, vintage: str = "vintage") -> DataFrame:
    """A table restated whole per vintage: only the newest one by ``when``."""
    newest = df.where(F.col(vintage) <= when).agg(F.max(vintage).alias(vintage))
    return df.join(F.broadcast(newest), vintage, "left_semi")


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, take: Sequence[str],
    *, strict: bool = False, prefix: str = "", bounded: bool = False,
) -> DataFrame:
    """Latest right row at or before (``strict``: before) each left row.

    Both sides are stacked and one running value carries the right payload
    along time, so no pair of rows is ever formed and hot keys split. With
    ``bounded`` (keys hold no more than the days of a calendar) it is a plain
    window. Right rows sharing a key and an instant collapse to the largest payload.
    """
    payload = F.struct(*[F.col(name) for name in take])
    single = right.groupBy(*keys, F.col(right_on).alias("_time")).agg(F.max(payload).alias("_right"))
    whole = F.struct(*[F.col(name) for name in left.columns])
    queries = left.select(*keys, F.col(left_on).alias("_time"), F.lit(0 if strict else 2).alias("_side"), whole.alias("_left"))
    stacked = queries.unionByName(single.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    found = {"_found": Running("last", "_right")}
    done = windowed(stacked, keys, ["_time", "_side"], found) if bounded else running(stacked, keys, ["_time", "_side"], found)
    kept = done.where(F.col("_left").isNotNull())
    return kept.select("_left.*", *[F.col(f"_found.{name}").alias(f"{prefix}{name}") for name in take])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def missing_months(have: DataFrame, start: str, end: str, group: str = "dataset", month: str = "available_month") -> DataFrame:
    """Months of the window a dataset never built."""
    spark = have.sparkSession
    tiles = spark.range(1).select(
        F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("_m")
    ).select(F.date_format("_m", "yyyyMM").alias(month))
    groups = have.select(group).distinct()
    wanted = groups.withColumn("_one", F.lit(1)).join(F.broadcast(tiles.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return wanted.join(have.select(group, month).distinct(), [group, month], "left_anti")


def drop_excluded(df: DataFrame, dataset: str, excluded: dict[str, Sequence[str]]) -> DataFrame:
    """Drop a dataset's leaking or unusable columns; other datasets keep theirs."""
    return df.drop(*excluded.get(dataset, ()))


def minutes_window(minutes: DataFrame, days: int, when: Column) -> DataFrame:
    """Bars of the last ``days`` visible trading days, by bar close."""
    seen = minutes.where(F.col("available_at") <= when)
    chosen = seen.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(days)
    return seen.join(F.broadcast(chosen), "trade_date", "left_semi").drop("available_at", "available_at_rule")


def at(text: str) -> Column:
    """A decision instant as a literal."""
    datetime.fromisoformat(text)
    return F.lit(text).cast("timestamp_ntz")
