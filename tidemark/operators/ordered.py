"""Ordered work over groups of any size.

``Window.partitionBy(key).orderBy(...)`` puts a whole group into one task. Where
a group is bounded by what it is (the names of one day, the bars of one
stock-day) that is the right plan, and the functions named after the day use
it. Everything else takes one path, whatever the size: rows are laid out in
range partitions by key and order, windows run inside a task's run of a key, and
one small row per run carries the totals of the runs before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import ordered_runs


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``sum``, ``max`` or ``last`` (non-null)."""

    kind: str
    column: str
    exclusive: bool = False


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The row with the smallest ``order`` per key, as a combinable aggregate."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The row with the largest ``order`` per key, as a combinable aggregate."""
    return _keep(df, keys, order, F.max_by)


def _keep(df: DataFrame, keys: Sequence[str], order, pick) -> DataFrame:
    rest = [name for name in df.columns if name not in keys]
    order_cols = [F.col(item) if isinstance(item, str) else item for item in order]
    row = F.struct(*[F.col(name) for name in rest]) if rest else F.struct(F.lit(1).alias("one"))
    kept = df.groupBy(*keys).agg(pick(row, F.struct(*order_cols)).alias("_row"))
    return kept.select(*[F.col(f"_row.{name}").alias(name) if name in rest else F.col(name) for name in df.columns])


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in range partitions by key and order, once for any number of :func:`along` calls."""
    return ordered_runs(df, list(keys), [F.col(name).asc() for name in order])


def along(laid: DataFrame, keys: Sequence[str], values: dict[str, Running], *, backwards: bool | Sequence[str] = False) -> DataFrame:
    """Add running values along the order of a layout; the layout's own columns stay.

    ``backwards`` holds for all values or names those that run from the end; both
    directions share one exchange. Carried totals go only to keys that span
    several tasks. A task's end cuts at most one key, so they are at most two
    rows for each task and are broadcast: the rows themselves do not move again.
    """
    run = [*keys, "_task"]
    turned = {name: backwards if isinstance(backwards, bool) else name in backwards for name in values}
    inside = laid
    for way in sorted(set(turned.values())):
        inside = windowed(inside, run, ["_at"], {name: spec for name, spec in values.items() if turned[name] == way}, way)
    totals = laid.groupBy(*run).agg(*[_run_total(spec, F.col("_at"), turned[name]).alias(f"_tot_{name}") for name, spec in values.items()])
    spread = totals.withColumn("_tasks", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_tasks > 1")

    def carry(name: str, spec: Running) -> Column:
        # A key has at most one row for each task here.
        direction = F.col("_task").desc() if turned[name] else F.col("_task").asc()
        before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
        return _fold(spec, f"_tot_{name}").over(before).alias(f"_carry_{name}")

    carried = spread.select(*run, *[carry(name, spec) for name, spec in values.items()])
    joined = null_safe_join(inside, F.broadcast(carried), run)
    for name, spec in values.items():
        joined = joined.withColumn(name, _combine(spec, F.col(name), F.col(f"_carry_{name}")))
    return joined.drop(*[f"_carry_{name}" for name in values])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Running], *, backwards: bool = False) -> DataFrame:
    """Add running values along ``order``, which must be unique inside each key."""
    return along(lay_out(df, keys, order), keys, values, backwards=backwards).drop("_task", "_at")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null, as grouping treats it."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, same, how).drop(*[f"_right_{key}" for key in keys])


def windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Running], backwards: bool = False) -> DataFrame:
    """Running values by plain windows, for keys that are bounded by what they are."""
    ordering = [F.col(name).desc() if backwards else F.col(name).asc() for name in order]
    base = Window.partitionBy(*keys).orderBy(*ordering)
    added = {}
    for name, spec in values.items():
        frame = base.rowsBetween(Window.unboundedPreceding, -1 if spec.exclusive else 0)
        added[name] = _fold(spec, spec.column).over(frame)
    return df.withColumns(added)


def _fold(spec: Running, column: str) -> Column:
    if spec.kind == "sum":
        return F.sum(column)
    if spec.kind == "max":
        return F.max(column)
    if spec.kind == "last":
        return F.last(column, ignorenulls=True)
    raise ValueError(f"unknown running kind {spec.kind!r}")


def _run_total(spec: Running, place: Column, backwards: bool) -> Column:
    if spec.kind != "last":
        return _fold(spec, spec.column)
    pick = F.min_by if backwards else F.max_by
    return pick(F.col(spec.column), F.when(F.col(spec.column).isNotNull(), place))


def _combine(spec: Running, here: Column, carry: Column) -> Column:
    if spec.kind == "sum":
        return F.when(here.isNull() & carry.isNull(), here).otherwise(
            F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        )
    if spec.kind == "max":
        return F.greatest(here, carry)
    return F.coalesce(here, carry)


def present(value: str) -> Column:
    """Neither null nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def value_positions(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with ``n_below``, ``n_equal`` and ``n_all``.

    Equal values collapse before anything is sorted, so a value shared by most
    of a group costs one row. Nulls and NaNs are left out.
    """
    counts = df.where(present(value)).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n_equal"))
    ranked = running(counts, group, [value], {"n_below": Running("sum", "n_equal", exclusive=True)})
    sizes = counts.groupBy(*group).agg(F.sum("n_equal").alias("n_all"))
    joined = null_safe_join(ranked, sizes, group, "inner") if group else ranked.join(F.broadcast(sizes))
    return joined.withColumn("n_below", F.coalesce("n_below", F.lit(0).cast("long")))


def average_rank(df: DataFrame, group: Sequence[str], value: str, name: str, *, count_name: str | None = None) -> DataFrame:
    """Add the average rank (ties share their mean) of ``value`` inside groups of any size.

    Null and NaN values get a null rank and do not count.
    """
    positions = value_positions(df, group, value).select(
        *group, value, (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias(name), *([F.col("n_all").alias(count_name)] if count_name else []))
    return null_safe_join(df, positions, [*group, value])


def quantiles(df: DataFrame, group: Sequence[str], value: str, cuts: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles of groups of any size, from running counts."""
    positions = value_positions(df, group, value)
    picked = []
    for name, cut in cuts.items():
        at = (F.col("n_all") - 1) * F.lit(cut)
        low, high = F.floor(at), F.ceil(at)
        covers = lambda spot: (F.col("n_below") <= spot) & (spot < F.col("n_below") + F.col("n_equal"))
        below = F.max(F.when(covers(low), F.col(value)))
        above = F.max(F.when(covers(high), F.col(value)))
        share = F.max(at - low)
        picked.append((below + (above - below) * share).alias(name))
    return positions.groupBy(*group).agg(*picked)


# -- cross-sections of a day: a group has one row for each listed name ------------------


def day_rank(group: Sequence[str], value: str, usable: Column | None = None) -> Column:
    """Average rank of a value among a day's names, null where it is not usable."""
    usable = present(value) if usable is None else usable
    window = Window.partitionBy(*group, usable)
    peers = window.orderBy(value).rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(usable, F.rank().over(window.orderBy(value)) + (F.count(F.lit(1)).over(peers) - 1) / 2)


def day_quantiles(df: DataFrame, group: Sequence[str], value: str, cuts: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles of a day's names."""
    return df.where(~F.isnan(F.col(value).cast("double"))).groupBy(*group).agg(*[F.percentile(value, F.lit(cut)).alias(name) for name, cut in cuts.items()])
