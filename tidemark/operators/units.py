"""Unit registry: what every column means, and source-to-normalised factors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UnitRule:
    """Meaning of columns (names or ``*?`` globs) of one (file, dataset)."""

    file: str
    dataset: str | None
    columns: tuple[str, ...]
    semantic: str = "numeric"
    source_unit: str | None = None
    factor: float | None = None
    unit: str | None = None
    status: str = "official"


# Daily table units and their factors.
DAILY_RULES = (
    UnitRule("daily", None, ("open", "high", "low", "close", "pre_close", "up_limit", "down_limit"), source_unit="CNY_per_share"),
    UnitRule("daily", None, ("vol",), source_unit="hands", factor=100.0, unit="shares"),
    UnitRule("daily", None, ("amount",), source_unit="thousand_CNY", factor=1000.0, unit="CNY"),
    UnitRule("daily", None, ("pct_chg", "turnover_rate"), source_unit="percent", factor=0.01, unit="decimal"),
    UnitRule("daily", None, ("total_share", "float_share"), source_unit="10k_shares", factor=10_000.0, unit="shares"),
    UnitRule("daily", None, ("total_mv", "circ_mv"), source_unit="10k_CNY", factor=10_000.0, unit="CNY"),
    UnitRule("daily", None, ("pe", "pb"), source_unit="multiple"),
    UnitRule("daily", None, ("adj_factor",), source_unit="dimensionless_ratio"),
    UnitRule("daily", None, ("is_suspended",), semantic="categorical"),
)
# Columns that mean the same everywhere; first match wins.
COMMON = (
    ("available_at_rule", "categorical"), ("available_at", "datetime"), ("first_seen_at", "datetime"),
    ("dataset", "categorical"), ("ts_code", "identifier"), ("*_date", "datetime"), ("name", "text"),
)


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored regular expression."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(ch, ch if ch.isalnum() or ch == "_" else "\\" + ch) for ch in glob) + "$"


def normalise_units(df: DataFrame, rules: Sequence[UnitRule] = DAILY_RULES) -> tuple[DataFrame, list[dict]]:
    """Multiply registered columns by their factor; reports what was applied."""
    applied, changed = [], {}
    for rule in rules:
        for name in rule.columns if rule.factor is not None else ():
            if name in df.columns:
                changed[name] = F.col(name).cast("double") * F.lit(rule.factor)
                applied.append({"column": name, "factor": rule.factor, "rule": f"{rule.source_unit}->{rule.unit}"})
    return (df.withColumns(changed) if changed else df), applied


def rule_table(spark: SparkSession, rules: Sequence[UnitRule]) -> DataFrame:
    rows = []
    for rule in rules:
        for name in rule.columns:
            tier = 3 if name == "*" else 1
            rows.append((rule.file, rule.dataset, name, glob_pattern(name), tier, 0, rule.semantic, rule.source_unit, rule.factor, rule.unit, rule.status))
    for position, (glob, semantic) in enumerate(COMMON):
        rows.append((None, None, glob, glob_pattern(glob), 2, position, semantic, None, None, None, "official"))
    return spark.createDataFrame(
        rows, "file string, dataset string, glob string, pattern string, tier int, position int, semantic string, "
        "source_unit string, factor double, unit string, status string",
    )


def match_columns(inventory: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of each (file, dataset, column), with unresolved and overlap flags.

    A dataset's own rules beat the common names, which beat its default. The
    rule table is a fixed list, and an inventory has one row per column.
    """
    left, right = inventory.alias("i"), F.broadcast(rules.alias("r"))
    own = F.col("r.file").isNull() | (
        (F.col("i.file") == F.col("r.file")) & F.col("i.dataset").eqNullSafe(F.col("r.dataset"))
    )
    hits = left.join(right, own & F.expr("i.column rlike r.pattern"), "left")
    order = F.struct("r.tier", "r.position", "r.glob")
    payload = F.struct("r.tier", "r.semantic", "r.source_unit", "r.factor", "r.unit", "r.status")
    best = hits.groupBy("i.file", "i.dataset", "i.column", "i.filled").agg(
        F.min_by(payload, order).alias("best"), F.count_if(F.col("r.tier") == 1).alias("explicit")
    )
    return best.select(
        "file", "dataset", "column", "filled", "best.semantic", "best.source_unit", "best.factor", "best.unit",
        F.when(F.col("best.tier").isNull(), "unresolved").when(F.col("explicit") > 1, "overlap").otherwise(F.col("best.status")).alias("status"),
    )


def resolve_columns(inventory: DataFrame, rules: Sequence[UnitRule]) -> DataFrame:
    """As :func:`match_columns`, failing on any unresolved or doubly ruled column."""
    matched = match_columns(inventory, rule_table(inventory.sparkSession, rules))
    bad = matched.where(F.col("status").isin("unresolved", "overlap")).select("file", "dataset", "column", "status").limit(50).collect()
    if bad:
        raise ValueError("unit registry: " + "; ".join(str(tuple(row)) for row in bad))
    return matched


def column_inventory(frames: dict[tuple[str, str | None], DataFrame]) -> DataFrame:
    """Physical columns of named tables with how many rows fill each, one scan per table."""
    out = None
    for (file, dataset), df in frames.items():
        counts = df.agg(*[F.count(name).alias(name) for name in df.columns])
        rows = F.explode(F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("filled")) for name in df.columns])).alias("r")
        part = counts.select(F.lit(file).alias("file"), F.lit(dataset).cast("string").alias("dataset"), rows).select("file", "dataset", "r.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables to list")
    return out


def reconcile_columns(physical: DataFrame, declared: DataFrame) -> DataFrame:
    """Columns no dataset declares, and declared columns the file lacks."""
    held = declared.select("file", "column").distinct()
    extra = physical.join(held, ["file", "column"], "left_anti").select("file", "column", "filled", F.lit("unattributed").alias("problem"))
    lost = declared.join(physical.select("file", "column").distinct(), ["file", "column"], "left_anti")
    return extra.unionByName(lost.select("file", "column", F.lit(0).cast("long").alias("filled"), F.lit("undeclared_in_file").alias("problem")).distinct())


def literal_rules(rules: Sequence[UnitRule]) -> Column:
    return F.array(*[F.lit(name) for rule in rules for name in rule.columns])
