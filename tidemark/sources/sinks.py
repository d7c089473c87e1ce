"""Writers: missing-partition builds, exports, view manifests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

# Columns of the orders export.
ORDER_COLUMNS = (
    "symbol", "action", "quantity", "execute_at", "matched_at", "status", "price", "commission", "stamp_duty", "dividend_tax", "realized_pnl", "reason",
)


def missing_partitions(source: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Partition values the target has not committed."""
    wanted = source.select(key).distinct()
    return wanted if done is None else wanted.join(done.select(key).distinct(), key, "left_anti")


def held_partitions(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """Partition values already written, or None before the first build."""
    try:
        return spark.read.parquet(folder).select(F.col(key).cast("string").alias(key)).distinct()
    except Exception as error:  # the target does not exist before its first build
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def build_missing(source: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame], key: str = "trade_date") -> DataFrame:
    """Derive only partitions not yet in ``folder``; returns rows per built partition.

    A non-empty source partition that derives nothing is an error, found before
    anything is written: published, it would read as "no data" ever after. Only the partitions being built are
    overwritten, so a repeated run after a failure is safe.
    """
    spark = source.sparkSession
    # Fixed before the write: a later read of the folder must not stand in for it.
    todo = materialise(missing_partitions(source, held_partitions(spark, folder, key), key))
    derived = materialise(build(source.join(todo, key, "left_semi")))
    built = derived.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("rows"))
    lacking = todo.select(F.col(key).cast("string").alias(key)).join(built, key, "left_anti")
    missing = lacking.count()
    if missing:
        named = [row[0] for row in lacking.orderBy(key).limit(20).collect()]
        raise ValueError(f"{missing} source partitions produced no rows, among them {named}")
    derived.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
    return built


def export_orders(df: DataFrame, folder: str, columns: Sequence[str] = ORDER_COLUMNS) -> None:
    """All orders as CSV with a fixed header; absent columns are blank."""
    cells = [F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name) for name in columns]
    df.select(*cells).write.mode("overwrite").option("header", "true").csv(folder)


def manifest(domains: dict[str, DataFrame], kind: str, decision_time: str, windows: dict[str, str], day: dict[str, str]) -> DataFrame:
    """One row per domain of a view: window, rows, coverage, datasets."""
    out = None
    for name, df in domains.items():
        column = day[name]
        datasets = F.array_join(F.array_sort(F.collect_set("dataset")), ",") if "dataset" in df.columns else F.lit(name)
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.min(column).cast("string").alias("coverage_start"), F.max(column).cast("string").alias("coverage_end"), datasets.alias("datasets"))
        row = row.select(F.lit(kind).alias("kind"), F.lit(decision_time).alias("decision_time"), F.lit(name).alias("domain"), F.lit(windows.get(name)).alias("window_start"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def write_manifest(rows: DataFrame, folder: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(folder)
