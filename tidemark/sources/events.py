"""Monthly event store: partition-pruned as-of reads and guarded month writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import visible_from
from ..operators.ordered import keep_last
from ..session import discard, materialise
from .layout import TARGET_BYTES, files_of, spread

MONTH = "available_month"


def read_asof(store: DataFrame, when: Column, first_month: str | None = None, *, first_seen: str | None = None) -> DataFrame:
    """Rows published (``first_seen``: and received) by ``when``.

    The month predicate is a partition filter; the clock settles the last month.
    """
    months = F.col(MONTH) <= F.date_format(when, "yyyyMM")
    if first_month:
        months = months & (F.col(MONTH) >= first_month)
    visible = visible_from(F.col("available_at"), F.col(first_seen) if first_seen else None)
    return store.where(months).where(visible <= when)


def dedupe_events(events: DataFrame, order: Sequence[str] = ("version_rank", "source_row_id")) -> DataFrame:
    """Last version of each (dataset, business key, stamp)."""
    return keep_last(events, ["dataset", "business_key", "available_at"], *order)


def write_event_months(events: DataFrame, folder: str, months: Sequence[str], datasets: Sequence[str], *, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Replace whole months of each dataset; returns the per-month manifest (``rows, files``).

    The input is evaluated once, into a stored table that the guard, the sizes
    and the write all read. Refuses to replace held rows by nothing. Months
    without rows are zero-row markers in the manifest, so a month that was never
    built shows. A month takes as many files as its measured size needs.
    """
    spark: SparkSession = events.sparkSession
    key = ["dataset", MONTH]
    fresh = materialise(dedupe_events(events.where(F.col(MONTH).isin(*months) & F.col("dataset").isin(*datasets))))
    wanted = spark.createDataFrame([(d, m) for d in datasets for m in months], f"dataset string, {MONTH} string")
    sizes = materialise(files_of(fresh, key, target_bytes))
    manifest = wanted.join(sizes, key, "left").na.fill(0, ["rows", "files"])
    try:
        held = spark.read.parquet(folder).where(F.col(MONTH).isin(*months)).groupBy("dataset", F.col(MONTH).cast("string").alias(MONTH)).count()
    except Exception as error:  # first write: the store does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        held = None
    if held is not None:
        emptied = manifest.where("rows = 0").join(held.where("count > 0"), key, "left_semi").orderBy(*key)
        total = emptied.count()
        if total:
            raise ValueError(f"refusing to replace held rows of {total} months by nothing, the first: {[tuple(row)[:2] for row in emptied.limit(20).collect()]}")
    dealt = spread(fresh, sizes, key, "business_key").sortWithinPartitions("available_at", "ts_code", "business_key")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(folder)
    discard(fresh)
    return manifest
