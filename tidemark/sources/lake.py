"""Lake datasets: one folder per dataset, partition names in file names or folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import TARGET_BYTES, files_of, spread

PARTITION = "partition_value"


def partition_value(path: Column, key: str | None = None) -> Column:
    """Value of the last ``key=value`` in a file's path, '' when there is none."""
    name = key if key else r"[A-Za-z_]+"
    return F.regexp_extract(path, rf".*(?:^|/){name}=([^/]+?)(?:\.parquet)?(?:/[^=]*)?$", 1)


def read_dataset(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All files of a dataset with the value in their name as a column.

    The partition lives in the file's path (``key=value.parquet`` or a
    ``key=value`` folder), so a filter on it is a filter on file metadata.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    df = (reader.schema(schema) if schema else reader).parquet(folder)
    return df.withColumn(PARTITION, partition_value(F.col("_metadata.file_path")))


def read_hive(spark: SparkSession, folder: str, key: str, start: str, end: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``key=value`` folders in a range, pruned at planning time."""
    df = spark.read.option("basePath", folder).parquet(folder)
    value = F.col(key).cast("string")
    kept = df.where(value.between(start, end)) if start <= end else df.where(F.lit(False))
    return kept.select(*columns) if columns else kept


def read_range(
    spark: SparkSession, folder: str, start: str, end: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Rows of partitions in ``[start, end]``; a reversed range is empty with schema."""
    df = read_dataset(spark, folder, schema)
    kept = df.where(F.col(PARTITION).between(start, end)) if start <= end else df.where(F.lit(False))
    return kept.select(*columns) if columns else kept


def overlaps(stem: Column, start: str, end: str) -> Column:
    """Whether a ``key=value`` partition name may hold rows of a day window.

    Day, month and year names are compared at their own precision; any other
    layout is read whole.
    """
    key, value = F.regexp_extract(stem, r"^([^=]+)=(.*)$", 1), F.regexp_extract(stem, r"^([^=]+)=(.*)$", 2)
    out = F.lit(True)
    for names, width in ((("trade_date", "date", "ann_date"), 8), (("month", "ann_month"), 6), (("year",), 4)):
        known = key.isin(*names) & value.rlike(rf"^\d{{{width}}}$")
        out = F.when(known, value.between(start[:width], end[:width])).otherwise(out)
    return out


def read_window(spark: SparkSession, folder: str, start: str, end: str, schema: T.StructType | None = None) -> DataFrame:
    """Partitions whose name overlaps the window ``YYYYMMDD..YYYYMMDD``."""
    df = read_dataset(spark, folder, schema)
    path = F.col("_metadata.file_path")
    named = F.regexp_extract(path, r".*(?:^|/)([A-Za-z_]+=[^/]+?)(?:\.parquet)?(?:/[^=]*)?$", 1)
    return df.where(overlaps(named, start, end))


def read_sources(spark: SparkSession, folder: str, sources: Sequence[str], months: tuple[str, str] | None = None) -> DataFrame:
    """Selected ``src=`` sub-trees with a ``src`` column; a missing one fails."""
    parts = [read_dataset(spark, f"{folder}/src={name}").withColumn("src", F.lit(name)) for name in sources]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.where(F.substring(PARTITION, 1, 6).between(*months)) if months else out


def union_datasets(frames: dict[str, DataFrame]) -> DataFrame:
    """Outer-column union of named tables with a leading ``dataset`` column."""
    out = None
    for name, frame in frames.items():
        labelled = frame.select(F.lit(name).alias("dataset"), *[F.col(c) for c in frame.columns if c != "dataset"])
        out = labelled if out is None else out.unionByName(labelled, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to union")
    return out


def stable_type(declared: T.DataType) -> T.DataType:
    """Padding type of a column no row carries: numbers are doubles."""
    if isinstance(declared, T.BooleanType):
        return T.BooleanType()
    if isinstance(declared, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def pad_union(df: DataFrame, schemas: Sequence[T.StructType]) -> DataFrame:
    """Add columns only empty tables declare, all null, in stable types."""
    wanted: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema.fields:
            wanted.setdefault(field.name, stable_type(field.dataType))
    added = {name: F.lit(None).cast(kind) for name, kind in wanted.items() if name not in df.columns}
    return df.withColumns(added) if added else df


def repartition_by_date(df: DataFrame, folder: str, *, key: str = "trade_date", order: Sequence[str] = ("ts_code", "trade_time"), target_bytes: int = TARGET_BYTES) -> None:
    """Re-write code-major bars date-major.

    A date takes as many files as its measured size needs, dealt by code, so a
    heavy day is several tasks; rows inside a file are sorted for row-group
    pruning.
    """
    dealt = spread(df, files_of(df, [key], target_bytes), [key], order[0])
    dealt.sortWithinPartitions(key, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
