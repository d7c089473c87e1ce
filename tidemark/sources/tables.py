"""Table loading; every read is a lazy, prunable parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; instants become zone-free wall-clock stamps."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    stamps = [field.name for field in df.schema.fields if field.dataType.typeName() == "timestamp"]
    for column in stamps:
        df = df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    return df
