"""Append-only JSON-lines ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAMAGED = "_damaged"


def read_jsonl(spark: SparkSession, folder: str, schema: T.StructType, *, strict: bool = True) -> DataFrame:
    """Records of a ledger; damaged lines refuse the read, or stay marked.

    With ``strict`` off, unreadable lines keep their text in ``_damaged``.
    """
    wide = T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])
    lines = spark.read.text(folder, pathGlobFilter="*.json*")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED}
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", wide, options).alias("r")).select("r.*")
    if not strict:
        return rows
    refused = F.raise_error(F.concat(F.lit("damaged ledger line: "), F.col(DAMAGED))).cast("boolean")
    return rows.where(F.when(F.col(DAMAGED).isNotNull(), refused).otherwise(True)).drop(DAMAGED)


def damaged_lines(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Count of lines, and of lines that cannot be read."""
    rows = read_jsonl(spark, folder, schema, strict=False)
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count(DAMAGED).alias("damaged"))


def new_records(ledger: DataFrame, records: DataFrame, key: str, volatile: Sequence[str] = ()) -> DataFrame:
    """Records whose identity the ledger does not hold, one per identity.

    With ``volatile`` columns the identity is the rest of the record, so a
    record detected again under a new id is not appended twice.
    """
    def identity(df: DataFrame):
        if not volatile:
            return F.col(key).cast("string")
        stable = sorted(set(df.columns) - set(volatile))
        return F.sha2(F.to_json(F.struct(*stable)), 256)

    fresh = records.withColumn("_id", identity(records)).dropDuplicates(["_id"])
    held = ledger.select(identity(ledger).alias("_id")).distinct()
    return fresh.join(held, "_id", "left_anti").drop("_id")


def append_unique(folder: str, ledger: DataFrame, records: DataFrame, key: str, volatile: Sequence[str] = ()) -> None:
    """Append the records a ledger does not hold yet."""
    new_records(ledger, records, key, volatile).write.mode("append").json(folder)
