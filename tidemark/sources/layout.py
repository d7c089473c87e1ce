"""How many files a partition needs, from its measured size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20


def row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row before encoding: texts by their length, anything else by eight."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8).cast("long") for f in schema.fields]
    return reduce(lambda a, b: a + b, sizes)


def files_of(df: DataFrame, keys: Sequence[str], target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``keys, rows, files``: one combinable aggregate, a row for each partition."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df.schema)).alias("_bytes"))
    return sums.select(*keys, "rows", F.greatest(F.lit(1), F.ceil(F.col("_bytes") / target_bytes)).alias("files"))


def spread(df: DataFrame, sizes: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The rows dealt by ``by`` over as many tasks as their partition has files: a hot partition is several tasks and files."""
    dealt = df.join(sizes.select(*keys, "files"), list(keys)).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("files")))
    return dealt.repartition(*keys, "_salt").drop("files", "_salt")
