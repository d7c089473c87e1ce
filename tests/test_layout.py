"""Files from measured sizes, and a month's rows evaluated once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_folder
from tidemark.sources.events import write_event_months
from tidemark.sources.lake import repartition_by_date


def events(spark, hot, cold=5):
    rows = spark.range(hot + cold).select(
        F.lit("d").alias("dataset"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("ts_code"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("business_key"),
        F.lit("2024-01-01").alias("available_at"), F.when(F.col("id") < hot, "202401").otherwise("202402").alias("available_month"), F.lit(0).alias("version_rank"), F.col("id").alias("source_row_id"))
    return rows


def test_a_hot_month_is_several_files(spark, many_tasks):
    folder = scratch_folder(spark, "months")
    manifest = {r["available_month"]: (r["rows"], r["files"]) for r in write_event_months(events(spark, 3000), folder, ["202401", "202402", "202403"], ["d"], target_bytes=20_000).collect()}
    assert manifest["202402"] == (5, 1) and manifest["202403"] == (0, 0) and manifest["202401"][0] == 3000 and manifest["202401"][1] > 5
    back = spark.read.parquet(folder)
    assert back.count() == 3005
    assert back.where("available_month = 202401").select(F.input_file_name()).distinct().count() > 2


def test_held_rows_are_not_replaced_by_nothing(spark):
    folder = scratch_folder(spark, "months")
    write_event_months(events(spark, 10), folder, ["202401", "202402"], ["d"])
    with pytest.raises(ValueError, match="of 1 months by nothing"):
        write_event_months(events(spark, 0), folder, ["202401", "202402"], ["d"])
    assert spark.read.parquet(folder).count() == 15


def test_a_hot_day_is_several_files(spark, many_tasks):
    bars = spark.range(4000).select(F.when(F.col("id") < 3900, "20240102").otherwise("20240103").alias("trade_date"), F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("ts_code"), F.col("id").alias("trade_time"))
    folder = scratch_folder(spark, "days")
    repartition_by_date(bars, folder, target_bytes=10_000)
    back = spark.read.parquet(folder)
    files = {r[0]: r[1] for r in back.select("trade_date", F.input_file_name().alias("file")).distinct().groupBy("trade_date").count().collect()}
    assert back.count() == 4000 and files[20240103] == 1 and files[20240102] > 2
