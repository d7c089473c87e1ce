"""Every draw has a digest of its own."""

from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, pools
from tidemark.operators.screen import date_index


def number(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_every_block_of_every_resample_starts_by_its_own_digest(spark):
    values = np.random.default_rng(4).normal(0.0, 0.01, 50)
    df = spark.createDataFrame([("r", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "run_id string, trade_date date, value double")
    points = inference.prefix_sums(df, ["run_id"]).withColumn("days", F.array(F.col("days").cast("long")))
    got = {row.draw: row.estimate for row in inference.bootstrap_draws(points, ["run_id"], F.col("run_id"), 300).collect()}
    starts = [[number("r", draw, blk) % 31 for blk in range(3)] for draw in range(300)]
    want = [np.concatenate([values[s:s + n] for s, n in zip(row, (20, 20, 10))]).mean() for row in starts]
    assert [got[draw] for draw in range(300)] == pytest.approx(want, abs=1e-12)


def test_every_pick_is_its_own_digest(spark):
    day = dt.date(2024, 1, 2)
    daily = spark.createDataFrame([(day, f"60000{i}.SH", 10.0 + i, 0) for i in range(7)], "trade_date date, ts_code string, open double, bucket int")
    trips = spark.createDataFrame([(day, "600001.SH", None, 0, 1600.0, 1), (day, "600006.SH", day, 0, 1450.0, 2)], "entry_day date, ts_code string, exit_day date, bucket int, notional double, o long")
    days = date_index(daily)
    drawn = pools.draw_names(trips, pools.candidates(daily, days, "bucket"), days, "bucket", 101, 7, ["entry_day", "ts_code", "o"])
    got = {(row.o, row.draw): (row.drawn_code, row.drawn_quantity) for row in drawn.collect()}
    want = {}
    for o, own, money, size in ((1, "600001.SH", 1600.0, 7), (2, "600006.SH", 1450.0, 5)):
        pool = [f"60000{i}.SH" for i in range(size) if f"60000{i}.SH" != own]
        for n in range(101):
            code = pool[number(7, n, day, own, o, 1) % len(pool)]
            want[o, n] = code, money // (10 + int(code[5])) // 100 * 100
    assert got == want
