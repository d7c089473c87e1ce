"""Pools chosen inside tasks agree with pools listed by exit day."""

from __future__ import annotations

import datetime as dt
import math
import random

from tidemark.operators import executions, pools
from tidemark.operators.screen import date_index


def sample(spark):
    rng = random.Random(5)
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    bars = [(day, f"{600000 + i}.SH" if i % 3 else f"{688000 + i}.SH", round(5 + rng.random() * 10, 2), rng.randrange(2)) for day in days for i in range(30) if rng.random() < 0.8]
    daily = spark.createDataFrame(bars, "trade_date date, ts_code string, open double, bucket int")
    trips = [(code, day, rng.choice([None, *[d for d in days if d >= day], dt.date(2025, 1, 1)]), bucket, float(rng.choice([10, 900, 1200, 3000])), 100, n)
             for n, (day, code, _, bucket) in enumerate(rng.sample(bars, 90))]
    return daily, spark.createDataFrame(trips, "ts_code string, entry_day date, exit_day date, bucket int, notional double, quantity long, o long")


def test_pools_in_parts_equal_listed_pools(spark, monkeypatch):
    daily, trips = sample(spark)
    listed = executions.pool_positions(trips, daily, "bucket", ["main", "star"])
    sized = executions.affordable(trips, listed, "bucket")
    days = date_index(daily)
    names = pools.candidates(daily, days, "bucket", ["main", "star"])
    # One row for each bar: a pool for each exit day had one for each pair of days.
    assert names.count() == daily.count() < listed.count()
    monkeypatch.setattr(pools, "SIZED_A_PART", 3)
    monkeypatch.setattr(pools, "DRAWN_A_PART", 3)
    got = {row.o: row.pool_size for row in pools.pool_sizes(trips, names, days, "bucket").collect()}
    assert got == {row.o: row.pool_size for row in sized.collect()} and len(set(got.values())) > 5
    identity = ["ts_code", "o"]
    columns = ["o", "draw", "drawn_code", "drawn_quantity", "pool_size"]
    drawn = pools.draw_names(trips, names, days, "bucket", 20, 1, identity).select(*columns)
    want = executions.draw(sized, listed, "bucket", 20, 1, identity).select(*columns)
    assert sorted(drawn.collect()) == sorted(want.collect())


def test_a_draw_that_loses_more_than_its_capital_is_not_a_number(spark):
    day = dt.date(2024, 1, 2)
    pnl = spark.createDataFrame([(0, day, -250.0), (1, day, 50.0)], "draw int, trade_date date, pnl double")
    curve = spark.createDataFrame([(day, 120.0, 100.0)], "trade_date date, equity double, initial_equity double")
    got = executions.draw_distribution(pnl, curve, 2).first()
    assert math.isnan(got["mean"]) and math.isnan(got["sd"]) and got["share_at_or_below"] == 0.0 and got["draws"] == 2
