"""Prices of drawn holdings travel once for a block of entry days; layouts go once they are read."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import executions, pools
from tidemark.operators.screen import date_index


def test_bars_travel_once_for_a_block_and_parts_sum_up(spark, monkeypatch):
    rng = random.Random(8)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=n) for n in range(30)]
    bars = []
    for day in days:
        for i in range(12):
            if rng.random() < 0.9:
                close = round(8 + rng.random() * 4, 2)
                bars.append((day, f"{600000 + i}.SH", close, close - 0.1, close * 0.99, close * 1.1, close * (1.0 if i == 3 else 0.9), i == 5, i % 2))
    daily = spark.createDataFrame(bars, "trade_date date, ts_code string, close double, open double, pre_close double, up_limit double, down_limit double, is_suspended boolean, bucket int")
    trips = spark.createDataFrame(
        [(bar[1], bar[0], rng.choice([None, *[d for d in days if d >= bar[0]]]), bar[8], float(rng.choice([900, 2500, 9000])), n) for n, bar in enumerate(rng.sample(bars, 120))],
        "ts_code string, entry_day date, exit_day date, bucket int, notional double, o long")
    index = date_index(daily)
    names = pools.priced_names(daily, index, "bucket", 5)
    sent = names.agg(F.sum(F.size("di")).alias("bars"), F.sum(F.size("entries")).alias("entries")).first()
    # A name's later bars for each of its days, as before, are its bars' pairs.
    pairs = daily.groupBy("ts_code").count().agg(F.sum(F.expr("count * (count + 1) div 2"))).first()[0]
    assert sent.entries == len(bars) and sent.bars * 3 < pairs

    def profit():
        out = pools.drawn_profit(trips, daily, index, "bucket", 20, 1, ["ts_code", "o"])
        return {(row.draw, row.trade_date): row.pnl for row in out.collect()}

    whole = profit()
    monkeypatch.setattr(pools, "SUMMED_A_PART", 7)
    monkeypatch.setattr(pools, "DRAWN_A_PART", 3)
    assert profit() == pytest.approx(whole, abs=1e-6) and len(whole) > 300


def test_round_trips_drop_the_layouts_they_have_read(spark, monkeypatch):
    stored = []
    laid_out = executions.lay_out
    monkeypatch.setattr(executions, "lay_out", lambda *args: stored.append(laid_out(*args)) or stored[-1])
    fills = spark.createDataFrame([("a", n, "buy" if n % 3 else "sell", 100) for n in range(50)], "ts_code string, at long, action string, quantity long")
    trips = executions.round_trips(fills, ["ts_code"], ["at"], ["at"])
    assert len(stored) == 2 and not os.path.exists(stored[0].scratch) and trips.scratch == stored[1].scratch
    assert trips.count() > 0
