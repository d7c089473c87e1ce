"""Keyed state of streams: late, repeated and stale rows, open days, folded batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.session import scratch_folder
from tidemark.streaming import state, streams

BAR = "ts_code string, trade_date string, trade_time string, open double, close double, vol double, amount double, received_at timestamp"


def feed(spark, schema, batches):
    """One file a batch, in order."""
    folder = scratch_folder(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return streams.read_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def bar(day, clock, price, vol, came):
    return ("600000.SH", f"202401{day:02}", f"2024-01-{day:02} {clock}:00", price, price, vol, price * vol, came)


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_days_close_once_late_bars_come_again_and_open_days_wait(spark):
    batches = [
        [bar(2, "09:30", 10.0, 100.0, at(2, 9, 31)), bar(2, "09:31", 10.5, 100.0, at(2, 9, 32)), bar(2, "09:31", 10.5, 100.0, at(2, 9, 33))],
        [bar(3, "09:30", 11.0, 100.0, at(3, 9, 31))],
        [bar(3, "09:31", 12.0, 50.0, at(3, 9, 35))],
        [bar(2, "09:32", 10.0, 200.0, at(3, 9, 40)), bar(4, "09:30", 11.0, 1.0, at(4, 18, 0))],
        [bar(3, "09:32", 12.0, 50.0, at(4, 18, 1)), bar(3, "09:33", 12.0, 50.0, at(4, 18, 2))],
        [bar(3, "09:34", 12.0, 50.0, at(4, 18, 3))],
        [bar(12, "09:30", 9.0, 10.0, at(12, 9, 31))],
        [bar(12, "09:31", 9.0, 10.0, at(12, 9, 40))],
        [bar(2, "09:33", 10.0, 5.0, at(12, 9, 50))],
    ]
    folder, columns = scratch_folder(spark, "days"), ["ts_code", "trade_date", "trade_time", "open", "close", "vol", "amount"]
    streams.track_session_days(feed(spark, BAR, batches), folder, scratch_folder(spark, "cp"), columns, keep_days=5).awaitTermination()
    stats = spark.read.parquet(f"{folder}/stats")
    emitted = {(r["trade_date"], r["n_bars"]) for r in stats.collect()}
    # The first day closed and came again with its late bar; the next closed in the batch of its late bars and came again
    # with one more; the fourth closed; the twelfth is still open.
    assert emitted == {("20240102", 2), ("20240102", 3), ("20240103", 4), ("20240103", 5), ("20240104", 1)}
    last = {r["trade_date"]: r["n_bars"] for r in streams.latest_rows(spark, f"{folder}/stats", ["ts_code", "trade_date"], ["n_bars"]).collect()}
    assert last == {"20240102": 3, "20240103": 5, "20240104": 1}
    flow = {r["trade_date"]: r["nret"] for r in streams.latest_rows(spark, f"{folder}/flow", ["ts_code", "trade_date"], ["nret"]).collect()}
    assert flow == {"20240102": 2, "20240103": 4, "20240104": 0}
    stale = spark.read.parquet(f"{folder}/stale").select("trade_time", "vol").collect()
    assert [tuple(r) for r in stale] == [("2024-01-02 09:33:00", 5.0)]


def test_first_receipts_are_kept_and_batches_fold(spark):
    batches = [[("a", 5), ("b", 7), ("a", 4)], [("a", 1), ("c", None)], [("c", 2), ("d", 9)]]
    folder = scratch_folder(spark, "seen")
    streams.track_first_seen(feed(spark, "k string, at int", batches), folder, scratch_folder(spark, "cp"), ["k"], "at").awaitTermination()
    seen = {r["k"]: (r["first_seen_at"], r[streams.EPOCH]) for r in spark.read.parquet(folder).collect()}
    assert seen == {"a": (4, 0), "b": (7, 0), "c": (None, 1), "d": (9, 2)}
    assert streams.compact(spark, folder, ["k"], 1) == 1 and streams.compact(spark, folder, ["k"], 1) == 0
    after = {r["k"]: (r["first_seen_at"], r[streams.EPOCH]) for r in spark.read.parquet(folder).collect()}
    assert after == {"a": (4, 1), "b": (7, 1), "c": (None, 1), "d": (9, 2)}


def test_tail_lines_count_once(spark):
    batches = [[("r", "x", 0), ("r", "y", 1)], [("r", "y", 1), ("r", "x", 5), ("s", "x", 100_001)], [("r", "x", 3), ("r", "x", 0), ("s", "x", 2)]]
    folder = scratch_folder(spark, "tail")
    streams.track_tails(feed(spark, "run_id string, event_type string, seq long", batches), folder, scratch_folder(spark, "cp")).awaitTermination()
    assert {tuple(r) for r in streams.tail_totals(spark, folder).collect()} == {("r", "x", 3), ("r", "y", 1), ("s", "x", 2)}
    assert spark.read.parquet(folder).where("run_id = 's'").select(F.count_distinct("block")).first()[0] == 2


def test_offset_ranges():
    held, fresh = state.add_offsets([], [3, 1, 2, 9, 2])
    assert held == [(1, 4), (9, 10)] and fresh == {1, 2, 3, 9}
    held, fresh = state.add_offsets(held, [0, 3, 4, 8, 10])
    assert held == [(0, 5), (8, 11)] and fresh == {0, 4, 8, 10}


def test_an_answer_that_claims_a_partition_and_holds_nothing_is_a_defect(spark):
    schema = "part string, id int, v string, claim boolean"
    first = [("p", i, "a", False) for i in range(4)] + [("q", i, "a", False) for i in range(4)]
    second = [("p", None, None, True), ("q", 0, "a", False), ("new", None, None, True)]
    third = [("q", i, "b", False) for i in range(4)]
    folder = scratch_folder(spark, "answers")
    step = streams.publish_step(folder, "part", ["id"], ["part", "id", "v"], claim="claim")
    streams.run_batches(feed(spark, schema, [first, second, third]), step, scratch_folder(spark, "cp")).awaitTermination()
    events = {(r["part"], r[streams.EPOCH]): r["outcome"] for r in spark.read.parquet(f"{folder}/events").collect()}
    assert events == {("p", 0): "appended", ("q", 0): "appended", ("p", 1): "defect", ("q", 1): "staged", ("new", 1): "appended", ("q", 2): "restated"}
    shown = sorted(tuple(r) for r in streams.visible_rows(spark, folder, "part", ["part", "id", "v"]).collect())
    assert shown == [("p", i, "a") for i in range(4)] + [("q", i, "b") for i in range(4)]
