"""First receipts of many keys: no call of Python for each of them."""

from __future__ import annotations

from tidemark.session import scratch_folder
from tidemark.streaming import streams


def test_keys_are_kept_by_deduplication(spark):
    folder, feed = scratch_folder(spark, "seen"), scratch_folder(spark, "feed")
    schema = "a string, b int, at date"
    for day, (low, high) in enumerate([(0, 3000), (2000, 5000), (0, 5000)]):
        rows = spark.range(low, high).selectExpr("if(id % 1000 = 0, null, concat('k', id)) as a", "cast(id % 7 as int) as b", f"date_add(date'2024-01-01', {day}) as at")
        late = rows.selectExpr("a", "b", "date_add(at, 5) as at").union(rows.selectExpr("a", "b", "cast(null as date) as at"))
        rows.union(late).coalesce(1).write.mode("append").parquet(feed)
    query = streams.track_first_seen(streams.read_stream(spark, feed, spark.createDataFrame([], schema).schema, files_per_batch=1), folder, scratch_folder(spark, "cp"), ["a", "b"], "at")
    query.awaitTermination()
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"dedupe"}
    seen = spark.read.parquet(folder)
    got = {(r["a"], r["b"]): str(r["first_seen_at"]) for r in seen.collect()}
    want = {}
    for day, (low, high) in enumerate([(0, 3000), (2000, 5000), (0, 5000)]):
        for n in range(low, high):
            want.setdefault((None if n % 1000 == 0 else f"k{n}", n % 7), f"2024-01-0{day + 1}")
    assert got == want and seen.count() == len(want)
