"""Points inside intervals, check owners and event unions against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import quality, versions
from tidemark.operators.intervals import inside


def day(n):
    return dt.date(2019, 12, 1) + dt.timedelta(days=n)


def test_points_meet_every_interval_that_holds_them(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), day(rng.randrange(900)), i) for i in range(300)] + [("a", None, 900), (None, day(3), 901)]
    spans = []
    for i in range(120):
        start, length = rng.randrange(900), rng.choice([0, 0, 1, 2, 5, 31, 32, 365, 900])
        spans.append((rng.choice("ab"), day(start), day(start + length), i))
    spans += [("a", day(9), day(3), 500), ("a", None, day(3), 501), ("b", day(3), None, 502)]
    p, s = spark.createDataFrame(points, "k string, at date, p int"), spark.createDataFrame(spans, "k string, lo date, hi date, s int")
    got = sorted((r["p"], r["s"]) for r in inside(p, s, "at", "lo", "hi", ["k"]).collect())
    want = sorted((i, j) for k, at, i in points for q, lo, hi, j in spans if k == q and k and at and lo and hi and lo <= at <= hi)
    assert got == want and len(want) > 500
    whole = sorted((r["p"], r["s"]) for r in inside(p, s.drop("k"), "at", "lo", "hi").collect())
    assert whole == sorted((i, j) for _, at, i in points for _, lo, hi, j in spans if at and lo and hi and lo <= at <= hi)
    assert inside(p, s.limit(0), "at", "lo", "hi", ["k"]).collect() == []


def test_a_check_belongs_to_the_longest_name_it_begins_with(spark):
    checks = spark.createDataFrame([("daily_basic_keys",), ("daily_rows",), ("daily",), ("dailyx_rows",), ("other_a_b",), ("_",), ("",)], "check string")
    names = spark.createDataFrame([("daily",), ("daily_basic",), ("other_a",), ("other",)], "dataset string")
    assert {tuple(r) for r in quality.owners(checks, names).collect()} == {("daily_basic_keys", "daily_basic"), ("daily_rows", "daily"), ("daily", "daily"), ("other_a_b", "other_a")}


FIELDS = "ts_code string, ann_date string, float_date string, float_share double, float_ratio double, holder_name string, share_type string"


def event(ann, share=1.0, holder="h", code="1"):
    return (code, ann, "20200101", share, 0.1, holder, "A")


def union(spark, base, active):
    cut = spark.createDataFrame([(*r[0], r[1]) for r in active], FIELDS + ", source_cap_risk boolean")
    return spark.createDataFrame(base, FIELDS), cut


def test_redated_capped_and_undated_events(spark):
    base = [event("20190101"), event("20190101", 2.0, code="2"), event("", 3.0, code="3"), event("20190105", code="4")]
    active = [(event("20190201", holder=" h "), False), (event("20190301", 2.0, code="2"), True), (event("20190109", 3.0, code="3"), False), (event("20190101", code="4"), False)]
    got = sorted(tuple(r)[:2] for r in versions.merge_unlocks(*union(spark, base, active)).collect())
    # 1 re-dated; 2 keeps its baseline beside cut evidence; 3 found its date; 4 was re-dated backwards.
    assert got == [("1", "20190201"), ("2", "20190101"), ("2", "20190301"), ("3", "20190109"), ("4", "20190101")]


def test_a_shrinking_union_is_refused(spark):
    base = [event("20190101"), event(""), event("20190101", 2.0, code="2")]
    sides = union(spark, base, [])
    counts = versions.unlock_shrink(versions.unlock_groups(*sides)).first().asDict()
    assert counts == {"before": 3, "after": 2, "superseded": 0, "shrinks": True}
    with pytest.raises(PySparkException, match="shrink event groups from 3 to 2"):
        versions.merge_unlocks(*sides).collect()
    kept = versions.merge_unlocks(*union(spark, base[:1] + base[2:], []))
    assert kept.where(F.col("ann_date") == "20190101").count() == 2
