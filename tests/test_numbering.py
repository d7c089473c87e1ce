"""Places in a total order against plain sorting, and the session's scratch folder."""

from __future__ import annotations

import os
import subprocess
import sys
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered
from tidemark.session import discard, materialise

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_places_of_hot_null_and_single_groups(spark):
    rows = [("hot", i * 7919 % 101) for i in range(700)] + [(None, i % 3) for i in range(50)] + [(f"g{i}", None) for i in range(40)]
    got = numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v").desc_nulls_last()]).collect()
    by = defaultdict(list)
    for row in got:
        by[row["g"]].append((row["position"], row["v"], row["n"]))
    assert len(got) == len(rows)
    for g, placed in by.items():
        placed.sort()
        assert [p for p, _, _ in placed] == list(range(len(placed))) and {n for _, _, n in placed} == {len(placed)}
        assert [v for _, v, _ in placed] == sorted((v for h, v in rows if h == g), key=lambda v: (v is None, -(v or 0)))


def test_no_group_equal_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x")] * 300, "v int, position_of string")
    got = numbered(df, [], [F.col("v").asc()], "place", None)
    assert got.columns == ["v", "position_of", "place"]
    assert sorted(r["place"] for r in got.collect()) == list(range(300))
    assert numbered(df.limit(0), ["v"], [F.col("position_of").asc()]).collect() == []


def test_scratch_tables_go(spark):
    kept = materialise(spark.range(5))
    later = materialise(kept.select((F.col("id") * 2).alias("id")), instead_of=[kept])
    folder = kept.scratch.removeprefix("file:")
    assert not os.path.exists(folder) and os.path.exists(later.scratch.removeprefix("file:"))
    discard(later, spark.range(1))
    assert not os.path.exists(later.scratch.removeprefix("file:"))


def test_session_without_machine_settings(tmp_path):
    """No settings file, another working folder, and the folder gone after the session stopped."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from tidemark.session import local_session, materialise\n"
        "spark = local_session(1)\n"
        "t = materialise(spark.range(3)); print('rows', t.count()); print('folder', t.scratch)\n"
        "from pyspark.sql import functions as F; from tidemark.operators.inference import upper_tail\n"
        "print('tail', spark.range(1).select(upper_tail(F.lit(0.0))).first()[0])\n"
        "spark.stop()\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=300, check=True).stdout
    assert "rows 3" in out and "tail 0.5" in out
    folder = out.split("folder ")[1].strip().removeprefix("file:")
    assert not os.path.exists(folder)
