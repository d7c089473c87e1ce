"""Running totals carried between tasks."""

from __future__ import annotations

from tidemark.operators.ordered import Running, running


def test_carried_totals_do_not_move_the_rows(spark, many_tasks, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(500).selectExpr("id % 3 as key", "id as at", "id % 11 as qty")
        out = running(df, ["key"], ["at"], {"total": Running("sum", "qty")})
        out.explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
        want = df.toPandas().sort_values("at")
        want["total"] = want.groupby("key").qty.cumsum()
        assert (out.toPandas().sort_values("at").total.to_numpy() == want.total.to_numpy()).all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
