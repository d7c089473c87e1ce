"""Auction audits of large part tables."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F
from test_oracles import FOLDER

from tidemark.registry import ORACLES, QUERIES


def test_auction_codes_of_large_part_tables(spark, tmp_path):
    parts = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    shifted = [parts.withColumn("l_partkey", F.col("l_partkey") + n) for n in (0, 123_456, 1_000_000)]
    shifted[0].unionByName(shifted[1]).unionByName(shifted[2]).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["dq19_auction_validation"](spark, str(tmp_path)).toPandas().sort_values("trade_date").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(ORACLES["dq19_auction_validation"]).df().sort_values("trade_date").reset_index(drop=True)
    for name in want.columns:
        assert (got[name] == want[name]).all(), name
