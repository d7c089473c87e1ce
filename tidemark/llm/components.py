"""Connected components of a table of links, by alternating star operations.

Each round hangs every node and its neighbours on the smallest node near it, in
two joins over the links; a hot node's neighbours are never gathered, only their
minimum is, by an aggregate that combines before the shuffle. A link (a, b) has
the greater node first, so the smaller neighbours of a node are the ``b`` of its
rows as ``a``. Rounds end when the links are stars around their smallest nodes,
which one count by node tells; their number grows with the logarithm of the
longest chain. Every round is stored in the shared folder, in place of the one
before. Nodes may be numbers or binary names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    return links.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    return links.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one node only, and that one on none."""
    roles = links.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(links.select("b", F.lit(0), F.lit(1)))
    mixed = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1 and below > 0")
    return mixed.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links(a, b)``; self-links are dropped."""
    now = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _settled(now):
        now = materialise(_small_star(_large_star(now)), instead_of=[now])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
