"""Linking of nodes that share index buckets, without listing all pairs of a large bucket.

A bucket of few nodes gives all of its pairs. A large one gives the pairs of its
smallest node with every other, and is kept as a list. When the pairs have been
verified and their components are known, a kept bucket whose nodes lie in one
component is done; of any other only the pairs across components are verified.
No link is lost, and a group of copies costs one check a node.

Nodes are 64-bit numbers; each carries a 64-bit sketch, and pairs whose sketches
prove them too different are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import materialise

#: Nodes of a bucket that is listed pair by pair.
SMALL = 32
ENTRY = np.dtype([("low", "u1", 6), ("node", "<i8"), ("sketch", "<u8")])
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pack_entries(buckets: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Index entries by hash range: range numbers and packed bytes."""
    part = ((buckets >> np.uint64(44)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    packed = np.zeros(len(order), ENTRY)
    packed["low"] = buckets[order].view(np.uint8).reshape(-1, 8)[:, :6]
    packed["node"], packed["sketch"] = nodes[order], sketches[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = [0, *cuts, len(part)] if len(part) else [0]
    return part[np.array(bounds[:-1], np.int64)], [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def meetings(packed: np.ndarray, near: Near, small: int = SMALL) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pairs (n, 2) of nodes that share a bucket and are near by sketch, and the large buckets (n, 2) of node and sketch."""
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :6] = packed["low"]
    bucket, node, sketch = wide.view(np.uint64).ravel(), packed["node"], packed["sketch"]
    order = np.lexsort((node, bucket))
    bucket, node, sketch = bucket[order], node[order], sketch[order]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])
    bucket, node, sketch = bucket[new], node[new], sketch[new]
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(bucket)))
    of = np.repeat(np.arange(len(begin)), size)
    place = np.arange(len(bucket)) - begin[of] if len(bucket) else np.zeros(0, np.int64)
    found = []
    for step in range(1, small):
        left = np.flatnonzero((place + step < size[of]) & (size[of] <= small))
        if not len(left):
            break
        ok = near(sketch[left], sketch[left + step])
        found.append(np.stack([node[left[ok]], node[left[ok] + step]], axis=1))
    spokes = np.flatnonzero((size[of] > small) & (place > 0))
    if len(spokes):
        hub = begin[of[spokes]]
        ok = near(sketch[hub], sketch[spokes])
        found.append(np.stack([node[hub[ok]], node[spokes[ok]]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    large = {np.stack([node[a:a + n], sketch[a:a + n].view(np.int64)], axis=1).tobytes() for a, n in zip(begin[size > small], size[size > small], strict=True)}
    return pairs, [np.frombuffer(x, np.int64).reshape(-1, 2) for x in sorted(large)]


def meet(packed: DataFrame, near: Near, small: int = SMALL) -> DataFrame:
    """Of rows (part, payload): rows of pairs (a, b) and of large buckets (nodes, sketches)."""

    def gather(table: pa.Table) -> pa.Table:
        pairs, large = meetings(np.frombuffer(b"".join(table.column("payload").to_pylist()), ENTRY), near, small)
        n, k, longs = len(pairs), len(large), pa.list_(pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.nulls(k, pa.int64())]), "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(k, pa.int64())]),
            "nodes": pa.concat_arrays([pa.nulls(n, longs), pa.array([x[:, 0] for x in large], longs)]),
            "sketches": pa.concat_arrays([pa.nulls(n, longs), pa.array([x[:, 1] for x in large], longs)]),
        })

    return packed.groupBy("part").applyInArrow(gather, "a long, b long, nodes array<long>, sketches array<long>")


def open_buckets(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, node, sketch, component) of large buckets whose nodes lie in several components of ``labels(node, component)``."""
    large = found.where("nodes is not null").select(F.xxhash64("nodes").alias("bucket"), F.explode(F.arrays_zip("nodes", "sketches")).alias("x")).select("bucket", "x.*").distinct()
    tagged = large.toDF("bucket", "node", "sketch").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = tagged.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return tagged.join(open_, "bucket", "left_semi")


def across(found: DataFrame, labels: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b), near by sketch, of large buckets' nodes that lie in different components."""
    rows = open_buckets(found, labels).groupBy("bucket").agg(F.collect_list(F.struct("node", "sketch", "component")).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for members in record.column(0):
                flat = members.values.flatten()
                node, sketch, component = (x.to_numpy() for x in flat)
                sketch = sketch.view(np.uint64)
                for i in range(len(node) - 1):
                    ok = component[i + 1:] != component[i]
                    ok[ok] = near(np.full(int(ok.sum()), sketch[i]), sketch[i + 1:][ok])
                    other = node[i + 1:][ok]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, node[i])), pa.array(np.maximum(other, node[i]))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def link(found: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame], inside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node, component`` of all nodes with a verified link; ``verify`` keeps the true pairs of (a, b).

    ``inside``, if given, makes links from the rows of :func:`open_buckets`
    itself, where that is cheaper than listing and verifying the pairs.
    """
    tried = found.where("nodes is null").select("a", "b").distinct()
    links = materialise(verify(tried))
    if found.where("nodes is not null").isEmpty():
        return components(links)
    labels = materialise(components(links))
    if inside:
        return components(links.union(inside(open_buckets(found, labels))))
    rest = across(found, labels, near).join(tried, ["a", "b"], "left_anti")
    return components(links.union(verify(rest)))


#: Bits of the filter that keeps rows nobody asks for out of a shuffle (2 MB in every task).
FILTER_BITS = 1 << 24


def filter_of(keys: DataFrame):
    """A broadcast bitmap of one column of 64-bit numbers, of fixed size.

    It may let other numbers through, so a join must follow; when the numbers
    outgrow it, it only saves less.
    """
    spark = keys.sparkSession
    bit = F.pmod(keys[keys.columns[0]], F.lit(FILTER_BITS)).cast("long")
    words = keys.select(bit.alias("bit")).where("bit is not null").groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    rows = words.toPandas()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(bitmap)


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = np.mod(keys, FILTER_BITS)
    return (bitmap[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) == 1
