"""Exact Jaccard join of documents' sets of word shingles, by partitioned segments.

Sets whose sizes share a band hash their shingles into ``m`` segments. Two sets
that reach the threshold differ in at most ``H`` shingles, a bound from their
sizes, so that of any ``H + 1`` filled segments of one at least one equals the
other's. Each set therefore indexes the ``H + 1`` segment subsets that are
cheapest under one global order: how common the rarest shingle of the subset is,
then its hash. (The first equal subset in that order is among the first
``H + 1`` of both sets.) A set with too few filled segments to afford this
indexes all its subsets, and for pairs of such sets also their one-deletion
neighbourhoods, where a segment of two or more shingles counts for two
differences; should even that not suffice, its single shingles. Sets that straddle a band's upper end join
the next band as well. Equal sets are one node from the start.

Subsets travel packed by hash range. Sets that meet are verified exactly: first
each bucket's first set against the others, then, among what is still
unconnected, every remaining candidate. Before shingles are fetched, parities of their counts in cells, which
never differ more than the sets, rule out most unlike pairs; the cells grow with
the set, so that they tell large sets apart as well as small ones. Pairs are verified
in blocks around their hubs, so that a text travels once for all its pairs of a
block and not once a pair; large buckets are compared block against block. So
copies of one text cost a few checks each, and no link between different texts
is lost.

Classes of equal sets are named by the set's 128-bit key throughout; ids meet
only at the end, where an id with several texts joins their components.

The list of common shingles steers the order alone and is bounded by
``COMMON``; any list gives the same links.

Defined cases: words are runs of characters other than ASCII white space, with
A-Z lower-cased; a text of fewer words than the shingle length is one shingle; a
null or empty text has an empty set, linked with nothing; a null id takes no
part and gets a null component; rows with one id and one text are one document;
an empty table gives an empty result; other columns are not looked at. Shingles
and sets are told apart by hashes of 64 and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.linking import filter_of, may_hold
from tidemark.llm.textbatch import BASE, TextBatch, distinct_per_text, mix, slices
from tidemark.session import discard, materialise

WORDS = 5
#: The threshold: ``OF * intersection >= AT_LEAST * union``.
AT_LEAST, OF = 75, 100
#: Segments for each subset that a set of the band's largest size must index.
SLACK = 1.5
#: Most common shingles that are known to the order of subsets (8 bytes each).
COMMON = 50_000
#: Shingles that a task names as common: found this often in one slice of texts.
COMMON_IN_SLICE, COMMON_A_TASK = 8, 5_000
#: Cells a shingle (at least) of the parities that tell most unlike sets apart before their shingles are compared, and cells of a set at most.
CELLS_A_SHINGLE, MOST_CELLS = 2, 1 << 17
#: Sets of a block of a bucket.
BUCKET_BLOCK = 512
#: Bytes of packed rows, or of sets around a hub, that one task gathers.
PART_BYTES = 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_DELETION, _SINGLE, _SHORT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A5A5, 0x5A5A5A5A5A5A5A5A, 0xC3C3C3C3C3C3C3C3))


def differences(n, largest):
    """Most differing shingles between a set of size n and a partner of at most ``largest``."""
    partner = np.minimum(largest, n * OF // AT_LEAST)
    return (n + partner) * (OF - AT_LEAST) // (OF + AT_LEAST)


def segments(largest):
    """Segments of the band of sets up to a size."""
    return np.ceil(SLACK * (differences(largest, largest) + 1)).astype(np.int64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes text by text in ascending order, the bounds of each text, and set keys (two int64)."""
    batch = TextBatch(texts)
    batch.data = _LOWER[batch.data]
    keys, of, _ = batch.grams(words)
    short = np.flatnonzero((batch.n_words > 0) & (batch.n_words < words))
    if len(short):
        bounds = np.searchsorted(batch.words[2], np.arange(batch.n + 1))
        extra = np.zeros(len(short), np.uint64)
        for k, n in enumerate(short):
            for h in batch.word_hashes[bounds[n]:bounds[n + 1]]:
                extra[k:k + 1] = extra[k:k + 1] * BASE + h
        keys, of = np.concatenate([keys, mix(extra ^ _SHORT)]), np.concatenate([of, short])
    keys, of = distinct_per_text(keys, of)
    bounds = np.searchsorted(of, np.arange(batch.n + 1))
    digests = b"".join(xxhash.xxh3_128_digest(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return keys, bounds, np.frombuffer(digests, np.int64).reshape(-1, 2)


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (doc_id, th, n, k1, node) and, with ``common`` true, of common shingles (k1, and their count as n).

    ``node`` is the set's whole key, ``k1`` its first half, ``th`` the text's hash.
    """
    names = ["doc_id", "th", "n", "k1", "node", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[int, int] = {}
        for record in batches:
            for start, stop in slices(record.column(1)):
                keys, bounds, sets = shingle_sets(record.column(1).slice(start, stop - start), words)
                found, counts = np.unique(keys, return_counts=True)
                often = counts >= COMMON_IN_SLICE
                for key, n in zip(found[often].view(np.int64).tolist(), counts[often].tolist(), strict=True):
                    common[key] = common.get(key, 0) + n
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [record.column(0).slice(start, n), record.column(2).slice(start, n), pa.array(np.diff(bounds)), pa.array(sets[:, 0]), names_of(sets), pa.array(np.zeros(n, bool))], names)
        top = sorted(common.items(), key=lambda x: (-x[1], x[0]))[:COMMON_A_TASK]
        n = len(top)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([c for _, c in top], pa.int64()), pa.array([k for k, _ in top], pa.int64()), pa.nulls(n, pa.binary()), pa.array([True] * n, pa.bool_())], names)

    return docs.select("doc_id", "text", "th").mapInArrow(run, "doc_id long, th long, n long, k1 long, node binary, common boolean")


def names_of(sets: np.ndarray) -> pa.Array:
    """The 16 bytes of each set's key."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(sets)], pa.binary())


def index_entries(keys: np.ndarray, bounds: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subset hashes that each set indexes, and the number of the set.

    ``common`` holds the common shingles in ascending order of hash, with how
    common they are (level 1 to 15) beside.
    """
    names, levels = common
    n = np.diff(bounds)
    band = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    owner = np.flatnonzero(n > 2)
    straddling = owner[n[owner] * OF // AT_LEAST > 1 << band[owner]]
    owner, band = np.concatenate([owner, straddling]), np.concatenate([band[owner], band[straddling] + 1])
    if not len(owner):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    need = differences(n[owner], 1 << band) + 1
    m = segments(1 << band)
    count = n[owner]
    group = np.repeat(np.arange(len(owner)), count)
    place = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[owner], count)
    token = keys[place]
    segment = (mix(token ^ band[group].astype(np.uint64)) % m[group].astype(np.uint64)).astype(np.int64)
    order = np.argsort((np.cumsum(m) - m)[group] + segment, kind="stable")
    token, group, segment = token[order], group[order], segment[order]
    first = np.ones(len(token), bool)
    first[1:] = (segment[1:] != segment[:-1]) | (group[1:] != group[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(token)))
    spread = mix(token + BASE)
    total = np.add.reduceat(spread, begin)
    label = mix((band[group[begin]].astype(np.uint64) << np.uint64(40)) + segment[begin].astype(np.uint64))
    of = group[begin]
    level = np.zeros(len(token), np.uint64)
    if len(names):
        at = np.minimum(np.searchsorted(names, token), len(names) - 1)
        level = np.where(names[at] == token, levels[at], 0).astype(np.uint64)
    subset = mix(total + label)
    rank_key = (np.minimum.reduceat(level, begin) << np.uint64(60)) | (subset >> np.uint64(4))
    filled = np.bincount(of, minlength=len(owner))
    order = np.lexsort((rank_key, of))
    rank = np.arange(len(of)) - np.repeat(np.cumsum(filled) - filled, filled)
    enough = filled >= need
    chosen = order[rank < need[of]]  # all of a set that has too few
    entries, sets = [subset[chosen]], [owner[of[chosen]]]
    if not enough.all():
        poor = ~enough[of]
        wide = poor & (size > 1)
        inside = np.repeat(np.arange(len(begin)), size)
        deleted = wide[inside]
        entries += [mix(total[poor] + label[poor] + _DELETION), mix(total[inside[deleted]] - spread[deleted] + label[inside[deleted]] + _DELETION)]
        sets += [owner[of[poor]], owner[group[deleted]]]
        afford = np.bincount(of, weights=np.where(size > 1, 2, 1), minlength=len(owner))
        poorest = ((afford < need) & ~enough)[group]
        entries.append(mix(token[poorest] + _SINGLE + band[group[poorest]].astype(np.uint64)))
        sets.append(owner[group[poorest]])
    return np.concatenate(entries), np.concatenate(sets)


def pack_entries(entries: np.ndarray, sets: np.ndarray, names: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Entries by hash range: for each range the sets that have some, their counts, and 48 bits a subset."""
    part = ((entries >> np.uint64(44)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((sets, part))
    part, sets, low = part[order], sets[order], entries[order].view(np.uint8).reshape(-1, 8)[:, :6]
    cuts = np.flatnonzero(np.diff(part)) + 1
    payloads = []
    for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
        if a < b:
            ids, counts = np.unique(sets[a:b], return_counts=True)
            payloads.append(np.uint32(len(ids)).tobytes() + names[ids].tobytes() + counts.astype(np.uint32).tobytes() + low[a:b].tobytes())
    return part[np.concatenate([[0], cuts]).astype(np.int64)] if len(part) else part, payloads


def unpack_entries(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(payload, np.uint32, 1)[0])
    names, counts = np.frombuffer(payload, np.int64, k, 4), np.frombuffer(payload, np.uint32, k, 4 + 8 * k)
    low = np.frombuffer(payload, np.uint8, offset=4 + 12 * k).reshape(-1, 6)
    subset = np.zeros((len(low), 8), np.uint8)
    subset[:, :6] = low
    return subset.view(np.uint64).ravel(), np.repeat(names, counts)


def meetings(subset: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct pairs (first of a bucket, other), and the distinct buckets of three or more."""
    order = np.lexsort((name, subset))
    subset, name = subset[order], name[order]
    new = np.ones(len(subset), bool)
    new[1:] = (subset[1:] != subset[:-1]) | (name[1:] != name[:-1])
    subset, name = subset[new], name[new]
    begin = np.flatnonzero(np.append(True, subset[1:] != subset[:-1])) if len(subset) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(subset)))
    of = np.repeat(np.arange(len(begin)), size)
    other = np.ones(len(subset), bool)
    other[begin] = False
    pairs = np.stack([name[begin][of][other], name[other]], axis=1)
    pairs = np.unique(pairs, axis=0)
    buckets = {name[begin[i]:begin[i] + size[i]].tobytes() for i in np.flatnonzero(size > 2)}
    return pairs, [np.frombuffer(x, np.int64) for x in sorted(buckets)]


def parts_for(spark: SparkSession, size: int) -> int:
    """Parts for so many bytes of packed rows, each some ``PART_BYTES`` at most."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def _meet(docs: DataFrame, words: int, common: list[tuple[int, int]], shingles: int) -> DataFrame:
    """Rows (a, b, members): pairs of sets that meet, and whole buckets of three or more."""
    spark = docs.sparkSession
    # A set indexes one subset for every three shingles, in 18 bytes at most.
    parts = parts_for(spark, 6 * shingles)
    names = np.array([k for k, _ in common], np.int64).view(np.uint64)
    levels = np.minimum(15, 1 + np.log2(1 + np.array([n for _, n in common], np.float64))).astype(np.uint64)
    order = np.argsort(names)
    held = spark.sparkContext.broadcast((names[order], levels[order]))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(0)):
                keys, bounds, sets = shingle_sets(record.column(0).slice(start, stop - start), words)
                _, once = np.unique(sets, axis=0, return_index=True)
                entries, of = index_entries(keys, bounds, held.value)
                first = np.zeros(len(bounds) - 1, bool)
                first[once] = True
                part, payloads = pack_entries(entries[first[of]], of[first[of]], sets[:, 0], parts)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(payloads, pa.binary())], ["part", "payload"])

    def gather(table: pa.Table) -> pa.Table:
        unpacked = [unpack_entries(x) for x in table.column("payload").to_pylist()]
        pairs, buckets = meetings(np.concatenate([x for x, _ in unpacked]), np.concatenate([x for _, x in unpacked]))
        n, k = len(pairs), len(buckets)
        blank = pa.nulls(k, pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(pairs[:, 0], pa.int64()), blank]), "b": pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), blank]),
            "members": pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array(buckets, pa.list_(pa.int64()))]),
        })

    packed = docs.select("text").mapInArrow(scatter, "part int, payload binary")
    return packed.groupBy("part").applyInArrow(gather, "a long, b long, members array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts (rep, th, text) that ``wanted(rep, th)`` names, each once."""
    held = filter_of(wanted.select("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            yield record.filter(pa.array(may_hold(held.value, record.column(0).to_numpy())))

    return docs.select("doc_id", "th", "text").mapInArrow(run, "rep long, th long, text string").dropDuplicates(["rep", "th"])


def _profiles(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """Rows (node, k1, n, profile) of the sets of ``wanted(rep, th, node)``: whether each cell holds an odd number of their shingles.

    The cells of two sets differ in no more places than the sets do.
    """
    held = filter_of(wanted.select("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            record = record.filter(pa.array(may_hold(held.value, record.column(0).to_numpy())))
            for start, stop in slices(record.column(1)):
                keys, bounds, sets = shingle_sets(record.column(1).slice(start, stop - start), words)
                packed = [parities(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([names_of(sets), pa.array(sets[:, 0]), pa.array(np.diff(bounds)), pa.array(packed, pa.binary())], ["node", "k1", "n", "profile"])

    found = docs.select("doc_id", "text").mapInArrow(run, "node binary, k1 long, n long, profile binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def parities(keys: np.ndarray) -> bytes:
    """A bit a cell: whether an odd number of shingles falls there. Cells are a power of two, 64 at least, never fewer for a larger set."""
    cells = min(MOST_CELLS, max(64, CELLS_A_SHINGLE << max(len(keys) - 1, 0).bit_length()))
    return np.packbits(np.bincount((keys % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(profiles: list[bytes], size: int) -> np.ndarray:
    """Profiles of one length as rows of ``size`` bytes; longer ones are folded onto as many cells."""
    cells = np.frombuffer(b"".join(profiles), np.uint64).reshape(len(profiles), -1, size // 8)
    return np.bitwise_xor.reduce(cells, axis=1)


def _near(n_x, n_y, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and parities by cell allow the threshold; arrays broadcast."""
    fits = OF * np.minimum(n_x, n_y) >= AT_LEAST * np.maximum(n_x, n_y)
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return fits & (apart <= (n_x + n_y) * (OF - AT_LEAST) // (OF + AT_LEAST))


def near_rows(n_x: np.ndarray, n_y: np.ndarray, x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Row by row, whether sizes and profiles of two columns allow the threshold."""
    ok = np.zeros(len(n_x), bool)
    lengths = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for a, b in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths[:, 0] == a) & (lengths[:, 1] == b))
        sides = [folded([column[i] for i in at], min(a, b)) for column in (x, y)]
        ok[at] = _near(n_x[at], n_y[at], *sides)
    return ok


def near_across(own: np.ndarray, label: np.ndarray, n: np.ndarray, profiles: list[bytes]) -> list[tuple[int, int]]:
    """Of sets in ascending order of size, the pairs of unlike ``own`` and ``label`` whose sizes and profiles allow the threshold."""
    pairs = []
    length = np.array([len(x) for x in profiles], np.int64)
    for size in np.unique(length):
        # Partners are at most a third larger, so their profiles are at most one length up.
        a, b, c = np.searchsorted(length, [size, size + 1, 2 * size + 1])
        cells = np.concatenate([folded(profiles[x:y], size) for x, y in ((a, b), (b, c)) if x < y])
        for i in range(a, b):
            end = min(c, int(np.searchsorted(n, n[i] * OF // AT_LEAST, side="right")))
            at = i + 1 + np.flatnonzero((label[i + 1:end] != label[i]) & (own[i + 1:end] != own[i]))
            if len(at):
                pairs += [(i, int(x)) for x in at[_near(n[i], n[at], cells[i - a], cells[at - a])]]
    return pairs


def _near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of halves of set keys, those (a, b) of sets that sizes and counts allow."""
    sides = [nodes.toDF(f"node_{x}", x, f"n_{x}", f"cells_{x}") for x in "ab"]
    sized = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").where(OF * F.least("n_a", "n_b") >= AT_LEAST * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            n_a, n_b = record.column(2).to_numpy(), record.column(3).to_numpy()
            ok = pa.array(near_rows(n_a, n_b, record.column(4).to_pylist(), record.column(5).to_pylist()))
            yield pa.RecordBatch.from_arrays([record.column(i).filter(ok) for i in (0, 1)], ["a", "b"])

    return _ordered(sized.select("node_a", "node_b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(run, "a binary, b binary"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocked(pairs: DataFrame, sizes: DataFrame, block_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs (a, b) with a task number ``part``: pairs around one hub meet there.

    A set's hub is the least of it and its partners. A hub whose sets exceed
    ``block_bytes`` is dealt into blocks of them; the pairs between two blocks
    share a part. What two later steps read is stored, so that it is made once.
    """
    spark = pairs.sparkSession
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    hubs = both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("hub"))
    around = materialise(pairs.join(hubs.toDF("a", "hub_a"), "a").join(hubs.toDF("b", "hub_b"), "b").select("a", "b", F.least("hub_a", "hub_b").alias("hub")))
    members = around.select("hub", F.explode(F.array("a", "b")).alias("node")).distinct()
    counts = members.join(sizes, "node").groupBy("hub").agg(F.sum("n").alias("shingles"))
    counts = materialise(counts.withColumn("blocks", F.ceil(8 * F.col("shingles") / block_bytes)))
    parts = parts_for(spark, 8 * int(counts.agg(F.sum("shingles")).first()[0] or 0))
    of = lambda side: F.pmod(F.xxhash64(side), F.col("blocks"))
    dealt = around.join(counts, "hub").select("a", "b", "hub", F.least(of("a"), of("b")).alias("i"), F.greatest(of("a"), of("b")).alias("j"))
    return materialise(dealt.select("a", "b", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(parts)).alias("part")), instead_of=[around, counts])


def _verified(pairs: DataFrame, docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that reach the threshold.

    Texts travel, not their sets, which are larger: each once for all its pairs
    of a part.
    """
    blocked = _blocked(pairs, wanted.select("node", "n"))
    sends = materialise(blocked.select(F.col("part").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct().join(wanted.select("node", "rep", "th"), "node").select("to", "rep", "th"))
    texts = sends.join(_texts(docs, sends), ["rep", "th"]).select("to", "text")

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        held, column = {}, texts.column("text").combine_chunks()
        for start, stop in slices(column):
            keys, bounds, sets = shingle_sets(column.slice(start, stop - start), words)
            held |= {row.tobytes(): keys[a:b] for row, a, b in zip(np.ascontiguousarray(sets), bounds[:-1], bounds[1:], strict=True)}
        keep = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            both = np.concatenate([held[a], held[b]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(OF * common >= AT_LEAST * (len(both) - common))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return texts.groupBy("to").cogroup(blocked.groupBy("part")).applyInArrow(run, "a binary, b binary")


def _across(found: DataFrame, nodes: DataFrame, labels: DataFrame, block: int = BUCKET_BLOCK) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a larger bucket and may reach the threshold.

    ``nodes`` has node, k1, n and the parities by cell, ``labels`` node and label.
    Buckets that begin with the same set are one group, so that a set's cells
    travel once for all of them. A group is compared block against block, each
    task holding two blocks.
    """
    named = nodes.select("node", "k1").join(labels, "node")
    grouped = found.where("members is not null").select(F.col("members")[0].alias("bucket"), F.explode("members").alias("k1")).distinct()
    tagged = grouped.join(named, "k1")
    open_ = tagged.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high")
    open_ = open_.select("bucket", F.ceil(F.col("size") / block).alias("blocks"))
    rows = tagged.join(open_, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label").join(nodes.select("node", "n", "profile"), "node")
    members = rows.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("own", "node", "label", "n", "profile")).alias("rows")).select((F.col("i") == F.col("j")).alias("within"), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for within, rows in zip(record.column(0).to_pylist(), record.column(1), strict=True):
                order = rows.values.field("n").to_numpy().argsort(kind="stable")
                own, node, label, n, profile = rows.values.take(pa.array(order)).flatten()
                # Components by number; a block's own rows are compared where it meets itself.
                label = np.unique(np.array(label.to_pylist(), object), return_inverse=True)[1]
                own = np.arange(len(n)) if within else own.to_numpy()
                pairs = np.array(near_across(own, label, n.to_numpy(), profile.to_pylist()), np.int64).reshape(-1, 2)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(x)) for x in pairs.T], ["a", "b"])

    return _ordered(members.mapInArrow(run, "a binary, b binary"))


def _linked(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of documents (doc_id, text, th): their sizes, the classes of equal sets, and the links between classes."""
    read = materialise(_sizes(docs, words))
    sizes = read.where("not common").drop("common")
    common = read.where("common").groupBy("k1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k1").limit(COMMON).collect()
    live = docs.where("doc_id is not null")
    filled = sizes.where("doc_id is not null and n > 0")
    shingles = filled.agg(F.sum("n")).first()[0] or 0
    found = materialise(_meet(live, words, [tuple(r) for r in common], shingles))
    first = F.min(F.struct("doc_id", "th")).alias("first")
    classes = filled.groupBy("node").agg(first, F.first("n").alias("n"), F.first("k1").alias("k1")).select("node", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"), "n", "k1")

    pairs = found.where("members is null").select("a", "b").distinct()
    met = pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct()
    wanted = materialise(classes.join(met, "k1", "left_semi").select("rep", "th", "node", "n"))
    nodes = materialise(_profiles(live, words, wanted))

    # First each bucket's first set against the others; then what that left apart.
    tried = materialise(_near_pairs(pairs, nodes))
    links = materialise(_verified(tried, live, words, wanted))
    labels = materialise(nodes.select("node").join(components(links).toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("label")))
    open_pairs = materialise(_across(found, nodes, labels).join(tried, ["a", "b"], "left_anti"), instead_of=[labels])
    links = materialise(links.union(_verified(open_pairs, live, words, wanted)), instead_of=[links])
    discard(found, nodes, wanted)
    return sizes, classes, links


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes with the label of their component."""
    return classes.join(components(links).toDF("node", "component"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    docs = _named(docs, key, text)
    sizes, classes, links = _linked(docs, words)
    # Texts of one id are one document.
    several = sizes.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    same_id = sizes.where("n > 0").join(several.select("doc_id", "low"), "doc_id").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    labelled = _labelled(classes, links.union(same_id))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = labelled.join(least, "label").select("node", "component_id")
    out = sizes.join(of, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("th"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The text with the smallest id of each group of linked texts; texts without words or id all stay.

    Of rows with equal id and text one stays: the one whose columns have the least hash.
    """
    sizes, classes, links = _linked(_named(docs, key, text), words)
    rows = sizes.where("doc_id is not null and n > 0").join(_labelled(classes, links).select("node", "label"), "node")
    name = F.struct("doc_id", "node", "th")
    best = rows.groupBy("label").agg(F.min(name).alias("best"))
    drop = rows.join(best, "label").where(name != F.col("best")).select("doc_id", "th").distinct()
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    kept = held.where("doc_id is not null").join(drop, ["doc_id", "th"], "left_anti").groupBy("doc_id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").unionByName(held.where("doc_id is null").select("row.*"))
