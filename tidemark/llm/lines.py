"""Removal of repeated lines across a corpus, near-equal ones included.

Lines within ``threshold`` edits of each other are linked. A line is cut into
``threshold + 1`` segments, of which one survives the edits: each line indexes
its own segments and probes the substrings that a shorter or equal partner's
segment can have moved to, given both lengths (the multi-match-aware ranges).
Lines that meet are verified by a banded bit-parallel edit distance, once what
they share at either end is stripped. Of each component of links the first line
stays, by document id and place, and the others go.

Defined cases: lines are what line feeds separate; lines without a word stay and
are never compared; lines of fewer than ``shortest`` characters are compared
exactly only; a null text stays null; a null id comes after all others; rows
equal in id and text are one document, and each of them keeps the same lines; an
empty table gives an empty result; other columns pass through. A document may
lose all its lines; its text is then empty. Lines are told apart by hashes of
128 bits, candidates by 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linking import filter_of, link, may_hold, meet, pack_entries
from tidemark.llm.textbatch import BASE, SPACES, mix, powers, slices
from tidemark.session import materialise

THRESHOLD, SHORTEST = 2, 20
SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Counters of a line's sketch: 4 bits each, beside 8 bits of its length.
COUNTERS = 14


class CodeLines:
    """Lines of some texts as ranges of code points, with their hashes."""

    def __init__(self, texts: pa.Array):
        strings = pc.fill_null(texts, "").to_pylist()
        joined = "\n".join(strings)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        feeds = np.flatnonzero(self.codes == 0x0A)
        self.starts = np.append(0, feeds + 1) if strings else np.zeros(0, np.int64)
        self.ends = np.append(feeds, len(self.codes)) if strings else np.zeros(0, np.int64)
        first = np.cumsum([0, *(len(s) + 1 for s in strings)])[:-1]
        self.of = np.searchsorted(first, self.starts, side="right") - 1
        opening = np.searchsorted(self.starts, first)
        self.number = np.arange(len(self.starts)) - opening[self.of] if strings else self.starts
        filled = np.append(0, np.cumsum(~np.isin(self.codes, SPACES)))
        self.has_word = filled[self.ends] > filled[self.starts]
        self.prefix = self._prefix(BASE)

    def _prefix(self, base: np.uint64) -> np.ndarray:
        out = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * powers(len(self.codes), base)[0], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
        prefix = self.prefix if base == BASE else self._prefix(base)
        return mix((prefix[ends] - prefix[starts]) * powers(len(self.codes) + 1, base)[1][starts] + (ends - starts).astype(np.uint64))

    def sketches(self, at: np.ndarray) -> np.ndarray:
        """Counts of characters by class, modulo 16, and the length, modulo 256."""
        out = (self.ends[at] - self.starts[at]).astype(np.uint64) & np.uint64(0xFF)
        kind = self.codes % COUNTERS
        for c in range(COUNTERS):
            total = np.append(0, np.cumsum(kind == c))
            out |= ((total[self.ends[at]] - total[self.starts[at]]).astype(np.uint64) & np.uint64(15)) << np.uint64(8 + 4 * c)
        return out


def near_sketches(x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """False where two lines surely differ by more edits: an edit moves at most two counters by one."""
    apart = ((x & np.uint64(0xFF)) - (y & np.uint64(0xFF))) & np.uint64(0xFF)
    ok = np.minimum(apart, np.uint64(256) - apart) <= threshold
    total = np.zeros(len(x), np.int64)
    for c in range(COUNTERS):
        shift = np.uint64(8 + 4 * c)
        apart = (((x >> shift) & np.uint64(15)) - ((y >> shift) & np.uint64(15))) & np.uint64(15)
        total += np.minimum(apart, np.uint64(16) - apart).astype(np.int64)
    return ok & (total <= 2 * threshold)


def segment(length: np.ndarray, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the i-th of threshold + 1 nearly equal segments; the later ones are longer."""
    base, rest = np.divmod(length, threshold + 1)
    longer = np.maximum(0, i - (threshold + 1 - rest))
    return i * base + longer, base + (i >= threshold + 1 - rest)


def probes(length: np.ndarray, threshold: int, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(segment number, lines, starts, lengths) of the substrings to index and to probe.

    The probe of a line's own length at the segment's own place is its index entry.
    """
    for i in range(threshold + 1):
        for shorter in range(threshold + 1):
            start, size = segment(length - shorter, i, threshold)
            low = np.maximum(start - i, start + shorter - (threshold - i))
            high = np.minimum(start + i, start + shorter + (threshold - i))
            for shift in range(-threshold, 2 * threshold + 1):
                at = start + shift
                fits = np.flatnonzero((at >= np.maximum(low, 0)) & (at <= high) & (at + size <= length) & (length - shorter >= shortest))
                if len(fits):
                    yield i, fits, at[fits], size[fits]


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most the threshold.

    One machine word a number of errors holds which diagonals of the band are
    alive; the sweep ends when none is.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[len(x) - n:][::-1] != y[len(y) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    x, y = x[:len(x) - tail].tolist(), y[:len(y) - tail].tolist()
    if not x or not y:
        return max(len(x), len(y)) <= threshold
    band, m = (1 << (2 * threshold + 1)) - 1, len(y)
    alive = [0] * (threshold + 1)
    alive[0] = 1 << threshold
    for k in range(1, threshold + 1):
        alive[k] = (alive[k - 1] << 1) & band
    for i, c in enumerate(x):
        same = inside = reach = 0
        for d in range(2 * threshold + 1):
            j = i + d - threshold
            if 0 <= j < m:
                inside |= 1 << d
                if y[j] == c:
                    same |= 1 << d
            if 0 <= j + 1 <= m:
                reach |= 1 << d
        now = [alive[0] & same]
        for k in range(1, threshold + 1):
            now.append(((alive[k] & same) | (alive[k - 1] & inside) | (alive[k - 1] >> 1) | (now[k - 1] << 1)) & reach)
        alive = now
        if not any(alive):
            return False
    end = m - len(x) + threshold
    return any(state >> end & 1 for state in alive)


def _line_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, line, h1, h2) of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(2)):
                lines = CodeLines(record.column(2).slice(start, stop - start))
                at = np.flatnonzero(lines.has_word)
                owner = pa.array(lines.of[at] + start)
                hashes = [lines.hashes(lines.starts[at], lines.ends[at], base).view(np.int64) for base in (BASE, SECOND_BASE)]
                yield pa.RecordBatch.from_arrays([record.column(0).take(owner), record.column(1).take(owner), pa.array(lines.number[at].astype(np.int32)), *map(pa.array, hashes)], ["doc_id", "th", "line", "h1", "h2"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, line int, h1 long, h2 long")


def _near_lines(docs: DataFrame, threshold: int, shortest: int) -> DataFrame:
    """``node, component`` of lines (by first hash) that are linked with a different line."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return near_sketches(x, y, threshold)

    def distinct(column: pa.Array) -> tuple[CodeLines, np.ndarray, np.ndarray]:
        lines = CodeLines(column)
        at = np.flatnonzero(lines.has_word & (lines.ends - lines.starts >= shortest))
        h1, first = np.unique(lines.hashes(lines.starts[at], lines.ends[at]), return_index=True)
        return lines, at[first], h1

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(0)):
                lines, at, h1 = distinct(record.column(0).slice(start, stop - start))
                found = [np.zeros((2, 0), np.uint64)]
                for i, which, begin, size in probes(lines.ends[at] - lines.starts[at], threshold, shortest):
                    begin = begin + lines.starts[at][which]
                    found.append(np.stack([mix(lines.hashes(begin, begin + size) + np.uint64(i + 1)), which.astype(np.uint64)]))
                bucket, which = np.concatenate(found, axis=1)
                order = np.lexsort((bucket, which))
                bucket, which = bucket[order], which[order].astype(np.int64)
                new = np.ones(len(bucket), bool)
                new[1:] = (bucket[1:] != bucket[:-1]) | (which[1:] != which[:-1])
                part, payloads = pack_entries(bucket[new], h1.view(np.int64)[which[new]], lines.sketches(at)[which[new]], parts)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(payloads, pa.binary())], ["part", "payload"])

    packed = docs.select("text").mapInArrow(scatter, "part int, payload binary")
    found = materialise(meet(packed, near))
    nodes = found.where("nodes is null").select(F.col("a").alias("node")).union(found.where("nodes is null").select("b")).union(found.where("nodes is not null").select(F.explode("nodes"))).distinct()
    wanted = materialise(nodes)
    held = filter_of(wanted)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(0)):
                lines, at, h1 = distinct(record.column(0).slice(start, stop - start))
                keep = may_hold(held.value, h1.view(np.int64))
                body = [lines.codes[lines.starts[i]:lines.ends[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in at[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)[keep]), pa.array(body, pa.string())], ["node", "body"])

    bodies = materialise(docs.select("text").mapInArrow(texts, "node long, body string").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("body").alias("body")))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b").select("a", "b", "x", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in batches:
                keep = pa.array([within(x, y, threshold) for x, y in zip(record.column(2).to_pylist(), record.column(3).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([record.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    return link(found, near, verify)


def drop_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` (with keys doc_id, th) without the line numbers in ``removed.lines``; adds n_lines and n_removed."""
    joined = docs.join(removed.toDF("_d", "_t", "lines"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    feed = F.split("text", "\n")
    kept = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(feed, lambda line, i: ~F.array_contains("lines", i)), "\n"))
    return joined.withColumns({"text": kept, "n_lines": F.coalesce(F.size(feed), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("lines"), F.lit(0)).cast("long")}).drop("_d", "_t", "lines")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shortest: int = SHORTEST, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, the text that stays, and the columns to ``carry`` along."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carry).withColumn("th", F.xxhash64("text"))
    rows = materialise(_line_rows(docs).distinct())
    linked = _near_lines(docs, threshold, shortest)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line")
    classes = rows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n")).join(linked.withColumnRenamed("node", "h1"), "h1", "left").where("n > 1 or component is not null")
    heads = classes.withColumns({"c1": F.coalesce("component", "h1"), "c2": F.when(F.col("component").isNull(), F.col("h2"))})
    firsts = heads.groupBy("c1", "c2").agg(F.min("first").alias("head"))
    named = heads.join(firsts.toDF("f1", "f2", "head"), (F.col("c1") == F.col("f1")) & F.col("c2").eqNullSafe(F.col("f2"))).select("h1", "h2", "head")
    gone = rows.join(named, ["h1", "h2"]).where(order != F.col("head"))
    removed = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return drop_lines(docs, removed).select("doc_id", "n_lines", "n_removed", "text", *carry)
