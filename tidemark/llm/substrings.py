"""Removal of passages that repeat across a corpus.

Two kinds of paragraphs are compared. Lines of at least ``min_words`` words are
linked when their five-word shingles reach a Jaccard similarity of 0.75: MinHash
bands (3 rows, 12 bands: 99.9 % of the pairs at the threshold collide) propose
pairs, the exact similarity decides, and components of the links keep one line.
Passages inside longer lines are found by cutting every text where a word pair's
hash is the smallest among its neighbours: the cuts depend on nearby words only,
not on line feeds, so a passage is cut alike wherever and however wrapped it stands. The windows of ``min_words`` words
that start at a cut or a line's begin, or end at a line's end, are compared; one
that occurred before, the same words in one place, is removed.

The first occurrence (smallest document id, then hash of the text, then place)
stays. Repeated windows are counted by hash in ranges, each task sending a window
once for each slice of its texts, so a passage that a third of all documents
share is no hot key.

Defined cases: words are runs of characters other than ASCII white space; a null
text stays null; rows with a null id come after all others; rows equal in id and
text are one document and keep the same words, any other rows are documents of
their own; a text may end up empty; an empty table gives an empty result; other
columns are not looked at. Windows, lines and the texts of one id are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linking import filter_of, link, may_hold, meet, pack_entries
from tidemark.llm.textbatch import BASE, TextBatch, distinct_per_text, mix, powers, slices
from tidemark.session import materialise

WORDS, AT_LEAST, OF = 5, 75, 100
ROWS, BANDS = 3, 12
MIN_WORDS = 20
#: A cut is the least word-pair hash among this many neighbours on either side.
NEIGHBOURS = 4
#: Lines of a bucket that is listed pair by pair; larger ones are compared in their task.
LISTED = 4
#: Cells of a matrix that counts common shingles (4 bytes each).
CELLS_AT_A_TIME = 1 << 22
LAST = (1 << 63) - 1
WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("unit", "<u4"), ("many", "u1")])
_RANDOM = np.random.default_rng(20).integers(1, 1 << 62, (ROWS * BANDS, 2)).astype(np.uint64)


class Units:
    """Lines and pieces of some texts, as ranges of words."""

    def __init__(self, texts: pa.Array):
        self.batch = TextBatch(texts)
        self.starts, self.ends, self.of = self.batch.words
        self.words = self.batch.word_hashes
        feeds = np.append(0, np.cumsum(self.batch.data == 0x0A))
        self.line = feeds[self.starts] + self.of  # a text's end parts lines as a line feed does
        new = np.ones(len(self.line), bool)
        new[1:] = self.line[1:] != self.line[:-1]
        self.line_begin = np.flatnonzero(new)
        self.line_words = np.diff(np.append(self.line_begin, len(self.line)))
        self.line_number = feeds[self.starts[self.line_begin]] - feeds[self.batch.offsets[self.of[self.line_begin]]]
        self.prefix = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * powers(len(self.words))[0], out=self.prefix[1:])

    def sequence(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each range of words."""
        return mix((self.prefix[end] - self.prefix[begin]) * powers(len(self.words) + 1)[1][begin] + (end - begin).astype(np.uint64))

    @cached_property
    def long_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the lines with enough words."""
        at = np.flatnonzero(self.line_words >= MIN_WORDS)
        return at, self.sequence(self.line_begin[at], self.line_begin[at] + self.line_words[at])

    @cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of every piece."""
        n = len(self.words)
        pair = self.words.copy()
        same = self.of[1:] == self.of[:-1]
        pair[:-1][same] = self.words[:-1][same] * BASE + self.words[1:][same]
        pair = mix(pair)
        cut = np.ones(n, bool)
        for step in range(1, min(NEIGHBOURS, n - 1) + 1):
            near = self.of[step:] == self.of[:-step]
            cut[step:] &= ~near | (pair[step:] < pair[:-step])
            cut[:-step] &= ~near | (pair[:-step] < pair[step:])
        begin = np.ones(n, bool)
        begin[1:] = cut[:-1] | ~same
        first = np.flatnonzero(begin)
        return first, np.append(first[1:], n)

    @cached_property
    def opening(self) -> np.ndarray:
        """First word of every text."""
        return np.searchsorted(self.of, np.arange(self.batch.n))

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows to compare; inside a piece without cuts one starts every ``size`` words."""
        first, end = self.pieces
        more = (end - first - 1) // size
        inner = np.repeat(first, more) + size * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        at = np.unique(np.concatenate([first, inner, self.line_begin, self.line_begin + self.line_words - size]))
        at = at[(at >= 0) & (at + size <= len(self.of))]
        return at[self.of[at] == self.of[at + size - 1]]

    def shingles(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of some lines in ascending order, and the place of the line in ``lines``."""
        wanted = np.full(len(self.line_begin), -1)
        wanted[lines] = np.arange(len(lines))
        rank = np.repeat(np.arange(len(self.line_begin)), self.line_words)
        keys, _, at = self.batch.grams(WORDS)
        inside = (rank[at] == rank[at + WORDS - 1]) & (wanted[rank[at]] >= 0)
        return distinct_per_text(keys[inside], wanted[rank[at[inside]]])


def band_hashes(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Per set of shingles (grouped by ``of``) one hash for each band."""
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    out = np.zeros((len(begin), BANDS), np.uint64)
    for k, (shift, factor) in enumerate(_RANDOM):
        if len(begin):
            least = np.minimum.reduceat((keys ^ shift) * (factor | np.uint64(1)), begin)
            out[:, k // ROWS] = mix(out[:, k // ROWS] * BASE + least + np.uint64(k))
    return out


def near_sizes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two numbers of shingles allow the similarity."""
    return OF * np.minimum(x, y) >= AT_LEAST * np.maximum(x, y)


def similar(x: bytes, y: bytes) -> bool:
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return OF * common >= AT_LEAST * (len(both) - common)


def common_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in turn how many members it shares with every set.

    Members that only one set has are left out of the counting, which is a
    product of 0/1 matrices in blocks of bounded size.
    """
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[token] > 1
    order = np.argsort(token[shared], kind="stable")
    owner, token = owner[shared][order], token[shared][order]
    token = np.cumsum(np.append(0, np.diff(token) > 0)) if len(token) else token
    width = max(1, CELLS_AT_A_TIME // n)
    rows = max(1, CELLS_AT_A_TIME // n)
    for top in range(0, n, rows):
        total = np.zeros((min(rows, n - top), n), np.float32)
        for left in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            a, b = np.searchsorted(token, [left, left + width])
            block = np.zeros((n, width), np.float32)
            block[owner[a:b], token[a:b] - left] = 1
            total += block[top:top + rows] @ block.T
        for i, row in enumerate(total):
            yield top + i, row


def bucket_links(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """As many true links of one bucket as join what its true links join."""
    size, label, links = np.array([len(s) for s in sets]), component.copy(), []
    for i, both in common_counts(sets):
        at = np.flatnonzero((label != label[i]) & (OF * both >= AT_LEAST * (size + size[i] - both)))
        while len(at):
            links.append((int(node[i]), int(node[at[0]])))
            label[label == label[at[0]]] = label[i]
            at = at[label[at] != label[i]]
    return links


def _linked_lines(docs: DataFrame, parts: int) -> DataFrame:
    """``node, component`` of long lines (by hash) that are linked with a different line."""

    def distinct(column: pa.Array) -> tuple[Units, np.ndarray, np.ndarray]:
        units = Units(column)
        at, keys = units.long_lines
        keys, first = np.unique(keys, return_index=True)
        return units, at[first], keys.view(np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(0)):
                units, at, nodes = distinct(record.column(0).slice(start, stop - start))
                keys, of = units.shingles(at)
                bands = band_hashes(keys, of)
                size = np.bincount(of, minlength=len(at)).astype(np.uint64)
                part, payloads = pack_entries(bands.ravel(), np.repeat(nodes, BANDS), np.repeat(size, BANDS), parts)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(payloads, pa.binary())], ["part", "payload"])

    found = materialise(meet(docs.select("text").mapInArrow(scatter, "part int, payload binary"), near_sizes, LISTED))
    nodes = materialise(found.where("nodes is null").select(F.col("a").alias("node")).union(found.where("nodes is null").select("b")).union(found.where("nodes is not null").select(F.explode("nodes"))).distinct())
    held = filter_of(nodes)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(0)):
                units, at, node = distinct(record.column(0).slice(start, stop - start))
                keep = may_hold(held.value, node)
                keys, of = units.shingles(at[keep])
                bounds = np.searchsorted(of, np.arange(int(keep.sum()) + 1))
                packed = [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(packed, pa.binary())], ["node", "shingles"])

    shingles = materialise(docs.select("text").mapInArrow(sets, "node long, shingles binary").join(nodes, "node", "left_semi").dropDuplicates(["node"]))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(shingles.toDF("a", "x"), "a").join(shingles.toDF("b", "y"), "b").select("a", "b", "x", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in batches:
                keep = pa.array([similar(x, y) for x, y in zip(record.column(2).to_pylist(), record.column(3).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([record.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def inside(rows: DataFrame) -> DataFrame:
        held = rows.select("bucket", "node", "component").join(shingles, "node").groupBy("bucket").agg(F.collect_list(F.struct("node", "component", "shingles")).alias("rows")).select("rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for record in batches:
                for members in record.column(0):
                    node, component, sets = members.values.flatten()
                    links = bucket_links(node.to_numpy(), component.to_numpy(), [np.frombuffer(x, np.uint64) for x in sets.to_pylist()])
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        return held.mapInArrow(run, "a long, b long")

    return link(found, near_sizes, verify, inside)


def _repeated_windows(docs: DataFrame, parts: int, size: int) -> DataFrame:
    """Rows (key, doc, th, unit): windows that occur more than once, with their first place."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(2)):
                units = Units(record.column(2).slice(start, stop - start))
                first = units.windows(size)
                rows = np.zeros(len(first), WINDOW)
                rows["key"], rows["unit"] = units.sequence(first, first + size), first - units.opening[units.of[first]]
                for k, name in enumerate(("doc", "th")):
                    rows[name] = record.column(k).to_numpy()[start:stop][units.of[first]]
                part = (rows["key"] >> np.uint64(44)) % np.uint64(parts)
                rows = rows[np.lexsort((rows["unit"], rows["th"], rows["doc"], rows["key"], part))]
                new = np.append(True, rows["key"][1:] != rows["key"][:-1])[:len(rows)]
                counts = np.diff(np.append(np.flatnonzero(new), len(rows)))
                rows = rows[new]
                rows["many"] = counts > 1
                part = ((rows["key"] >> np.uint64(44)) % np.uint64(parts)).astype(np.int32)
                bounds = np.concatenate([np.flatnonzero(np.append(True, np.diff(part) != 0)), [len(part)]]) if len(part) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["part", "payload"])

    def gather(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("payload").to_pylist()), WINDOW)
        rows = rows[np.lexsort((rows["unit"], rows["th"], rows["doc"], rows["key"]))]
        begin = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
        many = np.maximum.reduceat(rows["many"], begin) | (np.diff(np.append(begin, len(rows))) > 1)
        rows = rows[begin[many > 0]]
        return pa.table({"key": pa.array(np.ascontiguousarray(rows["key"]).view(np.int64)), "first_doc": pa.array(np.ascontiguousarray(rows["doc"])), "first_th": pa.array(np.ascontiguousarray(rows["th"])), "first_unit": pa.array(rows["unit"].astype(np.int64))})

    return docs.select("id", "th", "text").mapInArrow(scatter, "part int, payload binary").groupBy("part").applyInArrow(gather, "key long, first_doc long, first_th long, first_unit long")


def _places(docs: DataFrame, windows, lines, size: int) -> DataFrame:
    """Rows (window, key, id, th, unit) of windows and long lines that the two filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            ids, hashes = (record.column(k).to_numpy() for k in (0, 1))
            for start, stop in slices(record.column(2)):
                units = Units(record.column(2).slice(start, stop - start))
                first = units.windows(size)
                at, node = units.long_lines
                for is_window, keys, owner, number, held in ((True, units.sequence(first, first + size), units.of[first], first - units.opening[units.of[first]], windows.value), (False, node, units.of[units.line_begin[at]], units.line_number[at], lines.value)):
                    keys = keys.view(np.int64)
                    keep = may_hold(held, keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), is_window)), pa.array(keys[keep]), pa.array(ids[start:stop][owner[keep]]), pa.array(hashes[start:stop][owner[keep]]), pa.array(number[keep].astype(np.int64))], ["window", "key", "id", "th", "unit"])

    return docs.select("id", "th", "text").mapInArrow(run, "window boolean, key long, id long, th long, unit long")


def removed_words(units: Units, owner: np.ndarray, number: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words go: those of the named ranges, and of the named lines, whose ``size`` is 0."""
    ranges = size > 0
    begin = units.opening[owner[ranges]] + number[ranges]
    change = np.zeros(len(units.words) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + size[ranges], -1)
    gone = np.cumsum(change)[:-1] > 0
    lines = {(int(o), int(n)) for o, n in zip(owner[~ranges], number[~ranges], strict=True)}
    if lines:
        mine = np.array([(int(o), int(n)) in lines for o, n in zip(units.of[units.line_begin], units.line_number, strict=True)], bool)
        gone |= np.repeat(mine, units.line_words)
    return gone


def cut_words(units: Units, gone: np.ndarray) -> np.ndarray:
    """Which bytes stay: a word goes with the blanks after it, and a line without any word left goes whole."""
    data, feeds = units.batch.data, np.flatnonzero(units.batch.data == 0x0A)
    stops = np.sort(np.concatenate([feeds, units.batch.offsets[1:]]))
    line_end = stops[np.searchsorted(stops, units.starts)] if len(units.starts) else units.starts
    until = line_end.copy()
    same = units.line[1:] == units.line[:-1]
    until[:-1][same] = units.starts[1:][same]
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, units.starts[gone], 1)
    np.add.at(change, until[gone], -1)
    left = np.bincount(np.repeat(np.arange(len(units.line_begin)), units.line_words), weights=~gone, minlength=len(units.line_begin))
    whole = np.flatnonzero(left == 0) if len(units.line_begin) else np.zeros(0, np.int64)
    opening = np.sort(np.concatenate([feeds + 1, units.batch.offsets[:-1]]))
    begin = opening[np.searchsorted(opening, units.starts[units.line_begin[whole]], side="right") - 1]
    end = line_end[units.line_begin[whole]]
    np.add.at(change, begin, 1)
    np.add.at(change, np.minimum(end + np.isin(end, feeds), len(data)), -1)
    return np.cumsum(change)[:-1] == 0


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the text that stays, n_words, n_removed (words), ``kept_in``, the ids that hold what was removed, and the columns to ``carry`` along."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carry).withColumns({"id": F.coalesce("doc_id", F.lit(LAST)), "th": F.xxhash64("text")})
    windows = materialise(_repeated_windows(docs, parts, min_words))
    linked = materialise(_linked_lines(docs, parts))
    places = materialise(_places(docs, filter_of(windows.select("key")), filter_of(linked.select("node")), min_words))
    # A later window that overlaps the first one in the same text leaves that one whole.
    spared = F.when((F.col("id") == F.col("first_doc")) & (F.col("th") == F.col("first_th")), F.greatest(F.lit(0), F.col("first_unit") + min_words - F.col("unit"))).otherwise(F.lit(0))
    again = places.where("window").join(windows, "key").where("id <> first_doc or th <> first_th or unit <> first_unit").withColumn("spared", spared)
    later = again.select("id", "th", (F.col("unit") + F.col("spared")).alias("unit"), (min_words - F.col("spared")).alias("size"), F.col("first_doc").alias("kept"))
    lines = places.where("not window").join(linked.withColumnRenamed("node", "key"), "key")
    place = F.struct("id", "th", "unit")
    heads = lines.groupBy("component").agg(F.min(place).alias("head"))
    behind = lines.join(heads, "component").where(place != F.col("head")).select("id", "th", "unit", F.lit(0).cast("long").alias("size"), F.col("head.id").alias("kept"))
    removed = later.union(behind).distinct().groupBy("id", "th").agg(F.collect_list(F.struct("unit", "size", "kept")).alias("gone"))
    joined = docs.join(removed, ["id", "th"], "left").select("doc_id", "text", "gone", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(1)):
                texts, gone = record.column(1).slice(start, stop - start), record.column(2).slice(start, stop - start)
                units, n = Units(texts), stop - start
                named = gone.flatten()
                number, size, kept = (x.to_numpy(zero_copy_only=False) for x in named.flatten())
                counts = np.array([0 if x is None else x for x in pc.list_value_length(gone).to_pylist()], np.int64)
                owner = np.repeat(np.arange(n), counts)
                out = removed_words(units, owner, number, size)
                stay = cut_words(units, out)
                bounds = np.append(0, np.cumsum(stay))[units.batch.offsets]
                body = units.batch.data[stay].tobytes()
                lost = np.bincount(units.of[out], minlength=n)
                held: list[list[int]] = [[] for _ in range(n)]
                for o, k in sorted(set(zip(owner.tolist(), kept.tolist(), strict=True))):
                    if lost[o] and k != LAST:
                        held[o].append(k)
                # A last line that went leaves the line feed before it.
                open_end = (lost > 0) & ~pc.fill_null(pc.ends_with(texts, "\n"), False).to_numpy(zero_copy_only=False)
                cut = [body[a:b].decode() if valid else None for valid, a, b in zip(texts.is_valid().to_pylist(), bounds[:-1], bounds[1:], strict=True)]
                cut = [t.removesuffix("\n") if t and strip else t for t, strip in zip(cut, open_end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([record.column(0).slice(start, n), pa.array(cut, pa.string()), pa.array(units.batch.n_words), pa.array(lost.astype(np.int64)), pa.array(held, pa.list_(pa.int64())), *(record.column(3 + i).slice(start, n) for i in range(len(carry)))], ["doc_id", "text", "n_words", "n_removed", "kept_in", *carry])

    carried = "".join(f", `{name}` {docs.schema[name].dataType.simpleString()}" for name in carry)
    return joined.mapInArrow(run, f"doc_id long, text string, n_words long, n_removed long, kept_in array<long>{carried}")
