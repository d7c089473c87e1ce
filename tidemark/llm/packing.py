"""Packing of tokenised documents into sequences of a fixed length.

Token lengths are small integers, so the packing is decided on the histogram of
lengths (at most one number per length, however many documents there are).
First a reduction after Martello and Toth fixes sets that provably dominate all
alternatives: a piece that fits with no other stands alone, two pieces that fill
a sequence exactly are paired, and while at most one more piece fits beside the
longest one, it gets the longest that fits. The rest is packed best-fit in
descending length. Many equal sequences are handled as one group, so the work
does not grow with the number of documents. The plan is a list of runs, "the
pieces of this length with these ranks go to these sequences at this offset";
every piece is numbered within its length by Spark and looks up its run.

Defined cases: a null text counts as empty; only pieces longer than the capacity
are cut; rows with one document id are packed each by itself; an empty table
gives an empty result; columns other than key and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textbatch import TextBatch, slices
from tidemark.session import materialise

#: Distinct chunks of text whose ids a Python worker remembers; the memory starts anew beyond it.
REMEMBERED = 1_000_000
#: Chunks put to the tokenizer at a time.
CHUNKS_A_CALL = 20_000


class ChunkTokenizer:
    """Ids of chunks of text between ASCII white space, each distinct chunk tokenised once.

    For tokenizers whose normaliser and pre-tokenizer never look across white
    space; then the ids of a text are those of its chunks, end to end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.offsets, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.sorted_keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        counts, ids = [], []
        for at in range(0, len(chunks), CHUNKS_A_CALL):
            part = chunks[at:at + CHUNKS_A_CALL]
            encoding = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(c) + 1 for c in part)])
            first = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding.ids))
            counts.append(np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(part)))
            ids.append(np.array(encoding.ids, np.uint32))
        self.keys = np.concatenate([self.keys, keys])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(counts))])
        self.ids = np.concatenate([self.ids, *ids])
        self.slot = np.argsort(self.keys, kind="stable")
        self.sorted_keys = self.keys[self.slot]

    def encode(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch end to end, and how many each text has."""
        starts, ends, of = batch.words
        keys, first, chunk = np.unique(batch.word_hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.sorted_keys, keys)
        known = at < len(self.sorted_keys)
        known[known] = self.sorted_keys[at[known]] == keys[known]
        if not known.all():
            new = np.flatnonzero(~known)
            data = batch.data.tobytes()
            self._learn(keys[new], [data[starts[i]:ends[i]].decode() for i in first[new]])
            at = np.searchsorted(self.sorted_keys, keys)
        slot = self.slot[at] if len(keys) else np.zeros(0, np.int64)
        begin, length = self.offsets[slot][chunk], (self.offsets[slot + 1] - self.offsets[slot])[chunk]
        total = np.cumsum(length)
        place = np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + length, length)
        return self.ids[place], np.bincount(of, weights=length, minlength=batch.n).astype(np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of tokenised documents: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids end in ``end_id``; only documents longer than ``capacity``
    are cut, into pieces of that length and a last one that may be shorter.
    """
    docs = docs.select(F.col(key), F.col(text).cast("string"))
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for record in batches:
            for start, stop in slices(record.column(1)):
                batch = TextBatch(record.column(1).slice(start, stop - start))
                flat, counts = tokenizer.encode(batch)
                bounds = np.cumsum([0, *counts])
                rows, ids = [], []
                for n in range(batch.n):
                    own = np.append(flat[bounds[n]:bounds[n + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at:at + capacity]
                        rows.append((n + start, k, at, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            ids.append(part.astype(np.int64))
                columns = np.array(rows, np.int64).reshape(-1, 5).T
                arrays = [record.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c) for c in columns[2:])]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


class Plan:
    """Runs of pieces: length, first rank, end rank, first sequence, pieces a sequence, offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.used = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def _take(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), int(self.used[length]) + n, sequence, each, offset))
        self.used[length] += n
        self.left[length] -= n

    def _pair(self, long: int, short: int, n: int) -> None:
        """n sequences of one piece of each length."""
        if not n:
            return
        if long == short:
            self._take(long, 2 * n, self.sequences, 2, 0)
        else:
            self._take(long, n, self.sequences, 1, 0)
            self._take(short, n, self.sequences, 1, long)
        self.sequences += n

    def _smallest(self, without: int) -> list[int]:
        """The two smallest lengths left beside one piece of a given length."""
        found: list[int] = []
        for length in np.flatnonzero(self.left)[:3]:
            found += [int(length)] * min(2, int(self.left[length]) - (length == without))
        return found[:2]

    def reduce(self) -> None:
        """Fix dominating sets until none is certain."""
        for long in range(self.capacity - 1, (self.capacity - 1) // 2, -1):
            short = self.capacity - long
            self._pair(long, short, int(self.left[long] // 2 if long == short else min(self.left[long], self.left[short])))
        for long in range(self.capacity, 0, -1):
            room = self.capacity - long
            while self.left[long]:
                small = self._smallest(long)
                if not small or small[0] > room:
                    n = int(self.left[long])
                    self._take(long, n, self.sequences, 1, 0)
                    self.sequences += n
                elif sum(small) > room or len(small) < 2:
                    fit = np.flatnonzero(self.left[:room + 1])
                    fit = fit[fit != long] if self.left[long] < 2 else fit
                    best = int(fit[-1])
                    self._pair(long, best, int(self.left[long] // 2 if best == long else min(self.left[long], self.left[best])))
                else:
                    return

    def best_fit(self) -> None:
        """Pack what is left, longest first, each piece where the least room stays."""
        groups: dict[int, list[tuple[int, int]]] = {}
        open_ = np.zeros(self.capacity + 1, bool)

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                groups.setdefault(room, []).append((first, n))
                open_[room] = True

        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                n = int(self.left[length])
                fits = np.flatnonzero(open_[length:])
                if len(fits):
                    room = length + int(fits[0])
                    first, many = groups[room].pop()
                    open_[room] = bool(groups[room])
                else:
                    room, first = self.capacity, self.sequences
                    many = max(1, n // (room // length))
                    self.sequences += many
                each = room // length
                whole = min(many, n // each)
                if whole:
                    self._take(length, whole * each, first, each, self.capacity - room)
                    put(room - each * length, first, whole)
                else:
                    self._take(length, n, first, n, self.capacity - room)
                    put(room - n * length, first, 1)
                    whole = 1
                put(room, first + whole, many - whole)

    def table(self) -> np.ndarray:
        """The runs as columns, by length and rank."""
        runs = np.array(self.runs, np.int64).reshape(-1, 6)
        return runs[np.lexsort((runs[:, 1], runs[:, 0]))].T


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; needs a column ``length`` of at most ``capacity``.

    ``pieces`` is read several times, so it should be a stored table. Ranks
    within a length come from counts by block and length; no length, however
    common, meets in one task.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    runs = spark.sparkContext.broadcast(Plan(counts, capacity).table())
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = rows.groupBy("_block", "length").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("_block", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block", "length").orderBy(*order))
    ranked = rows.withColumn("_rank", inside - 1).join(firsts, ["_block", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(*pieces.columns, "_rank")
    names = pieces.columns
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, begin, _, sequence, each, offset = runs.value
        keys = lengths * (1 << 44) + begin
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            inner = rank - begin[k]
            placed = [pa.array(sequence[k] + inner // each[k]), pa.array(offset[k] + inner % each[k] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *placed], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents; one row a piece."""
    pieces = materialise(cut_pieces(docs, tokenizer_path, capacity, end_id, key, text))
    return pack(pieces, capacity, (key, "piece", "start", "ids_crc32"))
