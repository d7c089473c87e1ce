"""Benchmark passages in training texts, found by suffix arrays over the training words.

Each task sorts the suffixes of its shard (the words of a slice of texts) and
binary-searches every test suffix, all of them at once, in that array. The
bounds of those that begin with a test suffix's first words are the places where
its window occurs; the longest verbatim match at a place follows by comparing on.
Affected documents are those with a word inside an occurrence.

Words that no test text has cannot be in a match, so only runs of test words at
least as long as the shortest window are sorted. Words meet by 64-bit hashes;
whatever a hit covers is compared byte by byte with the test's words.

The training text is read where it lies, whole, without a shuffle. The test
texts, grouped by window, travel to every task in blocks of at most
``BLOCK_BYTES`` (a count of blocks that follows their measured size); more than
one block is one pass over the texts each, which hands on what it found.

Defined cases: words are runs of ASCII letters (A-Z lower-cased), digits and
characters beyond ASCII; a null or wordless text has no words and is clean; a
test text shorter than a window is one window; rows with one item id are one
item, and null ids count as the id ''; equal windows of several items hit for
all of them; empty tables give no rows, or clean documents; repeated documents
are judged alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbatch import TextBatch, slices
from tidemark.session import materialise

#: Words of a window.
WINDOW = 10
#: Bytes of test text that travel to the tasks at a time.
BLOCK_BYTES = 4 << 20
#: Tokens between texts: never a word.
BREAK = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_OUTSIDE = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _OUTSIDE[_a:_b] = False


class WordBatch(TextBatch):
    """Texts as lower-cased words of letters, digits and characters beyond ASCII."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        self.blank = _OUTSIDE[self.data]
        self.data = _LOWER[self.data]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def suffix_array(tokens: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``starts`` in the order of the suffixes there, told apart by their first ``depth`` tokens at least."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    reach = 1
    while reach < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[:-reach or None] = rank[reach:] if reach < len(rank) else 0
        joint = rank * (len(rank) + 2) + behind
        keys, rank = np.unique(joint, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        reach *= 2
        if len(keys) == len(rank):
            break
    return starts[np.argsort(rank[starts], kind="stable")]


@dataclass(frozen=True)
class Tests:
    """A block of test texts: their words, as tokens from 1, and their distinct windows.

    ``tokens`` holds all texts with breaks between, ``array`` its suffixes in order; a window is a place in it
    with a number of words, and ``items`` of window w are those from
    ``item_bounds[w]`` to ``item_bounds[w + 1]``.
    """

    hashes: np.ndarray
    order: np.ndarray
    word_bytes: np.ndarray
    word_bounds: np.ndarray
    tokens: np.ndarray
    array: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    items: np.ndarray
    item_bounds: np.ndarray
    shortest: int
    longest: int
    window: int


def tests_of(ids: list[str], texts: pa.Array, window: int = WINDOW) -> Tests | None:
    """The words and windows of test texts; None without any window."""
    batch = WordBatch(texts)
    begin, end, of = batch.words
    if not len(begin):
        return None
    words = [batch.data[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
    spelled = sorted(set(words))
    number = {w: i + 1 for i, w in enumerate(spelled)}
    bounds = np.searchsorted(of, np.arange(batch.n + 1))
    tokens, places = [BREAK], np.zeros(batch.n, np.int64)
    found: dict[bytes, tuple[int, int, set[str]]] = {}
    ids_of = np.array([number[w] for w in words], np.int64)
    for i in range(batch.n):
        own = ids_of[bounds[i]:bounds[i + 1]]
        places[i] = len(tokens)
        size = min(window, len(own))
        for j in range(len(own) - size + 1 if size else 0):
            found.setdefault(own[j:j + size].tobytes(), (len(tokens) + j, size, set()))[2].add(ids[i])
        tokens += [*own.tolist(), BREAK]
    at, sizes, items = zip(*found.values(), strict=True)
    hashes = WordBatch(pa.array([w.decode("utf-8", "surrogateescape") for w in spelled], pa.string())).word_hashes
    order = np.argsort(hashes)
    longest = int(np.bincount(of).max())
    tokens = np.array(tokens, np.int64)
    return Tests(
        hashes[order], order + 1, np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, 0, *map(len, spelled)]), tokens, suffix_array(tokens, np.flatnonzero(tokens), longest),
        np.array(at, np.int64), np.array(sizes, np.int64), np.array([x for s in items for x in sorted(s)], object), np.cumsum([0, *map(len, items)]), int(min(sizes)), longest, window,
    )


def compared(tokens: np.ndarray, suffixes: np.ndarray, tests: Tests, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as a suffix is before, begins with, or is after the first words of a test suffix."""
    out = np.zeros(len(suffixes), np.int8)
    active = np.arange(len(suffixes))
    step = 0
    while len(active):
        active = active[size[active] > step]
        mine, other = tokens[suffixes[active] + step], tests.tokens[place[active] + step]
        out[active] = np.sign(mine - other)
        active = active[mine == other]
        step += 1
    return out


def search(tokens: np.ndarray, array: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For every window the bounds in the suffix array of the suffixes that begin with it."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(tests.at), np.int64), np.full(len(tests.at), len(array))
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            side = compared(tokens, array[middle], tests, tests.at[open_], tests.sizes[open_])
            right = side <= 0 if upper else side < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
            open_ = open_[low[open_] < high[open_]]
        bounds.append(low)
    return bounds[0], bounds[1]


def agreement(tokens: np.ndarray, suffixes: np.ndarray, tests: Tests, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from each pair of places agree, and the sign of the first difference."""
    out, sign = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
    active = np.arange(len(suffixes))
    while len(active):
        mine, other = tokens[suffixes[active] + out[active]], tests.tokens[place[active] + out[active]]
        sign[active] = np.sign(mine - other)
        active = active[(mine == other) & (mine != BREAK)]
        out[active] += 1
    return out, sign


def longest_at(tokens: np.ndarray, suffixes: np.ndarray, tests: Tests) -> np.ndarray:
    """The longest verbatim match with any test text that begins at each place: one search in the tests' own suffix array."""
    low, high = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(tests.array))
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        after = agreement(tokens, suffixes[open_], tests, tests.array[middle])[1] > 0
        low[open_[after]] = middle[after] + 1
        high[open_[~after]] = middle[~after]
        open_ = open_[low[open_] < high[open_]]
    # The longest match is beside the place where the suffix would go.
    sides = [np.clip(low - k, 0, len(tests.array) - 1) for k in (0, 1)]
    return np.maximum(*(agreement(tokens, suffixes, tests, tests.array[at])[0] for at in sides))


@dataclass
class Found:
    """Occurrences in a shard: the word each begins at, its window and number of words, and the longest match there."""

    word: np.ndarray
    window: np.ndarray
    size: np.ndarray
    length: np.ndarray


def occurrences(batch: WordBatch, tests: Tests) -> Found:
    """All occurrences of the windows in a shard."""
    begin, end, of = batch.words
    nothing = Found(*(np.zeros(0, np.int64) for _ in range(4)))
    if not len(begin):
        return nothing
    at = np.minimum(np.searchsorted(tests.hashes, batch.word_hashes), len(tests.hashes) - 1)
    known = tests.hashes[at] == batch.word_hashes
    word_of = np.where(known, tests.order[at], BREAK)
    while True:
        # Runs of known words within a text, at least as long as the shortest window.
        new = np.append(True, (of[1:] != of[:-1]) | (word_of[1:] == BREAK) | (word_of[:-1] == BREAK))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(of)))
        kept = (word_of[first] != BREAK) & (length >= tests.shortest)
        first, length = first[kept], length[kept]
        if not len(first):
            return nothing
        inside = ranges(first, length)
        spot = np.arange(len(inside)) + np.repeat(np.arange(len(first)), length)
        tokens = np.full(len(inside) + len(first) + 1, BREAK)
        tokens[spot] = word_of[inside]
        word_at = np.zeros(len(tokens), np.int64)
        word_at[spot] = inside
        array = suffix_array(tokens, spot, tests.longest)
        low, high = search(tokens, array, tests)
        window = np.repeat(np.arange(len(low)), high - low)
        suffix = array[ranges(low, high - low)]
        wrong = _misspelled(batch, word_at[suffix], tests.sizes[window], word_of, tests)
        if not len(wrong):
            places, back = np.unique(suffix, return_inverse=True)
            # A match shorter than a window counts where it is a whole test text.
            length = longest_at(tokens, places, tests)[back]
            return Found(word_at[suffix], window, tests.sizes[window], np.where(length >= tests.window, length, tests.sizes[window]))
        word_of[wrong] = BREAK  # another word with a test word's hash


def _misspelled(batch: WordBatch, word: np.ndarray, size: np.ndarray, word_of: np.ndarray, tests: Tests) -> np.ndarray:
    """Covered words whose bytes are not those of the test word they stand for."""
    begin, end, _ = batch.words
    covered = np.unique(ranges(word, size))
    name = word_of[covered]
    lengths = tests.word_bounds[name + 1] - tests.word_bounds[name]
    differs = lengths != end[covered] - begin[covered]
    equal = np.flatnonzero(~differs)
    sizes = lengths[equal]
    same = batch.data[ranges(begin[covered[equal]], sizes)] == tests.word_bytes[ranges(tests.word_bounds[name[equal]], sizes)]
    differs[np.repeat(equal, sizes)[~same]] = True
    return covered[differs]


FOUND = "n_words long, longest long, spans array<struct<first:long,after:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def judge_batch(texts: pa.Array, tests: Tests | None) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: its words, its longest match, the spans of words inside occurrences, and the items found."""
    batch = WordBatch(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.n)]
    items: list[list[str]] = [[] for _ in range(batch.n)]
    longest = np.zeros(batch.n, np.int64)
    found = occurrences(batch, tests) if tests else None
    if found is not None and len(found.word):
        of = batch.words[2]
        base = np.searchsorted(of, np.arange(batch.n))
        hit = np.zeros(len(of) + 1, bool)
        hit[ranges(found.word, found.size)] = True
        edge = np.flatnonzero(np.diff(np.append(False, hit).astype(np.int8)) == 1)
        owner = of[found.word]
        np.maximum.at(longest, owner, found.length)
        for a in edge:  # a run of hit words may reach into the next text
            while a < len(of) and hit[a]:
                text = of[a]
                stop = a + int(np.argmin(np.append(hit[a:np.searchsorted(of, text, side="right")], False)))
                spans[text].append((int(a - base[text]), int(stop - base[text])))
                a = stop
        pairs = np.unique(np.stack([owner, found.window], axis=1), axis=0)
        for text in np.unique(pairs[:, 0]):
            own = pairs[np.searchsorted(pairs[:, 0], text):np.searchsorted(pairs[:, 0], text, side="right"), 1]
            items[text] = sorted({x for w in own for x in tests.items[tests.item_bounds[w]:tests.item_bounds[w + 1]]})
    return batch.n_words, longest, spans, items


def united(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two lists of spans as one, in order and apart."""
    out: list[tuple[int, int]] = []
    for first, after in sorted([*left, *right]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((first, after))
    return out


def _pass(docs: DataFrame, text: str, tests: Tests | None, again: bool) -> DataFrame:
    """The texts judged by one block of tests, on top of what an earlier pass found."""
    held = docs.sparkSession.sparkContext.broadcast(tests)
    at = docs.columns.index(text)
    names = [f.name for f in docs.schema.fields]
    kept = names[:-4] if again else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(at)):
                part = record.slice(start, stop - start)
                n_words, longest, spans, items = judge_batch(part.column(at), held.value)
                if again:
                    earlier = [c.to_pylist() for c in part.columns[-3:]]
                    longest = np.maximum(longest, np.array(earlier[0], np.int64))
                    spans = [united([(s["first"], s["after"]) for s in a], b) for a, b in zip(earlier[1], spans, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(earlier[2], items, strict=True)]
                made = [pa.array(n_words), pa.array(longest), pa.array([[{"first": a, "after": b} for a, b in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *made], [*kept, "n_words", "longest", "spans", "items"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:len(kept)])
    return docs.mapInArrow(run, f"{schema}, {FOUND}")


def find_matches(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id, text``, what is carried, ``n_words``, the ``longest`` match of a window or more, ``spans`` of hit words and ``items`` found."""
    named = tests.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    sized = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-sized // block_bytes))
    out = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *(c for c in carry))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for b in range(blocks):
        held = named.where(block == b).toArrow().combine_chunks()
        texts = held.column("text").combine_chunks() if len(held) else pa.array([], pa.string())
        earlier = out
        out = _pass(out, "text", tests_of(held.column("id").to_pylist(), texts, window), bool(b))
        if b < blocks - 1:
            out = materialise(out, instead_of=[earlier])
    return out


def hit_words() -> Column:
    """The words inside spans, of a row of :func:`find_matches`."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])


def judge_documents(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest``."""
    found = find_matches(docs, tests, **options)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest",
    )


def remove_contaminated(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any test passage, as they were."""
    others = tuple(c for c in docs.columns if c not in (key, text))
    renamed = docs.withColumnsRenamed({c: f"_kept_{c}" for c in others})
    found = find_matches(renamed, tests, key, text, carry=tuple(f"_kept_{c}" for c in others), **options).where(F.size("spans") == 0)
    return found.select(F.col("doc_id").alias(key), F.col("text").alias(text), *(F.col(f"`_kept_{c}`").alias(c) for c in others)).select(*docs.columns)
