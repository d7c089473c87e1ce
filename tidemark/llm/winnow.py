"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words (runs of characters other than ASCII white space) are hashed,
every window of ``k`` words gives a k-gram hash, and of every window of
``window`` consecutive k-grams the smallest hash is chosen, the rightmost where
several are equal. Chosen hashes keep their positions (first word of the k-gram).
Two texts that share ``k + window - 1`` words in a row share at least one chosen
hash. A text of fewer than ``k`` words has one k-gram of all its words.

Defined cases: a null text is an empty one, with an empty fingerprint; two empty
fingerprints are alike (likeness 1); rows of one document id are ordered by
their text's hash, and a null id comes after all others; an empty table gives an
empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 8
#: Ranges of ids for each shuffle partition; their cut points are the only thing the driver holds.
RANGES_A_PARTITION = 8


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def grams(text: Column, k: int) -> Column:
    """``array<struct<hash, position>>`` of all k-grams."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        all_grams = F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get(h, i + j) for j in range(k))).alias("hash"), i.alias("position")))
        return F.when(F.size(h) > 0, all_grams).otherwise(F.slice(all_grams, 1, 0))

    return let(hashes, of)


def lesser(a: Column, b: Column) -> Column:
    """The smaller hash, the later one where equal; ``b`` may be missing."""
    return F.when(b["hash"] <= a["hash"], b).otherwise(a)


def winnow(all_grams: Column, window: int) -> Column:
    """The chosen k-grams in order of position, each once.

    Minima over windows of 2, 4, 8, ... come from two halves, and the last step
    overlaps two of them to the full width.
    """

    def widen(t: Column, step: int) -> Column:
        return F.transform(t, lambda a, i: lesser(a, F.get(t, i + step)))

    def choose(t: Column) -> Column:
        full = F.slice(t, 1, F.greatest(F.size(t) - window + 1, F.least(F.size(t), F.lit(1))))
        return let(full, lambda m: F.filter(m, lambda a, i: (i == 0) | (a["position"] != F.get(m, i - 1)["position"])))

    def grow(t: Column, width: int) -> Column:
        if width == window:
            return choose(t)
        step = min(width, window - width)
        return let(widen(t, step), lambda wider: grow(wider, width + step))

    return let(all_grams, lambda t: grow(t, 1))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """``array<struct<hash, position>>`` of a text."""
    return winnow(grams(F.coalesce(text, F.lit("")), k), window)


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two fingerprints."""

    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda both: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(both / (F.size(x) + F.size(y) - both)))

    return let(F.array_distinct(a["hash"]), lambda x: let(F.array_distinct(b["hash"]), lambda y: of(x, y)))


def spelled(print_: Column) -> Column:
    """A fingerprint as one digest string."""
    return F.sha2(F.array_join(F.transform(print_, lambda g: F.concat_ws(":", F.hex(g["hash"]), g["position"].cast("string"))), " "), 256)


def range_of(cuts: list[int], value: Column) -> Column:
    """How many cuts exceed a value, by binary search; all for a null."""
    if not cuts:
        return F.lit(0)
    array = F.array(*(F.lit(c) for c in sorted(cuts, reverse=True)))
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(cuts).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) > value, at + step).otherwise(at))
    return F.when(value.isNull(), len(cuts)).otherwise(found)


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows in descending order of id by ranges, each range ended by the next one's first rows.

    The last range ends with the first rows of all. Rows so added are marked
    ``_ghost``; in the returned window every own row has its follower.
    """
    spark = docs.sparkSession
    n = RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = ", ".join(str(i / n) for i in range(1, n))
    cuts = docs.selectExpr(f"percentile_approx(doc_id, array({shares}), {20 * n}) as cuts").first()["cuts"] if n > 1 else []
    ranged = docs.withColumn("_range", range_of(sorted(set(cuts or [])), F.col("doc_id")))
    heads = sorted((row["_range"], row["head"]) for row in ranged.groupBy("_range").agg(F.max("doc_id").alias("head")).collect())
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    ends = spark.createDataFrame(before, "_head long, _ends int")
    joined = ranged.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_head")), "left").drop("_head")
    placed = F.array_compact(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost")), F.when(F.col("_ends").isNotNull(), F.struct(F.col("_ends").alias("range"), F.lit(True).alias("ghost")))))
    rows = joined.withColumn("_at", F.explode(placed)).select("doc_id", "text", F.col("_at.range").alias("_range"), F.col("_at.ghost").alias("_ghost"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    return rows, Window.partitionBy("_range").orderBy("_ghost", F.col("doc_id").desc(), F.col("_tie").desc())


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends in the beginning of the next document (descending id;
    after the last the first) in place of its own second half.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows, order = with_next(docs)
    chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring(F.lead("text").over(order), F.lit(1), half))
    rows = rows.select("*", edited.alias("edited"))
    rows = rows.select(
        "doc_id", "_range", "_ghost", "_tie", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), k, window).alias("fingerprint"),
        F.when(~F.col("_ghost"), fingerprint(F.col("edited"), k, window)).alias("edited_fingerprint"),
    )
    rows = rows.select("*", F.lead("fingerprint").over(order).alias("next_fingerprint")).where(~F.col("_ghost"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
