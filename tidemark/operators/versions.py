"""Versioned tables: diffs, publish decisions, observations and merges.

Comparisons stack both sides and count copies by (key, row text) in combinable
aggregates. No join is needed, and neither repeated rows nor one heavy key can
collect in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import canonical
from .ordered import keep_first, keep_last

STAGE_SHARE = 0.5
#: Outcomes after which a partition shows the new answer.
SHOWN = ("appended", "replaced", "restated")
# Key fields a vendor fills in later; a fill is not a removal.
BACKFILLED = {"disclosure_date": ("actual_date",), "dividend": ("ann_date",)}
# The fields of an unlock event.
UNLOCK_FIELDS = ("ts_code", "ann_date", "float_date", "float_share", "float_ratio", "holder_name", "share_type")


def _shape(df: DataFrame, keys: Sequence[str], values: Sequence[str], side: str) -> DataFrame:
    """Canonical keys, the canonical values as an array, and the side's mark."""
    cell = lambda name: canonical(F.col(name), df.schema[name].dataType) if name in df.columns else F.lit("")
    row = F.array(*[cell(name) for name in values]).cast("array<string>")
    return df.select(*[cell(key).alias(key) for key in keys], row.alias("_row"), F.lit(int(side == "old")).alias("_o"), F.lit(int(side == "new")).alias("_n"))


def value_columns(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> list[str]:
    return sorted((set(old.columns) | set(new.columns)) - set(keys))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: ``added``, ``removed``, ``changed`` or ``same``.

    Values compare as canonical text; a repeated key compares as the multiset
    of its rows. ``old_row``/``new_row`` hold the values of unrepeated keys.
    """
    values = value_columns(old, new, keys)
    stacked = _shape(old, keys, values, "old").unionByName(_shape(new, keys, values, "new"))
    copies = stacked.groupBy(*keys, "_row").agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))
    per_key = copies.groupBy(*keys).agg(
        F.sum("_o").alias("old_rows"), F.sum("_n").alias("new_rows"), F.max(F.col("_o") != F.col("_n")).alias("_differs"),
        F.max(F.when(F.col("_o") > 0, F.col("_row"))).alias("_old"), F.max(F.when(F.col("_n") > 0, F.col("_row"))).alias("_new"))
    status = F.when(F.col("new_rows") == 0, "removed").when(F.col("old_rows") == 0, "added").when(F.col("_differs"), "changed").otherwise("same")
    single = (F.col("old_rows") <= 1) & (F.col("new_rows") <= 1)
    return per_key.select(*keys, "old_rows", "new_rows", status.alias("status"), F.when(single, F.col("_old")).alias("old_row"), F.when(single, F.col("_new")).alias("new_row"))


def diff_counts(changes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Keys by status."""
    return changes.groupBy(*group).agg(
        F.count_if(F.col("old_rows") > 0).alias("old_keys"), F.count_if(F.col("new_rows") > 0).alias("new_keys"),
        *[F.count_if(F.col("status") == name).alias(name) for name in ("added", "removed", "changed")])


def changed_columns(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value column differs among changed, unrepeated keys."""
    both = changes.where((F.col("status") == "changed") & F.col("old_row").isNotNull() & F.col("new_row").isNotNull())
    counts = both.agg(*[F.count_if(F.col("old_row")[i] != F.col("new_row")[i]).alias(f"_{i}") for i in range(len(columns))])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"_{i}").alias("changes")) for i, name in enumerate(columns)]))
    return counts.select(rows.alias("r")).select("r.*").where("changes > 0")


def dedupe_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row with the smallest canonical text per key, whatever the order served."""
    return keep_first(df, keys, *[canonical(F.col(name)) for name in df.columns])


def dropped_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("dropped"))


def removal_share(old: DataFrame, new: DataFrame, keys: Sequence[str], dataset: str = "") -> DataFrame:
    """Held and removed keys, on the key minus the vendor's late-filled fields."""
    stable = [key for key in keys if key not in BACKFILLED.get(dataset, ())]
    counts = diff_counts(diff(old.select(*stable), new.select(*stable), stable))
    return counts.select(F.col("old_keys").alias("held"), "removed", F.coalesce(F.try_divide("removed", "old_keys"), F.lit(0.0)).alias("share"))


def classify_publish(old: DataFrame, new: DataFrame, keys: Sequence[str], dataset: str = "", *, truncated: bool = False) -> DataFrame:
    """What publishing ``new`` over ``old`` would be, as one row.

    An empty answer over held rows is a defect; losing more than half the keys
    is staged; otherwise appended, restated, or unchanged.
    """
    counts = diff_counts(diff(old, new, keys))
    share = removal_share(old, new, keys, dataset)
    same_columns = set(old.columns) == set(new.columns)
    moved = (F.col("added") + F.col("removed") + F.col("changed")) > 0
    joined = counts.join(F.broadcast(share.select("share")))
    outcome = (
        F.when((F.col("old_keys") > 0) & (F.col("new_keys") == 0), "defect")
        .when(~moved & F.lit(same_columns), "unchanged")
        .when(F.lit(not truncated) & (F.col("removed") > 0) & (F.col("share") > STAGE_SHARE), "staged")
        .when((F.col("removed") + F.col("changed")) > 0, "restated").otherwise("appended"))
    return joined.withColumn("outcome", outcome)


def classify_partitions(old: DataFrame, new: DataFrame, claims: DataFrame, partition: str, keys: Sequence[str], dataset: str = "") -> DataFrame:
    """Outcome and key counts of every claimed partition, whether or not the answer holds rows of it.

    ``claims`` has the partition and ``exists`` (true where one is held). The
    removed share is counted on the key minus the vendor's late-filled fields.
    """
    stable = [key for key in keys if key not in BACKFILLED.get(dataset, ())]
    counts = diff_counts(diff(old, new, keys), [partition])
    if stable == list(keys):
        counts = counts.withColumns({"stable_held": F.col("old_keys"), "stable_removed": F.col("removed")})
    else:
        share = diff_counts(diff(old.select(*stable), new.select(*stable), stable), [partition])
        counts = counts.join(share.select(partition, F.col("old_keys").alias("stable_held"), F.col("removed").alias("stable_removed")), partition, "left")
    met = claims.join(counts, partition, "left").fillna(0, [c for c in counts.columns if c != partition])
    moved = F.col("added") + F.col("removed") + F.col("changed")
    outcome = (
        F.when(F.col("exists").isNull(), "appended").when((F.col("old_keys") > 0) & (F.col("new_keys") == 0), "defect").when(moved == 0, "unchanged")
        .when((F.col("removed") > 0) & (F.col("stable_removed") > STAGE_SHARE * F.col("stable_held")), "staged")
        .when(F.col("removed") + F.col("changed") > 0, "restated").otherwise("appended"))
    return met.select(partition, "old_keys", "new_keys", "added", "removed", "changed", outcome.alias("outcome"))


# -- versions and observations -----------------------------------------------------


def visible_versions(pointers: DataFrame, when: Column | None = None) -> DataFrame:
    """Version each partition shows: the last pointer written (by ``when``).

    Pointers are appended only, so a restore or promotion is one more row and
    an interrupted writer leaves the former version in force.
    """
    seen = pointers.where(F.col("instant") <= when) if when is not None else pointers
    return seen.groupBy("partition").agg(F.max_by("version", "instant").alias("version"), F.max("instant").alias("visible_since"))


def read_visible(store: DataFrame, pointers: DataFrame, when: Column | None = None) -> DataFrame:
    """Rows of the visible version of every partition."""
    shown = visible_versions(pointers, when).select("partition", "version")
    return store.join(shown, ["partition", "version"], "left_semi")


def restore(pointers: DataFrame, partition: str, version: str, instant: Column) -> DataFrame:
    """The pointer table after putting a kept version back in force."""
    row = pointers.sparkSession.range(1).select(F.lit(partition).alias("partition"), F.lit(version).alias("version"), instant.alias("instant"))
    return pointers.unionByName(row)


def update_observations(observed: DataFrame, held: DataFrame, keys: Sequence[str], instant: Column, visible_since: Column | None = None) -> DataFrame:
    """Observations plus first-seen rows of keys not yet observed.

    Observations later than the visible partition belong to a landing that
    never completed and are dropped first.
    """
    valid = observed.where(F.col("first_seen_at") <= visible_since) if visible_since is not None else observed
    fresh = held.select(*keys).distinct().join(valid, list(keys), "left_anti").withColumn("first_seen_at", instant)
    return valid.select(*keys, "first_seen_at").unionByName(fresh)


def rebuild_observations(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First-seen instants from retained states (``state``, ``visible_since``, keys).

    A key counts from the first state that newly holds it and knows its
    instant. A key has at most one row per retained version.
    """
    held = states.groupBy(*keys, "state").agg(F.max("visible_since").alias("visible_since"))
    order = Window.partitionBy(*keys).orderBy("state")
    before = F.lag("state").over(order)
    starts = held.withColumn("_before", before).where((F.col("_before").isNull() | (F.col("_before") < F.col("state") - 1)) & F.col("visible_since").isNotNull())
    return starts.groupBy(*keys).agg(F.min_by("visible_since", "state").alias("first_seen_at"))


def dataset_vintage(pointers: DataFrame, dataset: str) -> DataFrame:
    """Identity of a dataset's restated state: a hash over its version pointers.

    One entry per restated partition, so the list is metadata-sized.
    """
    entry = F.concat_ws("\t", "partition", "restated_id")
    lines = pointers.where("restated_id is not null").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return lines.select(F.substring(F.sha2(F.array_join(F.concat(F.array(F.lit(dataset)), F.col("_l")), "\n"), 256), 1, 16).alias("vintage"))


# -- merges -----------------------------------------------------------------------


def merge_window(existing: DataFrame, refreshed: DataFrame, day: str, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Replace the rows of a date window by the answer; repeated keys keep the new row.

    An empty answer for a window that holds rows is refused.
    """
    inside = F.col(day).between(start, end)
    if refreshed.isEmpty() and not existing.where(inside).isEmpty():
        raise ValueError(f"empty answer for a window {start}..{end} that holds rows")
    kept = existing.where(~F.coalesce(inside, F.lit(False))).withColumn("_new", F.lit(0))
    merged = kept.unionByName(refreshed.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    if not keys:
        return merged.drop("_new")
    order = [F.coalesce(canonical(F.col(name)), F.lit("")) for name in existing.columns]
    return keep_last(merged, keys, "_new", *order).drop("_new")


def calendar_conflicts(old: DataFrame, new: DataFrame, today: Column, keys: Sequence[str] = ("exchange", "cal_date")) -> DataFrame:
    """Elapsed days whose open flag or previous day the new calendar changes."""
    checked = [name for name in ("is_open", "pretrade_date") if name in old.columns and name in new.columns]
    a = old.where(F.col("cal_date") <= today).select(*keys, *[F.col(c).alias(f"_old_{c}") for c in checked])
    both = a.join(new, list(keys))
    differs = F.lit(False)
    for name in checked:
        differs = differs | (canonical(F.col(f"_old_{name}")) != canonical(F.col(name)))
    return both.where(differs).select(*keys)


def merge_calendar(old: DataFrame, new: DataFrame, today: Column, keys: Sequence[str] = ("exchange", "cal_date")) -> DataFrame:
    """New rows win, unless they rewrite a day that has already passed."""
    bad = calendar_conflicts(old, new, today, keys).limit(5).collect()
    if bad:
        raise ValueError(f"calendar revises elapsed days: {[tuple(row) for row in bad]}")
    merged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(merged, keys, "_new").drop("_new")


def _identity(df: DataFrame) -> DataFrame:
    """Physical identity columns with the holder's spacing ignored."""
    return df.withColumn("_holder", F.regexp_replace(F.coalesce("holder_name", F.lit("")), r"\s+", "")).withColumn("_ann", F.coalesce(F.trim("ann_date"), F.lit("")))


IDENTITY = ["ts_code", "float_date", "_holder", "share_type"]


def drop_undated(df: DataFrame) -> DataFrame:
    """Drop an undated row whose identity and amount also have a dated row."""
    marked = _identity(df).withColumn("_share", F.col("float_share").try_cast("double"))
    twins = marked.where("_ann <> ''").select(*IDENTITY, "_share").distinct().withColumn("_dated", F.lit(True))
    joined = marked.join(twins, [*IDENTITY, "_share"], "left")
    return joined.where((F.col("_ann") != "") | F.col("_dated").isNull()).select(*df.columns)


def unlock_groups(baseline: DataFrame, active: DataFrame) -> DataFrame:
    """Distinct rows of both sides with what becomes of them, in one stacked pass.

    Flags: ``in_base``; ``superseded`` (its event was re-dated by dated, uncut
    evidence and its own date has none); ``stays`` (part of the union). Answers
    cut at the row cap never delete: only uncut ones name an event's newest
    announcement, and undated rows rank below every date. A physical event has
    a few announcements, so windows over it are small.
    """
    cap = F.coalesce(F.col("source_cap_risk").cast("boolean"), F.lit(False))
    sides = baseline.select(*UNLOCK_FIELDS, F.lit(True).alias("_b"), F.lit(None).cast("boolean").alias("_cap")).unionByName(
        active.select(*UNLOCK_FIELDS, F.lit(False).alias("_b"), cap.alias("_cap")))
    rows = sides.groupBy(*UNLOCK_FIELDS).agg(F.max("_b").alias("in_base"), F.min("_cap").alias("_cap"))
    rows = _identity(rows).withColumn("_share", F.col("float_share").try_cast("double")).repartition(*IDENTITY)
    event, dated = Window.partitionBy(*IDENTITY), Window.partitionBy(*IDENTITY, "_ann")
    answered, uncut = F.col("_cap").isNotNull(), F.coalesce(~F.col("_cap"), F.lit(False))
    rows = rows.withColumns({"_newest": F.max(F.when(uncut, F.col("_ann"))).over(event), "_uncut": F.max(uncut).over(dated), "_answered": F.max(answered).over(dated)})
    newest = F.coalesce("_newest", F.lit(""))
    fresh, known = answered & (F.col("_ann") >= newest), F.col("_answered") & (F.col("_ann") >= newest)
    replaced = F.col("_uncut") & (F.col("_ann") == newest)
    superseded = F.col("in_base") & (newest != "") & ~known
    rows = rows.withColumns({"superseded": superseded, "_in": fresh | (F.col("in_base") & ~replaced & ~superseded)})
    # An undated row goes when its event and amount also have a dated one in the union.
    twin = F.max(F.col("_in") & (F.col("_ann") != "")).over(Window.partitionBy(*IDENTITY, "_share"))
    lonely = (F.col("_ann") != "") | F.col("_share").isNull() | ~twin
    return rows.withColumn("stays", F.col("_in") & lonely).select(*UNLOCK_FIELDS, "_holder", "_ann", "in_base", "superseded", "stays")


def unlock_shrink(groups: DataFrame) -> DataFrame:
    """Distinct event groups before and after, the sanctioned re-dated ones, and whether the union shrinks beyond them."""
    each = groups.groupBy(*IDENTITY, "_ann").agg(*[F.max(name).alias(name) for name in ("in_base", "stays", "superseded")])
    counts = each.agg(F.count_if("in_base").alias("before"), F.count_if("stays").alias("after"), F.count_if("superseded").alias("superseded"))
    return counts.withColumn("shrinks", F.col("after") < F.col("before") - F.col("superseded"))


def merge_unlocks(baseline: DataFrame, active: DataFrame) -> DataFrame:
    """Union of a baseline with refreshed event groups.

    A group refreshed by an uncut answer replaces its baseline group; an event
    re-dated by dated, uncut evidence replaces its old dating; undated copies
    of dated rows go. Shrinking beyond re-dated groups fails the job.
    """
    groups = unlock_groups(baseline, active)
    lost = F.concat(F.lit("the union would shrink event groups from "), F.col("before").cast("string"), F.lit(" to "), F.col("after").cast("string"))
    allowed = F.when(F.col("shrinks"), F.raise_error(lost).cast("boolean")).otherwise(True)
    verdict = unlock_shrink(groups).select(allowed.alias("_allowed"))
    return groups.where("stays").join(F.broadcast(verdict)).where("_allowed").select(*UNLOCK_FIELDS)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows whose number of copies differs, with both counts."""
    names = sorted(a.columns)
    if names != sorted(b.columns):
        raise ValueError(f"different columns: {names} and {sorted(b.columns)}")
    stacked = a.select(*names, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*names, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return stacked.groupBy(*names).agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")).where("in_a <> in_b")


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same columns and the same rows as multisets, in any order."""
    return sorted(a.columns) == sorted(b.columns) and multiset_difference(a, b).isEmpty()


def drop_dupes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without exact repeats, and how many repeats went."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.drop("_n"), copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("dropped"))


def collapse_answers(answers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Overlapping answers as one table; the earliest answer's row is kept."""
    out = None
    for number, answer in enumerate(answers):
        part = answer.withColumn("_answer", F.lit(number))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return keep_first(out, keys, "_answer").drop("_answer")


# -- refresh records ---------------------------------------------------------------

OPENING = ("defect", "staged")


def fold_outcomes(events: DataFrame) -> DataFrame:
    """Per dataset: last refresh, and partitions whose latest outcomes are open issues.

    ``open_since`` is the first event of the partition's current run of
    failures, that is after its last good outcome.
    """
    bad = F.col("outcome").isin(*OPENING)
    good_at = events.groupBy("dataset", "partition").agg(F.max(F.when(~bad, F.col("at"))).alias("_good"))
    joined = events.join(good_at, ["dataset", "partition"])
    late = bad & (F.col("_good").isNull() | (F.col("at") > F.col("_good")))
    partitions = joined.groupBy("dataset", "partition").agg(
        F.max(F.when(~bad, F.col("at"))).alias("_refreshed"), F.min(F.when(late, F.col("at"))).alias("_open"))
    return partitions.groupBy("dataset").agg(
        F.max("_refreshed").alias("refreshed_at"), F.count("_open").alias("open_issues"), F.min("_open").alias("open_since"))


def unready(datasets: DataFrame, folded: DataFrame, launches: DataFrame, when: Column) -> DataFrame:
    """Datasets not refreshed since their last due launch, or with open issues.

    ``datasets`` maps dataset to node; ``launches`` is the job instance table.
    """
    due = launches.where(F.col("ready") <= when).groupBy("node").agg(F.max("start").alias("due"))
    joined = datasets.join(F.broadcast(due), "node", "left").join(folded, "dataset", "left")
    reason = (
        F.when(F.coalesce("open_issues", F.lit(0)) > 0, "open_issue").when(F.col("refreshed_at").isNull(), "never_refreshed")
        .when(F.col("refreshed_at") < F.col("due"), "stale"))
    return joined.withColumn("reason", reason).where("reason is not null").select("dataset", "node", "due", "refreshed_at", "reason")


def partition_gaps(have: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without a partition, and partitions nobody expects."""
    missing = expected.select(*keys).distinct().join(have, list(keys), "left_anti").select(*keys, F.lit("missing").alias("problem"))
    extra = have.select(*keys).distinct().join(expected, list(keys), "left_anti").select(*keys, F.lit("extra").alias("problem"))
    return missing.unionByName(extra)
