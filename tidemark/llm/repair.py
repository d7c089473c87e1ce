"""Cheapest edits that give a conversation the structure ``(s?(ua)+)?`` of role initials.

Each row is kept (cost 0), given the role user or assistant (1) or deleted (2);
an empty user or assistant row may be inserted anywhere (5); a truncated row
that stays adds 5; a blank or repeated row must go. Of the cheapest edits the
ones whose initials (D, I, K, R) in order are least in ASCII are taken.

One integer decides both. A path through the graph of (row, state of the
structure) has the weight ``cost * 2**width + letters``: the high digits carry
the cost, and each row owns a fixed-width slot of low digits that spell its
letters (inserts before it, then its own), filled up with zeros at the end. Two
paths agree up to a row and then differ in a letter, for a slot's letters end in
the only one that is no insert; so adding slots in place compares the audits as
strings, and the least integer is the answer, letters and all. No step is traced
back: the digits of the least weight are the edits.

On Spark, a block of ``BLOCK`` consecutive rows is a table of least weights from
state to state. Blocks of a longer conversation are steps of the same graph one
level up: their cost, and in place of letters the rank of their weight among
those from the same state, which orders as the letters do. So levels climb until
one block is left, and the chosen states come down again; no task holds more
than a block's rows. Places of rows come from range partitions. What is
sequential by nature, the digest of a conversation's whole repaired text, is a
stream over sorted rows that holds one row at a time.

Defined cases: a null role or text counts as one space, thus blank; rows ascend
by turn, null turns first, and rows of one turn by the SHA-256 of role and text;
a conversation without rows has zeros, no edits and the digest of nothing; rows
of a null id are one conversation; an empty table has none; other columns are
not looked at. A role's initial is its first character.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered
from tidemark.session import materialise

#: Letters of edits in ASCII order: a letter's digit is its place, from 1.
LETTERS = "DIKR"
DIGIT, INSERTS = 3, 2
SLOT = DIGIT * (INSERTS + 1)
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
#: States: nothing yet, after s, after u, after a; what follows an added row, and its role.
STATES = 4
ADDED = (2, 2, 3, 2)
ADDED_ROLE = ("user", "user", "assistant", "user")
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Rows added at the end, by state.
TAIL = ("", "II", "I", "")
#: Faults of a row, first fault first.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua-"
#: Rows (or blocks) that one task takes at a time.
BLOCK = 256
RANK = 2
FILLED = r"[^\x20\x09-\x0D]"
Layer = list[list[tuple[int, int, int]]]


def code_of(letters: str) -> int:
    """The digits of a slot, letters first, zeros behind."""
    return sum((LETTERS.index(c) + 1) << (SLOT - DIGIT * (i + 1)) for i, c in enumerate(letters))


def letters_of(code: int) -> str:
    digits = ((code >> (SLOT - DIGIT * (i + 1))) & 7 for i in range(INSERTS + 1))
    return "".join(LETTERS[d - 1] for d in digits if d)


def edges(initial: str, fault: int) -> Layer:
    """For each state the least (next state, cost, code) that takes a row of this kind."""
    out: Layer = []
    for state in range(STATES):
        best: dict[int, tuple[int, int]] = {}
        inside, letters = state, ""
        for _ in range(INSERTS + 1):
            ways = [("D", inside, 0)]
            if fault in (SOUND, TRUNCATED):
                stays = TRUNCATED_COST if fault == TRUNCATED else 0
                ways.append(("R", ADDED[inside], stays))
                ways += [("K", KEPT[initial][inside], stays)] if inside in KEPT.get(initial, ()) else []
            for letter, after, extra in ways:
                weight = (sum(COSTS[c] for c in letters + letter) + extra, code_of(letters + letter))
                best[after] = min(best.get(after, weight), weight)
            inside, letters = ADDED[inside], letters + "I"
        out.append([(after, *weight) for after, weight in sorted(best.items())])
    return out


#: Layers by row code: place of the initial times four, plus the fault.
ROW_LAYERS = [edges(initial, fault) for initial in INITIALS for fault in range(4)]


def least(layers: list[Layer], bits: int, starts: range | tuple[int, ...] = range(STATES)) -> list[list[int | None]]:
    """Least weights through all layers, from state to state; each layer owns ``bits`` low digits."""
    width = bits * len(layers)
    out: list[list[int | None]] = [[None] * STATES for _ in range(STATES)]
    for start in starts:
        now: list[int | None] = [None] * STATES
        now[start] = 0
        shift = width
        for layer in layers:
            shift -= bits
            after: list[int | None] = [None] * STATES
            for state, weight in enumerate(now):
                if weight is not None:
                    for to, cost, code in layer[state]:
                        new = weight + (cost << width) + (code << shift)
                        if after[to] is None or new < after[to]:
                            after[to] = new
            now = after
        out[start] = now
    return out


def slots(weight: int, count: int, bits: int) -> list[int]:
    """The codes that a weight's low digits spell."""
    return [(weight >> (bits * (count - 1 - i))) & ((1 << bits) - 1) for i in range(count)]


def ranked(weights: list[list[int | None]], width: int) -> tuple[list[int], list[int]]:
    """Costs from state to state (-1: no way), and the ranks of the letters among those from one state."""
    costs, ranks = [], []
    mask = (1 << width) - 1
    for row in weights:
        order = sorted(w & mask for w in row if w is not None)
        costs += [-1 if w is None else w >> width for w in row]
        ranks += [-1 if w is None else order.index(w & mask) for w in row]
    return costs, ranks


def layer_of(costs: list[int], ranks: list[int]) -> Layer:
    """A block as one layer of the level above."""
    return [[(to, costs[STATES * s + to], ranks[STATES * s + to]) for to in range(STATES) if costs[STATES * s + to] >= 0] for s in range(STATES)]


def last_state(costs: list[int], ranks: list[int]) -> int:
    """Where a whole conversation's least weight ends, rows added at the end included."""
    ways = [(costs[q] + COSTS["I"] * len(TAIL[q]), ranks[q], code_of(TAIL[q]), q) for q in range(STATES) if costs[q] >= 0]
    return min(((cost << (RANK + SLOT)) + (rank << SLOT) + code, q) for cost, rank, code, q in ways)[1]


def apply_edits(state: int, letters: str, initial: str) -> tuple[list[str], str | None, int]:
    """Roles added before a row, the row's role (None: deleted, empty: as it is) and the state after."""
    added = []
    for letter in letters:
        if letter == "I":
            added.append(ADDED_ROLE[state])
            state = ADDED[state]
        elif letter == "D":
            return added, None, state
        elif letter == "R":
            return added, ADDED_ROLE[state], ADDED[state]
        else:
            return added, "", KEPT[initial][state]
    return added, None, state


MATRIX = "costs array<int>, ranks array<int>"
INTS = pa.list_(pa.int32())


def _mapped(df: DataFrame, schema: str, make: Callable[[dict], list[dict]], kinds: pa.Schema) -> DataFrame:
    """Rows made of each row, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [out for row in batch.to_pylist() for out in make(row)]
            yield pa.RecordBatch.from_pylist(made, kinds)

    return df.mapInArrow(run, schema)


def faults(rows: DataFrame) -> DataFrame:
    """Rows ``key, turn, role, text`` with ``copy, seal, initial`` and the faults that a row shows by itself."""
    sealed = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    blank, ended = ~F.col("text").rlike(FILLED), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    first = F.substring("role", 1, 1)
    return rows.withColumns({
        "seal": F.unhex(sealed),
        "initial": F.when(first.isin(*"sua"), first).otherwise(F.lit("-")),
        "own": F.when(blank, BLANK).when(ended, SOUND).otherwise(TRUNCATED),
    })


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Stored blocks of consecutive rows: ``key, position, n`` (of blocks), the rows' codes, the first row's order, and the matrix."""
    narrow = rows.select("key", "turn", "seal", "initial", "own")
    placed = materialise(numbered(narrow, ["key"], [F.col("turn").asc_nulls_first(), F.col("seal").asc()]))
    first = placed.groupBy("key", "seal").agg(F.min("position").alias("first"))
    seen = placed.join(first, ["key", "seal"])
    fault = F.when((F.col("own") != BLANK) & (F.col("position") > F.col("first")), DUPLICATE).otherwise(F.col("own"))
    code = F.expr(f"locate(initial, '{INITIALS}') - 1") * 4 + fault
    cut = seen.select("key", "turn", "seal", "position", F.ceil(F.col("n") / size).cast("long").alias("n"), F.floor(F.col("position") / size).cast("long").alias("block"), code.cast("int").alias("code"))
    # At most ``size`` rows a list.
    lists = cut.groupBy("key", "n", "block").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("rows"), F.min_by(F.struct("turn", "seal"), "position").alias("first"))
    lists = lists.select("key", F.col("block").alias("position"), "n", F.transform("rows", lambda r: r["code"]).alias("codes"), "first")
    known = {f.name: f.dataType.simpleString() for f in lists.schema.fields}
    turn = _arrow_kind(rows.schema["turn"].dataType.simpleString())
    kinds = pa.schema([("key", pa.string()), ("position", pa.int64()), ("n", pa.int64()), ("codes", INTS), ("first", pa.struct([("turn", turn), ("seal", pa.binary())])), ("costs", INTS), ("ranks", INTS)])

    def make(row: dict) -> list[dict]:
        weights = least([ROW_LAYERS[c] for c in row["codes"]], SLOT, range(STATES) if row["n"] > 1 else (0,))
        costs, ranks = ranked(weights, SLOT * len(row["codes"]))
        return [row | {"costs": costs, "ranks": ranks}]

    return materialise(_mapped(lists, ", ".join(f"{k} {v}" for k, v in known.items()) + f", {MATRIX}", make, kinds))


def _arrow_kind(name: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[name]


ITEM = pa.schema([("key", pa.string()), ("position", pa.int64()), ("n", pa.int64()), ("costs", INTS), ("ranks", INTS)])
STATE = pa.schema([("key", pa.string()), ("position", pa.int64()), ("state", pa.int32()), ("after", pa.int32())])


def _grouped(items: DataFrame, size: int) -> DataFrame:
    """Items of one block of the next level in a list, in order."""
    block = F.floor(F.col("position") / size).cast("long").alias("block")
    lists = items.groupBy("key", block, "n").agg(F.array_sort(F.collect_list(F.struct("position", "costs", "ranks"))).alias("items"))
    return lists.select("key", F.col("block").alias("position"), F.ceil(F.col("n") / size).cast("long").alias("n"), "items")


def states_of(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """The state before and after every block on its conversation's least path: ``key, position, state, after``."""

    def climb(row: dict) -> list[dict]:
        layers = [layer_of(x["costs"], x["ranks"]) for x in row["items"]]
        costs, ranks = ranked(least(layers, RANK), RANK * len(layers))
        return [{k: row[k] for k in ("key", "position", "n")} | {"costs": costs, "ranks": ranks}]

    def top(row: dict) -> list[dict]:
        return [{"key": row["key"], "position": 0, "state": 0, "after": last_state(row["costs"], row["ranks"])}]

    def descend(row: dict) -> list[dict]:
        layers = [layer_of(x["costs"], x["ranks"]) for x in row["items"]]
        weight = least(layers, RANK, (row["state"],))[row["state"]][row["after"]]
        out, state = [], row["state"]
        for x, rank in zip(row["items"], slots(weight, len(layers), RANK), strict=True):
            after = x["ranks"][STATES * state:STATES * (state + 1)].index(rank)
            out.append({"key": row["key"], "position": x["position"], "state": state, "after": after})
            state = after
        return out

    levels = [blocks.select("key", "position", "n", "costs", "ranks")]
    while not (several := levels[-1].where("n > 1")).isEmpty():
        levels.append(materialise(_mapped(_grouped(several, size), f"key string, position long, n long, {MATRIX}", climb, ITEM)))
    schema = "key string, position long, state int, after int"
    chosen = None
    for level in reversed(levels):
        tops = _mapped(level.where("n = 1").select("key", "position", "n", "costs", "ranks"), schema, top, STATE)
        if chosen is None:
            chosen = tops
        else:
            below = _mapped(_grouped(level.where("n > 1"), size).join(chosen, ["key", "position"]), schema, descend, STATE)
            chosen = materialise(tops.unionByName(below))
    return chosen


def chunks_of(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """The edits of every block: ``key, turn, seal`` of its first row, ``block, state, edits, faults, cost``."""
    turn = blocks.schema["first"].dataType["turn"].dataType.simpleString()
    kinds = pa.schema([("key", pa.string()), ("turn", _arrow_kind(turn)), ("seal", pa.binary()), ("block", pa.int64()), ("edits", pa.list_(pa.string())), ("faults", INTS), ("cost", pa.int64())])

    def make(row: dict) -> list[dict]:
        codes = row["codes"]
        weight = least([ROW_LAYERS[c] for c in codes], SLOT, (row["state"],))[row["state"]][row["after"]]
        edits = [letters_of(c) for c in slots(weight, len(codes), SLOT)]
        return [{"key": row["key"], **row["first"], "block": row["position"], "edits": edits, "faults": [c % 4 for c in codes], "cost": weight >> SLOT * len(codes)}]

    met = blocks.select("key", "position", "codes", "first").join(states, ["key", "position"])
    return _mapped(met, f"key string, turn {turn}, seal binary, block long, edits array<string>, faults array<int>, cost long", make, kinds)


class Conversation:
    """What a stream of one conversation's rows, with the edits of its blocks before them, comes to."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.initial = conv_id, 0, None
        self.edits: deque[tuple[str, int]] = deque()
        self.counts, self.illegal, self.cost = [0, 0, 0, 0], 0, 0
        self.low = self.high = None
        self.distinct = 0
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def chunk(self, edits: list[str], faults: list[int], cost: int) -> None:
        self.edits.extend(zip(edits, faults, strict=True))
        self.cost += cost

    def keep(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
        self.begun = True
        return role, text

    def row(self, turn, role: str, text: str) -> list[tuple[str, str]]:
        """The repaired rows that come of a row."""
        letters, fault = self.edits.popleft()
        initial = role[:1]
        self.counts[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        self.audit.append(letters)
        added, own, self.state = apply_edits(self.state, letters, initial if initial in "sua" else "-")
        return [self.keep(r, "") for r in added] + ([] if own is None else [self.keep(own or role, text)])

    def end(self) -> list[tuple[str, str]]:
        """The rows added after the last one."""
        letters = TAIL[self.state]
        self.cost += COSTS["I"] * len(letters)
        self.audit.append(letters)
        return [self.keep(r, "") for r in apply_edits(self.state, letters, "")[0]]

    def summary(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED],
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(),
        }


def _named(turns: DataFrame, key: str) -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))


def _stream(turns: DataFrame, conversations: DataFrame, rows_out: bool, size: int) -> DataFrame:
    """Summaries, or repaired rows, of all ``conversations(conv_id)``."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = faults(turns.select(_named(turns, "conv_id").alias("key"), "turn", *(c.alias(n) for n, c in spaced.items())))
    blocks = blocks_of(rows, size)
    chunks = chunks_of(blocks, states_of(blocks, size))
    heads = conversations.select("conv_id").distinct().withColumn("key", _named(conversations, "conv_id")).withColumn("kind", F.lit(0))
    parts = [
        heads.withColumn("step", F.lit(0)),
        chunks.withColumns({"kind": F.lit(1), "step": F.lit(0)}),
        rows.select("key", "turn", "seal", "role", "text").withColumns({"kind": F.lit(1), "step": F.lit(1)}),
    ]
    joined = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    sorted_ = joined.repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), F.col("seal").asc(), "step", "block")
    stream = sorted_.select("conv_id", "kind", "step", "turn", "role", "text", "edits", "faults", "cost")
    conv, turn = (conversations.schema["conv_id"].dataType.simpleString(), turns.schema["turn"].dataType.simpleString())
    if rows_out:
        schema, kinds = f"conv_id {conv}, place long, role string, text string", pa.schema([("conv_id", _arrow_kind(conv)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    else:
        counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        schema = f"conv_id {conv}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
        kinds = pa.schema([("conv_id", _arrow_kind(conv)), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        place = 0
        for batch in batches:
            out: list[dict] = []

            def emit(made: list[tuple[str, str]], out: list[dict] = out) -> None:
                nonlocal place
                if rows_out:
                    out += [{"conv_id": now.conv_id, "place": place + i, "role": r, "text": t} for i, (r, t) in enumerate(made)]
                place += len(made)

            for conv_id, kind, step, at, role, text, edits, found, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    if now:
                        emit(now.end())
                        out += [] if rows_out else [now.summary()]
                    now, place = Conversation(conv_id), 0
                elif not step:
                    now.chunk(edits, found, cost)
                else:
                    emit(now.row(at, role, text))
            yield pa.RecordBatch.from_pylist(out, kinds)
        if now:
            tail = [{"conv_id": now.conv_id, "place": place + i, "role": r, "text": t} for i, (r, t) in enumerate(now.end())]
            yield pa.RecordBatch.from_pylist(tail if rows_out else [now.summary()], kinds)

    return stream.mapInArrow(run, schema)


def audit_conversations(turns: DataFrame, conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """Per conversation: its gaps, faults and illegal neighbours, the least cost, the edits, and the digest of the repaired text."""
    return _stream(turns, conversations, False, size)


def repair_conversations(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """The repaired rows: ``conv_id, place, role, text``."""
    return _stream(turns, turns, True, size)


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults: by the checksum of id and turn a row is dropped, emptied, cut short, repeated or given a role."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    drawn = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")), (F.crc32(name.cast("binary")) % 20).alias("act")).where("act <> 0")
    text = F.when(F.col("act") == 1, F.lit("")).when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = drawn.withColumns({"text": text, "role": F.when(F.col("act") == 4, F.lit("user")).otherwise(F.col("role"))})
    return changed.withColumn("copy", F.explode(F.expr("sequence(0, if(act = 3, 1, 0))"))).drop("act", "copy")
