"""Chat records of many layouts, formatted with one reversible template.

A record is a JSON object. Its schema fingerprint, a hash of the sorted nested
field paths, selects a declarative mapping from its layout to canonical turns
``(role, text)``. The template marks every turn, escapes control strings inside
roles and texts so that they can never be read as marks, and returns the spans
(code points) that a loss should cover: the texts of the assistant's turns.

Defined cases: a null text or role is empty; a record that is null, no JSON
object, or of a layout without a mapping has a null ``layout``, no turns, and is
formatted as an empty conversation; rows of one conversation with the same turn
number come in the order of role, then text; a null turn number comes first; an
empty table gives an empty result; repeated rows are repeated turns; other
columns are not looked at. A conversation is one string, so it must fit a task.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
TURN, CLOSE = "<|turn|>", "<|close|>\n"
#: Strings that templates use as marks; inside a text they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|close|>", "<|startoftext|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    """Double backslashes, then put one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Layout:
    """How one family of records becomes turns.

    ``required`` and ``optional`` are nested field paths. ``turns`` lists fixed
    ``(role, paths)``: the texts at the paths joined by a blank line, left out
    when all are missing. ``each`` names a list of messages with the paths of
    role and text inside; ``aliases`` renames roles.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    aliases: dict[str, str] = field(default_factory=dict)

    def fingerprints(self) -> list[str]:
        sets = itertools.chain.from_iterable(itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint_of(self.required + extra) for extra in sets]

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            name, role, text = self.each
            return [(self.aliases.get(m.get(role), m.get(role)) or "", m.get(text) or "") for m in record.get(name) or () if isinstance(m, dict)]
        found = []
        for role, paths in self.turns:
            parts = [record[p] for p in paths if record.get(p)]
            if parts or paths[0] in record:
                found.append((role, "\n\n".join(map(str, parts))))
        return found


LAYOUTS = (
    Layout("messages_text", ("messages[].role", "messages[].text"), each=("messages", "role", "text")),
    Layout("messages_content", ("messages[].content", "messages[].role"), ("id", "messages[].name"), each=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("id",), each=("conversations", "from", "value"), aliases={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("input", "system", "id"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt_response", ("prompt", "response"), ("system", "id"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("id",), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("answer", "question"), ("context", "id"), (("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; the items of a list share one path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint_of(paths) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)))


def mapping_table(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint to layout; two layouts must not share one."""
    table: dict[str, Layout] = {}
    for layout in layouts:
        for print_ in layout.fingerprints():
            if table.setdefault(print_, layout) is not layout:
                raise ValueError(f"layouts {table[print_].name} and {layout.name} have the same fields")
    return table


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the spans of the assistant's texts in it."""
    parts, at, begins, ends = [BEGIN], len(BEGIN), [], []
    for role, text in turns:
        head, body = f"{TURN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        if role == "assistant":
            begins.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join([*parts, END]), begins, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked(formatted: str, begins: list[int], ends: list[int]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in zip(begins, ends, strict=True))


def format_records(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Per record: key, fingerprint, layout (null: unknown), formatted, loss_begins, loss_ends."""
    table = mapping_table(layouts)
    records = records.select(F.col(key), F.col(record).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[frozenset, str] = {}
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                paths = frozenset(field_paths(value)) if isinstance(value, dict) else None
                print_ = None if paths is None else known.get(paths) or known.setdefault(paths, fingerprint_of(paths))
                layout = table.get(print_)
                rows.append((print_, layout and layout.name, *render(layout.read(value) if layout else [])))
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, "fingerprint", "layout", "formatted", "loss_begins", "loss_ends"])

    kind = records.schema[key].dataType.simpleString()
    return records.mapInArrow(run, f"`{key}` {kind}, fingerprint string, layout string, formatted string, loss_begins array<int>, loss_ends array<int>")


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """Per formatted conversation: its turns as ``array<struct<role, text>>``, the text under the mask."""
    formatted = formatted.select(key, "formatted", "loss_begins", "loss_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, begins, ends = (batch.column(i).to_pylist() for i in (1, 2, 3))
            turns = [[{"role": r, "text": t} for r, t in parse(text)] for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(turns, turn), pa.array([masked(*x) for x in zip(texts, begins, ends, strict=True)], pa.string())],
                [key, "formatted", "turns", "loss_text"],
            )

    kind = formatted.schema[key].dataType.simpleString()
    return formatted.mapInArrow(run, f"`{key}` {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string")


def records_of_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one JSON record of messages per conversation."""
    empty = F.lit("")
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))
    grouped = turns.groupBy(F.col(key).alias(key)).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    return grouped.select(key, F.to_json(F.struct(messages.alias("messages"))).alias("record"))
