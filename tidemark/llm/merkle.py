"""Merkle manifest of a dataset: a tree of hashes by group, with resumable parents.

A leaf is the hash of a row's fields. Within a group (a source) leaves ascend by
key and every ``FANOUT`` consecutive nodes become their parent's digest until one
is left; the groups' tops, in order of the group, go on likewise to one root.

A parent (:class:`Run`) keeps a copy of its running SHA-256 state before each
child slot. Folding a leaf up, to check it against the root, resumes the state
of its slot, feeds the replacement digest and the siblings to its right only,
and goes on with the parent's slot. Left siblings are never hashed again.

On Spark the tree is cut into blocks of ``FANOUT ** BLOCK_LEVELS`` consecutive
nodes, each a whole subtree that one task handles; the tops of blocks are the
nodes of the next stage, and so on until a group has one. Paths then come down
stage by stage: the runs above a block, some kilobytes, meet its leaves, and the
task folds every leaf through its block's parents and those above. Places within
a group are given by range partitions, so a hot group is many tasks.

Defined cases: a null field is spelled ``-``, any other by its UTF-8 byte count, a
colon and its value; null keys come first, rows with equal keys ascend by leaf,
equal rows are leaves of their own; the null group comes before all others; an
empty table has no rows and no root; other columns are not looked at. A row with
a null key is not tampered with.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered
from tidemark.session import materialise

FANOUT = 16
#: Levels of a subtree that one task builds: 4,096 nodes.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Run:
    """A parent: its children, the state before each slot, and the digest (hex digests as bytes)."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in the slot: only it and what follows is hashed."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(b"".join(self.children[slot + 1:]))
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1:])


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def subtree(digests: list[bytes], levels: int) -> list[list[Run]]:
    """Level by level the parents above consecutive nodes."""
    tree = []
    for _ in range(levels):
        tree.append([Run(digests[i:i + FANOUT]) for i in range(0, len(digests), FANOUT)])
        digests = [run.digest for run in tree[-1]]
    return tree


def above(tree: list[list[Run]], at: int) -> list[tuple[int, Run]]:
    """Slot and parent of the node at a place, upwards."""
    path = []
    for level in tree:
        path.append((at % FANOUT, level[at // FANOUT]))
        at //= FANOUT
    return path


def pack_path(path: list[tuple[int, Run]]) -> bytes:
    """Slot, number of children and their raw digests, run by run."""
    return b"".join(bytes([slot, len(run.children)]) + bytes.fromhex(b"".join(run.children).decode()) for slot, run in path)


def unpack_path(packed: bytes) -> list[tuple[int, Run]]:
    path, at = [], 0
    while at < len(packed):
        slot, n = packed[at], packed[at + 1]
        digests = packed[at + 2:at + 2 + 32 * n].hex().encode()
        path.append((slot, Run([digests[64 * i:64 * i + 64] for i in range(n)])))
        at += 2 + 32 * n
    return path


def fold(path: list[tuple[int, Run]], digest: bytes) -> bytes:
    """The root that a node at the path's foot would give."""
    for slot, run in path:
        digest = run.fold(slot, digest)
    return digest


def proof(path: list[tuple[int, Run]]) -> str:
    """Digest of all siblings from the foot to the root."""
    state = hashlib.sha256()
    for slot, run in path:
        state.update(run.siblings(slot))
    return state.hexdigest()


def field_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each by byte count and value; nulls as ``-``."""
    spelled = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*spelled), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


#: Nodes of a stage: group ``key`` (never null), ``position`` among ``n`` of the group, ``digest``.
NODES = "key string, position long, n long, digest string"


def _sorted(table: pa.Table, levels: int) -> tuple[pa.Table, list[bytes], list[list[Run]]]:
    table = table.sort_by("position").combine_chunks()
    digests = [d.encode() for d in table.column("digest").to_pylist()]
    return table, digests, subtree(digests, min(levels, height(table.column("n")[0].as_py())))


def _block(levels: int) -> Column:
    return F.floor(F.col("position") / FANOUT**levels).cast("long")


def climb(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The tops of all blocks: the nodes of the next stage."""

    def run(table: pa.Table) -> pa.Table:
        table, digests, tree = _sorted(table, levels)
        size = FANOUT**levels
        top = tree[-1][0].digest if tree else digests[0]
        n = table.column("n")[0].as_py()
        return pa.table({"key": [table.column("key")[0].as_py()], "position": [table.column("position")[0].as_py() // size], "n": [-(-n // size)], "digest": [top.decode()]})

    return nodes.select("key", "position", "n", "digest", _block(levels).alias("block")).groupBy("key", "block").applyInArrow(run, NODES)


def descend(nodes: DataFrame, tops: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Nodes with the packed path above them, given that of the next stage's nodes (key, position, path, and what else is the group's)."""
    extra = [f for f in tops.schema.fields if f.name not in ("key", "position", "path")]

    def run(below: pa.Table, path: pa.Table) -> pa.Table:
        table, _, tree = _sorted(below, levels)
        rest = path.column("path")[0].as_py()
        paths = [pack_path(above(tree, i)) + rest for i in range(len(table))]
        columns = {"key": table.column("key"), "position": table.column("position"), "path": pa.array(paths, pa.binary())}
        return pa.table(columns | {f.name: pa.array([path.column(f.name)[0].as_py()] * len(table)) for f in extra})

    schema = "key string, position long, path binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)
    left = nodes.select("key", "position", "n", "digest", _block(levels).alias("block")).groupBy("key", "block")
    return left.cogroup(tops.withColumnRenamed("position", "block").groupBy("key", "block")).applyInArrow(run, schema)


def stages(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Stored nodes of every stage, the last with one node a group; each has one for every block of the one before."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1 or len(out) == 1:
        out.append(materialise(climb(out[-1], levels)))
    return out


def manifest(leaves: DataFrame, group: str, order: list[Column], levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of rows with a ``leaf`` column: their places, and the path above each block of them.

    The first has the rows with ``key``, ``position`` and ``n``; the second
    ``key, position`` (of the block), ``path, subroot, root``.
    """
    keyed = leaves.withColumn("key", F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")))
    placed = materialise(numbered(keyed, ["key"], order))
    trees = stages(placed.select("key", "position", "n", F.col("leaf").alias("digest")), levels)
    subroots = trees[-1].select(F.col("key").alias("name"), "digest")
    roots = stages(materialise(numbered(subroots.withColumn("key", F.lit("")), ["key"], [F.col("name").asc()])), levels)
    path = roots[-1].select("key", "position", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    for stage in reversed(roots[:-1]):
        path = descend(stage, path, levels)
    named = path.join(roots[0].select("position", F.col("name"), F.col("digest").alias("subroot")), "position")
    path = named.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("position"), "path", "subroot", "root")
    for stage in reversed(trees[1:-1]):
        path = descend(stage, path, levels)
    return placed, materialise(path)


def fold_leaves(placed: DataFrame, paths: DataFrame, replacement: str = "replacement", levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row of a manifest with its proof's digest and the root its replacement leaf folds to."""
    kept = [f for f in placed.schema.fields if f.name not in ("key", "position", "n", replacement)]

    def run(table: pa.Table, path: pa.Table) -> pa.Table:
        table, _, tree = _sorted(table, levels)
        rest = unpack_path(path.column("path")[0].as_py())
        proofs, folded = [], []
        for i, other in enumerate(table.column(replacement).to_pylist()):
            own = above(tree, i) + rest
            proofs.append(proof(own))
            folded.append(fold(own, other.encode()).decode())
        n = len(table)
        shared = {name: pa.array([path.column(name)[0].as_py()] * n, pa.string()) for name in ("subroot", "root")}
        return pa.table({f.name: table.column(f.name) for f in kept} | shared | {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", subroot string, root string, proof_sha256 string, folded_root string"
    left = placed.withColumns({"block": _block(levels), "digest": F.col("leaf")}).groupBy("key", "block")
    return left.cogroup(paths.withColumnRenamed("position", "block").groupBy("key", "block")).applyInArrow(run, schema)


def tampered_rows(docs: DataFrame, key: str = "doc_id", every: int = 5) -> Column:
    """Rows whose text is changed: those where ``every`` divides the key's checksum."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % every == 0, F.lit(False))


def verify_documents(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text", levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: its leaf, subroot, root, proof and the root that its tampered form folds to."""
    changed = [lower_ascii(F.col(c).cast("string")) if c == text else F.col(c) for c in fields]
    leaves = docs.select(F.col(key).alias("doc_id"), F.col(group).alias("group"), field_digest(*(F.col(c) for c in fields)).alias("leaf"), F.when(tampered_rows(docs, key), field_digest(*changed)).alias("changed"))
    leaves = leaves.select("doc_id", "group", "leaf", F.coalesce("changed", "leaf").alias("replacement"))
    placed, paths = manifest(leaves, "group", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], levels)
    folded = fold_leaves(placed, paths, levels=levels)
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
