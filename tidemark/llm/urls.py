"""Filtering of urls against a large rule list held as a sorted digest array.

The list is one file: 64-bit xxhash keys in ascending order, and beside each the
stored rule. Spark ships the file once to every executor, which maps it into
memory. A batch of urls is probed with one vectorised binary search over all its
keys (each parent domain with each path length that a rule has), and a hit
counts only when the stored rule equals the probed text, so a collision of
digests never decides.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; an empty table gives an empty result; repeated rows are judged
alike; other columns of the table are not looked at. Of the rules that fit, the
longest wins (host and path together); rules are unique after lower-casing the
host.
"""

from __future__ import annotations

import atexit
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import drop_folder, shared_folder

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class RuleFile:
    """A rule list that Spark has shipped: file name, path lengths in use, default verdict."""

    name: str
    path_lengths: tuple[int, ...]
    default: str


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(ASCII_LOWER), slash + path


def pack(rules: list[tuple[str, str]]) -> bytes:
    """The file of a rule list of ``(verdict, host/path)``: digests in order, then what they stand for."""
    rows = {}
    for verdict, rule in rules:
        host, path = split_rule(rule)
        key = f"{host}{path}"
        if rows.setdefault(key, (verdict, rule))[0] != verdict:
            raise ValueError(f"rule {rule!r} has two verdicts")
    order = sorted((xxhash.xxh64_intdigest(key.encode()), key) for key in rows)
    stored = [f"{rows[key][0]}\t{key}\t{rows[key][1]}".encode() for _, key in order]
    out = io.BytesIO()
    np.save(out, np.array([digest for digest, _ in order], np.uint64))
    np.save(out, np.cumsum([0, *map(len, stored)]).astype(np.int64))
    out.write(b"".join(stored))
    return out.getvalue()


def ship(spark: SparkSession, rules: list[tuple[str, str]], default: str = "allow") -> RuleFile:
    """Write the rule file to the shared folder and have Spark hand it to all executors."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(pack(rules)))
    out.close()
    context.addFile(path.toString())
    atexit.register(drop_folder, spark, path.toString())
    return RuleFile(name, tuple(sorted({len(split_rule(rule)[1]) for _, rule in rules})), default)


class DigestArray:
    """The mapped file: sorted digests, offsets, stored rules."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            shapes = []
            for _ in range(2):
                version = np.lib.format.read_magic(file)
                shape, _, kind = np.lib.format.read_array_header_1_0(file) if version == (1, 0) else np.lib.format.read_array_header_2_0(file)
                shapes.append((file.tell(), shape[0], kind))
                file.seek(shape[0] * kind.itemsize, 1)
            body = file.tell()
            file.seek(0, 2)
            size = file.tell() - body
        self.digests, self.offsets = (np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind) for at, n, kind in shapes)
        self.body = np.memmap(path, np.uint8, "r", body, (size,)) if size else np.zeros(0, np.uint8)

    def stored(self, at: int) -> tuple[str, str, str]:
        verdict, key, rule = bytes(self.body[self.offsets[at]:self.offsets[at + 1]]).decode().split("\t")
        return verdict, key, rule

    def find(self, keys: list[str]) -> list[tuple[str, str] | None]:
        """For each text its verdict and rule if stored, else None."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))
        left = np.searchsorted(self.digests, digests, side="left")
        right = np.searchsorted(self.digests, digests, side="right")
        out: list[tuple[str, str] | None] = [None] * len(keys)
        for i in np.flatnonzero(right > left):
            for at in range(left[i], right[i]):
                verdict, key, rule = self.stored(at)
                if key == keys[i]:
                    out[i] = (verdict, rule)
        return out


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: RuleFile, key: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, deciding rule (null: none) and verdict of every url, one row a row."""
    pages = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = DigestArray(SparkFiles.get(rules.name))
        for record in batches:
            hosts, paths = record.column(1).to_pylist(), record.column(2).to_pylist()
            probes: dict[str, int] = {}
            wanted: list[list[int]] = []
            for host, path in zip(hosts, paths, strict=True):
                own = []
                labels = host.split(".") if host else []
                for i in range(len(labels)):
                    parent = ".".join(labels[i:])
                    own += [probes.setdefault(parent + path[:n], len(probes)) for n in rules.path_lengths if n <= len(path)]
                wanted.append(own)
            found = stored.find(list(probes))
            best = [max((found[i] for i in own if found[i]), key=lambda hit: len(hit[1]), default=None) for own in wanted]
            yield pa.RecordBatch.from_arrays(
                [*record.columns, pa.array([hit and hit[1] for hit in best], pa.string()), pa.array([hit[0] if hit else rules.default for hit in best], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
