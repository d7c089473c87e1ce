"""Url rules against a plain version, collisions, and the defined cases."""

from __future__ import annotations

import random
import re

import numpy as np
from tidemark.llm import urls
from tidemark.llm.queries import URL_RULES

RULES = [*URL_RULES, ("block", "a.b.c/"), ("allow", "a.b.c/x"), ("block", "host.only")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(LOWER)
    best = None
    for verdict, rule in RULES:
        at, slash, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


def test_against_plain(spark):
    rng = random.Random(2)
    made = [None, "", "no scheme", "http://", "://x", "http://ORG", "http://org/", "https://Example.ORG/es/1?q#f", "http://notexample.org/es/", "ftp://u@A.b.C/xy://z", "http://fr.com/fr/", "x://host.only?/a", "x://é.com/de/ü\nz"]
    for _ in range(300):
        host = ".".join(rng.choice("a b c org com example host only www".split()) for _ in range(rng.randrange(0, 4)))
        made.append(f"{rng.choice(['http', ''])}://{host}{rng.choice(['', '/', '/es/', '/en/12', '/fr/', '/de/x', '/x', '?', '#'])}")
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(made)], "page_id long, url string, host string, verdict int")
    got = urls.judge(df, urls.ship(spark, RULES)).collect()
    assert len(got) == len(made)
    for row in got:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == plain(made[row["page_id"]])
    assert urls.judge(df.limit(0), urls.ship(spark, RULES)).collect() == []


def test_collisions_are_told_apart(tmp_path):
    path = tmp_path / "rules.bin"
    path.write_bytes(urls.pack([("block", "a/"), ("allow", "b/"), ("block", "c/d")]))
    held = urls.DigestArray(str(path))
    assert held.find(["a/", "b/", "c/d", "c/", ""]) == [("block", "a/"), ("allow", "b/"), ("block", "c/d"), None, None]
    held.digests = np.full(3, held.digests[0])
    name = held.stored(0)[1]
    same = held.find([name, "z/"])
    assert same[0] is not None and same[1] is None


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(df, urls.ship(spark, [], "block")).collect()] == [(1, "a", "/b", None, "block")]
