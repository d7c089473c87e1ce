from __future__ import annotations

import random

import pytest

from tidemark.llm import components as module
from tidemark.llm import jaccard


def least_of(links):
    label = {x: x for link in links for x in link if link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return set(label.items())


@pytest.fixture
def stored(monkeypatch):
    """The tables that are stored, one after the other."""
    tables = []
    for where in (module, jaccard):
        monkeypatch.setattr(where, "materialise", lambda df, f=where.materialise, **kwargs: tables.append(df) or f(df, **kwargs))
    return tables


@pytest.mark.parametrize("seed", range(3))
def test_random_links(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)]
    links += [(500, x) for x in range(501, 540)] + [(499, 539)]
    got = {tuple(r) for r in module.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == least_of(links)
    named = [tuple(x.to_bytes(16, "big") for x in link) for link in links]
    got = {(bytes(a), bytes(b)) for a, b in module.components(spark.createDataFrame(named, "a binary, b binary")).collect()}
    assert got == least_of(named)


def test_stars_take_no_round(spark, stored):
    links = [(1, x) for x in range(2, 60)] + [(99, 70), (70, 71)]
    assert {tuple(r) for r in module.components(spark.createDataFrame(links, "a long, b long")).collect()} == least_of(links)
    assert len(stored) == 1


def test_a_round_is_five_exchanges(spark, stored):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    module.components(links)
    assert len(stored) > 1
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        written = links.select("b", "a").toDF("a", "b")
        plan = module._small_star(module._large_star(written))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len([line for line in plan.splitlines() if "- Exchange" in line]) <= 5


def test_dealt_pairs_are_made_once(spark, stored):
    links = [(b"a" * 16, b"b" * 16), (b"a" * 16, b"c" * 16), (b"d" * 16, b"e" * 16)]
    sizes = spark.createDataFrame([(x * 16, 10) for x in (b"a", b"b", b"c", b"d", b"e")], "node binary, n long")
    dealt = jaccard._blocked(spark.createDataFrame(links, "a binary, b binary"), sizes, block_bytes=160)
    assert {(bytes(r["a"]), bytes(r["b"])) for r in dealt.collect()} == set(links)
    assert len(stored) == 3
