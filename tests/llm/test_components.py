import random

import pytest

from beaconaudit.llm import components as module


@pytest.mark.parametrize("last", [0, 20_000])
def test_against_union_find(spark, monkeypatch, last):
    """Also with every round done between tasks: chains, stars, and a component of half the nodes."""
    monkeypatch.setattr(module, "LAST_LINKS", last)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(999, i) for i in range(600, 640)]
    links += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(160)] + [(7, 7), (None, 3)]
    rng.shuffle(links)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    expected = {x: root(x) for x in parent if root(x) != x}
    found = module.components(spark.createDataFrame(links, "a long, b long").repartition(6))
    assert {r["node"]: r["root"] for r in found.collect()} == expected


def test_binary_nodes_and_no_links(spark):
    links = spark.createDataFrame([(b"b", b"a"), (b"c", b"b")], "a binary, b binary")
    assert {(bytes(r["node"]), bytes(r["root"])) for r in module.components(links).collect()} == {(b"b", b"a"), (b"c", b"a")}
    assert module.components(links.where("1 = 0")).count() == 0


def test_a_star_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(module, "LAST_LINKS", 0)
    forest = module._local_forest

    def bounded(batches):
        batches = list(batches)
        assert sum(map(len, batches)) <= 1500
        yield from forest(iter(batches))

    monkeypatch.setattr(module, "_local_forest", bounded)
    links = spark.range(1, 2001).selectExpr("0L AS a", "id AS b")
    found = module.components(links).collect()
    assert len(found) == 2000 and {r["root"] for r in found} == {0}
