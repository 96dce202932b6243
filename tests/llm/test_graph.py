"""Connected components against a plain union-find."""

import random

import pytest

from fieldloom.llm import graph


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


@pytest.mark.parametrize("contracted", [1 << 18, 60])
def test_components(spark, monkeypatch, contracted):
    monkeypatch.setattr(graph, "CONTRACTED", contracted)
    r = random.Random(4)
    path = list(range(-100, 100))
    r.shuffle(path)
    edges = [*zip(path, path[1:]), *((1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(150)), (5000, 5000)]
    edges += edges[:20]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({x["node"] for x in found})
    assert {x["node"]: x["component"] for x in found} == plain([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()
