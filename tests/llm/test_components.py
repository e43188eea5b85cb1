"""Connected components against union-find."""

import random

import pytest

from tidemark.llm.components import connected_components


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 80)], [(99, k) for k in range(80)], [], [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5)]], ids=["chain", "hub", "high hub", "none", "odd"])
def test_shapes(spark, edges):
    check(spark, edges)


def test_random_graph(spark):
    rng = random.Random(0)
    check(spark, [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)])


def check(spark, edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((v, find(v)) for v in root)
