import random

import pytest

from pagemill.llm.graph import components


@pytest.mark.parametrize("edges", [[], [(3, 3), (None, 1)], [(i, i + 1) for i in range(199)], [(9, k) for k in range(10, 200)] + [(9, 200)] * 3, [(random.Random(k).randrange(400), random.Random(-k - 1).randrange(400)) for k in range(300)]])
def test_components(spark, edges):
    got = sorted((r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == sorted((x, find(x)) for x in list(root))
