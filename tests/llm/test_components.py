import random

import pytest

from quillspark.llm.components import components
from quillspark.llm.tables import Staged


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] if seed == 0 else [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    if seed == 0:
        rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    got = components(spark.createDataFrame(edges, "u long, v long"), Staged(spark, "test")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)
