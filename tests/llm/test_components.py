import random

import pytest

from difforge.llm import common, components


@pytest.mark.parametrize("one_task", [0, 1 << 16])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(one_task)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(-5, 7000), (9, 9)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            p, q = root(u), root(v)
            parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r.node: r.comp for r in components.components(df, common.Scratch(spark, "cc")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components.components(df.where("false"), common.Scratch(spark, "cc")).count() == 0
