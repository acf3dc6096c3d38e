import random

from matweft.llm.common import connected_components


def brute(edges):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {x: root(x) for x in label}


def test_components(spark):
    rng = random.Random(5)
    chain = list(range(100))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)]
    edges += [(5, 5), (None, 3), (7, None), (1000, 1001), (1001, 1000), (-4, 9000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == brute(edges)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
