import math

import numpy as np

from matweft.llm import embed_dedup


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, label int, v double")


def brute(rows, cosine=0.95):
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None for (_, v), ok in zip(rows, usable)]
    links, label = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
                label[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = i if root(k) not in least or i is not None and (least[root(k)] is None or i < least[root(k)]) else least[root(k)]
    return sorted(((i, links[k], least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def test_matches_brute_force(spark, tiny, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PART", 16)  # large buckets in several parts
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    centre = rng.normal(size=64)
    rows += [(1000 + i, (centre + rng.normal(size=64) * 0.12).tolist()) for i in range(90)]
    rows += [(2000 + i, centre.tolist()) for i in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] + [1.0] * 63), (3004, [None] + [1.0] * 63), (3005, [float("inf")] * 64), (None, centre.tolist())]
    rows += [(3006, [1.0, 0.0]), (3007, [2.0, -0.0]), (3008, [1e-30, 0.0]), (3009, [3e38] * 3), (3010, [1e-38] * 3)]
    got = sorted(map(tuple, embed_dedup.embedding_classes(table(spark, rows)).collect()), key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    links = sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.995 * links
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(want)


def test_plan():
    assert embed_dedup.meeting(0.1) > embed_dedup.meeting(0.3) > embed_dedup.meeting(1.4)
    assert embed_dedup.plan(10**9, 0.95)[0] > embed_dedup.plan(10**4, 0.95)[0]


def test_empty(spark):
    assert embed_dedup.embedding_classes(table(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert list(map(tuple, embed_dedup.embedding_classes(table(spark, [(7, None)])).collect())) == [(7, 0, 7, True)]


def test_shared_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (8, [0.01, 1.0]), (9, [0.02, 1.0])]
    got = sorted(map(tuple, embed_dedup.embedding_classes(table(spark, rows)).collect()))
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (8, 2, 5, False), (9, 2, 5, False)]
    rows = [(2, [1.0, 0.01]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (8, [0.01, 1.0]), (None, [1.0, 0.02]), (None, [-1.0, 0.0])]
    got = sorted(map(tuple, embed_dedup.embedding_classes(table(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 2, 2, True), (5, 2, 2, False), (5, 1, 5, True), (8, 1, 5, False), (None, 2, 2, False), (None, 0, None, True)], key=str)
