import math
from collections import Counter

import pytest

from matweft.llm.mixing import mix
from tests.llm.helpers import docs


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    rows += [(1000 + i, "a b\tc\x0bd", "tiny") for i in range(2)]
    got = mix(docs(spark, rows)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), (s, taken[s], want[s])
    assert {r.size for r in got if r.source == "tiny"} == {3}
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs(spark, rows)).collect()))


def test_inclusion_and_size(spark):
    sizes = [1, 2, 4, 9, 20, 50]
    rows = [(i, " ".join(["w"] * sizes[i % 6]), "s" if i // 6 % 3 else "t") for i in range(9000)]
    rows += [(None, "a b c", "s")] * 3000
    for seed in (1, 2):
        got = mix(docs(spark, rows), seed=seed, fixes=0).collect()
        by = {}
        for r in got:
            by.setdefault(r.source, []).append(r)
        for mine in by.values():
            words = sum(r.size for r in mine)
            f = mine[0].target / words
            mean = sum(r.size * math.log2(r.size + 1) for r in mine) / words
            reach = max(abs(math.log2(r.size + 1) - mean) for r in mine)
            want = {n: f + 0.5 * min(f, 2 - f) / reach * (mean - math.log2(n + 1)) for n in {r.size for r in mine}}
            assert math.isclose(sum(want[r.size] * r.size for r in mine), mine[0].target, rel_tol=1e-5)
            for n in want:
                these = [r.copies for r in mine if r.size == n]
                assert set(these) <= {math.floor(want[n]), math.ceil(want[n])}
                assert abs(sum(these) / len(these) - want[n]) < 0.05, (n, want[n])
            assert len({round(w, 6) for w in want.values()}) == len(want)
            # the number of copies is fixed, whichever documents the hash picks
            assert abs(sum(r.copies for r in mine) - sum(want[r.size] for r in mine)) <= 1 + 1e-6


def test_edges(spark):
    assert mix(docs(spark, [(1, "x", "s")]).limit(0)).collect() == []
    got = mix(docs(spark, [(1, None, None), (2, "", "s"), (2, "", "s"), (None, "a b", "t"), (None, "a b", "t")])).collect()
    assert [r.size for r in sorted(got, key=lambda r: (r.size, str(r)))] == [0, 0, 0, 2, 2]
    assert all(r.target == 0 and r.taken == 0 for r in got if r.size == 0)
    assert sum(r.taken for r in got) == pytest.approx(6, abs=2)
