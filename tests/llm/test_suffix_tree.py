import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matweft.llm import suffix_tree
from tests.llm.helpers import docs


def lower(text):
    return (text or "").encode().lower().split()


def brute_base(rows, held):
    count = Counter(w for i, t in rows if i not in held for w in [*lower(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = [*lower(t), None]
        out.append((i, len(tokens), sum(count[w] > 0 for w in tokens), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    return sorted(out, key=str)


def brute_scores(rows, held, depth, least):
    """(doc_id, n_in_context, score) of each row, with one dictionary of all contexts."""
    follow = defaultdict(Counter)  # context -> next token -> count; () is the root
    for i, t in rows:
        if i not in held:
            run = [None, *lower(t), None]
            for k in range(1, len(run)):
                for d in range(0, min(depth, k) + 1):
                    follow[tuple(run[k - d : k])][run[k]] += 1
    root = follow[()]
    n, v = sum(root.values()), len(root)
    ones, twos = (sum(c == k for c in root.values()) for k in (1, 2))
    discount = (ones + 0.5) / (ones + 2 * twos + 1)
    kept = set()
    for ctx, nexts in follow.items():
        size, suffix = sum(nexts.values()), follow[ctx[1:]]
        if not ctx or size < least:
            continue
        of_suffix = sum(suffix.values())
        g = seen = expected = free = 0
        for w, c in nexts.items():
            # next tokens rarer than least (after the root), or seen once in the suffix, are one cell
            told = suffix[w] >= (least if len(ctx) == 1 else 2)
            e = size * suffix[w] / of_suffix if told else 0
            if e > 0 and (e >= 1 or c >= 5):
                g, seen, expected, free = g + c * math.log(c / e), seen + c, expected + e, free + 1
        if size > seen:
            g += (size - seen) * math.log((size - seen) / max(size - expected, 0.5))
        if free and 2 * g >= free + 4 * math.sqrt(2 * free) and g >= 0.002 * size:
            kept.add(ctx)
    out = []
    for i, t in rows:
        run, score, inside = [None, *lower(t), None], 0.0, 0
        for k in range(1, len(run)):
            p = (root[run[k]] - discount) / n if root[run[k]] else discount * v / n
            states = [ctx for d in range(1, min(depth, k) + 1) if (ctx := tuple(run[k - d : k])) in kept]
            for ctx in states:
                nexts = follow[ctx]
                size, mass = sum(nexts.values()), sum(c for c in nexts.values() if c > 1)
                c = nexts[run[k]] if nexts[run[k]] > 1 else 0
                p = (c + (size - mass + 5) * p) / (size + 5)
            inside += bool(states)
            score += math.log10(p)
        out.append((i, inside, score))
    return sorted(out, key=str), kept


def chains(n, seed=0):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        words = ["a"]
        for _ in range(int(rng.integers(0, 40))):  # b mostly follows a, and c follows b unless before that was c
            last = words[-2:]
            sure = {"a": "b", "b": "d" if last[0] == "c" else "c", "c": "b", "d": "a"}[last[-1]] if rng.random() < 0.7 else None
            words.append(sure or ["a", "b", "c", "d", f"w{rng.integers(50)}"][rng.integers(4)])
            if rng.random() < 0.1:
                words[-1:] = [f"w{rng.integers(50)}", "a"]
        out.append(" ".join(words))
    return out


def test_base_score_and_gain(spark, tiny, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SEGMENT_WORDS", 5_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (9001, ""), (9002, "Unseen wörds \x0b only"), (9003, "the " * 20_000)]
    held = {i for i, _ in rows if i % 5 == 0}
    got = suffix_tree.score_documents(docs(spark, rows), F.col("doc_id") % 5 == 0, least=20).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute_base(rows, held)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == held
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    want, _ = brute_scores(rows, held, 3, 20)
    for (i, inside, score), (j, n, expected) in zip(sorted(((r.doc_id, r.n_in_context, r.score) for r in got), key=str), want):
        assert (i, inside) == (j, n) and score == pytest.approx(expected, rel=1e-9)


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SEGMENT_WORDS", 700)
    rows = list(enumerate(chains(300)))
    held = {i for i, _ in rows if i % 4 == 1}
    got = suffix_tree.score_documents(docs(spark, rows).repartition(3), F.col("doc_id") % 4 == 1, least=30).collect()
    want, kept = brute_scores(rows, held, 3, 30)
    assert {len(ctx) for ctx in kept} >= {1, 2}
    for (i, inside, score), (j, n, expected) in zip(sorted(((r.doc_id, r.n_in_context, r.score) for r in got), key=str), want):
        assert (i, inside) == (j, n) and score == pytest.approx(expected, rel=1e-9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("matweft_lm_")]


def test_edges(spark):
    table = docs(spark, [(1, "x y"), (None, "x")])
    assert suffix_tree.score_documents(table.limit(0), F.lit(False)).collect() == []
    none = suffix_tree.score_documents(table, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, round(r.score, 6)) for r in none] == [(0, 0, 0.0, 0.0)] * 2
    got = suffix_tree.score_documents(table, F.col("doc_id") == 1).collect()
    assert sorted((r.n_tokens, r.n_known, r.held_out) for r in got) == [(2, 2, False), (3, 2, True)]


def test_a_segment_holds_one_kind_of_totals_at_a_time():
    """Totals of three lengths of runs, 8 MB of codes and 8 of numbers each, beside a short text."""
    rng, kinds, n = np.random.default_rng(6), (1, 2, 3), 1_000_000
    codes = [rng.integers(-(1 << 62), 1 << 62, n) for _ in kinds]
    cells = lambda x: pa.array([suffix_tree.packed(part) for part in np.split(x, 10)], pa.binary())
    none = pa.nulls(10, pa.int64())
    side = pa.concat_tables(pa.table({"kind": np.full(10, k), "key": none, "value": none, "keys": cells(c), "values": cells(2 * np.arange(n))}) for k, c in zip(kinds, codes))
    words = np.array([0, 5, 6, 7], np.int64)
    left = pa.table({"held_out": [False, None], "tokens": pa.array([np.array([1, 2, 3], np.int32).tobytes(), None], pa.binary()), "hashes": pa.array([None, words.tobytes()], pa.binary())})
    tracemalloc.start()
    segment = suffix_tree.Segment(left, side, 3, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for k, c in zip(kinds, codes):
        assert np.array_equal(suffix_tree.look_up(*segment.known(k), c[::-1], -1), np.arange(n)[::-1])
