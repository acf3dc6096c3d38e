import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from matweft.llm import entries, periodic_runs
from tests.llm.helpers import docs


def brute(words, least=12):
    """Runs by trying every period at every place."""
    n, found = len(words), []
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            length = i - start + period
            if i > start and length >= max(least, 2 * period):
                own = words[start : start + length]
                if all(own[d:] != own[:-d] for d in range(1, period)):
                    found.append((start, length, period))
            i += i == start
    return sorted(found)


def collapsed(words, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(1200):
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters = rng.randint(1, 4)
            words = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.6:
                words += words[: rng.randint(1, 8)] * rng.randint(1, 6) + [rng.randrange(letters) for _ in range(rng.randint(0, 5))]
            texts.append(words * rng.choice([1, 1, 2, 3]))
        least = rng.choice([2, 4, 5, 12, 12])
        ids = np.array([x for words in texts for x in words], np.int64)
        got = periodic_runs.runs_of(ids, np.repeat(np.arange(len(texts)), [len(w) for w in texts]), least)
        assert got == [(d, *run) for d, words in enumerate(texts) for run in brute(words, least)]


def test_suffix_order_and_prefixes():
    rng = random.Random(2)
    for n in (1, 2, 30, 200):
        words = np.array([rng.randrange(3) for _ in range(n)] + [-1])
        order, lcp = periodic_runs.suffix_order(words)
        assert sorted(order.tolist()) == list(range(n + 1))
        tails = [words[i:].tolist() for i in order]
        assert tails == sorted(tails)
        for a, b, length in zip(tails, tails[1:], lcp):
            assert a[:length] == b[:length] and a[length : length + 1] != b[length : length + 1]


def test_long_texts(spark):
    fib = ["a", "b"]
    while len(fib[-1]) < 60_000:
        fib.append(fib[-1] + fib[-2])
    texts = ["x " * 120_000 + "y", " ".join(fib[-1]), " ".join(f"w{k}" for k in range(70_000)) + " " + " ".join(f"w{k}" for k in range(70_000))]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs(spark, list(enumerate(texts)))).collect()}
    assert [tuple(r) for r in got[0].runs] == [(0, 120_000, 1)] and got[0].text == "x y"
    assert [tuple(r) for r in got[2].runs] == [(0, 140_000, 70_000)] and got[2].n_words == 140_000
    words = list(fib[-1])
    for start, length, period in map(tuple, got[1].runs):
        own = words[start : start + length]
        assert own[period:] == own[:-period] and length >= max(12, 2 * period)
        assert (start == 0 or words[start - 1] != words[start - 1 + period]) and (start + length == len(words) or words[start + length] != words[start + length - period])
    assert len(got[1].runs) > 10_000


def test_odd_rows(spark):
    repeat = "one two " * 6
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, repeat), (4, repeat), (None, repeat), (5, "one\x0btwo " + repeat), (6, "é ü " * 7), (7, "same " * 11), (8, "same " * 12)]
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.periodic_runs(docs(spark, rows[:5] + rows[6:])).collect())
    want = []
    for key, text in rows[:5] + rows[6:]:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        want.append((key, len(words), brute(words), collapsed(words, brute(words))))
    assert got == sorted(want)
    assert [r.doc_id for r in periodic_runs.periodic_runs(docs(spark, rows[5:6])).collect()] == [None]
    assert periodic_runs.periodic_runs(docs(spark, rows).where("false")).count() == 0
    named = spark.createDataFrame([("a", repeat)], "doc_id string, text string")
    assert [(r.doc_id, r.text) for r in periodic_runs.periodic_runs(named).collect()] == [("a", "one two")]


def test_query_matches_brute_force(spark, tiny):
    got = {r.doc_id: r for r in entries.op11_periodic_runs(spark, tiny).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    found = 0
    for key, text in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(key).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            words = [words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] if i >= a else w for i, w in enumerate(words)]
        if n > 1500:
            continue
        runs = brute(words)
        found += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))
        assert tuple(got[key]) == want
    assert found > 20
    assert entries.planted_runs(docs(spark, [(None, "a b"), (1, None), (0, "")])).where(F.col("text") == "a b").count() == 1
