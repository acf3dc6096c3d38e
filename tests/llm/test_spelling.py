import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from matweft.llm import entries, spelling
from tests.llm.helpers import docs

FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(counts):
    """word -> (word, n, n_near, form, form_n, root), by comparing all words that share a deletion or all pairs."""
    others: dict = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            others[a].append(b)
            others[b].append(a)
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    rows = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows[w] = (w, counts[w], len(others[w]), form.get(w), counts[form[w]] if w in form else None, root)
    return rows


def found(spark, counts):
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {r.word: (r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(vocab).collect()}


def test_near_words_match_all_pairs(spark):
    rng = random.Random(7)
    counts = {}
    for letters, sizes, number in (("ab", (4, 9), 300), ("abcdé", (7, 8), 300), ("a", (4, 12), 9), ("thion", (7, 12), 300)):
        for _ in range(number):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))
            for _ in range(3):
                counts.setdefault(word, rng.choice([2, 3, 25, 30, 300, 4000]))
                at, c = rng.randrange(len(word) + 1), rng.choice(letters + "zÿ")
                word = rng.choice([word[:at] + c + word[at:], word[: max(at - 1, 0)] + word[at:], word[: max(at - 1, 0)] + c + word[at:]])
                if len(word) < 4:
                    break
    counts = {w: n for w, n in counts.items() if len(w) >= 4}
    want = brute(counts)
    assert found(spark, counts) == want
    assert sum(r[2] for r in want.values()) > 2000 and sum(r[3] is not None and want[r[3]][3] is not None for r in want.values()) > 20


def test_pivots():
    rng = random.Random(8)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        weights = [rng.randint(0, 9) for _ in places]
        weigh = dict(zip(places, weights))
        for span, number in ((2, 2), (2, 3), (3, 2)):
            fit = [c for c in combinations(places, number) if all(b - a >= span for a, b in zip(c, c[1:]))]
            if fit:
                got = spelling.cheapest_disjoint(places, weights, span, number)
                assert tuple(got) in fit and sum(map(weigh.get, got)) == min(sum(map(weigh.get, c)) for c in fit)


def test_chains_and_ties(spark):
    counts = {"aaaaaaaa": 10**6, "aaaaaaab": 10**5, "aaaaaabb": 10**4, "aaaaabbb": 1000, "aaaabbbb": 100, "aaabbbbb": 10, "aabbbbbb": 1, "zzzzzzzz": 5, "tiesuvwa": 30, "tiesuvwb": 30, "tiesuvwc": 3, "tiesuvwé": 30}
    got = found(spark, counts)
    assert got == brute(counts)
    assert got["aabbbbbb"][-1] == "aaaaaaaa" and got["tiesuvwc"][3] == "tiesuvwa" and got["zzzzzzzz"][2:] == (0, None, None, "zzzzzzzz")


def test_odd_texts(spark):
    long = "x" * 30_000
    rows = [(1, None), (2, ""), (3, "short wörds ABCDEFG,abcdefg 1abcdefgh2"), (3, "ÀBCDEFG àBCDEFG_abcdefx"), (None, "abcdefg"), (4, f"{long} {long} {long}y {long}y"), (4, "abcdéfg abcdéfg")]
    words = spelling.letter_runs(docs(spark, rows)).withColumnRenamed("run", "word")
    counts = Counter(x for _, t in rows for x in (r.translate(FOLD) for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")) if len(x) >= 7)
    vocab = spelling.vocabulary(words)
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert {r.word: r.n for r in vocab.collect()} == counts and long in counts
    assert {r.word: tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(vocab).collect()} == brute(counts)
    assert spelling.variants(vocab.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.vocabulary(words, least_length=3)


def test_query_matches_brute_force(spark, tiny):
    counts: Counter = Counter()
    for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    want = brute(counts)
    got = {r.word: tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in entries.op13_spelling(spark, tiny).collect()}
    assert got == want and any(r[3] for r in want.values())
