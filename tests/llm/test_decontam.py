import re

import numpy as np
from pyspark.sql import functions as F

from matweft.llm import decontam
from tests.llm.helpers import docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, width):
    windows = {}
    for item, text in items:
        ws = words(text)
        k = min(width, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            windows.setdefault(tuple(ws[i : i + k]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in rows:
        ws, hit, found = words(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                if tuple(ws[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(ws[i : i + k])]
        out.append((doc, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def items_df(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")


def test_matches_brute_force(spark, tiny, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_PHRASES", 100)  # several blocks
    monkeypatch.setattr(decontam, "BROADCAST_TERMS", 0)  # the ways beyond the broadcasts
    monkeypatch.setattr(decontam, "BROADCAST_PHRASES", 0)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    items += [(900, "Short Item"), (901, "short item"), (902, "..."), (None, "a b c"), (903, None), (900, "Short Item"), (904, "ä ö ü x x x x x x x x x")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "SHORT, item short-item"), (5002, "SHORT, item short-item"), (5003, "short"), (5004, "item short"), (5005, "a-b.c a b c"), (None, "Ä ö ü X x x x x x x x x x x")]
    got = decontam.contamination(docs(spark, rows), items_df(spark, items)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(rows, items, 10)


def test_small_segments_and_empty(spark):
    rows = [(i, "one two three four") for i in range(10)]
    index = decontam.build_index(docs(spark, rows), segment_words=7)
    assert index.where("term is null").count() > 1
    found = decontam.search(index, decontam.phrases(items_df(spark, [(1, "two three")]), 10))
    assert [r.hit for r in found.collect()] == [[1, 2]] * 10
    none = decontam.contamination(docs(spark, rows), items_df(spark, [(1, "x")]).limit(0)).collect()
    assert [(r.n_hit, r["items"]) for r in none] == [(0, [])] * 10
    assert decontam.contamination(docs(spark, rows).limit(0), items_df(spark, [(1, "x")])).collect() == []


def test_proximity(spark):
    index = decontam.build_index(docs(spark, [(1, "alpha beta x gamma"), (2, "alpha x y z q beta gamma"), (3, "alpha beta"), (4, "gamma")]))
    wanted = decontam.phrases(items_df(spark, [(7, "alpha beta gamma")]))
    assert decontam.search(index, wanted).collect() == []
    assert [(r.nth, r.hit) for r in decontam.search(index, wanted, slop=1).collect()] == [(0, [0, 1, 2, 3])]
    low, high = decontam.intersect([np.array([4, 9]), np.array([5, 30])])
    assert low.tolist() == [4] and high.tolist() == [5]


def test_proximity_stays_inside_documents(spark):
    """The nearest occurrence may stand in the next document; one in the same still counts."""
    rows = [(1, "beta x x alpha"), (2, "beta y"), (3, "alpha"), (4, "beta")]
    items = spark.createDataFrame([("i", "alpha beta")], "item_id string, text string")
    for some in (rows[:1], rows):
        got = {r.doc_id: r.n_hit for r in decontam.contamination(docs(spark, some), items, slop=4).collect()}
        assert got[1] == 4 and not any(n for i, n in got.items() if i != 1)


def test_phrases_visit_segments_with_their_rarest_term_only(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) if x < 5000)) for k in range(60)]
    index = decontam.build_index(docs(spark, rows), segment_words=150)
    items = [(k, " ".join(rows[k][1].split()[5:12])) for k in range(0, 60, 3)] + [(90, "w1 nowhere w2"), (91, "w1 w2")]
    wanted = decontam.phrases(items_df(spark, items), 4).withColumn("block", F.lit(0))
    held = index.where("term is not null").select(F.col("segment").alias("seg"), "term")
    where: dict = {}
    for r in held.collect():
        where.setdefault(bytes(r.term), set()).add(r.seg)
    want = {}
    for r in wanted.collect():
        terms = tuple(bytes(t) for t in r.terms)
        for seg in where.get(min(terms, key=lambda t: (len(where.get(t, ())), t)), ()):
            want[seg, terms] = sorted(r["items"])
    for most in (0, 10**6):
        got = decontam.routes(held, wanted, most).collect()
        assert len(got) == len(want) and {(r.seg, tuple(bytes(t) for t in r.terms)): sorted(r["items"]) for r in got} == want
    assert 0 < len(want) < wanted.count() * len({s for v in where.values() for s in v}) / 2
    got = decontam.contamination(docs(spark, rows), items_df(spark, items), 4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == brute(rows, items, 4)


def test_very_long_texts(spark):
    long = " ".join(f"a{k}" for k in range(150_000))
    rows = [(1, long + " the planted words stand here at last"), (2, "planted " + long), (3, "x " * 200_000)]
    items = [(7, "The planted words, stand here"), (8, "x x x x x x x x x x x x")]
    got = decontam.contamination(docs(spark, rows), items_df(spark, items)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == [(1, 150_007, 5, ["7"]), (2, 150_001, 0, []), (3, 200_000, 200_000, ["8"])]
