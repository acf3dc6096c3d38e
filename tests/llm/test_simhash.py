import random

import numpy as np
from pyspark.sql import functions as F
import xxhash

from matweft.llm import simhash
from tests.llm.helpers import docs


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(codes, bits):
    label = list(range(len(codes)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= bits:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(codes))]


def test_index_matches_all_pairs():
    rng = random.Random(3)
    for n, spread in ((1, 3), (40, 3), (300, 2), (300, 6), (500, 40)):
        centre = [rng.getrandbits(64) for _ in range(5)]
        codes = list({rng.choice(centre) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) for _ in range(n)})
        code = np.array(codes, dtype=np.uint64)
        order = np.argsort(simhash.gray_rank(code), kind="stable")
        a, b = simhash.GrayIndex(np.zeros(len(code), np.int64), code[order]).links(4)
        got = simhash.spanning(len(code), a, b)
        assert got.tolist() == brute_classes([int(c) for c in code[order]], 4)


def test_classes_match_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "One two"), (10_003, "one TWO"), (5, rows[5][1])]
    rows += [(20_000 + i, " ".join(rows[3][1].split()[: 200 + i % 3])) for i in range(40)]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.simhash_classes(docs(spark, rows)).collect()}
    fps = [brute_fp(t) for _, t in rows]
    classes = brute_classes(fps, 4)
    least = {}
    for (i, _), c in zip(rows, classes):
        least[c] = min(i, least.get(c, i))
    want = {(i, f - (1 << 64) if f >= 1 << 63 else f): least[c] for (i, _), f, c in zip(rows, fps, classes)}
    assert got == want


def test_empty_and_null_ids(spark):
    assert simhash.simhash_classes(docs(spark, [(1, "x")]).limit(0)).collect() == []
    got = sorted(map(tuple, simhash.simhash_classes(docs(spark, [(None, "a"), (4, "a"), (None, "b")])).select("doc_id", "component_id").collect()), key=str)
    assert got == [(4, 4), (None, 4), (None, None)]


def test_null_ids_link(spark, monkeypatch):
    """Fingerprints 0, 0b1111, 0xff: the middle one, of a row without id, joins the others."""
    codes = {"a": 0, "b": 0b1111, "c": 0xFF}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", F.lit(1).cast("long").alias("text_hash"), F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[F.col("text")].cast("long").alias("fp")))
    got = sorted(simhash.simhash_classes(docs(spark, [(4, "a"), (None, "b"), (9, "c")])).select("fp", "component_id").collect())
    assert [r.component_id for r in got] == [4, 4, 4]
