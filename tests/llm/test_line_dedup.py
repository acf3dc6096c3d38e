import random
from collections import Counter

from pyspark.sql import functions as F

import pytest
import xxhash

from matweft.llm import line_dedup
from matweft.llm.line_dedup import band_keys, dedup_lines, signatures
from tests.llm.helpers import docs


def grams(line, k=9):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(rows, similarity=0.8):
    """(doc_id, kept text) for each row; one line stays per class of similar lines."""
    first = {}
    key = lambda i, t: (i is not None, i or 0, text_hash(t))
    for i, text in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: key(*r)):
        for pos, line in enumerate(text.split("\n")):
            if line.strip(" \t\r"):
                first.setdefault(line, (*key(i, text), pos))
    lines, sets = list(first), [grams(x) for x in first]
    label = list(range(len(lines)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by_gram = {}
    for k, s in enumerate(sets):
        for j in Counter(j for g in s for j in by_gram.get(g, ())):
            both = len(s & sets[j])
            if both / (len(s) + len(sets[j]) - both) >= similarity:
                a, b = sorted((root(k), root(j)))
                label[b] = a
        for g in s:
            by_gram.setdefault(g, []).append(k)
    keep = {}
    for k, line in enumerate(lines):
        keep[root(k)] = min(keep.get(root(k), first[line]), first[line])
    where = {line: keep[root(k)] for k, line in enumerate(lines)}
    out = []
    for i, text in rows:
        if text is not None:
            text = "\n".join(x for pos, x in enumerate(text.split("\n")) if not x.strip(" \t\r") or where[x] == (*key(i, text), pos))
        out.append((i, text))
    return sorted(out, key=str)


def test_matches_brute_force(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rng = random.Random(4)
    line = rows[0][1].split("\n")[0]
    for i in range(60):  # near copies of one line, each with a word changed
        words = line.split(" ")
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((1000 + i, " ".join(words) + "\n\n" + line))
    rows += [(2000, None), (2001, ""), (2002, "\n \n"), (2002, "\n \n"), (None, "no id here\nno id here"), (2003, "x" * 20_000), (2004, "x" * 20_010 + "y")]
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(docs(spark, rows)).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    same = sum(a == b for a, b in zip(got, want))
    assert same >= 0.995 * len(want), [x for x in zip(got, want) if x[0] != x[1]][:3]


def test_short_and_repetitive_lines(spark):
    rows = [(1, "Of.\nof.\nab ab ab ab ab ab ab ab ab\nab ab ab ab ab ab ab ab ab ab"), (2, "Of.\nxy\nOf.")]
    assert sorted(map(tuple, dedup_lines(docs(spark, rows)).select("doc_id", "text", "n_lines", "n_removed").collect())) == [
        (1, "Of.\nof.\nab ab ab ab ab ab ab ab ab", 4, 1),
        (2, "xy", 3, 2),
    ]


def test_recall_of_bands_at_the_threshold(spark):
    rng = random.Random(9)
    pairs = []
    while len(pairs) < 1500:
        base = "".join(rng.choice("abcdefghij ") for _ in range(300))
        edit = list(base)
        for p in rng.sample(range(300), 4):
            edit[p] = "Z"
        a, b = grams(base), grams("".join(edit))
        if 0.8 <= len(a & b) / len(a | b) < 0.83:
            pairs.append((base, "".join(edit)))
    bands = bands_of(spark, [x for p in pairs for x in p])
    assert sum(bool(bands[x] & bands[y]) for x, y in pairs) >= 0.99 * len(pairs)


def bands_of(spark, lines):
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "h bigint, line string")
    return {lines[r.h]: set(r.bands) for r in signatures(table, 9).select("h", band_keys().alias("bands")).collect()}


def test_lines_with_a_common_frame(spark):
    """2000 pairs: 0.99 alike in a pair, at most 0.74 across; every pair is found."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    frame = word(170)
    rows = []
    for i in range(2000):
        own = word(30)
        rows += [(2 * i, frame + own + "a"), (2 * i + 1, frame + own + "b")]
    got = dedup_lines(docs(spark, rows)).select("doc_id", "n_removed").collect()
    assert sum(r.n_removed for r in got if r.doc_id % 2) >= 1980
    assert all(r.n_removed == 0 for r in got if r.doc_id % 2 == 0)


@pytest.mark.parametrize("own, common", [(18, 8), (12, 14), (6, 20)])
def test_pairs_near_the_threshold_in_a_common_frame(spark, own, common):
    """2000 pairs in a frame of 180 letters, 0.83 to 0.95 alike in a pair and 0.76 to 0.78
    across: of the pairs that share a band at least 0.99 are found, and nothing else."""
    rng = random.Random(own)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    frame, lines = word(180), []
    for _ in range(2000):
        behind = word(common)
        lines += [word(own) + frame + behind, word(own) + frame + behind]
    bands = bands_of(spark, lines)
    share = [bool(bands[a] & bands[b]) for a, b in zip(lines[::2], lines[1::2])]
    got = {r.doc_id for r in dedup_lines(docs(spark, list(enumerate(lines)))).where("n_removed > 0").collect()}
    sets = [grams(x) for x in lines]
    for i in (i for i in got if i % 2 == 0):  # lines of other pairs are alike enough now and then
        assert any(len(y & x) >= 0.8 * len(y | x) for y in sets[i : i + 2] for j, x in enumerate(sets) if j // 2 != i // 2)
    assert sum(ok and 2 * i + 1 in got for i, ok in enumerate(share)) >= 0.99 * sum(share)


def test_families_of_many_in_a_common_frame(spark):
    """40 families of 60 lines: the part that a family shares is not rare either."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    frame, rows = word(180), []
    for family in range(40):
        behind = word(14)
        rows += [(100 * family + i, word(12) + frame + behind) for i in range(60)]
    got = {r.doc_id for r in dedup_lines(docs(spark, rows)).where("n_removed > 0").collect()}
    # every line of a family is alike, and now and then lines of two families are
    sets, holders = {i: grams(x) for i, x in rows}, {}
    for i, x in sets.items():
        for g in x - grams(frame):
            holders.setdefault(g, []).append(i)
    met = Counter((a, b) for at in holders.values() for a in at for b in at if a // 100 < b // 100)
    label = list(range(40))
    for a, b in met:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((label[a // 100], label[b // 100]))
            label = [low if x == high else x for x in label]
    want = {i for i in sets if i % 100 or label[i // 100] != i // 100}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_recall_at_the_threshold(spark):
    """1500 pairs of similarity 0.8 to 0.85, and as many of 0.75 to 0.795."""
    rng = random.Random(32)
    rows, near = [], set()
    while len(rows) < 6000:
        base = "".join(rng.choice("abcdefghij ") for _ in range(300))
        edit = list(base)
        for p in rng.sample(range(300), rng.randint(3, 5)):
            edit[p] = "Z"
        a, b = grams(base), grams("".join(edit))
        like = len(a & b) / len(a | b)
        close = 0.8 <= like < 0.85
        if (close and len(near) < 1500) or (0.75 <= like < 0.795 and len(rows) // 2 - len(near) < 1500):
            if close:
                near.add(len(rows) + 1)
            rows += [(len(rows), base), (len(rows) + 1, "".join(edit))]
    gone = {r.doc_id for r in dedup_lines(docs(spark, rows)).where("n_removed > 0").collect()}
    assert gone <= near and len(gone) >= 0.99 * len(near)


def test_joins_without_broadcast(spark, monkeypatch):
    rows = [(i, f"{'lorem ipsum dolor sit amet ' * 4}{i // 3} {'x' * (i % 3)}\nown line of {i * 7919} and no other\nsame line") for i in range(60)]
    want = sorted(dedup_lines(docs(spark, rows)).select("doc_id", "text").collect())
    for bound in ("BANDS", "PLACES", "KEPT", "REMOVED"):
        monkeypatch.setattr(line_dedup, f"BROADCAST_{bound}", -1)
    assert sorted(dedup_lines(docs(spark, rows)).select("doc_id", "text").collect()) == want


def test_shared_and_null_ids(spark):
    other = "something nobody else ever wrote"
    rows = [(1, "dup"), (7, "dup"), (7, other), (None, "dup"), (None, "a line of its own, without an id"), (8, "née à l'été, un texte où rien ne manque"), (9, "née à l'été, un texte où rien ne manqua")]
    got = sorted(map(tuple, dedup_lines(docs(spark, rows)).select("doc_id", "text").collect()), key=str)
    assert got == sorted([(1, ""), (7, ""), (7, other), (None, "dup"), (None, rows[4][1]), (8, rows[5][1]), (9, "")], key=str)


def test_families_in_a_common_frame(spark):
    """Lines with a common frame: classes are those of all pairs that share a band."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    frame = [word(150), word(150)]
    lines = []
    for _ in range(60):
        own = word(150)
        for _ in range(3):
            edit = list(own)
            edit[rng.randrange(150)] = "Z"
            lines.append(frame[0] + "".join(edit) + frame[1])
    members = {}
    for x, bands in bands_of(spark, lines).items():
        for band in bands:
            members.setdefault(band, set()).add(x)
    sets, label = {x: grams(x) for x in lines}, {x: x for x in lines}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in {(a, b) for m in members.values() for a in m for b in m if a < b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label[root(b)] = root(a)
    want, seen = [], set()
    for i, x in enumerate(lines):
        want.append((i, "" if root(x) in seen else x))
        seen.add(root(x))
    assert max(map(len, members.values())) > 100 and sum(x == "" for _, x in want) > 100
    assert sorted((r.doc_id, r.text) for r in dedup_lines(docs(spark, list(enumerate(lines)))).collect()) == want


@pytest.mark.parametrize("wide", [64, 4])
def test_all_lines_of_a_band_are_settled(spark, monkeypatch, wide):
    """Lines of 30 parts, of which two or three are changed: lines with one part between them are
    alike, and many have each part. Classes are exactly those of all pairs that share a band."""
    monkeypatch.setattr(line_dedup, "WIDE", wide, raising=False)
    rng = random.Random(77)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    parts = [(word(8), word(8)) for _ in range(30)]
    line = lambda changed: "".join(p[k in changed] for k, p in enumerate(parts))
    few = rng.sample([(i, j) for i in range(30) for j in range(i)], 150)
    many = [(*x, rng.choice([k for k in range(30) if k not in x])) for x in few]
    lines = list(dict.fromkeys(line(set(x)) for x in few + many))
    bands, sets, label = bands_of(spark, lines), {x: grams(x) for x in lines}, {x: x for x in lines}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    members = {}
    for x, keys in bands.items():
        for key in keys:
            members.setdefault(key, []).append(x)
    assert max(map(len, members.values())) > 64
    for a, b in {(a, b) for m in members.values() for a in m for b in m if a < b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label[root(b)] = root(a)
    seen, want = set(), []
    for i, x in enumerate(lines):
        if root(x) in seen:
            want.append(i)
        seen.add(root(x))
    got = dedup_lines(docs(spark, list(enumerate(lines)))).where("n_removed > 0").collect()
    assert 100 < len(want) < len(lines) and sorted(r.doc_id for r in got) == want


def test_bitmaps_reject_no_alike_pair(spark):
    """Pairs of all similarities, with repeated shingles and without: what a bitmap rejects is less
    alike than 0.8, and most of what is much less alike is rejected."""
    rng = random.Random(8)
    lines = []
    for k in range(600):
        base = [rng.choice("abcdefghij ") for _ in range(rng.choice([3, 9, 40, 200, 600]))] * (1 + k % 3 // 2)
        edit = list(base)
        for p in rng.sample(range(len(base)), min(len(base), rng.randint(0, 6))):
            edit[p] = "Z"
        lines += ["".join(base), "".join(edit) + "ab" * rng.randint(0, 4)]
    table = spark.createDataFrame(list(enumerate(lines)), "h bigint, line string")
    marked = line_dedup.marks(table, 9)
    pairs = marked.toDF("a", "n_a", "m_a").join(marked.toDF("b", "n_b", "m_b"), F.expr("a div 2 = b div 2 and a < b"))
    left = {r.a for r in pairs.where(line_dedup.may_be_alike(0.8)).select("a").collect()}
    like = {i: len(x & y) / len(x | y) for i in range(0, len(lines), 2) for x, y in [(grams(lines[i]), grams(lines[i + 1]))]}
    assert {i for i, v in like.items() if v >= 0.8} <= left
    far = {i for i, v in like.items() if v < 0.5}
    assert len(far) > 100 and len(far - left) >= 0.9 * len(far)


def test_lines_of_one_class_do_not_meet_by_frequent_shingles(spark):
    """One family of 400 lines in classes that rare shingles unite: what is then left to meet by
    the frequent ones grows with the family, not with its square."""
    lines = [(i, i, list(range(200)) + list(range(1000 + 20 * (i // 2), 1010 + 20 * (i // 2)))) for i in range(400)]
    sets = spark.createDataFrame(lines, "h bigint, c bigint, s array<bigint>")
    keys = line_dedup.prefix_keys(sets, 0.8).cache()
    rare = line_dedup.prefix_pairs(keys.where("times <= 64").drop("times"), 0.8).distinct().collect()
    assert sorted(map(tuple, rare)) == [(i, i + 1) for i in range(0, 400, 2)]
    one = keys.where("times > 64").drop("times").withColumn("c", F.lit(0).cast("long"))
    assert line_dedup.prefix_pairs(one, 0.8).count() == 0
    assert line_dedup.prefix_pairs(keys.where("times > 64").drop("times"), 0.8).distinct().count() == 400 * 399 // 2
    keys.unpersist()


def test_empty(spark):
    assert dedup_lines(docs(spark, [(1, "x")]).limit(0)).collect() == []
    assert dedup_lines(docs(spark, [(1, None)])).select("text", "n_lines", "n_removed").collect() == [(None, 0, 0)]
