"""Line dedup across documents: fuzzy lines by MinHash, in DataFrame functions only.

A line's shingles are the runs of `shingle` characters (UTF-16 units: a character beyond the
basic plane counts as two). Each shingle is hashed once to a long; a signature value is the
least exclusive-or of a line's hashes with a fixed number. Hashing and minima run in
generated code: shingles are made in short stretches, of which only the minima are kept.
Values stand in three groups of four, and each triple of a group is a band, so two lines of
similarity 0.8 share a band with probability 0.994, of 0.9 with 0.9998.

1. Of each band the least and the greatest line are found by an aggregate that combines
   early; bands of one line drop out. Every line of a band is compared with the least one by
   the exact Jaccard similarity of the shingle sets, and links feed a distributed union-find.
2. All lines of a band that still holds several classes are compared, unless they are of one
   class. In bands of up to WIDE lines, pairs are taken as they are. Wider bands are first
   narrowed by rounds of comparisons with one more line of a band's largest class; their lines
   are then joined by prefixes, which is exact: shingles are put in order, rarest first, and two
   lines that are alike share one of the first fifth of the longer line and the first ninth of
   the shorter. Rare shingles are joined first, and lines that have come into one class by
   them do not meet by the frequent ones. Pairs whose bitmaps show too many shingles of
   one line alone are not compared, which is exact as well. So every two lines that share a band are compared, or in one class already,
   or shown to be less alike than the threshold.
3. Of each class the line that stands first stays.

Lines are told apart by a 64-bit hash: among 10^9 different lines, a chance of 3 % that any
two are taken for one.
"""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, staged

#: Up to so many bands with several lines, and so many lines in them, are broadcast (some
#: 50 MB each); more are joined by a shuffle.
BROADCAST_BANDS = 1_000_000
BROADCAST_PLACES = 1_000_000
#: Up to so many lines that have copies, and so many classes of them, are broadcast (some 50 MB).
BROADCAST_KEPT = 1_000_000
#: Up to so many removed lines, their places are broadcast to the documents (some 50 MB);
#: more are brought there by a shuffled join.
BROADCAST_REMOVED = 2_000_000

GROUPS, GROUP = 3, 4
#: Shingles hashed in one step of generated code.
STRETCH = 8
#: Keys of up to WIDE lines are joined first, then those of up to so many times more lines.
STEP = 16
#: Longs of a line's bitmap, a power of two.
WORDS = 16
#: Lines of a band of which all pairs are compared as they are.
WIDE = 64
#: Rounds of comparisons with one more line of a wide band; they end when a round has brought
#: less than a tenth of what was left into the bands' largest classes.
ROUNDS = 12

_rng = random.Random(20)
ORDERS = [_rng.getrandbits(64) - (1 << 63) for _ in range(GROUPS * GROUP)]


def _few(df: DataFrame, bound: int, weight: Column | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most bound rows (or that sum of weight)."""
    size = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= bound else df


def _characters(line: str) -> str:
    return f"encode({line}, 'UTF-16BE')"


def _shingles(shingle: int) -> str:
    """SQL for the number of shingles of the characters b; a shorter line is one."""
    return f"greatest(1, int(octet_length(b) / 2) - {shingle - 1})"


def _hash(at: str, shingle: int) -> str:
    return f"xxhash64(substring(b, 2 * ({at}) - 1, {2 * shingle}))"


def hashes(line: str, shingle: int) -> str:
    """SQL for the shingle hashes of a line. The one-element array holds its characters, so
    that the inner function does not fetch them anew for each shingle."""
    return f"transform(array({_characters(line)}), b -> transform(sequence(1, {_shingles(shingle)}), i -> {_hash('i', shingle)}))[0]"


def _held(rows: DataFrame, kept: list[str], **values: str) -> DataFrame:
    """The kept columns and the values of SQL expressions. They go through a generator, which
    the optimizer does not move them past: each is computed once, however often it is used."""
    return rows.select(*kept, F.inline(F.array(F.struct(*(F.expr(v).alias(k) for k, v in values.items())))))


def least_values(lines: DataFrame, shingle: int, orders: list[int]) -> DataFrame:
    """Rows (h, m0, m1, ...) for the distinct lines of rows (h, line): the upper 32 bits of the
    least hash in each order."""
    rows = lines.select("h", F.expr(_characters("line")).alias("b")).select("h", "b", F.expr(_shingles(shingle)).alias("n"))
    rows = rows.select("h", "b", "n", F.explode(F.expr(f"sequence(1, n, {STRETCH})")).alias("p"))
    # past the end the last shingle is taken again, which changes no minimum
    rows = rows.select("h", *(F.expr(_hash(f"least(p + {k}, n)", shingle)).alias(f"x{k}") for k in range(STRETCH)))
    least = [F.min(F.least(*(F.col(f"x{k}").bitwiseXOR(F.lit(c)) for k in range(STRETCH)))).alias(f"m{j}") for j, c in enumerate(orders)]
    return rows.groupBy("h").agg(*least).select("h", *(F.shiftrightunsigned(f"m{j}", 32).alias(f"m{j}") for j in range(len(orders))))


def signatures(lines: DataFrame, shingle: int) -> DataFrame:
    """Rows (h, v0, v1, ...) for the distinct lines of rows (h, line): the signature values,
    two in a long."""
    count = GROUPS * GROUP
    values = [F.shiftleft(f"m{j}", 32).bitwiseOR(F.col(f"m{j + 1}")).alias(f"v{j // 2}") for j in range(0, count, 2)]
    return least_values(lines, shingle, ORDERS).select("h", *values)


def band_keys() -> Column:
    """The bands of a row of signatures()."""
    half = lambda j: F.shiftrightunsigned(f"v{j // 2}", 32) if j % 2 == 0 else F.col(f"v{j // 2}").bitwiseAND(F.lit((1 << 32) - 1))
    return F.array(*(F.xxhash64(F.lit(g), *(half(GROUP * g + k) for k in triple)) for g in range(GROUPS) for triple in combinations(range(GROUP), 3)))


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, t, pos, h, line) of the lines that are not blank; t is a hash of the text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where("length(btrim(line, ' \t\r')) > 0").select("doc_id", "t", "pos", F.xxhash64("line").alias("h"), "line")


def alike(compared: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows (a, b, line_a, line_b) whose shingle sets have at least this Jaccard similarity."""
    sets = _held(compared, ["a", "b"], x=hashes("line_a", shingle), y=hashes("line_b", shingle))
    # both / (|x| + |y| - both) >= similarity
    both, sizes = F.size(F.array_intersect("x", "y")), F.size(F.array_distinct("x")) + F.size(F.array_distinct("y"))
    return sets.where(both * F.lit(1 + similarity) >= F.lit(similarity) * sizes - 1e-9).select("a", "b")


def _texts(wanted: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (h, line) for rows (h). Only documents where one of them stands first are taken apart."""
    first = places.join(_few(wanted, BROADCAST_PLACES), "h").groupBy("h").agg(F.min(F.struct("doc_id", "t", "pos")).alias("at"))
    at = first.groupBy(F.col("at.doc_id").alias("__at_id"), F.col("at.t").alias("__at_t")).agg(F.collect_list(F.struct("at.pos", "h")).alias("__at"))
    at = _few(staged(at, "line_places"), BROADCAST_PLACES, F.size("__at") + 1)
    found = docs.select("doc_id", "text").join(at, F.col("doc_id").eqNullSafe(F.col("__at_id")) & (F.xxhash64("text") == F.col("__at_t")))
    lines = found.select(F.explode(F.expr("transform(array(split(text, '\n')), l -> transform(__at, a -> struct(a.h, get(l, a.pos) as line)))[0]")).alias("x"))
    return lines.select("x.h", "x.line").dropDuplicates(["h"])  # rows may repeat


def marks(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (h, n, m) for rows (h, line): the number of a line's shingles, repeats included, and a
    bitmap of WORDS longs in which each shingle sets one bit."""
    rows = texts.select("h", F.expr(_characters("line")).alias("b")).select("h", "b", F.expr(_shingles(shingle)).alias("n"))
    rows = rows.select("h", "b", "n", F.explode(F.expr("sequence(1, n)")).alias("p")).select("h", "n", F.expr(_hash("p", shingle)).alias("x"))
    rows = rows.select("h", "n", F.expr(f"shiftright(x, 6) & {WORDS - 1}").alias("k"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    held = [F.bit_or(F.when(F.col("k") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(WORDS)]
    return rows.groupBy("h").agg(F.max("n").alias("n"), *held).select("h", "n", F.struct(*(f"m{k}" for k in range(WORDS))).alias("m"))


def _both(similarity: float) -> Column:
    """The least number of shingles that two lines of n_a and n_b share if they are alike."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-9)


def may_be_alike(similarity: float) -> Column:
    """Condition on (n_a, m_a, n_b, m_b) of marks(): false only for lines that are less alike. A bit
    that one bitmap has alone is of a shingle that one line has alone, and alike lines have at most
    (1 - similarity) / (1 + similarity) of their different shingles alone."""
    alone = sum((F.bit_count(F.col(f"m_a.m{k}").bitwiseXOR(F.col(f"m_b.m{k}"))) for k in range(WORDS)), F.lit(0))
    return alone <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-9


def line_classes(lines: DataFrame, places: DataFrame, docs: DataFrame, shingle: int = 9, similarity: float = 0.8) -> DataFrame:
    """Rows (node, component) for the lines of signatures() that have a near copy."""
    keyed = lines.select("h", F.explode(band_keys()).alias("band"))
    ends = keyed.groupBy("band").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("band", "low")
    ends = staged(ends, "line_bands", codec="snappy")
    members = staged(keyed.join(_few(ends, BROADCAST_BANDS), "band"), "line_members", codec="snappy")
    wanted = staged(members.select("h").distinct(), "line_wanted", codec="snappy")
    texts = staged(_texts(wanted, places, docs), "line_texts")
    marked = staged(marks(texts, shingle), "line_marks", codec="snappy")

    def linked(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(marked.toDF(x, f"n_{x}", f"m_{x}"), x)
        pairs = pairs.where(may_be_alike(similarity)).select("a", "b")
        for x in "ab":
            pairs = pairs.join(texts.select(F.col("h").alias(x), F.col("line").alias(f"line_{x}")), x)
        return staged(alike(pairs, shingle, similarity), "line_links")

    stars = staged(members.where("low <> h").select(F.col("low").alias("a"), F.col("h").alias("b")).distinct(), "line_pairs")
    classes = staged(connected_components(linked(stars)), "line_stars")
    in_class = members.join(classes, F.col("h") == F.col("node"), "left").select("band", "low", "h", F.coalesce("component", "h").alias("c"))
    in_class = staged(in_class, "line_inner", codec="snappy")
    # few bands have several classes; all lines of a band were compared with its least one
    mixed = in_class.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 < c1 and n > 2").select("band", "n")
    rows = staged(in_class.join(_few(staged(mixed, "line_mixed", codec="snappy"), BROADCAST_BANDS), "band"), "line_unsettled", codec="snappy")
    wide, was, found = staged(rows.where(F.col("n") > WIDE).select("band", "h", F.col("c").alias("c0"), "c"), "line_wide", codec="snappy"), None, []
    # a round takes the lines of wide bands that still hold several classes, and no others
    for k in range(ROUNDS + 1):
        tops = staged(_top_classes(wide), "line_tops", codec="snappy")
        got = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.col("n") * (F.col("n") - F.col("most"))), F.lit(0)).alias("work")).first()
        if k == ROUNDS or got.work <= WIDE * got.lines or (was is not None and got.work > 0.9 * was):
            break
        was = got.work
        held = wide.join(_few(tops.select("band", "top"), BROADCAST_BANDS), "band")
        centre = held.where("c = top").groupBy("band").agg(F.min_by("h", F.xxhash64(F.lit(k), "h")).alias("a"))
        found.append(linked(held.where("c <> top").select("band", F.col("h").alias("b")).join(centre, "band").select("a", "b").distinct()))
        of_class = held.where("h <> c").select(F.col("h").alias("a"), F.col("c").alias("b")).distinct()
        wide = staged(_moved(wide, connected_components(found[-1].unionByName(of_class))), "line_wide", codec="snappy")
    few = rows.where((F.col("n") <= WIDE) & (F.col("h") != F.col("low"))).select("band", "h", "c")
    if found:
        few = _moved(few, wide.where("c0 <> c").select(F.col("c0").alias("node"), F.col("c").alias("component")).distinct())
    x, y = few.toDF("band", "a", "c_a"), few.toDF("band", "b", "c_b")
    pairs = x.join(y, "band").where("a < b and c_a <> c_b").select("a", "b")
    found.append(linked(staged(pairs.distinct(), "line_pairs")))
    if got.lines:
        lines_of = staged(wide.join(_few(tops.select("band"), BROADCAST_BANDS), "band").select("h", "c").distinct(), "line_inner", codec="snappy")
        keys = prefix_keys(_held(lines_of.join(texts, "h"), ["h", "c"], s=f"array_distinct({hashes('line', shingle)})"), similarity)
        of_class = lines_of.where("h <> c").select(F.col("h").alias("a"), F.col("c").alias("b"))
        # lines that meet by rare keys are mostly of one class before the others are joined
        least, most = 0, keys.agg(F.max("times")).first()[0] or 0
        while least < most:
            below = max(WIDE, STEP * least)
            level = keys.where((F.col("times") > least) & (F.col("times") <= below)).drop("times")
            if least:
                level = staged(_moved(level, connected_components(of_class)), "line_keys", codec="snappy")
            found.append(linked(staged(prefix_pairs(level, similarity).distinct(), "line_pairs")))
            least, of_class = below, of_class.unionByName(found[-1])
    edges = classes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    for links in found:
        edges = edges.unionByName(links)
    return staged(connected_components(edges), "line_classes")


def _top_classes(rows: DataFrame) -> DataFrame:
    """Rows (band, n, top, most) for rows (band, h, c): bands of several classes, their numbers of
    lines, their largest classes and the lines of these."""
    each = rows.groupBy("band", "c").count().groupBy("band")
    each = each.agg(F.sum("count").alias("n"), F.max_by("c", F.struct("count", "c")).alias("top"), F.max("count").alias("most"))
    return each.where("most < n")


def _moved(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with their classes c replaced where classes (node, component) tells another."""
    return rows.join(classes, F.col("c") == F.col("node"), "left").withColumn("c", F.coalesce("component", "c")).drop("node", "component")


def prefix_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (g, h, c, n, rest, times) for rows (h, c, s) of lines, their classes and sets of
    shingles: keys g by which lines of different classes meet that have this Jaccard similarity.

    Shingles that the same lines have are one key, told by the exclusive-or of those lines; they
    share or miss it as a whole. Keys are ordered by the number of lines that have them. If the
    first key that a line shares with another leaves it `rest` shingles, those of the key with
    them, the two share no more; so keys that leave less than `similarity` of the line's are
    none. Nor are keys of one class. `times` is the number of a key's rows."""
    sets = staged(sets.select("h", "c", F.size("s").alias("n"), "s"), "line_sets", codec="snappy")
    rows = sets.select("h", "c", F.explode("s").alias("x"))
    shared = rows.groupBy("x").agg(F.count("*").alias("f"), F.bit_xor(F.xxhash64("h")).alias("g"), (F.min("c") < F.max("c")).alias("mixed")).where("f > 1")
    listed = rows.select("h", "x").join(shared, "x").select("h", "f", "g", "mixed").repartition("h")  # for all that follows
    listed = listed.groupBy("h", "f", "g").agg(F.count("*").alias("w"), F.first("mixed").alias("mixed"))
    last_first = W.partitionBy("h").orderBy(F.desc("f"), F.desc("g")).rowsBetween(W.unboundedPreceding, W.currentRow)
    listed = listed.withColumn("rest", F.sum("w").over(last_first)).where("mixed").select("h", "g", "rest")
    keys = listed.join(sets.select("h", "c", "n"), "h").where(F.col("rest") >= F.ceil(F.lit(similarity) * F.col("n") - 1e-9))
    keys = staged(keys.select("g", "h", "c", "n", "rest"), "line_keys", codec="snappy")
    times = keys.groupBy("g").agg(F.count("*").alias("times"), (F.min("c") < F.max("c")).alias("mixed")).where("mixed").select("g", "times")
    return staged(keys.join(times, "g"), "line_keys", codec="snappy")


def prefix_pairs(keys: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b) for rows (g, h, c, n, rest) of prefix_keys(): the pairs of lines of different
    classes that meet in a key and may be alike, some more than once.

    Two lines of n and m shingles are alike if they share 1 / (1 + 1 / similarity) of n + m: that is
    not less than 2 / (1 + 1 / similarity) of the shorter. Lines of a key's largest class are
    compared with others only."""
    tops = keys.groupBy("g", "c").count().groupBy("g").agg(F.max_by("c", F.struct("count", "c")).alias("top"), F.count("*").alias("k")).where("k > 1").select("g", "top")
    keys = staged(keys.join(tops, "g").select("g", "h", "c", "n", "rest", (F.col("c") != F.col("top")).alias("out")), "line_keys", codec="snappy")
    long = keys.toDF("g", "a", "c_a", "n_a", "rest_a", "out_a")
    short = keys.where(F.col("rest") >= F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9)).toDF("g", "b", "c_b", "n_b", "rest_b", "out_b")
    met = long.where("out_a").join(short, "g").unionByName(long.where("not out_a").join(short.where("out_b"), "g"))
    met = met.where("c_a <> c_b and (n_a > n_b or n_a = n_b and a > b)").where(F.least("rest_a", "rest_b") >= _both(similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def removed_lines(docs: DataFrame, shingle: int = 9, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, t, removed): the places, from 0, of the lines that go, for documents that
    lose any; t is a hash of the text."""
    lines = _lines(docs)
    places = staged(lines.drop("line"), "line_all", codec="snappy")
    signed = staged(signatures(lines.select("h", "line"), shingle), "lines", codec="snappy")
    classes = staged(line_classes(signed, places, docs, shingle, similarity), "line_classes")
    again = places.groupBy("h").count().where("count > 1").select("h").join(classes, F.col("h") == F.col("node"), "left_anti")
    copied = staged(classes.select(F.col("node").alias("h"), F.col("component").alias("c")).unionByName(again.select("h", F.col("h").alias("c"))), "line_copied")
    at = F.struct("doc_id", "t", "pos")
    placed = staged(places.join(_few(copied, BROADCAST_KEPT), "h").select("c", at.alias("at")), "line_placed")
    keep = staged(placed.groupBy("c").agg(F.min("at").alias("keep")), "line_keep")
    gone = placed.join(_few(keep, BROADCAST_KEPT), "c").where("not (at <=> keep)")
    return staged(gone.groupBy("at.doc_id", "at.t").agg(F.collect_set("at.pos").alias("removed")), "line_removed")


def dedup_lines(docs: DataFrame, shingle: int = 9, similarity: float = 0.8, counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """docs with their texts less the lines that near-copy an earlier line, and, if counts
    names them, two more columns (long): the lines of the text, and those removed.

    Earlier: by doc_id, null first, then a hash of the text, then place. Blank lines always
    stay and are not counted as copies. Null texts stay null, with no lines; an empty text is
    one blank line. A document that loses every line keeps an empty text. Rows alike in
    doc_id and text are one document and lose the same places; rows that share a doc_id only
    are two. Other columns pass through, but for those with the names of the counts, which
    are replaced. No documents give no rows.
    """
    gone = removed_lines(docs, shingle, similarity)
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("t").alias("__gone_t"), F.col("removed").alias("__gone"))
    size = gone.agg(F.coalesce(F.sum(F.size("__gone") + 1), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if size <= BROADCAST_REMOVED else gone.hint("shuffle_hash")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.xxhash64("text") == F.col("__gone_t")), "left")
    kept = F.expr("transform(array(split(text, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), __gone), i -> l[i]), '\n'))[0]")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    out = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        n_lines = F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), F.lit(0))
        out += [n_lines.cast("long").alias(counts[0]), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)
