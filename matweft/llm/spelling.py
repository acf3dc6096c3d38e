"""Spelling variants of a vocabulary: words one edit apart, by pivotal grams.

The bigrams of a word are put in one order for all words, rarest first. A word's prefix are
its first three: among them are always two that do not overlap, and the two of least weight
(dynamic programming) are its pivots. One edit spoils one pivot at most. So of two words one
edit apart, a pivot of the one whose prefix ends earlier in the order stands in the prefix of
the other, at the same place from the start or, if the edit is left of it, from the end.

Pivots and prefixes meet in an equi-join. Its key holds the gram's place with all that the
place says: if the edit is right of the first pivot, both words agree up to this pivot's end
and in one half of what follows it; if it is left of the second one, in all from this pivot on
and in one half of what is before. The words that meet are then compared.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: What a word is made of, and its least length in code points and least number of occurrences.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its variants.
RATIO = 10
#: Grams whose counts are sent to all tasks, the most frequent ones; all others come before them.
SENT_GRAMS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, letters: str = LETTERS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows (doc_id, run): each run of letters of at least least_length, A-Z lower-cased. The runs
    are maximal, as a longest match is and nothing shorter than a whole run is left over."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{letters}]{{{least_length},}}"), 0)).alias("run"))
    return runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of words (word): those long and frequent enough. Null words are left out."""
    if least_length < 4:
        raise ValueError("two disjoint bigrams take words of at least 4 code points")
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def cheapest_disjoint(places: list[int], weights: list[int], span: int = 2, number: int = 2) -> list[int]:
    """The `number` of the increasing places, at least span apart, of the least sum of weights."""
    best: list = [(0, [])] + [None] * number  # best[k]: of k places among those seen
    before: list = []  # the same as it was at each place
    for k, (place, weight) in enumerate(zip(places, weights)):
        free = k
        while free and places[free - 1] > place - span:
            free -= 1
        before.append(list(best))
        base = before[free] if free < k else best
        for m in range(number, 0, -1):
            if base[m - 1] is not None:
                cost = base[m - 1][0] + weight
                if best[m] is None or cost < best[m][0]:
                    best[m] = (cost, [*base[m - 1][1], place])
    return best[number][1]


def prefixes(vocab: DataFrame) -> DataFrame:
    """vocab (word, n) with `last`, the weight of the last gram of the word's prefix, its first and
    second pivot's places a, b, and the places of its prefix, from 0. Grams equal to the last one
    of the prefix belong to it, up to two: more than two grams ahead of one no edit can make."""
    grams = F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), k -> substring(word, k, 2))"))).alias("gram")
    counts = vocab.select(grams).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(SENT_GRAMS).toArrow()
    sent = vocab.sparkSession.sparkContext.broadcast(dict(zip(counts["gram"].to_pylist(), counts["n"].to_pylist())))

    def run(batches):
        weigh = sent.value.get
        for batch in batches:
            last, pivots, places = [], [], []
            for word in batch.column(0).to_pylist():
                of = [(weigh(g := word[k : k + 2], 0), g, k) for k in range(len(word) - 1)]
                order = sorted(of)[:5]
                first = sorted(order[:3], key=lambda x: x[2])
                pivots.append(cheapest_disjoint([x[2] for x in first], [x[0] for x in first]))
                last.append(order[2][0])
                places.append([x[2] for k, x in enumerate(order) if k < 3 or x[1] == order[2][1]])
            a, b = zip(*pivots) if pivots else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(last, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(places, pa.list_(pa.int32()))], names=["word", "n", "last", "a", "b", "places"]
            )

    return vocab.select("word", "n").mapInArrow(run, "word string, n bigint, last bigint, a int, b int, places array<int>")


def _keys(word: Column, at: Column, length: Column, left: bool) -> list[Column]:
    """Keys of the gram of word at `at` for an indexed word of `length`: all up to the gram's end
    (left) or from its start, with the nearer and with the farther half of the rest."""
    from_end = F.length(word) - at - 2
    if left:
        near = F.floor((length - at - 2) / 2).cast("int")
        far = length - at - 2 - near
        return [F.xxhash64(F.lit(0), length, at, F.substring(word, F.lit(1), at + 2 + near)), F.xxhash64(F.lit(1), length, at, F.substring(word, F.lit(1), at + 2), F.right(word, far))]
    rest = length - from_end - 2
    near = F.floor(rest / 2).cast("int")
    return [F.xxhash64(F.lit(2), length, from_end, F.right(word, from_end + 2 + near)), F.xxhash64(F.lit(3), length, from_end, F.right(word, from_end + 2), F.substring(word, F.lit(1), rest - near))]


def near_pairs(vocab: DataFrame) -> DataFrame:
    """Rows (a, n_a, b, n_b), a < b: all pairs of words of vocab (word, n), distinct words, that
    differ by exactly one inserted, deleted or replaced code point."""
    words = staged(prefixes(vocab), "spelling_prefixes")
    word, size = F.col("word"), F.length("word")
    at = words.select("word", "n", "last", F.explode("places").alias("at"))
    index = at.select(F.explode(F.array(*_keys(word, F.col("at"), size, True), *_keys(word, F.col("at"), size, False))).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"))
    asked = [k for d in (-1, 0, 1) for p, left in (("a", True), ("b", False)) for k in _keys(word, F.col(p), size + d, left)]
    pivots = words.select(F.explode(F.array(*asked)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"))
    met = pivots.join(index, "key").where("a <> b and last_b >= last_a").where("levenshtein(a, b, 1) = 1")
    ahead = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    return met.select(pick("a", "b").alias("a"), pick("n_a", "n_b").alias("n_a"), pick("b", "a").alias("b"), pick("n_b", "n_a").alias("n_b")).distinct()


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root), one for each row of vocab (word, n).

    n_near counts the words one edit apart. form is the most frequent of them (ties: the smallest
    by code points), if it occurs at least ratio times as often as the word; form_n is its n.
    root is met by going from word to form as often as there is one; it is word if there is none.
    """
    vocab = staged(vocab.select("word", "n"), "spelling_words")
    near = staged(near_pairs(vocab), "spelling_near")
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    known = vocab.join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    known = staged(known, "spelling_forms")
    return known.join(roots(known.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) of links (word, form), which make no circle: each round every word goes on to
    where its root has got, so a chain's unmet part halves."""
    now = staged(links.select("word", F.col("form").alias("root")), "spelling_roots")
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = staged(moved, "spelling_roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now
    raise RuntimeError("forms make a circle")
