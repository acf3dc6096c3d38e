"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document is wanted x times: target / size of its
source, tilted so that short documents are wanted more often than long ones and the words
of the mix come from more documents; weighted by words, x has the mean target / size. The
whole part of x is allocated for certain, the fraction p is the inclusion probability in a
sample. For the sample, documents of a source and size class are ranked by
Q = (u / (1 - u)) / (p / (1 - p)), u a hash of the document, and as many of the lowest ranks
are taken as the class's p add up to, a number fixed before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Ranks are cut into so many bins for the running sums, so no sort is larger than one
#: bin of one source, and the sum over bins has at most this many rows a source.
BINS = 1 << 14
#: With up to so many sources, what is known of each (some 50 bytes) is broadcast, so that
#: the documents of a hot source need not meet; with more it is joined by source.
BROADCAST_SOURCES = 100_000
#: Of the room that x has between none and the most copies, the part that the tilt uses.
TILT = 0.5


def words(text: Column) -> Column:
    """Number of runs of anything but space, tab, LF, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, other columns, target, fraction) from rows (source,
    source_size, other columns).

    Sources take the weights in turn, in code point order, null last. The targets are
    min(most * size, level * weight), with the level that makes them add up to share of all
    words: what is left when an excess is reshared by weight until none is above its limit.
    One row a source; the windows here see those rows only.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("limit", F.col("source_size") * most).withColumn("full_at", F.col("limit") / F.col("w"))
    by_level = W.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("full", F.coalesce(F.sum("limit").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("try", (F.col("budget") - F.col("full")) / F.col("open"))
    )
    # the first source in this order that its share does not fill fixes the level
    ranked = ranked.withColumn("level", F.min(F.when(F.col("try") <= F.col("full_at"), F.struct("full_at", "source", "try"))).over(everything)["try"])
    target = F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("w")), F.col("limit"))
    return ranked.select(*sizes.columns, target.alias("target")).withColumn(
        "fraction", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, fixes: int = 2) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one per row of docs.

    docs has doc_id, text and source; other columns are ignored. Null and empty texts have
    size 0 and are taken with their whole copies at no cost. A null source is a source of
    its own, the last. Repeated rows are separate documents, told apart by their order only,
    so reruns give the same rows. No documents give no rows.

    fixes: after the sample, the one document whose size comes nearest to what its source
    still lacks or has too much is added or dropped, so many times; without them the sample
    has its fixed size.
    """
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    # identical rows are numbered, so that a single one of them can be picked
    nth = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(F.lit(0)))
    number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "size", "nth"), 11)
    slim = slim.withColumn("nth", nth).withColumn("u", (number.cast("double") + 0.5) / float(1 << 53))
    slim = staged(slim.withColumn("log_size", F.round(F.log2(F.col("size") + 1.0), 6)), "mix_sizes")
    plan = _tilted(targets(_sizes(slim), weights, share, most), most)
    few = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda df: df

    wanted = F.when(F.col("source_size") > 0, F.col("fraction") + F.col("tilt") * (F.col("mean_log") - F.col("log_size"))).otherwise(0.0)
    odds = F.col("p") / (1 - F.col("p"))
    ranked = (
        slim.join(few(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("wanted", F.greatest(F.least(wanted, F.lit(most)), F.lit(0.0)))
        .withColumn("whole", F.floor("wanted").cast("int"))
        .withColumn("p", F.col("wanted") - F.col("whole"))
        .withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / odds))
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
        .withColumn("class", F.floor("log_size").cast("int"))
        .select("doc_id", "source", "size", "nth", "source_size", "target", "whole", "p", "rank", "bin", "class")
    )
    sampled = _sample(staged(ranked, "mix_ranked"), seed, few)
    for k in range(fixes):
        sampled = _fix(staged(sampled, f"mix_sample{k}"), few)
    copies = F.col("whole") + F.col("extra")
    return sampled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _sizes(slim: DataFrame) -> DataFrame:
    return slim.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        # exact sums, so that reruns agree to the last bit
        F.sum(F.col("size") * F.col("log_size").cast("decimal(8,6)")).cast("double").alias("log_words"),
        F.min("log_size").alias("low"),
        F.max("log_size").alias("high"),
    )


def _tilted(plan: DataFrame, most: float) -> DataFrame:
    """The targets with the mean log size of a source, weighted by words, and the tilt: copies by
    which a document is wanted more often for each power of two that it is shorter."""
    mean = F.when(F.col("source_size") > 0, F.col("log_words") / F.col("source_size")).otherwise(0.0)
    reach = F.greatest(F.col("mean_log") - F.col("low"), F.col("high") - F.col("mean_log"))
    # rounding alone makes a reach where all sizes are one
    tilt = F.when(reach > 1e-9, TILT * F.least(F.col("fraction"), most - F.col("fraction")) / reach).otherwise(0.0)
    told = plan.withColumn("mean_log", mean).withColumn("tilt", tilt)
    return staged(told.select("source", "source_size", "target", "fraction", "mean_log", "tilt"), "mix_targets")


def _sample(ranked: DataFrame, seed: int, few) -> DataFrame:
    """extra = 1 for the lowest ranks of each source and size class, as many as its p add up to.

    The numbers of a source's classes are roundings of running sums with one random start, so
    each has the right mean and they add up to that of the source. Ranks are counted in two
    steps: over the bins of a class, then, only in the bin where the number is reached, over
    its documents.
    """
    strata = W.partitionBy("source").orderBy("class")
    start = (F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source"), F.lit(1 << 20)).cast("double") + 0.5) / float(1 << 20)
    upto = F.floor(F.sum("p").over(strata).cast("double") + start)
    number = ranked.where("bin is not null").groupBy("source", "class").agg(F.sum(F.col("p").cast("decimal(10,9)")).alias("p"))
    number = number.withColumn("upto", upto).select("source", "class", (F.col("upto") - F.coalesce(F.lag("upto").over(strata), F.lit(0))).alias("number"))

    bins = ranked.where("bin is not null").groupBy("source", "class", "bin").agg(F.count("*").alias("in_bin"))
    run = W.partitionBy("source", "class").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("upto", F.sum("in_bin").over(run))
    number = number.select(F.col("source").alias("s"), F.col("class").alias("k"), "number")
    bins = bins.join(few(number), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")))
    # the first bin that has more than the number; a class taken whole has none
    cut = bins.where("upto > number").groupBy("s", "k").agg(F.min_by(F.struct("bin", (F.col("number") - F.col("upto") + F.col("in_bin")).alias("left")), "bin").alias("cut"))
    cut = cut.select("s", "k", F.col("cut.bin").alias("cut_bin"), "cut.left")
    with_cut = ranked.join(few(cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")), "left").drop("s", "k")
    at = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    below = F.coalesce((F.col("bin") < F.col("cut_bin")) | (F.col("bin").isNotNull() & F.col("cut_bin").isNull()), F.lit(False))
    rest = with_cut.where(~at).withColumn("extra", below.cast("int"))
    place = F.row_number().over(W.partitionBy("source", "class").orderBy("rank", "doc_id", "nth"))
    edge = with_cut.where(at).withColumn("extra", (place <= F.col("left")).cast("int"))
    return rest.unionByName(edge).drop("cut_bin", "left")


def _fix(sampled: DataFrame, few) -> DataFrame:
    """Add or drop, in each source, the one document that brings it nearest to its target."""
    taken = F.sum((F.col("whole") + F.col("extra")) * F.col("size"))
    left = sampled.groupBy(F.col("source").alias("s")).agg((F.first("target") - taken).alias("off"))
    after = F.abs(F.abs(F.col("off")) - F.col("size"))
    free = F.when(F.col("off") > 0, (F.col("extra") == 0) & F.col("bin").isNotNull()).otherwise(F.col("extra") == 1)
    best = (
        sampled.join(few(left), F.col("source").eqNullSafe(F.col("s")))
        .where(free & (after < F.abs(F.col("off"))))
        .groupBy("s")
        .agg(F.min(F.struct(after.alias("after"), "rank", F.col("doc_id").alias("pick"), F.col("nth").alias("pick_nth"))).alias("b"))
        .select("s", "b.pick", "b.pick_nth", F.col("b.rank").alias("pick_rank"))
    )
    on = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("pick")) & (F.col("nth") == F.col("pick_nth")) & (F.col("rank") == F.col("pick_rank"))
    flipped = F.when(F.col("pick_nth").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))
    return sampled.join(few(best), on, "left").withColumn("extra", flipped).select(*sampled.columns)
