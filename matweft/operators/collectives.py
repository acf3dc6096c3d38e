"""What collectives between processes come to: unions, sums and extremes by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import data_type, sum_blocks
from .validate import check_split


def concat_matrices(parts: list[tuple[DataFrame, int]], axis: str = "col") -> DataFrame:
    """All-gather: coo parts side by side (col) or one below the other (row); each part comes
    with its extent along the axis."""
    at, moved, key = 0, [], "j" if axis == "col" else "i"
    for df, extent in parts:
        moved.append(df.withColumn(key, F.col(key) + F.lit(at).cast("long")).select("i", "j", "v"))
        at += extent
    return reduce(DataFrame.unionByName, moved)


def reduce_scatter(partials: DataFrame, owner: F.Column) -> DataFrame:
    """Sum of partial cells (i, j, v) and the part that owns each."""
    return partials.groupBy("i", "j").agg(F.sum("v").cast("long").alias("v")).withColumn("owner", owner)


def reduce_scatter_splits(partials: DataFrame, splits: list[int], total: int, axis: str = "j") -> DataFrame:
    """reduce_scatter where part k owns the next splits[k] indices of an axis of length total."""
    check_split(splits, total)
    ends = F.array(*[F.lit(sum(splits[: k + 1])).cast("long") for k in range(len(splits))])
    return reduce_scatter(partials, F.size(F.filter(ends, lambda e: e <= F.col(axis))))


def all_reduce(values: DataFrame, *keys: str) -> DataFrame:
    """Sum, largest and smallest of v over the ranks."""
    return values.groupBy(*keys).agg(F.sum("v").cast("long").alias("sum_v"), F.max("v").cast("long").alias("max_v"), F.min("v").cast("long").alias("min_v"), F.count("*").alias("n_ranks"))


def sum_tiles(tiles: DataFrame, fan: int | None = None) -> DataFrame:
    """Sum of dense partial results: tiles (part, rb, cb, nrow, ncol, data) of all parts, by place,
    in two keyed levels of about `fan` and then parts / fan sums each (fan: the root of the number
    of shuffle partitions). What is moved is a tile a part and place, however many numbers went
    into it; a task holds a sum and one tile."""
    data_type(tiles)
    fan = fan or max(1, round(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    first = sum_blocks(tiles.withColumn("part", F.expr(f"part % {fan}")), "part")
    return sum_blocks(first.drop("part")) if fan > 1 else first.drop("part")
