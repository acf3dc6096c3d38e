"""Process grids, block layouts and redistribution, as projections and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matweft.functions import floor_split
from matweft.session import staged

#: Which grid axes split the rows and the columns, and which splits the columns again.
FACES = {"a": ("row", "col", "fib"), "b": ("col", "fib", "row"), "c": ("row", "fib", "col")}


def grid_coordinates(ranks: DataFrame, p2: int, p3: int) -> DataFrame:
    """rank -> (row, col, fib) in C order."""
    r = F.col("rank")
    return ranks.select("rank", F.expr(f"rank div {p2 * p3}").alias("row"), F.expr(f"(rank div {p3}) % {p2}").alias("col"), (r % p3).alias("fib"))


def grid_groups(coords: DataFrame) -> DataFrame:
    """The three groups of each rank: ranks that agree in the other two coordinates."""
    out = coords
    for axis, (a, b) in {"row": ("row", "fib"), "col": ("col", "fib"), "fib": ("row", "col")}.items():
        group = coords.groupBy(a, b).agg(F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda x: x.cast("string")), ",").alias(f"{axis}_group"))
        out = out.join(group, [a, b])
    return out.select("rank", "row", "col", "fib", "row_group", "col_group", "fib_group")


def face_layout(coords: DataFrame, face: str, dims: dict[str, int], m: int, n: int) -> DataFrame:
    """(rank, row_start, n_rows, col_start, n_cols) of each rank's block of an m x n matrix."""
    by_row, by_col, inner = FACES[face]
    row_start, n_rows = floor_split(m, dims[by_row], by_row)
    outer_start, outer = floor_split(n, dims[by_col], by_col)
    inner_start, n_cols = floor_split(outer, dims[inner], inner)
    return coords.select("rank", row_start.alias("row_start"), n_rows.alias("n_rows"), (outer_start + inner_start).alias("col_start"), n_cols.alias("n_cols"))


def prefix_sums(rows: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """rows with the exclusive running sum of value in the order of some columns, which tell all
    rows apart.

    Rows are dealt out in ranges of the order and kept so; the ranges' sums (a row a range) give
    each range what came before it, and a window within the range gives the rest. No task has
    more than a range. Null values count as 0; the sums have value's own type, at least bigint.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("s")).orderBy("__range").collect()  # a row a range
    ahead, offsets = 0, {}
    for r in sums:
        offsets[r["__range"]] = ahead
        ahead += r.s or 0
    kind = dealt.select(F.sum(value).alias("s")).schema["s"].dataType
    offset = F.create_map(*[F.lit(x) for k, v in offsets.items() for x in (k, v)])[F.col("__range")].cast(kind) if offsets else F.lit(0)
    within = F.sum(value).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return dealt.withColumn(name, (offset + F.coalesce(within, F.lit(0))).cast(kind)).drop("__range")


def displacements(counts: DataFrame) -> DataFrame:
    """(part, size) -> exclusive running sums, over one row a part."""
    return prefix_sums(counts.select("part", "size"), ["part"], "size", "displacement")


def redistribute(coo: DataFrame, m: int, n: int, row_parts: int, col_parts: int) -> DataFrame:
    """Cells with the block (rb, cb) each goes to under floor splits, dealt out by block.

    Row to column blocks is (1, P), row to 2-D blocks (P1, P2), 2-D to row blocks (P, 1).
    """
    rb = F.least(F.expr(f"i div {max(1, m // row_parts)}"), F.lit(row_parts - 1))
    cb = F.least(F.expr(f"j div {max(1, n // col_parts)}"), F.lit(col_parts - 1))
    return coo.select("i", "j", "v", rb.alias("rb"), cb.alias("cb")).repartition("rb", "cb")
