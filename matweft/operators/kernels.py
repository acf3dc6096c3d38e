"""Kernel matrices of feature rows (i, x), in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import batch_of

#: Rows a block; a block of the kernel has its square of numbers.
BLOCK = 512
#: Rows of either side that a group of panels holds (32 MB at 64 numbers a row).
HELD_ROWS = 65_536


def _panels(rows: DataFrame, size: int) -> DataFrame:
    by = rows.groupBy(F.floor(F.col("i") / size).cast("int").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    return by.select("b", F.size("r").alias("n"), F.expr("cast(flatten(transform(r, e -> e.x)) as array<double>)").alias("data"))


def kernel_blocks(rows: DataFrame, n: int, kind: str = "linear", sigma: float = 1.0, size: int = BLOCK) -> DataFrame:
    """blocks of X Xᵀ (linear) or exp(-|x - y|² / 2 sigma²) (rbf) for n rows with ids 0..n-1.

    The work is n² whatever the plan. A block leaves its task as soon as it is made.
    """
    return kernel_map(rows, n, lambda batches: batches, "rb int, cb int, nrow int, ncol int, data array<double>", kind, sigma, size)


def kernel_map(rows: DataFrame, n: int, use: Callable, schema: str, kind: str | Callable = "linear", sigma: float = 1.0, size: int = BLOCK) -> DataFrame:
    """What use(batches of blocks) yields of the blocks of kernel_blocks, in the tasks that make
    them, so that they need not leave these. kind may be a function of two panels of rows that
    gives their block.

    Panels of rows meet on a square grid: each goes to a row and a column of its groups. The side
    of the grid is the root of the groups that keep the cores busy, and grows only when a share
    of the rows is more than HELD_ROWS. Each group is a task of its own: by the bytes it gets,
    Spark would put many into one.
    """
    count = max(1, -(-n // size))
    spark = rows.sparkSession
    groups = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    side = min(count, max(math.isqrt(max(1, groups) - 1) + 1, -(-n // HELD_ROWS)))
    panels = _panels(rows, size).select("b", "n", "data", F.expr(f"cast(b * {side}L div {count} as int)").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("other"))
    ways = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(r).alias("g1"), F.col(c).alias("g2")) for k, (r, c) in enumerate((("g", "other"), ("other", "g"))))))
    met = panels.select("b", "n", "data", ways.alias("w")).select("w.side", F.expr(f"cast(w.g1 * {side} + w.g2 as int)").alias("g"), "b", "n", "data")

    def blocks(batches):
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for k, b, m, data in zip(*(batch.column(c) for c in ("side", "b", "n", "data"))):
                held[k.as_py()].append((b.as_py(), data.values.to_numpy().reshape(m.as_py(), -1)))
        # row by row of the blocks, so that what is summed by row is held once
        for rb, x in held[0]:
            for cb, y in held[1]:
                g = kind(x, y) if callable(kind) else x @ y.T
                if kind == "rbf":
                    far = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * g, 0)
                    g = np.exp(-far / (2 * sigma**2))
                yield batch_of("double", [(rb, cb, g)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from use(blocks(batches))

    return met.repartitionById(side * side, "g").groupBy("g").applyInArrow(run, schema)
