"""Products of matrices: joins for sparse ones, blocks and BLAS for dense ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matweft.functions import SEED, cell_integers, wrap_int32

from .dense import batch_of, block_product, block_schema, block_sum, data_type, exact_product, sum_blocks  # noqa: F401
from .encodings import blocks_to_coo, rows_to_coo
from .generators import omega
from .grid import multiply_grid

#: Largest right-hand side (numbers) that goes to every task; larger ones are joined.
BROADCAST_CELLS = 4_000_000
#: Sums of blocks that a task holds before it hands them on.
HELD_BLOCKS = 32


def multiply_coo(a: DataFrame, b: DataFrame, transpose_a: bool = False, wrap: bool = False, wide: bool = False) -> DataFrame:
    """A B, or Aᵀ B: an equi-join on the inner index and a sum.

    Integer sums that leave 64 bits are an error; wrap gives 32-bit arithmetic instead, wide
    sums of 38 decimal digits.
    """
    out, inner = ("j", "i") if transpose_a else ("i", "j")
    left = a.select(F.col(out).alias("i"), F.col(inner).alias("k"), F.col("v").alias("va"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    each = F.col("va").cast("decimal(19,0)") * F.col("vb").cast("decimal(19,0)") if wide else F.col("va") * F.col("vb")
    total = F.sum(each)
    return left.join(right, "k").groupBy("i", "j").agg((wrap_int32(total) if wrap else total).alias("v"))


def multiply_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B for blocks of one size and type: pairs of blocks meet by the inner block number, are
    multiplied, and products are summed by block, first within a task. Where both sides are large
    multiply_grid moves less. A single inner block would be one key of the join, with nothing to
    sum: its pairs meet on a grid instead."""
    kind = data_type(a)
    if not a.where("cb > 0").select("cb").head(1):
        return multiply_grid(a, b)
    right = b.select(F.col("rb").alias("k"), F.col("cb").alias("cb2"), F.col("nrow").alias("nrow2"), F.col("ncol").alias("ncol2"), F.col("data").alias("data2"))
    pairs = a.join(right, F.col("cb") == F.col("k")).select("rb", F.col("cb2").alias("cb"), "nrow", "ncol", "ncol2", "data", "data2")

    def run(batches):
        held: dict = {}
        for batch in batches:
            rb, cb, nrow, inner = (batch.column(k).to_pylist() for k in range(4))
            left, right = batch.column(5), batch.column(6)
            for k, at in enumerate(zip(rb, cb)):
                part = block_product(left[k].values.to_numpy().reshape(nrow[k], -1), right[k].values.to_numpy().reshape(inner[k], -1))
                held[at] = block_sum(held.get(at), part)
                if len(held) >= HELD_BLOCKS:
                    yield batch_of(kind, ((*at, m) for at, m in held.items()))
                    held.clear()
        if held:
            yield batch_of(kind, ((*at, m) for at, m in held.items()))

    return sum_blocks(pairs.mapInArrow(run, block_schema(kind)))


def _per_row(rows: DataFrame, width: int, right) -> DataFrame:
    """rows (i, x) times right(inner) in tasks, whole batches at a time."""

    def run(batches):
        b = None
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                b = right(x.shape[1]) if b is None else b
                y = x.astype(np.float64) @ b.astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["i", "x"])

    return rows.select("i", "x").mapInArrow(run, "i long, x array<double>")


def multiply_generated(rows: DataFrame, width: int, seed: int = SEED) -> DataFrame:
    """A B with B made anew in every task from (seed, i, j): nothing is moved."""
    return _per_row(rows, width, lambda inner: cell_integers(range(inner), width, seed=seed))


def multiply_dense(rows: DataFrame, inner: int, width: int, strategy: str = "generate", seed: int = SEED) -> DataFrame:
    """A B for the random B (inner x width), by either strategy: generate or send."""
    if strategy == "generate":
        return multiply_generated(rows, width, seed)
    if strategy == "send":
        return multiply_sent(rows, omega(rows.sparkSession.range(inner).select(F.col("id").alias("i")), width, seed=seed), inner, width)
    raise ValueError(f"strategy {strategy!r} is not generate or send")


def product(a: DataFrame, b: DataFrame | None = None, strategy: str = "join", inner: int = 0, width: int = 0, seed: int = SEED) -> DataFrame:
    """A B as coo by any strategy: join (both coo), blocks or grid (both blocks of one size, that
    of their first block), generate or send (rows a, and b the random matrix, inner x width)."""
    if strategy == "join":
        return multiply_coo(a, b)
    if strategy in ("blocks", "grid"):
        first = a.where("rb = 0 and cb = 0").select("nrow", "ncol").first()
        return blocks_to_coo((multiply_blocks if strategy == "blocks" else multiply_grid)(a, b), max(first) if first else 1)
    return rows_to_coo(multiply_dense(a, inner, width, strategy, seed))


def multiply_sent(rows: DataFrame, b: DataFrame, inner: int, width: int) -> DataFrame:
    """A B with B (coo, inner x width) made once and sent to every task, if it is small
    enough; else as a join on the inner index."""
    if inner * width > BROADCAST_CELLS:
        coo = rows.select("i", F.posexplode("x").alias("j", "v"))
        cells = multiply_coo(coo, b)
        return cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c")).select("i", F.expr("cast(transform(c, e -> e.v) as array<double>)").alias("x"))
    matrix = np.zeros((inner, width))
    cells = b.select("i", "j", "v").toArrow()  # at most BROADCAST_CELLS
    matrix[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(matrix)
    return _per_row(rows, width, lambda _: sent.value)
