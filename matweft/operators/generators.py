"""Deterministic and random matrices over the rows of a table of indices (i)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matweft.functions import SEED, cell_integers, cell_uniforms, stream_rows


def _cells(rows: DataFrame, ncol: int) -> DataFrame:
    return rows.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ncol - 1).cast("long"))).alias("j"))


def index_matrix(rows: DataFrame, ncol: int) -> DataFrame:
    """v = i * ncol + j, in 64 bits."""
    return _cells(rows, ncol).select("i", "j", (F.col("i") * ncol + F.col("j")).alias("v"))


def ones(rows: DataFrame, ncol: int) -> DataFrame:
    return _cells(rows, ncol).select("i", "j", F.lit(1).cast("long").alias("v"))


def psd(rows: DataFrame, n: int, rank: int) -> DataFrame:
    """G Gᵀ for G with row i = (i * rank, ..., i * rank + rank - 1), in closed form.

    The indices are dealt out evenly first: each becomes n cells, however few files they are in.
    """
    rows = rows.select("i").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    k, s1, s2 = rank, rank * (rank - 1) // 2, (rank - 1) * rank * (2 * rank - 1) // 6
    i, j = F.col("i"), F.col("j")
    return _cells(rows, n).select("i", "j", (i * j * k**3 + (i + j) * k * s1 + s2).alias("v"))


def _made(rows: DataFrame, width: int, make, integer: bool) -> DataFrame:
    """Cells (i, j, v) of make(ids) in tasks, a bounded number of rows at a time."""
    step = max(1, 200_000 // max(1, width))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), step):
                ids = batch.column(0).slice(at, step)
                cells = make(ids.to_numpy())
                j = np.tile(np.arange(width), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(), width)), pa.array(j), pa.array(cells.ravel())], names=["i", "j", "v"])

    return rows.where("i is not null").select(F.col("i").cast("long").alias("i")).mapInArrow(run, f"i long, j long, v {'long' if integer else 'double'}")


def omega(rows: DataFrame, rank: int, integer: bool = True, seed: int = SEED) -> DataFrame:
    """The sketch matrix: i.i.d. uniform, a function of (seed, i, j) alone."""
    return _made(rows, rank, (lambda ids: cell_integers(ids, rank, seed=seed)) if integer else (lambda ids: cell_uniforms(ids, rank, seed)), integer)


def omega_stream(spark, height: int, rank: int, state: tuple[int, int], parts: int = 16) -> DataFrame:
    """The height x rank matrix that one xoroshiro128+ stream fills column by column, made in
    parts of rows; each jumps to its place in every column."""
    step = max(1, -(-height // parts))

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows = range(part * step, min(height, part * step + step))
                cells = stream_rows(rows, rank, height, state)
                i, j = np.divmod(np.arange(cells.size), rank)
                yield pa.RecordBatch.from_arrays([pa.array(i + rows.start), pa.array(j), pa.array(cells.ravel())], names=["i", "j", "v"])

    count = -(-height // step)
    return spark.range(0, count, 1, max(1, count)).mapInArrow(run, "i long, j long, v double")
