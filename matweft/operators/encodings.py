"""Three encodings of a matrix and the ways between them.

coo: (i, j, v), a missing cell is 0. rows: (i, x array). blocks: (rb, cb, nrow, ncol, data
array), row-major, rb and cb the numbers of the block in a grid of `size` rows and columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import batch_of, block_schema, data_type


def feature_rows(vectors: DataFrame, scale: int | None = 1000) -> DataFrame:
    """rows of a feature table (vec_id, embedding); with scale, integers round(x * scale)."""
    x = "cast(round(cast(e as double) * {}) as bigint)".format(scale) if scale else "cast(e as double)"
    return vectors.select(F.col("vec_id").alias("i"), F.expr(f"transform(embedding, e -> {x})").alias("x"))


def rows_to_coo(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def coo_to_rows(coo: DataFrame, ncol: int) -> DataFrame:
    """Dense rows; rows without any cell do not appear."""
    cells = coo.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    return cells.select("i", F.expr(f"transform(sequence(0, {ncol - 1}), k -> coalesce(m[cast(k as bigint)], 0))").alias("x"))


def rows_to_blocks(rows: DataFrame, size: int, kind: str = "double") -> DataFrame:
    """Blocks of size x size, of numbers of a kind (double, float, bigint, int); a block holds its
    own slice of each of its rows."""
    sliced = rows.select(
        "i",
        F.floor(F.col("i") / size).cast("int").alias("rb"),
        F.expr(f"posexplode(transform(sequence(0, greatest(size(x) - 1, 0) div {size}), b -> slice(x, b * {size} + 1, {size})))").alias("cb", "part"),
    )
    by = sliced.groupBy("rb", "cb").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("rows"))
    return by.select(
        "rb",
        F.col("cb").cast("int").alias("cb"),
        F.size("rows").alias("nrow"),
        F.expr("size(rows[0].part)").alias("ncol"),
        F.expr(f"cast(flatten(transform(rows, r -> r.part)) as array<{kind}>)").alias("data"),
    )


def coo_to_panels(coo: DataFrame, nrow: int, ncol: int, size: int) -> DataFrame:
    """Panels (rb, nrow, data) of `size` whole rows; missing cells are 0, rows that share no panel
    with any cell do not appear."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, rb = None, 0
        for batch in batches:
            if len(batch):
                rb = batch.column(0)[0].as_py()
                panel = np.zeros((min(size, nrow - rb * size), ncol)) if panel is None else panel
                panel[batch.column(1).to_numpy() - rb * size, batch.column(2).to_numpy()] = batch.column(3).to_numpy()
        if panel is not None:
            made = batch_of("double", [(rb, 0, panel)])
            yield pa.RecordBatch.from_arrays([made.column(k) for k in (0, 2, 4)], names=["rb", "nrow", "data"])

    cells = coo.select(F.expr(f"cast(i div {size} as int)").alias("rb"), "i", "j", F.col("v").cast("double").alias("v"))
    return cells.groupBy("rb").applyInArrow(fill, "rb int, nrow int, data array<double>")


def transpose_blocks(blocks: DataFrame) -> DataFrame:
    """Each block is transposed where it lies."""
    kind = data_type(blocks)

    def run(batches):
        for batch in batches:
            rb, cb, nrow, _, data = batch.columns
            yield batch_of(kind, [(c, r, d.values.to_numpy().reshape(n, -1).T) for r, c, n, d in zip(rb.to_pylist(), cb.to_pylist(), nrow.to_pylist(), data)])

    return blocks.select("rb", "cb", "nrow", "ncol", "data").mapInArrow(run, block_schema(kind))


def blocks_to_coo(blocks: DataFrame, size: int) -> DataFrame:
    cells = blocks.select("rb", "cb", "ncol", F.posexplode("data").alias("p", "v"))
    return cells.select(
        (F.col("rb").cast("long") * size + F.expr("p div ncol")).alias("i"), (F.col("cb").cast("long") * size + F.expr("p % ncol")).alias("j"), "v"
    )


def densify(coo: DataFrame, nrow: int, ncol: int) -> DataFrame:
    """coo with a cell for every (i, j): missing ones are 0."""
    cells = coo.sparkSession.range(nrow).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ncol - 1).cast("long"))).alias("j"))
    return cells.join(coo, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0)).alias("v"))
