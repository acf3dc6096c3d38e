"""Checks of matrices against each other and of arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n_cells, n_differ): cells of either matrix, and those whose values differ; a
    missing cell counts as 0."""
    both = a.select("i", "j", F.col("v").alias("va")).join(b.select("i", "j", F.col("v").alias("vb")), ["i", "j"], "full")
    differ = F.coalesce(F.col("va"), F.lit(0)) != F.coalesce(F.col("vb"), F.lit(0))
    return both.agg(F.count("*").alias("n_cells"), F.sum(differ.cast("long")).alias("n_differ"))


def all_close(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row (n_cells, n_far): cells further apart than atol + rtol * |b|."""
    both = a.select("i", "j", F.col("v").alias("va")).join(b.select("i", "j", F.col("v").alias("vb")), ["i", "j"], "full")
    x, y = F.coalesce(F.col("va"), F.lit(0)).cast("double"), F.coalesce(F.col("vb"), F.lit(0)).cast("double")
    return both.agg(F.count("*").alias("n_cells"), F.sum((F.abs(x - y) > atol + rtol * F.abs(y)).cast("long")).alias("n_far"))


def check_split(sizes: list[int], total: int) -> None:
    if sum(sizes) != total or min(sizes, default=0) < 0:
        raise ValueError(f"splits {sizes} do not add up to {total}")


def check_grid(dims: tuple[int, int, int], procs: int) -> None:
    if dims[0] * dims[1] * dims[2] != procs:
        raise ValueError(f"grid {dims} does not have {procs} processes")
