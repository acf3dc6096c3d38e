"""What a run of this library did: rows, numbers and seconds of its phases, as a table."""

from __future__ import annotations

import time

from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from matweft.functions import SEED
from matweft.session import staged

from .kernels import BLOCK
from .sketch import STRATEGIES, _Draws, _sum_panels, kernel_products, sketch_parts

METRICS = "phase_no int, phase string, n_rows long, n_numbers long, seconds double, n_tasks int, min_task_seconds double, max_task_seconds double, max_task_rows long"


class _Lists(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


class Run:
    """Phases of a run, each computed once and kept as a table in the shared folder.

    Rows and numbers (of `data`, if there is such a column) are observed where they are written;
    each task reports its rows and how long it took to bring them forth.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def phase(self, name: str, df: DataFrame, rows: Column | None = None, numbers: Column | None = None) -> DataFrame:
        """rows and numbers: aggregates to be told in place of df's rows and their numbers."""
        seen, tasks = Observation(), self.spark.sparkContext.accumulator([], _Lists())

        def timed(batches):
            began, n = time.monotonic(), 0
            for batch in batches:
                n += len(batch)
                yield batch
            tasks.add([(TaskContext.get().partitionId(), n, time.monotonic() - began)])

        if numbers is None:
            numbers = F.sum(F.size("data").cast("long") if "data" in df.columns else F.lit(0).cast("long"))
        counted = [F.coalesce(c, F.lit(0).cast("long")).alias(k) for c, k in ((F.count(F.lit(1)) if rows is None else rows, "n_rows"), (numbers, "n_numbers"))]
        observed = df.mapInArrow(timed, df.schema).observe(seen, *counted)
        began = time.monotonic()
        out = staged(observed, "phase")
        took = time.monotonic() - began
        each = {part: (n, s) for part, n, s in tasks.value}  # of a task that ran twice, once
        times = [s for _, s in each.values()] or [0.0]
        got = seen.get
        self.rows.append((len(self.rows), name, got["n_rows"], got["n_numbers"], took, len(each), min(times), max(times), max((n for n, _ in each.values()), default=0)))
        return out

    def table(self) -> DataFrame:
        """A row a phase: its rows and numbers, seconds from start to end, and of its tasks their
        number, the shortest and longest seconds and the most rows."""
        return self.spark.createDataFrame(self.rows, METRICS)


def measured_sketch(blocks: DataFrame, n: int, rank: int, strategy: str = "n4", size: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panels of Y, tiles of Z, metrics) of a sketch whose phases run one after the other: the
    matrix, Y, Z."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is not one of {STRATEGIES}")
    run = Run(blocks.sparkSession)
    a = run.phase("matrix", blocks)
    panels = run.phase("panels", sketch_parts(a, n, rank, strategy, size, seed)[0])
    tiles = run.phase("tiles", sketch_parts(a, n, rank, strategy, size, seed, panels=panels)[1])
    return panels, tiles, run.table()


def measured_kernel_sketch(rows: DataFrame, n: int, rank: int, size: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """measured_sketch of X Xᵀ by n4, for rows of X with ids 0..n-1. The phase of the matrix makes
    its blocks and multiplies each where it is made: it tells the blocks and their numbers, and
    keeps their products only."""
    run, draws = Run(rows.sparkSession), _Draws(rank, seed, False, None)
    products = run.phase("matrix", kernel_products(rows, n, draws, size=size), F.sum("n_blocks"), F.sum("n_numbers"))
    panels = run.phase("panels", _sum_panels(products, draws))
    tiles = run.phase("tiles", sketch_parts(panels, n, rank, "n4", size, seed, panels=panels)[1])
    return panels, tiles, run.table()
