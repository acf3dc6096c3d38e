import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from matweft import functions as fn
from matweft.operators import kernels, metrics, sketch
from matweft.plans import queries
from tests.test_dense import _moved
from tests.test_matrix import dense, rows_of

DATA = "/root/testdata/sf0.1"  # X has 1 MB, A = X Xᵀ 32 MB


@pytest.mark.parametrize("name", ["sketch_z_n1", "sketch_z_n3", "sketch_z_wide_n1", "recon_general"])
def test_no_block_of_the_gram_matrix_is_moved(spark, name):
    assert _moved(spark, queries.QUERIES[name](spark, DATA))[0] < 8e6


def test_files_hold_the_factor(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda _: str(tmp_path))
    queries.file_sketch(spark, DATA).count()
    assert sum(os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path)) == 2000 * 64 * 8


def test_sketches_of_a_factor_and_of_a_kernel(spark):
    x = np.random.default_rng(1).integers(-50, 50, (37, 9))
    rows, om = rows_of(spark, x), fn.cell_integers(range(37), 6)
    y_want, z_want = x @ (x.T @ om), om.T @ x @ (x.T @ om)
    made = [sketch.sketch_gram(rows, 37, 6, s, 8) for s in sketch.STRATEGIES] + [sketch.sketch_kernel(rows, 37, 6, size=8)]
    for y, z in made:
        assert np.array_equal(dense(y, (37, 6)), y_want) and np.array_equal(dense(z, (6, 6)), z_want)
    with pytest.raises(ValueError):
        sketch.sketch_gram(rows, 37, 6, "n9")


def test_metrics_keep_no_block(spark, monkeypatch):
    monkeypatch.setattr(kernels, "HELD_ROWS", 8)  # a grid of several groups
    x = np.random.default_rng(1).integers(-9, 9, (40, 3))
    panels, tiles, table = metrics.measured_kernel_sketch(rows_of(spark, x), 40, 5, 16)
    assert [(r.phase, r.n_rows, r.n_numbers) for r in table.collect()] == [("matrix", 9, 1600), ("panels", 3, 200), ("tiles", 1, 25)]
    assert (panels.count(), tiles.count()) == (3, 1)


def test_error_of_a_reconstruction(spark):
    x = np.random.default_rng(3).integers(-9, 9, (30, 6))
    for rank, want in ((6, 0.0), (2, None)):
        y, z = sketch.sketch_linear(rows_of(spark, x).select("i", F.expr("cast(x as array<bigint>)").alias("x")), 30, rank)
        got = sketch.reconstruction_error(rows_of(spark, x), y, z, 30, rank).first()
        om = fn.cell_integers(range(30), rank)
        back = x @ x.T @ om @ np.linalg.pinv(om.T @ x @ x.T @ om) @ om.T @ x @ x.T
        want = np.linalg.norm(x @ x.T - back) / np.linalg.norm(x @ x.T) if want is None else want
        assert got.n_cells == 900 and abs(got.relative_error - want) < 1e-8


def test_rounding_is_that_of_decimals(spark):
    rng = np.random.default_rng(5)
    v = [*(rng.normal(size=500) * 10.0 ** rng.integers(-3, 12, 500)), 0.5, -0.5, 2.5, 150.0, -50.0, 149.99999999999997, 49.99999999999999, 0.49999999999999994, -0.0, 0.0]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for to, scale in ((1, 0), (100, -2)):
        assert df.where(queries._rounded("v", to) != F.round("v", scale) + 0.0).count() == 0


#: Queries of the sketches of X Xᵀ that are to work on X alone.
BY_FACTOR = ["sketch_y_n2", "sketch_y_n3", "sketch_z_n1", "sketch_z_n2", "sketch_z_n3", "sketch_z_n5", "sketch_z_n4"]


@pytest.mark.parametrize("name", BY_FACTOR)
def test_sketches_make_no_block_of_the_gram_matrix(spark, monkeypatch, name):
    def made(*_, **__):
        raise AssertionError("a block of A is made")

    for f in ("kernel_blocks", "kernel_map"):
        monkeypatch.setattr(kernels, f, made, raising=False)
    monkeypatch.setattr(sketch, "kernel_map", made, raising=False)
    assert _moved(spark, queries.QUERIES[name](spark, DATA))[0] < 2e6


@pytest.mark.parametrize("name", ["recon_rank2", "recon_rank1", "file_product", "gen_psd", "gram_linear", "gram_rbf", "matmul_blocks", "matmul_grid", "matmul_int32_blocks", "matmul_float32_blocks"])
def test_cells_of_a_square_are_made_by_many_tasks(spark, name):
    made = queries.QUERIES[name](spark, DATA).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 2000 * 2000
    assert len(made) >= 4 and max(r["count"] for r in made) <= 1_200_000, made
