import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from matweft.operators import encodings, kernels, matmul, sketch
from matweft.sources import binary
from tests.test_matrix import A, K, M, dense, rows_of


@pytest.fixture(params=["F", "C"])
def file(request, tmp_path):
    path = str(tmp_path / "m.bin")
    np.asarray(A, float).ravel(order=request.param).tofile(path)
    return path, request.param


def test_blocks_of_a_file(spark, file):
    path, order = file
    for size, parts in ((7, 5), (64, 3), (5, 100)):
        blocks = binary.read_blocks(spark, path, M, K, size, order, parts)
        assert np.array_equal(dense(encodings.blocks_to_coo(blocks, size), (M, K)), A)
    with pytest.raises(Exception, match="bytes"):
        binary.read_blocks(spark, path, M + 1, K, 7, order).collect()


def test_filters_leave_blocks_unread(spark, file):
    path, order = file
    blocks = binary.read_blocks(spark, path, M, K, 5, order, parts=1000)  # a task a block
    count = lambda df: df.rdd.getNumPartitions()
    assert count(blocks) == 30
    for where, rb, cb in (("rb = 2", {2}, range(6)), ("rb >= 3 and cb < 2", {3, 4}, {0, 1}), ("cb in (1, 4)", range(5), {1, 4}), ("rb = 1 and cb = 1 and ncol = 5", {1}, {1}), ("rb > 0 and rb <= 1", {1}, range(6))):
        some = blocks.where(where)
        assert {(r.rb, r.cb) for r in some.collect()} == {(r, c) for r in rb for c in cb}, where
        assert count(some) == len(rb) * len(cb), where
    assert blocks.where("rb = 9").count() == 0
    assert blocks.where(F.col("nrow") == 3).count() == 6


def test_products_and_sketches_from_a_file(spark, file):
    path, order = file
    blocks = binary.read_blocks(spark, path, M, K, 7, order)
    a = A @ A.T
    assert np.array_equal(dense(encodings.blocks_to_coo(matmul.multiply_grid(blocks, encodings.transpose_blocks(blocks)), 7), (M, M)), a)
    gram = path + ".gram"
    binary.write_blocks(kernels.kernel_blocks(rows_of(spark, A), M, size=8), gram, M, M, 8, order)
    y, z = sketch.sketch(binary.read_blocks(spark, gram, M, M, 8, order), M, 3, "n4", 8)
    from matweft import functions as fn

    om = fn.cell_integers(range(M), 3)
    assert np.array_equal(dense(y, (M, 3)), a @ om) and np.array_equal(dense(z, (3, 3)), om.T @ a @ om)


@pytest.mark.parametrize("kind", ["blocks", "rows"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, kind):
    path = str(tmp_path / "out.bin")
    fail = F.raise_error(F.lit("lost")).cast("double")
    if kind == "rows":
        good = rows_of(spark, A)
        bad = good.withColumn("x", F.when(F.col("i") == 20, F.array(fail)).otherwise(F.col("x")))
        write = lambda df: binary.write_matrix(df, path, M, K)
        part, twice = good.where("i <> 3"), good.unionByName(good.where("i = 3"))
    else:
        good = encodings.rows_to_blocks(rows_of(spark, A), 7)
        bad = good.withColumn("data", F.when(F.col("rb") == 2, F.array(fail)).otherwise(F.col("data")))
        write = lambda df: binary.write_blocks(df, path, M, K, 7)
        part, twice = good.where("rb <> 1 or cb <> 1"), good.unionByName(good.where("rb = 1 and cb = 1"))
    for df, why in ((bad, "lost"), (part, "written"), (twice, "twice")):
        with pytest.raises(Exception, match=why):
            write(df)
        assert os.listdir(tmp_path) == []
    write(good)
    assert os.listdir(tmp_path) == ["out.bin"] and np.array_equal(np.fromfile(path).reshape((M, K), order="F"), A)
    with pytest.raises(Exception, match="lost"):
        write(bad)
    assert os.listdir(tmp_path) == ["out.bin"] and np.array_equal(np.fromfile(path).reshape((M, K), order="F"), A)
    write(good.where("true"))  # takes the place of what was there
    assert os.listdir(tmp_path) == ["out.bin"]
