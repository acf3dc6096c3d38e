import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matweft import functions as fn
from matweft.operators import collectives, dense, encodings, factor, grid, kernels, layout, matmul, sketch
from tests.test_matrix import A, B, K, M, N, coo_of, dense as to_dense, rows_of

GRIDS = [(1, 1, 1), (2, 2, 2), (3, 1, 2), (8, 1, 1), (1, 8, 1), (1, 1, 8), (2, 4, 1), (50, 50, 50)]
KINDS = {"double": np.float64, "float": np.float32, "bigint": np.int64, "int": np.int32}


def blocks_of(spark, a, size, kind):
    return encodings.rows_to_blocks(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], f"i long, x array<{kind}>").repartition(3), size, kind)


@pytest.mark.parametrize("shape", GRIDS)
def test_grids_with_uneven_blocks(spark, shape):
    a, b = blocks_of(spark, A, 7, "bigint"), blocks_of(spark, B, 7, "bigint")
    got = matmul.multiply_grid(a, b, shape)
    assert np.array_equal(to_dense(encodings.blocks_to_coo(got, 7), (M, N)), A @ B)
    assert got.groupBy("rb", "cb").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("kind", KINDS)
def test_types_of_blocks(spark, kind):
    rng = np.random.default_rng(4)
    full = kind == "int"
    a, b = (rng.integers(-(2**31) if full else -9, 2**31 if full else 9, s).astype(KINDS[kind]) for s in ((20, 33), (33, 11)))
    with np.errstate(over="ignore"):
        want = a @ b
    for multiply in (matmul.multiply_grid, matmul.multiply_blocks):
        got = encodings.blocks_to_coo(multiply(blocks_of(spark, a, 8, kind), blocks_of(spark, b, 8, kind)), 8)
        assert got.schema["v"].dataType.simpleString() == kind
        assert np.array_equal(to_dense(got, (20, 11)), want)


def test_products_of_integers():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-(2**31), 2**31, s).astype(np.int32) for s in ((5, 300), (300, 4)))
    assert np.array_equal(dense.wrapped_product(a, b), a @ b)
    low = np.full((1, 300), -(2**31), np.int32)
    assert np.array_equal(dense.wrapped_product(low, low.T), low @ low.T)
    with pytest.raises(OverflowError):
        dense.block_sum(np.array([2**62]), np.array([2**62]))
    for bad in (0.5, 2.0**60, np.nan, np.inf):
        with pytest.raises(ValueError):
            dense.whole(np.array([bad]))


def test_overflow_is_an_error(spark):
    big = np.full((3, 2), 2**40)
    with pytest.raises(Exception, match="Overflow|too large|too big|overflow"):
        matmul.multiply_grid(blocks_of(spark, big, 2, "bigint"), blocks_of(spark, big.T, 2, "bigint")).collect()
    with pytest.raises(ValueError, match="do not multiply"):
        matmul.multiply_grid(blocks_of(spark, big, 2, "bigint"), blocks_of(spark, big.T.astype(float), 2, "double"))
    with pytest.raises(ValueError, match="empty axis"):
        matmul.multiply_grid(blocks_of(spark, big, 2, "bigint"), blocks_of(spark, big.T, 2, "bigint"), (0, 1, 1))
    assert matmul.multiply_grid(blocks_of(spark, big, 2, "bigint").where("false"), blocks_of(spark, big.T, 2, "bigint")).count() == 0


def test_choice_of_a_grid():
    gb = float(1 << 30)
    assert grid.choose_grid(gb, gb, gb, (64, 64, 64), 64) == (4, 4, 4)  # of sides alike a cube moves least
    tall = grid.choose_grid(64 * gb, gb / 16, 4 * gb, (4096, 64, 4), 512)
    assert tall[2] == 1 and tall[0] >= 128  # a large left side is moved once
    inner = grid.choose_grid(8 * gb, 8 * gb, gb / 1024, (2, 4096, 2), 256)
    assert inner[1] >= 64  # a long inner index is cut
    for a, b, c, counts in ((gb, gb, gb, (64, 64, 64)), (64 * gb, gb / 16, 4 * gb, (4096, 64, 4)), (8 * gb, 8 * gb, gb / 1024, (2, 4096, 2))):
        g = grid.choose_grid(a, b, c, counts, 64)
        assert a / (g[0] * g[1]) + b / (g[1] * g[2]) + c / (g[0] * g[2]) <= grid.CELL_BYTES
    assert grid.choose_grid(0, 0, 0, (1, 1, 1), 8) == (1, 1, 1)


def test_a_grid_moves_less_than_the_join(spark):
    rng = np.random.default_rng(6)
    a, b = (blocks_of(spark, rng.normal(size=(256, 256)), 16, "double").persist() for _ in range(2))
    a.count(), b.count()
    try:
        moved = {name: _moved(spark, df)[0] for name, df in (("grid", matmul.multiply_grid(a, b, (2, 1, 2))), ("join", matmul.multiply_blocks(a, b)))}
    finally:
        a.unpersist(), b.unpersist()
    assert 0 < moved["grid"] < moved["join"], moved


def _moved(spark, df):
    """(bytes, rows) that a run of df writes to shuffles."""
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
        return [found.apply(k) for k in range(found.size())]

    known = {s.stageId() for s in stages()}
    df.write.format("noop").mode("overwrite").save()
    new = [s for s in stages() if s.stageId() not in known]
    return sum(s.shuffleWriteBytes() for s in new), sum(s.shuffleWriteRecords() for s in new)


def test_tiles_in_two_levels(spark):
    rng = np.random.default_rng(7)
    parts = [rng.integers(-9, 9, (5, 7)) for _ in range(40)]
    rows = [(k, rb, cb, *t.shape, t.ravel().tolist()) for k, m in enumerate(parts) for rb, cb, t in dense.tiles_of(m, 3)]
    tiles = spark.createDataFrame(rows, "part int, rb int, cb int, nrow int, ncol int, data array<bigint>")
    for fan in (None, 1, 7):
        got = encodings.blocks_to_coo(collectives.sum_tiles(tiles, fan), 3)
        assert np.array_equal(to_dense(got, (5, 7)), sum(parts))


def test_large_ranks_move_tiles_only(spark, monkeypatch):
    """Z of rank 2000: tiles of each task, not rank² rows of each batch."""
    x = np.random.default_rng(8).integers(-9, 9, (700, 3))
    rows = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "i long, x array<long>").repartition(3)
    om = fn.cell_integers(range(700), 2000)
    want = (x.T @ om).T @ (x.T @ om)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        made = sketch._Draws(2000, fn.SEED, False, None)
        panels = sketch._summed_panels(kernels.kernel_blocks(rows, 700, size=128), 128, made)
        tiles = sketch._z_tiles(panels, 128, made)
        got = np.zeros((2000, 2000), np.int64)
        for r in tiles.toArrow().to_pylist():
            at, left = r["rb"] * dense.TILE, r["cb"] * dense.TILE
            got[at : at + r["nrow"], left : left + r["ncol"]] = np.reshape(r["data"], (r["nrow"], r["ncol"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.array_equal(got, want)
    assert _moved(spark, tiles)[1] < 20_000  # of 4 000 000 numbers a partial sum
    monkeypatch.setattr(sketch, "HELD_CELLS", 10)  # nothing may be held: the same sums
    y, z = sketch.sketch(kernels.kernel_blocks(rows, 700, size=128), 700, 4, "n5", 128)
    assert np.array_equal(to_dense(z, (4, 4)), want[:4, :4]) and np.array_equal(to_dense(y, (700, 4)), x @ (x.T @ om[:, :4]))


def test_pivots_of_a_small_matrix():
    g = np.random.default_rng(9).normal(size=(20, 6))
    order, triangle = factor.pivots_of(g @ g.T, 1e-10)
    assert len(order) == 6 and np.allclose(triangle, np.tril(triangle)) and np.allclose(triangle @ triangle.T, (g @ g.T)[np.ix_(order, order)])
    assert factor.pivots_of(np.zeros((3, 3)), 0.0)[0] == []


def test_reconstruction_at_rank_500_collects_no_square(spark, monkeypatch):
    x = np.random.default_rng(10).integers(-100, 100, (640, 40))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, x array<double>").repartition(4)
    a = x @ x.T
    y, z = sketch.sketch(kernels.kernel_blocks(rows, 640), 640, 500, "n4")
    monkeypatch.setattr(matmul, "BROADCAST_CELLS", 1)  # the driver may not take Z
    monkeypatch.setattr(factor, "STEP", 32)
    got = np.zeros((640, 640))
    for r in sketch.reconstruct_blocks(y, z, 640, 500, method="cholesky").toArrow().to_pylist():
        at, left = r["rb"] * kernels.BLOCK, r["cb"] * kernels.BLOCK
        got[at : at + r["nrow"], left : left + r["ncol"]] = np.reshape(r["data"], (r["nrow"], r["ncol"]))
    om = fn.cell_integers(range(640), 500)
    plain = (a @ om) @ np.linalg.pinv((om.T @ (a @ om)).astype(float)) @ (a @ om).T
    assert np.linalg.norm(got - a) < 1e-11 * np.linalg.norm(a) and np.linalg.norm(got - plain) < 1e-10 * np.linalg.norm(a)


def test_reconstruction_in_steps_and_of_indefinite_matrices(spark, monkeypatch):
    rng = np.random.default_rng(11)
    g = rng.normal(size=(60, 9))
    z, y = g[:12] @ g[:12].T, g[12:] @ g[:12].T
    panel = lambda m, size: spark.createDataFrame([(k // size, len(m[k : k + size]), m[k : k + size].ravel().tolist()) for k in range(0, len(m), size)], "rb int, nrow int, data array<double>")
    for step in (1, 4, 64):
        f, width = factor.semidefinite_factor(panel(z, 5), panel(y, 5), 12, 5, step=step)
        got = np.vstack([np.reshape(r.data, (r.nrow, width)) for r in f.orderBy("rb").collect()])
        assert width == 9 and np.allclose(got @ got.T, y @ np.linalg.pinv(z, rcond=1e-12) @ y.T)
    a = np.diag([5.0, -3, 2, 0, 0, 1])
    om = fn.cell_integers(range(6), 5).astype(float)
    coo = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.ndindex(*m.shape)], "i long, j long, v double")
    y, z = coo(a @ om), coo(om.T @ a @ om)
    with pytest.raises(factor.NotSemidefinite):
        sketch.reconstruct_blocks(y, z, 6, 5, 1e-12, "cholesky")
    assert np.allclose(to_dense(sketch.reconstruct(y, z, 6, 5, 1e-10), (6, 6)), a, atol=1e-6)
    with pytest.raises(ValueError, match="not auto"):
        sketch.reconstruct_blocks(y, z, 6, 5, method="other")


@pytest.mark.parametrize("parts", [1, 5])
def test_prefix_sums(spark, parts):
    rng = np.random.default_rng(12)
    rows = [(int(k), int(v) if v % 5 else None) for k, v in zip(rng.permutation(300), rng.integers(0, 50, 300))]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "k int, v int")
        got = layout.prefix_sums(df, ["k"], "v")
        total, want = 0, {}
        for k, v in sorted(rows):
            want[k] = (v, total)
            total += v or 0
        assert {r.k: (r.v, r.before) for r in got.collect()} == want
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
        assert layout.prefix_sums(df.where("false"), ["k"], "v").count() == 0
        assert layout.prefix_sums(df.select("k", F.lit(0.5).alias("v")), ["k"], "v").where("k = 299").first().before == 149.5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_panels_of_cells(spark):
    panels = encodings.coo_to_panels(coo_of(spark, A).where("v % 3 = 0"), M, K, 6).orderBy("rb").collect()
    got = np.vstack([np.reshape(r.data, (r.nrow, K)) for r in panels])
    assert np.array_equal(got, np.where(A % 3 == 0, A, 0))
    assert pa.types.is_list(dense.batch_of("double", []).column(4).type) and rows_of(spark, A).count() == M
