import numpy as np
import pytest
from pyspark.sql import functions as F

from matweft import functions as fn
from matweft.operators import collectives, encodings, generators, kernels, layout, matmul, sketch, validate
from matweft.sources import binary, runlogs


def indices(spark, n):
    return spark.range(n).select(F.col("id").alias("i"))


def dense(coo, shape):
    out = np.zeros(shape)
    for r in coo.collect():
        out[r.i, r.j] = r.v
    return out


def coo_of(spark, a):
    return spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in np.ndindex(*a.shape)], "i long, j long, v long")


def rows_of(spark, a):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "i long, x array<double>").repartition(3)


M, K, N = 23, 29, 31
A = np.arange(M * K).reshape(M, K)
B = np.arange(K * N).reshape(K, N)


@pytest.mark.parametrize("size", [7, 16, 64])
def test_products_with_uneven_blocks(spark, size):
    a, b = generators.index_matrix(indices(spark, M), K), generators.index_matrix(indices(spark, K), N)
    assert np.array_equal(dense(matmul.multiply_coo(a, b), (M, N)), A @ B)
    blocks = matmul.multiply_blocks(encodings.rows_to_blocks(rows_of(spark, A), size), encodings.rows_to_blocks(rows_of(spark, B), size))
    assert np.array_equal(dense(encodings.blocks_to_coo(blocks, size), (M, N)), A @ B)


def test_transposed_and_wrapped_products(spark):
    a, c = coo_of(spark, A), coo_of(spark, A[:, :5])
    assert np.array_equal(dense(matmul.multiply_coo(a, c, transpose_a=True), (K, 5)), A.T @ A[:, :5])
    big = (A * 999_983).astype(np.int32)
    want = big @ (B * 7919).astype(np.int32)
    got = dense(matmul.multiply_coo(coo_of(spark, big), coo_of(spark, (B * 7919).astype(np.int32)), wrap=True), (M, N))
    assert np.array_equal(got, want)


def test_wide_sums(spark):
    big = spark.createDataFrame([(0, k, 3 * 10**18) for k in range(4)], "i long, j long, v long")
    tall = spark.createDataFrame([(k, 0, 5) for k in range(4)], "i long, j long, v long")
    assert int(matmul.multiply_coo(big, tall, wide=True).first().v) == 6 * 10**19
    with pytest.raises(Exception, match="OVERFLOW"):
        matmul.multiply_coo(big, tall).collect()


def test_generated_and_sent_sides_agree(spark, monkeypatch):
    rows = rows_of(spark, A)
    want = A @ fn.cell_integers(range(K), 4)
    b = generators.omega(indices(spark, K), 4)
    assert np.array_equal(dense(encodings.rows_to_coo(matmul.multiply_generated(rows, 4)), (M, 4)), want)
    assert np.array_equal(dense(encodings.rows_to_coo(matmul.multiply_sent(rows, b, K, 4)), (M, 4)), want)
    monkeypatch.setattr(matmul, "BROADCAST_CELLS", 1)
    assert np.array_equal(dense(encodings.rows_to_coo(matmul.multiply_sent(rows, b, K, 4)), (M, 4)), want)


def test_encodings_round_trip(spark):
    sparse = coo_of(spark, A).where("v % 3 = 0")
    back = encodings.rows_to_coo(encodings.coo_to_rows(sparse, K))
    assert np.array_equal(dense(back, A.shape), np.where(A % 3 == 0, A, 0))
    assert encodings.densify(sparse, M, K).count() == M * K


def test_psd_and_kernels(spark):
    g = np.arange(12 * 5).reshape(12, 5)
    assert np.array_equal(dense(generators.psd(indices(spark, 12), 12, 5), (12, 12)), g @ g.T)
    x = np.random.default_rng(0).normal(size=(20, 6))
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    for size in (6, 32):
        got = kernels.kernel_blocks(rows_of(spark, x), 20, "rbf", 1.5, size)
        assert np.allclose(dense(encodings.blocks_to_coo(got, size), (20, 20)), np.exp(-far / 4.5))


@pytest.mark.parametrize("size", [8, 64])
def test_strategies_agree(spark, size):
    x = np.random.default_rng(1).integers(-50, 50, (37, 9))
    a, om = x @ x.T, fn.cell_integers(range(37), 6)
    y_want, z_want = a @ om, om.T @ a @ om
    blocks = kernels.kernel_blocks(rows_of(spark, x), 37, size=size).persist()
    for strategy in sketch.STRATEGIES:
        y, z = sketch.sketch(blocks, 37, 6, strategy, size)
        assert np.array_equal(dense(y, (37, 6)), y_want), strategy
        got = dense(z, (6, 6))
        assert np.array_equal(got, z_want) and np.array_equal(got, got.T), strategy
    y, z = sketch.sketch_linear(encodings.rows_to_coo(rows_of(spark, x)).groupBy("i").agg(F.expr("transform(array_sort(collect_list(struct(j, v))), e -> cast(e.v as bigint))").alias("x")), 37, 6)
    assert np.array_equal(dense(y, (37, 6)), y_want) and np.array_equal(dense(z, (6, 6)), z_want)
    blocks.unpersist()


def test_reconstruction_recovers_low_rank(spark):
    y, z = sketch.sketch(kernels.kernel_blocks(rows_of(spark, A[:, :2]), M), M, 4)
    back = dense(sketch.reconstruct(y, z, M, 4, rcond=1e-12), (M, M))
    a = A[:, :2] @ A[:, :2].T
    assert np.linalg.norm(back - a) < 1e-6 * np.linalg.norm(a)


def test_strategy_choice_and_arguments(spark):
    assert sketch.choose_strategy(2000, 8, 4) == "n1"
    assert sketch.choose_strategy(2000, 500, 64) == "n2"
    assert sketch.choose_strategy(10**6, 8, 64) == "n4"
    with pytest.raises(ValueError):
        sketch.sketch(spark.range(1), 1, 1, "n9")
    with pytest.raises(ValueError):
        validate.check_split([3, 4], 8)
    with pytest.raises(ValueError):
        validate.check_grid((2, 2, 1), 8)


def test_splits_and_grids(spark):
    one = spark.range(7).select(F.col("id").alias("k"))
    plain = [r[0] for r in one.select(fn.ceil_split(F.lit(10), F.lit(7), F.col("k"), clamp=False)).collect()]
    clamped = [r[0] for r in one.select(fn.ceil_split(F.lit(10), F.lit(7), F.col("k"))).collect()]
    assert plain == [2] * 6 + [-2] and clamped == [2] * 5 + [0, 0]
    assert fn.grid_2d(128) == (16, 8, 1) and fn.grid_3d(128) == (8, 4, 4) and fn.grid_3d(4) == (2, 2, 1)
    coords = layout.grid_coordinates(spark.range(12).select(F.col("id").alias("rank")), 2, 3)
    for face in "abc":
        layout_ = layout.face_layout(coords, face, {"row": 2, "col": 2, "fib": 3}, 11, 13).collect()
        cells = [(i, j) for r in layout_ for i in range(r.row_start, r.row_start + r.n_rows) for j in range(r.col_start, r.col_start + r.n_cols)]
        assert sorted(cells) == [(i, j) for i in range(11) for j in range(13)]


def test_collectives(spark):
    a, b = coo_of(spark, A), coo_of(spark, A[:, :3])
    assert np.array_equal(dense(collectives.concat_matrices([(a, K), (b, 3)]), (M, K + 3)), np.hstack([A, A[:, :3]]))
    total = collectives.reduce_scatter(a.unionByName(a), F.expr("i div 8"))
    assert np.array_equal(dense(total, A.shape), 2 * A)


def test_validation(spark):
    a = coo_of(spark, A)
    assert validate.matrix_diff(a, a.where("v <> 0")).first() == (M * K, 0)
    assert validate.matrix_diff(a, a.where("v <> 5")).first() == (M * K, 1)
    assert validate.all_close(a, a.withColumn("v", F.col("v") * 1.001)).first() == (M * K, M * K - 1)


@pytest.mark.parametrize("order", ["F", "C"])
def test_matrix_file(spark, tmp_path, order):
    path = str(tmp_path / "m.bin")
    binary.write_matrix(rows_of(spark, A), path, M, K, order)
    assert np.array_equal(np.fromfile(path).reshape((M, K), order=order), A)
    back = binary.read_matrix(spark, path, M, K, order, parts=5)
    assert back.rdd.getNumPartitions() == 5
    assert np.array_equal(dense(encodings.rows_to_coo(back), A.shape), A)
    with pytest.raises(Exception, match="bytes"):
        binary.read_matrix(spark, path, M, K + 1).collect()


def test_logs_from_files(spark, tmp_path):
    good = "nystrom-1d-redist-1d_cpp_cluster-gpu_32_128_32_50000_500_128x1x1_1x1x128.10"
    (tmp_path / good).write_text("Nystrom approximation of 50000x50000 matrix to rank 500 using nystrom-1d-redist-1d\nTotal time: 1.5 sec\nTime to unpack: 1e-05 sec\n")
    (tmp_path / good.replace(".10", ".11")).write_text("srun: error\n")
    got = runlogs.parse_sketch_logs(runlogs.read_logs(spark, str(tmp_path))).collect()
    assert len(got) == 1 and (got[0].n, got[0].r, got[0].matmul2p3, got[0].total_time, got[0].unpack_time, got[0].pack_time) == (50000, 500, 128, 1.5, 0.0, 0.0)
    (tmp_path / good.replace("_500_", "_501_")).write_text("Nystrom approximation of 50000x50000 matrix to rank 500 using x\n")
    with pytest.raises(Exception, match="disagree"):
        runlogs.parse_sketch_logs(runlogs.read_logs(spark, str(tmp_path))).collect()


def test_lookup(spark):
    runs = spark.createDataFrame([("a", 4, 2.5)], "alg string, nproc int, t double")
    axis = spark.createDataFrame([("a", 4), ("a", 8)], "alg string, nproc int")
    assert sorted(r.t for r in runlogs.lookup(axis, runs, ["alg", "nproc"], "t").collect()) == [0.0, 2.5]
    with pytest.raises(Exception, match="no t"):
        runlogs.lookup(axis, runs, ["alg", "nproc"], "t", default=None).collect()


def test_generators_are_uniform_and_xoroshiro_is_a_bit_stream():
    cells = fn.cell_integers(range(200), 8)
    assert abs(cells.mean() - 499.5) < 25 and cells.min() >= 0 and cells.max() < 1000
    x = fn.xoroshiro128((1, 2), 2000)
    assert x[0] == (3 >> 11) * 2.0**-53 and (0 <= x).all() and (x < 1).all() and abs(x.mean() - 0.5) < 0.05


def test_exact_product():
    a, b = np.array([[2**40, 3], [1, 2**30]]), np.array([[2**20, 1], [5, 7]])
    assert np.array_equal(matmul.exact_product(a, b), a @ b)
    with pytest.raises(OverflowError):
        matmul.exact_product(np.array([[2**40]]), np.array([[2**40]]))


def test_sketch_of_factors_by_both_ways(spark, monkeypatch):
    x = np.random.default_rng(1).integers(-1000, 1000, (40, 6))
    rows = spark.createDataFrame([*((i, [int(v) for v in r]) for i, r in enumerate(x)), (40, None), (41, [1, None, 0, 0, 0, 2])], "i long, x array<long>").repartition(3)
    full = np.vstack([x, np.zeros(6, int), [1, 0, 0, 0, 0, 2]])
    om = fn.cell_integers(range(42), 3)
    want = full @ (full.T @ om), om.T @ (full @ (full.T @ om))
    for cells in (matmul.BROADCAST_CELLS, 1):
        monkeypatch.setattr(matmul, "BROADCAST_CELLS", cells)
        y, z = sketch.sketch_linear(rows, 42, 3)
        assert np.array_equal(dense(y.where("v is not null"), (42, 3)), want[0]) and np.array_equal(dense(z, (3, 3)), want[1])
    assert [d.count() for d in sketch.sketch_linear(rows.limit(0), 0, 3)] == [0, 0]


def test_blocks_summed_within_tasks(spark, monkeypatch):
    monkeypatch.setattr(matmul, "HELD_BLOCKS", 2)
    a, b = encodings.rows_to_blocks(rows_of(spark, A), 7), encodings.transpose_blocks(encodings.rows_to_blocks(rows_of(spark, A[:9]), 7))
    assert np.array_equal(dense(matmul.product(a, b, "blocks"), (M, 9)), A @ A[:9].T)
    with pytest.raises(ValueError, match="not generate or send"):
        matmul.product(rows_of(spark, A), None, "other", K, 2)


def test_explicit_splits(spark):
    cells = spark.createDataFrame([(0, j, 1) for j in range(5)] * 2, "i long, j long, v long")
    got = {r.j: (r.v, r.owner) for r in collectives.reduce_scatter_splits(cells, [2, 0, 3], 5).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 2), 3: (2, 2), 4: (2, 2)}
    with pytest.raises(ValueError, match="do not add up"):
        collectives.reduce_scatter_splits(cells, [2, 2], 5)


def test_kernel_blocks_to_a_file(spark, tmp_path):
    x = np.random.default_rng(2).integers(0, 9, (11, 3))
    cells = encodings.blocks_to_coo(kernels.kernel_blocks(rows_of(spark, x), 11, size=4), 4)
    path = str(tmp_path / "gram.bin")
    binary.write_matrix(encodings.coo_to_rows(cells, 11), path, 11, 11)
    back = binary.read_matrix(spark, path, 11, 11)
    assert np.array_equal(dense(encodings.rows_to_coo(back), (11, 11)), x @ x.T)
