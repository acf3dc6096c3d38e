import numpy as np
import pytest

from matweft.operators import kernels, metrics
from matweft.sources import runlogs
from tests.test_matrix import rows_of

NAME = "nystrom-1d-redist-1d_cpp_cluster_8_32_32_{}_{}_32x1x1_1x1x32.1"
BODY = "Nystrom approximation of {0}x{0} matrix to rank {1} using nystrom-1d-redist-1d\nTotal time: 1.5 sec\n"


def test_metrics_of_a_sketch(spark):
    x = np.random.default_rng(1).integers(-9, 9, (40, 3))
    panels, tiles, table = metrics.measured_sketch(kernels.kernel_blocks(rows_of(spark, x), 40, size=16), 40, 5, "n4", 16)
    got = {r.phase: r for r in table.collect()}
    assert [(r.phase_no, r.phase, r.n_rows, r.n_numbers) for r in got.values()] == [(0, "matrix", 9, 1600), (1, "panels", 3, 200), (2, "tiles", 1, 25)]
    for r in got.values():
        assert r.n_tasks >= 1 and 0 <= r.min_task_seconds <= r.max_task_seconds <= r.seconds and 1 <= r.max_task_rows <= r.n_rows
    assert (panels.count(), tiles.count()) == (3, 1)
    run = metrics.Run(spark)
    assert run.phase("none", spark.range(0)).count() == 0 and run.table().first().n_rows == 0
    with pytest.raises(ValueError):
        metrics.measured_sketch(panels, 40, 5, "n9")


def test_logs_that_are_left_out(spark, tmp_path):
    logs = [(NAME.format(50, 5), BODY.format(50, 5)), (NAME.format(51, 5), "srun: error"), (NAME.format(52, 5), "\n"), (NAME.format(53, 5), BODY.format(53, 6)), ("short", BODY.format(50, 5)), (NAME.format(54, "none"), BODY.format(54, 5)), (NAME.format(55, 5), BODY.format("9" * 30, 5))]
    assert runlogs.write_logs(spark.createDataFrame(logs, "name string, body string").repartition(3), str(tmp_path / "logs")) == 7
    read = runlogs.read_logs(spark, str(tmp_path / "logs"))
    left = {r.name: r.reason for r in runlogs.rejects(read, runlogs.sketch_reason()).collect()}
    assert left == {name: runlogs.NO_HEADER if k in (1, 2) else runlogs.DISAGREE for k, (name, _) in enumerate(logs) if k}
    assert [(r.n, r.r) for r in runlogs.parse_sketch_logs(read, strict=False).collect()] == [(50, 5)]
    with pytest.raises(Exception, match="disagree"):
        runlogs.parse_sketch_logs(read).collect()
    products = spark.createDataFrame([("matmul_cpp_c_1_4_32_50_60_70_1x4x1", "testing 50x60 with 60x70 on 1x4x1 grid", None), ("matmul_cpp_c_1_4_32_50_60_71_1x4x1", "testing 50x60 with 60x70 on 1x4x1 grid", None), ("m", None, None)], "name string, body string, modified timestamp")
    assert {r.name: r.reason for r in runlogs.rejects(products, runlogs.matmul_reason()).collect()} == {"matmul_cpp_c_1_4_32_50_60_71_1x4x1": runlogs.DISAGREE, "m": runlogs.NO_HEADER}
    assert [(r.a_rows, r.b_cols) for r in runlogs.parse_matmul_logs(products, strict=False).collect()] == [(50, 70)]
