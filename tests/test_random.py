import numpy as np
import pytest
from pyspark.sql import functions as F

from matweft import functions as fn
from matweft.functions import random
from matweft.operators import generators, sketch


def test_philox_known_answers():
    # the published vectors of philox4x32 with 10 rounds: counter, key, result
    for counter, key, want in (
        ([0] * 4, 0, [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]),
        ([0xFFFFFFFF] * 4, 0xFFFFFFFFFFFFFFFF, [0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD]),
        ([0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344], 0x299F31D0A4093822, [0xD16CFE09, 0x94FDCCEB, 0x5001E420, 0x24126EA1]),
    ):
        assert [int(w) for w in random.philox(counter, key)] == want


def test_cells_of_column_and_numpy_agree(spark):
    at = [(0, 0), (1, 0), (0, 1), (7, 3), (2**32 + 5, 2), (5, 2**33 + 1), (2**40, 2**35)]
    for seed in (1234, 2**40 + 7):
        cells = spark.createDataFrame(at, "i long, j long").select("i", "j", fn.cell_number(F.col("i"), F.col("j"), seed).alias("v")).collect()
        assert [r.v for r in cells] == [int(random.cell_numbers([i], 1, seed, first=j)[0, 0]) for i, j in at]
    assert np.array_equal(random.cell_numbers(range(5), 7, first=3), random.cell_numbers(range(5), 10)[:, 3:])
    many = generators.omega(spark.range(50).select(F.col("id").alias("i")), 5, integer=False)
    assert np.allclose([r.v for r in many.orderBy("i", "j").collect()], fn.cell_uniforms(range(50), 5).ravel(), rtol=0, atol=0)


def test_cells_are_uniform():
    v = fn.cell_uniforms(range(2000), 50)
    assert abs(v.mean() - 0.5) < 0.005 and abs(v.var() - 1 / 12) < 0.001
    assert abs(np.corrcoef(v[:, 0], v[:, 1])[0, 1]) < 0.1 and len(np.unique(v)) == v.size
    assert np.histogram(v, 10, (0, 1))[0].min() > 9000


def sequential(state, n):
    a, b = state
    out = []
    for _ in range(n):
        out.append(((a + b & random.LONG) >> 11) * 2.0**-53)
        b ^= a
        a, b = random._turn(a, 24) ^ b ^ (b << 16 & random.LONG), random._turn(b, 37)
    return np.array(out)


@pytest.mark.parametrize("state", [(1, 2), (2**64 - 1, 12345678901234567890)])
def test_any_stretch_of_the_stream(state):
    whole = sequential(state, 5000)
    for n, skip in ((0, 3), (1, 0), (1, 4999), (300, 17), (5000, 0), (4000, 1000)):
        assert np.array_equal(random.xoroshiro128(state, n, skip), whole[skip : skip + n])
    far = 10**15
    assert random.jump(random.jump(state, far), 5) == random.jump(state, far + 5)


def test_stream_fills_columns(spark):
    want = sequential((5, 6), 44).reshape(4, 11).T
    assert np.array_equal(random.stream_rows(range(3, 7), 4, 11, (5, 6)), want[3:7])
    for parts in (1, 3, 50):
        cells = generators.omega_stream(spark, 11, 4, (5, 6), parts).collect()
        assert len(cells) == 44 and all(want[r.i, r.j] == r.v for r in cells)


def test_sketch_draws_from_the_stream(spark):
    from matweft.operators import encodings

    x = np.random.default_rng(3).normal(size=(30, 4))
    a = x @ x.T
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "i long, x array<double>")
    om = sequential((9, 8), 90).reshape(3, 30).T
    draws = lambda ids, rank: random.stream_rows(ids, rank, 30, (9, 8))
    for strategy in sketch.STRATEGIES:
        y, z = sketch.sketch(encodings.rows_to_blocks(rows, 8), 30, 3, strategy, 8, real=True, draws=draws)
        got = np.zeros((30, 3)), np.zeros((3, 3))
        for df, out in zip((y, z), got):
            for r in df.collect():
                out[r.i, r.j] = r.v
        assert np.allclose(got[0], a @ om) and np.allclose(got[1], om.T @ a @ om)
    with pytest.raises(Exception, match="not integers"):
        sketch.sketch(encodings.rows_to_blocks(rows, 8), 30, 3, "n4", 8)[0].collect()
