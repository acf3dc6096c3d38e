"""Column functions: cell-wise random numbers, splits of an axis, process grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .random import SEED, cell_number, cell_numbers, jump, stream_rows, xoroshiro128

__all__ = ["SEED", "cell_number", "cell_numbers", "jump", "stream_rows", "xoroshiro128"]


def cell_uniform(i, j, seed: int = SEED) -> Column:
    """cell_number as a double in the unit interval."""
    return cell_number(i, j, seed) / F.lit(float(1 << 53))


def cell_integer(i, j, below: int = 1000, seed: int = SEED) -> Column:
    return cell_number(i, j, seed) % below


def cell_integers(rows, width: int, below: int = 1000, seed: int = SEED) -> np.ndarray:
    """cell_integer for all cells of the rows, for use inside tasks."""
    return cell_numbers(rows, width, seed) % below


def cell_uniforms(rows, width: int, seed: int = SEED) -> np.ndarray:
    return cell_numbers(rows, width, seed) * 2.0**-53


def floor_split(n, parts, k) -> tuple[Column, Column]:
    """(start, size) of part k of n: parts of floor(n / parts), the last takes the rest."""
    n, parts, k = (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x for x in (n, parts, k))
    each = F.floor(n / parts).cast("long")
    return k * each, F.when(k == parts - 1, n - k * each).otherwise(each)


def ceil_split(n, parts, k, clamp: bool = True) -> Column:
    """Size of part k of n in parts of ceil(n / parts); the last may come out negative, which
    clamp sets to what is left."""
    each = F.ceil(n / parts).cast("long")
    if clamp:
        return F.greatest(F.lit(0).cast("long"), F.least(each, n - k * each))
    return F.when(k == parts - 1, n - (parts - 1) * each).otherwise(each)


def wrap_int32(x: Column) -> Column:
    """A sum of products as 32-bit arithmetic would leave it."""
    return (F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def grid_2d(procs: int) -> tuple[int, int, int]:
    """Near-square grid of a power of two of processes."""
    k = int(math.log2(procs))
    return 1 << (k + 1) // 2, 1 << k // 2, 1


def grid_3d(procs: int) -> tuple[int, int, int]:
    """Near-cubic grid of a power of two of processes."""
    k = int(math.log2(procs))
    return 1 << (k + 2) // 3, 1 << (k + 1) // 3, 1 << k // 3
