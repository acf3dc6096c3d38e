"""What tasks do with one or two blocks: products and sums by type, tiles, Arrow batches.

Blocks are (rb, cb, nrow, ncol, data), data an array of double, float, bigint or int. Products
of doubles and floats are BLAS's; those of bigint are exact or an error; those of int wrap at 32
bits, as do their sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ARROW = {"double": pa.float64(), "float": pa.float32(), "bigint": pa.int64(), "int": pa.int32()}
#: Rows and columns of the tiles in which large sums are moved.
TILE = 256


def data_type(blocks: DataFrame) -> str:
    """Type of the numbers of a DataFrame of blocks or panels."""
    kind = blocks.schema["data"].dataType.elementType.simpleString()
    if kind not in ARROW:
        raise ValueError(f"blocks of {kind} are not supported, only of {', '.join(ARROW)}")
    return kind


def block_schema(kind: str) -> str:
    return f"rb int, cb int, nrow int, ncol int, data array<{kind}>"


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 64-bit integers: by BLAS where doubles hold every sum, else in integers, with an
    error where those overflow."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b if bound < 2**62 else (a.astype(object) @ b.astype(object)).astype(np.int64)


def wrapped_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 32-bit integers modulo 2^32: halves of 16 bits by BLAS, exact in doubles for up to
    2^21 terms; longer sums are split."""
    if a.shape[1] > 1 << 21:
        half = a.shape[1] // 2
        return wrapped_product(a[:, :half], b[:half]) + wrapped_product(a[:, half:], b[half:])
    a, b = a.astype(np.int64) & 0xFFFFFFFF, b.astype(np.int64) & 0xFFFFFFFF
    (al, ah), (bl, bh) = (((x & 0xFFFF).astype(float), (x >> 16).astype(float)) for x in (a, b))
    cross = (ah @ bl).astype(np.uint64) + (al @ bh).astype(np.uint64)
    low = (al @ bl).astype(np.uint64) + (cross << np.uint64(16))
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def block_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == np.int64:
        return exact_product(a, b)
    return wrapped_product(a, b) if a.dtype == np.int32 else a @ b


def block_sum(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """a + b; sums of 64-bit integers that overflow are an error."""
    if a is None:
        return b.copy()
    total = a + b
    if total.dtype == np.int64 and ((a ^ total) & (b ^ total) < 0).any():
        raise OverflowError("a sum leaves 64 bits")
    return total


def whole(x: np.ndarray) -> np.ndarray:
    """Doubles that are integers as such; an error for any other."""
    if x.dtype.kind == "i":
        return x.astype(np.int64)
    if not (np.abs(x) <= 2**53).all() or (x != np.rint(x)).any():
        raise ValueError("the matrix has numbers that are not integers of at most 53 bits; sketch it as a real one")
    return x.astype(np.int64)


def batch_of(kind: str, blocks) -> pa.RecordBatch:
    """blocks (rb, cb, matrix) as one batch."""
    blocks = list(blocks)
    sizes = [pa.array([f(x) for x in blocks], pa.int32()) for f in (lambda x: x[0], lambda x: x[1], lambda x: x[2].shape[0], lambda x: x[2].shape[1])]
    data = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum([x[2].size for x in blocks])]), pa.int32()),
        pa.array(np.concatenate([np.ascontiguousarray(x[2]).ravel() for x in blocks]) if blocks else np.zeros(0), ARROW[kind]),
    )
    return pa.RecordBatch.from_arrays([*sizes, data], names=["rb", "cb", "nrow", "ncol", "data"])


def tiles_of(matrix: np.ndarray, size: int = TILE):
    """(rb, cb, tile) of a matrix cut into tiles."""
    for at in range(0, matrix.shape[0], size):
        for left in range(0, matrix.shape[1], size):
            yield at // size, left // size, matrix[at : at + size, left : left + size]


def sum_blocks(blocks: DataFrame, *more: str) -> DataFrame:
    """Sum of the blocks at each place (and of each value of further columns): one group a place,
    of which one block and the sum are held at a time."""
    kind = data_type(blocks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = None, None
        for batch in batches:
            for data in batch.column("data"):
                total = block_sum(total, data.values.to_numpy())
            if len(batch):
                place = batch.slice(0, 1)
        if place is not None:
            offsets = pa.array([0, len(total)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(place.column(c) for c in (*more, "rb", "cb", "nrow", "ncol")), pa.ListArray.from_arrays(offsets, pa.array(total))], names=[*more, "rb", "cb", "nrow", "ncol", "data"]
            )

    head = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in more)
    return blocks.groupBy(*more, "rb", "cb").applyInArrow(add, head + block_schema(kind))
