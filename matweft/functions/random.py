"""Random numbers that are a function of their place, so that tasks make them anew.

Philox4x32-10 turns a counter and a key into four 32-bit words; a cell (i, j) has the counter
(i, j div 2) and takes the first or the last two of its words. The same in numpy, for tasks,
and as a column expression. xoroshiro128+ is one sequential stream, of which any stretch can be
made by itself: its step is linear over GF(2), so a power of its matrix jumps ahead.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 1234

# Fixed values of Philox4x32-10: multipliers, key increments, rounds.
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
INCREMENTS = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10
# Fixed values of xoroshiro128+: rotation, shift, rotation.
TURN_A, SHIFT_B, TURN_C = 24, 16, 37

WORD = (1 << 32) - 1
LONG = (1 << 64) - 1


def round_keys(seed: int) -> list[tuple[int, int]]:
    """The two key words of each round; the key is the seed's lower and upper word."""
    return [(((seed & WORD) + r * INCREMENTS[0]) & WORD, ((seed >> 32 & WORD) + r * INCREMENTS[1]) & WORD) for r in range(ROUNDS)]


def philox(counter, seed: int) -> list[np.ndarray]:
    """Four arrays of words for the arrays of the counter's four words."""
    a, b, c, d = (np.asarray(x, np.uint64) for x in counter)
    low, turn = np.uint64(WORD), np.uint64(32)
    for k0, k1 in round_keys(seed):
        p, q = a * np.uint64(MULTIPLIERS[0]), c * np.uint64(MULTIPLIERS[1])
        a, b, c, d = q >> turn ^ b ^ np.uint64(k0), q & low, p >> turn ^ d ^ np.uint64(k1), p & low
    return [a, b, c, d]


def cell_numbers(rows, width: int, seed: int = SEED, first: int = 0) -> np.ndarray:
    """cell_number of all cells (i, first..first+width-1) of the rows i."""
    i = np.asarray(rows, np.int64).astype(np.uint64)[:, None]
    half = np.arange(first // 2, (first + width + 1) // 2, dtype=np.uint64)[None, :]
    low, turn = np.uint64(WORD), np.uint64(32)
    zero = np.zeros((i.shape[0], half.shape[1]), np.uint64)
    w = philox((zero + (i & low), zero + (i >> turn), zero + (half & low), zero + (half >> turn)), seed)
    pairs = np.stack([w[0] << np.uint64(21) | w[1] >> np.uint64(11), w[2] << np.uint64(21) | w[3] >> np.uint64(11)], axis=2)
    return pairs.reshape(i.shape[0], -1)[:, first % 2 : first % 2 + width].astype(np.int64)


def _column(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def philox_words(counter, seed: int, finish) -> Column:
    """finish(struct of four words w0..w3) for a counter of four columns below 2^32."""
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in round_keys(seed)])
    state = F.struct(*[_column(c).alias(f"w{k}") for k, c in enumerate(counter)])

    def product(x: Column, by: int) -> tuple[Column, Column]:
        """Upper and lower word of x * by, by halves of x, since the whole leaves 63 bits."""
        low, high = (x.bitwiseAND(F.lit(0xFFFF))) * by, F.shiftright(x, 16) * by
        high = high + F.shiftright(low, 16)
        return F.shiftright(high, 16), F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))

    def step(s: Column, k: Column) -> Column:
        p, q = product(s["w0"], MULTIPLIERS[0]), product(s["w2"], MULTIPLIERS[1])
        return F.struct(q[0].bitwiseXOR(s["w1"]).bitwiseXOR(k["a"]).alias("w0"), q[1].alias("w1"), p[0].bitwiseXOR(s["w3"]).bitwiseXOR(k["b"]).alias("w2"), p[1].alias("w3"))

    return F.aggregate(keys, state, step, finish)


def cell_number(i, j, seed: int = SEED) -> Column:
    """A 53-bit number that depends on (seed, i, j) only, whatever the partitioning."""
    i, j = _column(i), _column(j)
    half = F.shiftright(j, 1)
    even = j.bitwiseAND(F.lit(1)) == 0
    pair = lambda s: (F.when(even, s["w0"]).otherwise(s["w2"]), F.when(even, s["w1"]).otherwise(s["w3"]))
    joined = lambda s: F.shiftleft(pair(s)[0], 21).bitwiseOR(F.shiftright(pair(s)[1], 11))
    low = lambda x: x.bitwiseAND(F.lit(WORD))
    return philox_words((low(i), F.shiftrightunsigned(i, 32), low(half), F.shiftrightunsigned(half, 32)), seed, joined)


def _turn(x, k):
    return (x << k | x >> 64 - k) & LONG


def _step(state: int) -> int:
    a, b = state >> 64, state & LONG
    b ^= a
    return (_turn(a, TURN_A) ^ b ^ b << SHIFT_B & LONG) << 64 | _turn(b, TURN_C)


def _apply(columns: tuple[int, ...], state: int) -> int:
    out, k = 0, 0
    while state:
        if state & 1:
            out ^= columns[k]
        state >>= 1
        k += 1
    return out


@lru_cache(maxsize=128)
def _power(k: int) -> tuple[int, ...]:
    """Columns of the matrix of 2^k steps, over GF(2)."""
    if k == 0:
        return tuple(_step(1 << b) for b in range(128))
    half = _power(k - 1)
    return tuple(_apply(half, c) for c in half)


def jump(state: tuple[int, int], steps: int) -> tuple[int, int]:
    """The state of xoroshiro128+ after so many steps, in time of their logarithm."""
    packed, k = state[0] << 64 | state[1], 0
    while steps:
        if steps & 1:
            packed = _apply(_power(k), packed)
        steps >>= 1
        k += 1
    return packed >> 64, packed & LONG


def xoroshiro128(state: tuple[int, int], n: int, skip: int = 0) -> np.ndarray:
    """Doubles skip..skip+n-1 of the xoroshiro128+ stream that begins at a 128-bit state.

    Up to 4096 stretches of the stream advance side by side, each begun by a jump.
    """
    lanes = max(1, min(4096, n // 256))
    each = -(-n // lanes)
    begin, a, b = jump(state, skip), np.empty(lanes, np.uint64), np.empty(lanes, np.uint64)
    stride = [k for k in range(each.bit_length()) if each >> k & 1]
    packed = begin[0] << 64 | begin[1]
    for lane in range(lanes):
        a[lane], b[lane] = packed >> 64, packed & LONG
        for k in stride if lane < lanes - 1 else ():
            packed = _apply(_power(k), packed)
    out = np.empty((each, lanes))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    with np.errstate(over="ignore"):
        for k in range(each):
            out[k] = (a + b >> np.uint64(11)) * 2.0**-53
            b ^= a
            a, b = turn(a, TURN_A) ^ b ^ b << np.uint64(SHIFT_B), turn(b, TURN_C)
    return out.T.ravel()[:n]


def stream_rows(rows: range, width: int, height: int, state: tuple[int, int]) -> np.ndarray:
    """Those rows of the height x width matrix that the stream fills column by column."""
    return np.stack([xoroshiro128(state, len(rows), column * height + rows.start) for column in range(width)], axis=1)
