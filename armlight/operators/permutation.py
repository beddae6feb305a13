"""A keyed permutation of the numbers below n: shuffles by arithmetic, with nothing sorted or stored.

A Feistel network of ``ROUNDS`` rounds permutes the numbers of ``2 h`` bits that cover n; a number that lands at n or
above is put through again until it falls below, which leaves a permutation of the numbers below n.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
# all products of the round function stay below 2^62
MODULUS, FIRST, SECOND = 1 << 31, 1_640_531_527, 1_446_648_777


def half_bits(n: int) -> int:
    """Half the bits of the smallest even-sized block that covers the numbers below ``n``."""
    return max(1, (max(n - 1, 0).bit_length() + 1) // 2)


def round_keys(seed: int, epoch):
    """A key per round; ``epoch`` may be an array."""
    mixed = [seed * 1_000_003 + epoch * 10_007 + r * 101 for r in range(ROUNDS)]
    return [(m % MODULUS * 1_103_515_245 + 12_345) % MODULUS for m in mixed]


def _once(x, half, keys):
    # the halves and keys have at most 31 bits; products wrap at 2^32, which leaves the bits below the modulus right
    mask, low = np.uint32((1 << half) - 1), np.uint32(MODULUS - 1)
    left, right = (x >> half).astype(np.uint32), x.astype(np.uint32) & mask
    for key in keys:
        y = (right * np.uint32(FIRST) + key) & low
        y = ((y ^ (y >> 15)) * np.uint32(SECOND)) & low
        left, right = right, left ^ ((y ^ (y >> 13)) & mask)
    return left.astype(np.int64) << half | right.astype(np.int64)


def permute(numbers, n: int, epochs, seed: int) -> np.ndarray:
    """The place of each of ``numbers``, all below ``n``, in the order of its epoch."""
    x = np.array(numbers, np.int64)
    half, todo = half_bits(n), np.arange(len(x))
    several = np.ndim(epochs) > 0
    epochs = np.broadcast_to(np.asarray(epochs, np.int64), x.shape) if several else int(epochs)
    while len(todo):
        keys = [np.asarray(k).astype(np.uint32) for k in round_keys(seed, epochs[todo] if several else epochs)]
        moved = _once(x[todo], half, keys)
        x[todo] = moved
        todo = todo[moved >= n]
    return x


def permuted(number: str, n: int, epoch: str, seed: int) -> Column:
    """``permute`` of a column of numbers below ``n``."""

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series, epochs: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, epochs.to_numpy(), seed))

    return place(F.col(number), F.col(epoch))
