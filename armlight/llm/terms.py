"""64-bit hashes of the words of many texts at once, by numpy."""

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# fixed: the white space of the contracts
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
# white space and ASCII punctuation
BREAKS = WHITE.copy()
BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    if size:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(content: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE):
    """(hash, text number) of every word, in order; A to Z count as a to z, words don't cross texts.

    The hash of a word is its part of one running polynomial over all bytes, shifted to the word's start.
    """
    size = len(content)
    inside = ~breaks[content]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < size)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    running = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[LOWER[content]] * _powers(_BASE, size), out=running[1:])
    hashes = mix((running[end] - running[start]) * _powers(_INVERSE, size + 1)[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(offsets, start, side="right") - 1
