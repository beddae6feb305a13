"""Random numbers from hashes: the same for a row however often it is recomputed."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, parts) -> str:
    return f"concat_ws(':', '{seed}', {', '.join(f'`{p}`' for p in parts)})"


def _word(seed, parts) -> str:
    """32 bits of the MD5 of the seed and the columns, as a double."""
    return f"cast(conv(substr(md5({_key(seed, parts)}), 1, 8), 16, 10) as double)"


def uniform(seed, *parts) -> Column:
    """Uniform in [0, 1) from the seed and the given columns."""
    return F.expr(f"{_word(seed, parts)} / 4294967296D")


def normal(seed, *parts) -> Column:
    """Standard normal by the Box-Muller transform of two hashed uniforms in (0, 1)."""
    radius, angle = (f"(({_word(f'{seed}{half}', parts)} + 1D) / 4294967297D)" for half in "ab")
    return F.expr(f"sqrt(-2D * ln({radius})) * cos(6.283185307179586D * {angle})")


def shuffle_key(seed, *parts) -> Column:
    """Sort key of a repeatable shuffle: 60 bits, so ties need a second sort column."""
    return F.expr(f"cast(conv(substr(md5({_key(seed, parts)}), 1, 15), 16, 10) as bigint)")
