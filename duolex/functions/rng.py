"""Seeded randomness that does not depend on partitioning.

Row level: the first 32 bits of md5 over seed and key.  Position level (inside
an array): a counter-based generator.  A row has 60 bits of seed; half of them say
where its counter starts, the others, which salts change too, how far it steps.  Rows and
salts thus walk through different sequences instead of windows of a common one.
The counter is mixed by two integer rounds, far cheaper than a digest per element.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK31 = (1 << 31) - 1
MUL1, MUL2 = 2146121005, 2221713035
SALT_START, SALT_STEP = 1640531527, 1013904223  # what a salt adds to start and step


def _digest(seed, keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def hash32(seed, *keys) -> Column:
    """BIGINT in [0, 2**32)."""
    return F.conv(F.substring(_digest(seed, keys), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """DOUBLE in [0, 1)."""
    return hash32(seed, *keys) / F.lit(4294967296.0)


def row_seed(seed, *keys) -> Column:
    """60-bit BIGINT, the ``s`` of ``mix``."""
    return F.conv(F.substring(_digest(seed, keys), 1, 15), 16, 10).cast("bigint")


def reseed(s: Column, key: Column) -> Column:
    """The seed of a part of a row, as of one source row in a packed one."""
    return s.bitwiseXOR(key.bitwiseAND(F.lit(MASK31)) * F.lit((1 << 29) + 1))


def _walk(s: Column, salt: int):
    """Start and odd step of a row's counter, both of 31 bits."""
    start, step = s.bitwiseAND(F.lit(MASK31)), F.shiftright(s, 31)
    if salt:
        start, step = (start + F.lit(salt * SALT_START)).bitwiseAND(F.lit(MASK31)), step + F.lit(salt * SALT_STEP)
    return start, step.bitwiseAND(F.lit(MASK31)).bitwiseOR(F.lit(1))


def mix(s: Column, pos: Column, salt: int = 0) -> Column:
    """BIGINT in [0, 2**31) for position ``pos`` of a row with seed ``s``."""
    start, step = _walk(s, salt)
    h = (start + pos.cast("bigint") * step).bitwiseAND(F.lit(MASK31))
    h = (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MUL1)).bitwiseAND(F.lit(MASK31))
    return (h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(MUL2)).bitwiseAND(F.lit(MASK31))


def mix_array(s, pos, salt: int = 0):
    """``mix`` of numpy arrays of BIGINT."""
    start, step = s & MASK31, s >> 31
    if salt:
        start, step = (start + salt * SALT_START) & MASK31, step + salt * SALT_STEP
    h = (start + pos * ((step & MASK31) | 1)) & MASK31
    h = ((h ^ (h >> 16)) * MUL1) & MASK31
    return ((h ^ (h >> 15)) * MUL2) & MASK31


def mix_each(s: Column, n: Column, salt: int = 0, start: int = 0) -> Column:
    """``mix`` for the positions start .. start+n-1, as an array.

    The counter is a native arithmetic sequence; the rounds run as one pass
    each, so no intermediate value is computed twice.
    """
    begin, step = _walk(s, salt)
    first = begin + F.lit(start) * step
    h = F.when(n > 0, F.sequence(first, first + (n - 1) * step, step)).otherwise(
        F.array().cast("array<bigint>")
    )
    half = MASK31 >> 16
    h = F.transform(
        h,
        lambda v: (
            v.bitwiseAND(F.lit(MASK31)).bitwiseXOR(F.shiftright(v, 16).bitwiseAND(F.lit(half))) * F.lit(MUL1)
        ).bitwiseAND(F.lit(MASK31)),
    )
    return F.transform(h, lambda v: (v.bitwiseXOR(F.shiftright(v, 15)) * F.lit(MUL2)).bitwiseAND(F.lit(MASK31)))


def mix_uniform(s: Column, pos: Column, salt: int = 0) -> Column:
    """DOUBLE in [0, 1)."""
    return mix(s, pos, salt) / F.lit(2147483648.0)


def mix_below(s: Column, pos: Column, n: Column, salt: int = 0) -> Column:
    """BIGINT in [0, n), for n < 2**31."""
    return F.shiftright(mix(s, pos, salt) * n.cast("bigint"), 31)
