"""Texts as flat byte arrays: what the vectorised operators of this folder share.

A batch of texts is one ``uint8`` array with row offsets.  Spans of it (words,
lines, windows) get 64-bit fingerprints from one prefix sum, so that no Python
object exists per word.
"""

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C1B  # odd, 3 mod 8
UNBASE = pow(BASE, -1, 1 << 64)

#: ``[\x20\x09-\x0D]``
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BYTE_VALUE = np.random.default_rng(20).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def text_slices(batch, name="text", limit=2 << 20):
    """Rows of one Arrow batch in runs of about ``limit`` bytes (one row at least):
    (first row, last row + 1, bytes, offsets).  Null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    offsets = np.frombuffer(offsets, wide)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def spread_bits(x):
    """A 64-bit finaliser."""
    out = x >> U(30)
    out ^= x
    out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(27)
    out *= U(0x94D049BB133111EB)
    out ^= out >> U(31)
    return out


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n):
        if len(self.up) < n:
            n += -n % (1 << 18)
            for name, base in (("up", BASE), ("down", UNBASE)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self


def prefix_sums(data, powers):
    """Fingerprint prefix sums of a byte array, one longer than it."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers.upto(len(data) + 1).up[:len(data)], out=sums[1:])
    return sums


def span_prints(sums, starts, ends, powers):
    """64-bit fingerprints of the spans ``[start, end)``."""
    raw = (sums[ends] - sums[starts]) * powers.down[starts]
    return spread_bits(raw + (ends - starts).astype(np.uint64))


def word_spans(data, offsets, is_gap=IS_SPACE):
    """Starts, ends and row of every word, in order; words do not cross rows."""
    word = ~is_gap[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word
    after = np.zeros(n + 1, bool)
    after[:n] = word
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def windows(prints, rows, n):
    """Fingerprints of ``n`` words in a row, and the index of each first word;
    windows do not cross rows.  ``rows`` ascends."""
    m = len(prints) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = prints[:m].copy()
    for k in range(1, n):
        out = out * U(BASE) + prints[k:k + m]
    first = np.flatnonzero(rows[:m] == rows[n - 1:n - 1 + m])
    return spread_bits(out[first] + U(n)), first


def stable_order(keys):
    """``np.argsort(keys, kind="stable")``: the quicker sort, then equal keys by place."""
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    if again.any():
        among = np.append(False, again)
        group = np.cumsum(~among)
        among[:-1] |= again
        places = group[among] * len(keys) + order[among]
        places.sort()
        order[among] = places % len(keys)
    return order


def per_row(flags, offsets):
    """Sum of a byte-wise array for each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
