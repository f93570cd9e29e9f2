"""n-grams of a prediction and its reference, counted inside their row.

A batch's words become numbers, an n-gram the pair of the (n-1)-gram at its start and
its last word, numbered row by row: nothing is sorted, and no n-gram leaves its row.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

CHUNK_WORDS = 1 << 18  # words counted at a time, a longer row alone

FIELDS = {
    "n": pa.int32(), "matched": pa.float64(), "in_prediction": pa.float64(), "in_reference": pa.float64(),
    "hyp_len": pa.int64(), "ref_len": pa.int64(),
}
_TOTALS = "array<struct<n int, matched double, in_prediction double, in_reference double, hyp_len bigint, ref_len bigint>>"


def _lengths(texts: pa.Array):
    return pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _left(lengths):
    """For every word how many there are from it to the end of its text."""
    return np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())


def _chunk_totals(hyp: pa.Array, ref: pa.Array, max_order: int, keywords, other: float) -> dict:
    """The columns of ``FIELDS``, each of shape (rows, orders)."""
    n_hyp, n_ref, words = _lengths(hyp), _lengths(ref), hyp.flatten()
    rows, split = len(n_hyp), len(words)
    coded = pa.concat_arrays([words, ref.flatten()]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(coded.dictionary) + 1
    row = np.concatenate([np.repeat(np.arange(rows), n) for n in (n_hyp, n_ref)])
    left = np.concatenate([_left(n_hyp), _left(n_ref)])
    out = {name: np.zeros((rows, max_order), kind.to_pandas_dtype()) for name, kind in FIELDS.items()}
    gram, at = row, np.arange(len(code))
    for n in range(1, max_order + 1):
        long = left[at] >= n
        at, gram = at[long], gram[long]
        gram, found = pd.factorize(gram * size + code[at + n - 1])
        owner, last, mine = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), np.searchsorted(at, split)
        owner[gram], last[gram] = row[at], code[at]
        h, r = (np.bincount(side, minlength=len(found)) for side in (gram[:mine], gram[mine:]))
        weight = 1.0
        if keywords is not None and n == 1:
            weight = np.where(pc.is_in(coded.dictionary, pa.array(sorted(keywords), coded.dictionary.type)), 1.0, other)[last]
        out["n"][:, n - 1] = n
        for name, counts in (("matched", np.minimum(h, r)), ("in_prediction", h), ("in_reference", r)):
            out[name][:, n - 1] = np.bincount(owner, counts * weight, rows)
        out["hyp_len"][:, n - 1], out["ref_len"][:, n - 1] = (np.maximum(m - (n - 1), 0) for m in (n_hyp, n_ref))
    return out


def totals_of(hyp: pa.Array, ref: pa.Array, max_order: int, keywords=None, other=0.2) -> pa.Array:
    """For every row a list over the orders of the structs of ``FIELDS``."""
    ends = np.cumsum(_lengths(hyp) + _lengths(ref))
    cuts = np.searchsorted(ends, np.arange(CHUNK_WORDS, ends[-1], CHUNK_WORDS)) if len(ends) else []
    edges = sorted({0, *map(int, cuts), len(hyp)})
    parts = [_chunk_totals(hyp[a:b], ref[a:b], max_order, keywords, other) for a, b in zip(edges, edges[1:])]
    columns = [
        pa.array(np.concatenate([p[name].ravel() for p in parts]) if parts else [], kind) for name, kind in FIELDS.items()
    ]
    offsets = pa.array(np.arange(len(hyp) + 1) * max_order, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=list(FIELDS)))


def row_totals(max_order: int, keywords=None, other=0.2):
    """Function of the word lists of prediction and reference (null: empty).

    ``hyp_len`` and ``ref_len`` count the n-grams of the order.  With ``keywords``, single
    words weigh 1 in the list and ``other`` outside it.
    """
    keywords = None if keywords is None else frozenset(keywords)

    @F.arrow_udf(_TOTALS)
    def totals(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        return totals_of(hyp, ref, max_order, keywords, float(other))

    return totals
