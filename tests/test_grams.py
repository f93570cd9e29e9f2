"""n-grams counted inside their row, and across the rows of a pair."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from duolex.operators import grams as G
from duolex.operators import metrics as M


def brute(hyp, ref, n, weight=lambda g: 1.0):
    h, r = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (hyp, ref))
    both = sum(min(c, r[g]) * weight(g) for g, c in h.items())
    return (both, *(sum(c * weight(g) for g, c in side.items()) for side in (h, r)), h.total(), r.total())


@pytest.mark.parametrize("chunk", [1, 40, 1 << 18])
def test_totals_of_rows(monkeypatch, chunk):
    monkeypatch.setattr(G, "CHUNK_WORDS", chunk)
    rng = random.Random(3)
    texts = [[rng.choices("abcd", k=rng.randint(0, 30)) for _ in range(2)] for _ in range(40)] + [[None, ["a"]], [None, None], [[], []]]
    hyp, ref = (pa.array(side, pa.list_(pa.string())) for side in zip(*texts))
    for keywords in (None, ["a", "b"]):
        got = G.totals_of(hyp.slice(1), ref.slice(1), 4, keywords, 0.2).to_pylist()
        assert len(got) == len(texts) - 1
        for (h, r), row in zip(texts[1:], got):
            for n, t in enumerate(row, 1):
                light = keywords is not None and n == 1
                want = brute(h or [], r or [], n, lambda g: 0.2 if light and g[0] not in keywords else 1.0)  # noqa: B023
                assert tuple(t.values()) == (n, *map(pytest.approx, want[:3]), *want[3:])
    assert G.totals_of(hyp[:0], ref[:0], 4).to_pylist() == []


def test_rows_of_a_pair_are_counted_together(spark):
    rows = [(1, "a b", "a"), (1, "c", "a b c"), (None, "x y", "x"), (None, None, "y x y"), (2, "a b", None),
            (3, "q\u0001r s", "q r\u0001s"), (4, None, None)]
    df = spark.createDataFrame(rows, "pair_id bigint, prediction string, reference string")
    got = {r.n: tuple(r)[1:] for r in M.ngram_totals(df, tokenize=M.plain_tokens).collect()}
    # the words of a pair's rows are one bag; the mark joins words as in a joined n-gram
    assert got == {1: (5.0, 9.0, 10.0, 9, 10), 2: (3.0, 4.0, 5.0, None, None), 3: (0.0, 0.0, 2.0, None, None)}
