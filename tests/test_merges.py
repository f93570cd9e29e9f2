"""Drafted merges against merging one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from duolex.operators import merges as M
from duolex.operators.vocab import learn_bpe_merges, word_counts
from test_tokens import brute_bpe


def zipf_words(seed, size, alphabet):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(size // 4)]
    return {rng.choice(stems) + rng.choice(stems): 1 + size // (i + 1) for i in range(size)}


@pytest.mark.parametrize("seed,n,limits", [
    (0, 300, {}),
    (1, 30, {"draft_words": 5, "draft_pairs": 3, "ahead": 7}),
    (2, 8, {"draft_words": 0, "draft_pairs": 1, "ahead": 4}),
])
def test_against_brute_force(spark, monkeypatch, seed, n, limits):
    monkeypatch.setattr(M, "FOLD", 10)
    monkeypatch.setattr(M, "HELD", 50)
    counts = zipf_words(seed, 150, "abcdeé𝒳")
    counts["aaaaa"] = 90
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    rounds = []
    merges, words = M.learn_merges(df, n, rounds=rounds, **limits)
    want, pieces = brute_bpe(counts, n)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == want
    assert {r.word: r.pieces for r in words.collect()} == pieces
    assert sum(rounds) == len(want) and min(rounds) > 0
    if not limits:  # all words are in the draft: it is right to its end
        assert len(rounds) == 1


def test_poor_drafts_still_advance(spark):
    """A sample that knows nothing of the rest: the rarest words decide the merges."""
    counts = {"xyxy": 50, **{f"a{c}b": 3 for c in "cdefghij"}, **{f"k{c}": 20 + i for i, c in enumerate("lmnop")}}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    merges, _ = M.learn_merges(df, 8, draft_words=1, draft_pairs=2, ahead=4)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == brute_bpe(counts, 8)[0]


def test_odd_input(spark):
    schema = "word string, n bigint, rank int, pieces string"
    rows = [(None, 5, 1, "x"), ("", 5, 1, "x"), ("ab", None, 1, "x"), ("abab", 2, 1, "x"), ("abab", 2, 1, "x"), ("cd", 0, 1, "x"),
            ("cdcd", -4, 1, "x"), ("e", 9, 1, "x"), ("\n\n", 1, 1, "x"), ("\u0001" * 3, 1, 1, "x"), ("ab" * 3000, 1, 1, "x")]
    merges, words = M.learn_merges(spark.createDataFrame(rows, schema), 2)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == [("a", "b"), ("ab", "ab")]
    got = {r.word: (r.n, r.pieces) for r in words.collect()}
    assert got["abab"] == (2, ["abab"]) and got["cd"] == (0, ["c", "d"]) and got["ab"] == (0, ["ab"])
    assert words.where("word = 'abab'").count() == 2 and None not in got and "" not in got
    for empty in (spark.createDataFrame([], schema), spark.createDataFrame([("e", 1)], "word string, n bigint")):
        merges, words = M.learn_merges(empty, 5)
        assert merges.count() == 0 and words.count() == empty.count()


def test_documents_as_one_by_one(spark):
    counts = word_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    assert M.learn_merges(counts, 12)[0].collect() == learn_bpe_merges(counts, 12)[0].collect()


def test_words_are_merged_together(spark):
    """All words of a task at once, as word by word; the changes as counted before and after each merge."""
    rng = random.Random(5)
    words = ["", "a", "aaaaa", "ab" * 40, "aab" * 9] + ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(300)]
    weights = [rng.randint(1, 9) for _ in words]
    merges = [("a", "a"), ("a", "b"), ("ab", "ab"), ("aa", "b"), ("b", "c"), ("a", "bc"), ("x", "y"), ("a", "b"), ("c", "é"), ("aa", "a"), ("a", "a")]
    for quiet in (0, 4):
        pieces = M.Pieces(pa.array([list(w) for w in words], pa.list_(pa.string())), np.array(weights), merges)
        left, right, step, delta = (c.to_pylist() for c in pieces.merge(quiet))
        want, now = {}, [list(w) for w in words]
        for i, pair in enumerate(merges, 1 - quiet):
            for k, n in enumerate(weights):
                after = M.merge_pair(now[k], *pair)
                for sign, row in ((-n, now[k]), (n, after)):
                    for p in zip(row, row[1:]):
                        want[*p, i] = want.get((*p, i), 0) + sign
                now[k] = after
        assert pieces.lists().to_pylist() == now
        assert dict(zip(zip(left, right, step), delta)) == {k: d for k, d in want.items() if d and k[2] > 0}
