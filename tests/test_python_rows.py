"""Functions that run in Python workers: what they are sent, and draws of whole batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duolex import session
from duolex.functions import rng
from duolex.operators import encode as E
from duolex.operators import filters, masking
from duolex.schemas import IGNORE, MASK


@pytest.fixture
def wide(spark):
    """Default limits, as in a session that is not built here; 2 MB of text in one partition."""
    kept = {k: spark.conf.get(k, None) for k in (session._BATCH_LIMIT, "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set(session._BATCH_LIMIT, 64 << 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    yield spark.range(0, 2000, 1, 1).select(F.col("id").alias("row_id"), F.repeat(F.lit("ab "), 2000).alias("text"))
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_batches_are_bounded_in_bytes(wide):
    def few(batch):
        assert len(batch) < 1000  # 12 MB of text
        return batch["row_id"] % 2 == 0

    assert filters.filter_rows(wide, few).count() == 1000


def test_filter_rows_keeps_what_the_mask_says(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x" * i, [i]) for i in range(20)], "id int, t string, a array<int>")
    got = filters.filter_rows(df, lambda b: b["t"].str.len() > 4)
    assert got.schema == df.schema
    assert sorted(r.id for r in got.collect()) == [6, 9, 12, 15, 18]
    assert filters.filter_rows(df, lambda b: pd.Series(True, b.index)).count() == 20


def test_draws_of_arrays(spark):
    seeds, pos = [0, 1, (1 << 60) - 1, 123456789012345678], list(range(0, 5000, 611))
    df = spark.createDataFrame([(s, i) for s in seeds for i in pos], "s bigint, i int")
    for salt in (0, 1, 2):
        want = [tuple(r) for r in df.select("s", "i", rng.mix(F.col("s"), F.col("i"), salt)).collect()]
        got = rng.mix_array(np.array([w[0] for w in want]), np.array([w[1] for w in want], np.int64), salt)
        assert got.tolist() == [w[2] for w in want]


def test_token_mask_by_element(spark):
    rows = [(1, [0, 20, 21, None, 22, 2] * 30), (2, []), (3, None), (4, [1] * 5)]
    df = spark.createDataFrame(rows, "row_id bigint, input_ids array<int>")
    got = {r.row_id: r for r in masking.token_mask(df, ["row_id"], 500, 13, 0.5, 3).collect()}
    draw = spark.range(180).select(
        *[(rng.mix_uniform(rng.row_seed(3, F.lit(1)), F.col("id"), k)).alias(f"u{k}") for k in (0, 1)],
        rng.mix_below(rng.row_seed(3, F.lit(1)), F.col("id"), F.lit(487), 2).alias("o"),
    ).collect()
    for x, d, new, label in zip(rows[0][1], draw, got[1].input_ids, got[1].labels):
        if x in (0, 1, 2) or d.u0 >= 0.5:
            assert (new, label) == (x, IGNORE)
        else:
            assert new == (MASK if d.u1 < 0.8 else d.o + 13 if d.u1 < 0.9 else x)
            assert label == (IGNORE if x is None else x)
    assert (got[2].input_ids, got[2].labels, got[3].input_ids, got[3].labels) == ([], [], None, None)
    assert (got[4].input_ids, got[4].labels) == ([1] * 5, [IGNORE] * 5)


def test_a_word_is_cut_once_a_task(spark, monkeypatch):
    monkeypatch.setattr(E, "HELD_WORDS", 2)  # the words held are dropped now and then
    merges = spark.createDataFrame([(1, "a", "b")], "rank int, left string, right string")
    vocab = spark.createDataFrame([(0, "<s>", True), (5, "ab", False), (6, "##c", False)], "token_id int, token string, is_special boolean")
    df = spark.createDataFrame([(i, "abc ab abd " * 3) for i in range(9)], "row_id bigint, text string")
    for r in E.encode_learned(df, None, vocab, merges=merges).collect():
        assert r.input_ids == [0] + [5, 6, 5, 5, 3] * 3 + [2]


def test_cut_words_carry_their_number(spark):
    call = E._to_pieces(spark.createDataFrame([(1, "a", "b"), (2, "ab", "c")], "rank int, left string, right string"))
    rows = [(0, ["abc", "abx", "é"]), (1, []), (2, ["xyz"])]
    df = spark.createDataFrame(rows, "id int, words array<string>").repartition(1)
    got = {r.id: (r.cut.pieces, r.cut.owner) for r in df.select("id", call("words").alias("cut")).collect()}
    assert got == {0: (["abc", "ab", "##x", "é"], [0, 1, 1, 2]), 1: ([], []), 2: (["x", "##y", "##z"], [0, 0, 0])}
