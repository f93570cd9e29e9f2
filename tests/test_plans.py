"""What moves and what does not: exchanges in the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from duolex.operators import encode as E
from duolex.operators import filters, metrics
from duolex.operators import noise as N
from duolex.operators.frequency import token_frequency
from duolex.operators.index import global_index
from duolex.operators.masking import whole_word_mask
from duolex.operators.pack import pack_chunks
from duolex.operators.sampling import balance_corpora
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.session import materialise, spread

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).withColumnRenamed("doc_id", "row_id")


@pytest.fixture(scope="module")
def vocab(spark, docs):
    return materialise(learn_vocab(word_counts(docs), 500, ["en", "fr", "de", "es"]), "vocab")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """Exchanges that are no broadcasts."""
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan(df))


def read_columns(df):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>\s*$", plan(df), re.M)]


def test_row_local_operators_do_not_shuffle(docs, vocab):
    rows = E.encode(docs, vocab, max_length=64, padding="max")
    assert shuffles(rows) == []
    assert shuffles(whole_word_mask(rows, ["row_id"])) == []
    assert shuffles(filters.length_filter(docs)) == []
    assert shuffles(filters.keyword_profile(docs, {"a": ["the"]})) == []
    sampler = N.TokenSampler({"en": [(100, 1)], "fr": [(101, 1)]})
    noisy = N.denoise_examples(rows, N.Ratios(), sampler, {}, ["en", "fr"], ["row_id"])
    assert shuffles(noisy) == []


def test_balancing_compares_rows_with_a_cut(docs):
    out = balance_corpora(docs, seed=1).select("row_id", "lang")
    assert shuffles(out) == [] and "BroadcastHashJoin" in plan(out)
    assert read_columns(out)[0] == {"row_id", "lang"} or read_columns(out)[0] == {"doc_id", "lang"}


def test_positions_move_rows_once(docs):
    assert shuffles(global_index(docs, by=["lang"])) == ["hashpartitioning"]
    assert shuffles(global_index(docs, by=["lang"], seed=1)) == ["hashpartitioning"]


def test_packing_moves_slices_once_more(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.sequence(F.lit(1), F.lit(9)).alias("input_ids"))
    assert shuffles(pack_chunks(rows, ("input_ids",), 8)) == ["hashpartitioning"] * 2


def test_ngrams_do_not_travel(spark):
    df = spark.range(100).select(F.col("id").alias("pair_id"), F.lit("a b c d").alias("prediction"), F.lit("a b c").alias("reference"))
    found = shuffles(metrics.ngram_totals(df))
    assert found == ["hashpartitioning"] * 2  # the sums per order, and the texts by pair
    assert re.search(r"HashAggregate\(keys=\[pair_id.*\n.*HashAggregate\(keys=\[pair_id.*\n.*Generate", plan(metrics.ngram_totals(df)))


def test_counts_are_combined_before_they_move(docs, vocab):
    text = plan(token_frequency(E.encode(docs, vocab, max_length=64)))
    assert text.index("Exchange hashpartitioning") < text.index("partial_count")


def test_entities_are_matched_in_their_row(spark):
    df = spark.createDataFrame([("en", [1], [1])], "lang string, labels array<int>, predictions array<int>")
    assert shuffles(metrics.entity_prf(df, by=["lang"])) == ["hashpartitioning"]


def test_spread_only_small_inputs(spark, docs):
    assert "RoundRobin" in plan(spread(docs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert shuffles(spread(docs)) == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
