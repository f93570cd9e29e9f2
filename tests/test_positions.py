"""Positions of ids of any kind, exact batches of a map, filters that reach the scan, growing noise."""

import random

import pytest
from pyspark.sql import functions as F

from duolex.operators import clean, index
from duolex.operators import encode as E
from duolex.operators.index import bucket_of, global_index, id_bounds
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.plans.recipes import denoise_data

DOCS = "/root/testdata/sf0.001/documents.parquet"
RNG = random.Random(4)
IDS = {
    "dense": list(range(3000)),
    "hashed": [RNG.randint(-(1 << 63), (1 << 63) - 1) for _ in range(3000)],
    "sparse": [i * 10**15 + i % 7 for i in range(3000)],
    "negative": [-i * 3 for i in range(3000)],
    "clustered": [i for i in range(2900)] + [(1 << 62) + i for i in range(100)],
    "edges": [-(1 << 63), (1 << 63) - 1, 0, -1, 1] + list(range(5, 3000)),
}


def frame(spark, ids):
    return spark.createDataFrame([(i, "ab"[n % 2]) for n, i in enumerate(ids)], "row_id bigint, lang string").repartition(5)


@pytest.mark.parametrize("kind", IDS)
def test_positions_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(index, "BUCKET_ROWS", 100)
    rows = frame(spark, IDS[kind])
    got = {r.row_id: r.idx for r in global_index(rows).collect()}
    assert got == {i: n for n, i in enumerate(sorted(IDS[kind]))}
    by = {(r.lang, r.row_id): r.idx for r in global_index(rows, by=["lang"]).collect()}
    for lang in "ab":
        own = sorted(i for n, i in enumerate(IDS[kind]) if "ab"[n % 2] == lang)
        assert [by[lang, i] for i in own] == list(range(len(own)))


@pytest.mark.parametrize("kind", IDS)
def test_buckets_are_even_and_few(spark, kind):
    rows = frame(spark, IDS[kind])
    bounds = id_bounds(rows, "row_id", 100)
    sizes = [r["count"] for r in rows.groupBy(bucket_of(F.col("row_id"), bounds).alias("b")).count().collect()]
    # hashed ids used to get a bucket each
    assert 20 <= len(sizes) <= 31 and max(sizes) <= 250 and len(bounds) <= 30


def test_bounds_of_nothing(spark):
    empty = frame(spark, IDS["dense"]).where("false")
    assert id_bounds(empty, "row_id", 1) == [] and global_index(empty).count() == 0
    one = spark.createDataFrame([(None, 1), (5, 2)], "row_id bigint, x int")
    assert sorted(r.idx for r in global_index(one).collect()) == [0, 1]


def test_bisection(spark):
    bounds = [-5, 0, 7, 7 + 10**12]
    values = [-(1 << 63), -6, -5, -1, 0, 6, 7, 10**12, 10**12 + 7, (1 << 62), None]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = [r.b for r in rows.select(bucket_of(F.col("v"), bounds).alias("b")).collect()]
    assert got == [sum(b <= v for b in bounds) if v is not None else 0 for v in values]


@pytest.mark.parametrize("size", [1, 7, 1000, 100_000])
def test_map_batched_sees_exact_batches(spark, size):
    import pandas as pd

    rows = spark.range(5300).repartition(3).withColumn("task", F.spark_partition_id())
    out = clean.map_batched(
        rows, lambda b: pd.DataFrame({"task": [b.task.iloc[0]], "n": [len(b)], "total": [b.id.sum()], "fresh": [b.index[0]]}),
        "task int, n bigint, total bigint, fresh bigint", batch_size=size).collect()
    assert sum(r.total for r in out) == sum(range(5300)) and all(r.fresh == 0 for r in out)
    for task in {r.task for r in out}:
        sizes = [r.n for r in out if r.task == task]
        assert all(n == size for n in sizes[:-1]) and 0 < sizes[-1] <= size


def test_map_batched_refuses_no_rows(spark):
    with pytest.raises(ValueError):
        clean.map_batched(spark.range(1), lambda b: b, "id bigint", batch_size=0)


def test_filters_reach_the_scan_below_encoding(spark):
    docs = spark.read.parquet(DOCS).withColumnRenamed("doc_id", "row_id")
    vocab = learn_vocab(word_counts(docs), 300, ["en", "fr"]).cache()
    for out in (E.encode(docs, vocab), E.encode(docs, vocab, max_length=64, padding="max"),
                E.decode(E.encode(docs, vocab), vocab, "input_ids")):
        plan = out.where("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(lang,en)" in plan.split("PushedFilters")[1]
        assert plan.count("ArrowEvalPython") <= 2
    assert E.encode(docs, vocab).where("lang = 'en'").count() == docs.where("lang = 'en'").count()


def test_noise_grows_with_the_step(spark):
    text = " ".join(f"word{k % 9}" for k in range(60))
    rows = [(i, "en" if i % 2 else "fr", text + f" {' '.join(f'own{i}x{k}' for k in range(25))}") for i in range(80)]
    corpus = spark.createDataFrame(rows, "row_id bigint, lang string, text string")
    plan = dict(every=4, mask=0.0, dropout=0.0, replace=0.0, insert=0.0, p=0.05, pd=0.0, cap=0.6, warmup=1000)
    out = denoise_data(corpus, ["en", "fr"], {"en": ["if"], "fr": ["if"]}, 400, 128, 4, schedule=plan)
    masked = {r.step: r.n for r in out.groupBy("step").agg(F.sum(F.size(F.filter("input_ids", lambda v: v == 4))).alias("n")).collect()}
    assert len(masked) == 20 and masked[1] == masked[3] == 0 < masked[4] < masked[12] < masked[20]
