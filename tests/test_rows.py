"""Filters, sampling, positions, unions and interleaving."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duolex.keywords import CPP, CUDA, KEYWORDS
from duolex.operators import combine, filters, sampling
from duolex.operators.batches import (
    assemble_batches, check_batch_language, pad_batches, pad_gathered, token_classification_batches,
)
from duolex.operators.index import global_index, mark_first_k, top_k


def key(seed, i):
    return int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16), i


def ids(df, col="row_id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_keyword_lists():
    assert len(CUDA) == 33 and len(CPP) == 95 and len(KEYWORDS["fortran_keywords"]) == 222


def test_length_filter_edges(spark):
    rows = [(0, 19, 19), (1, 20, 20), (2, 20, 2000), (3, 20, 2001)]
    text = [(i, " ".join(f"w{j % unique}" for j in range(n))) for i, unique, n in rows]
    df = spark.createDataFrame(text, "row_id int, text string")
    assert ids(filters.length_filter(df)) == [1, 2]
    spaces = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(19)) + "  ")], "row_id int, text string")
    assert filters.length_filter(spaces).count() == 1  # the empty word counts


def test_keyword_filter_modes(spark):
    df = spark.createDataFrame([(0, "x __device__ y"), (1, "__global__"), (2, "none")], "row_id int, text string")
    assert ids(filters.keyword_filter(df)) == [0, 1]
    assert ids(filters.keyword_filter(df, mode="first")) == [1]
    tokens = df.withColumn("tokens", F.split("text", " "))
    assert ids(filters.keyword_filter(tokens, "tokens")) == [0, 1]
    strict = spark.createDataFrame([(0, "threadIdx.x"), (1, "gridDim")], "row_id int, cuda string")
    assert ids(filters.keyword_filter_strict(strict)) == [0]


def test_keyword_profile_and_audit(spark, corpus):
    df = spark.createDataFrame([(0, "for while x For"), (1, "nothing")], "row_id int, text string")
    got = {(r.row_id, r.list_name): r.hits for r in filters.keyword_profile(df, {"loops": ["for", "while", "le x"], "no": ["q"]}).collect()}
    assert got == {(0, "loops"): 3}
    audit = filters.filter_audit(corpus, F.col("row_id") < 10).collect()
    assert sum(r.rows_before for r in audit) == 60 and sum(r.rows_after for r in audit) == 10
    assert filters.filter_rows(corpus, lambda b: b["row_id"] < 4).count() == 4


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_positions_do_not_depend_on_partitions(spark, corpus, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = corpus.repartition(partitions)
        order = sorted(range(60), key=lambda i: key(3, i))
        got = {r.row_id: r.idx for r in global_index(df, seed=3).collect()}
        assert got == {i: n for n, i in enumerate(order)}
        langs = {r.row_id: r.lang for r in corpus.collect()}
        per = {}
        for i in order:
            per.setdefault(langs[i], []).append(i)
        k = min(map(len, per.values()))
        want = sorted(i for rows in per.values() for i in rows[:k])
        assert ids(sampling.balance_corpora(df, seed=3)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_file_order_over_many_buckets(spark):
    wide = [i * 99_991 for i in range(300)] + [10**12, 10**12 + 5]
    df = spark.createDataFrame([(i,) for i in wide], "row_id bigint").repartition(5)
    assert {r.row_id: r.idx for r in global_index(df).collect()} == {i: n for n, i in enumerate(wide)}


def test_shuffle_order(corpus):
    got = [r.row_id for r in sampling.seeded_shuffle(corpus, seed=3).collect()]
    assert got == sorted(range(60), key=lambda i: key(3, i))


def test_downsample(corpus):
    out = sampling.downsample(corpus, 5, seed=1)
    assert Counter(r.lang for r in out.collect()) == {"en": 5, "fr": 5, "de": 5}
    with pytest.raises(Exception, match="fewer than the limit"):
        sampling.downsample(corpus, 1000, seed=1).count()


@pytest.mark.parametrize("n", [0, 1, 17, 60, 100])
def test_sample_and_complement(corpus, n):
    out = sampling.sample_and_complement(corpus.withColumn("text", F.concat("text", F.lit(" \t"))), n, seed=2)
    order = sorted(range(60), key=lambda i: key(2, i))
    assert ids(out.where("in_sample")) == sorted(order[:n])
    assert ids(out.where("not in_sample")) == sorted(order[n:])
    assert not out.where(F.col("text").endswith("\t")).count()


def test_limits_per_group(spark, corpus):
    limits = spark.createDataFrame([("en", 0), ("fr", 1000)], "lang string, k bigint")
    out = mark_first_k(corpus, lambda sizes: limits, ["lang"], "row_id", 1)
    marks = Counter((r.lang, r.in_sample) for r in out.collect())
    assert marks == {("en", False): 40, ("fr", True): 10}


def test_top_k_ties(spark):
    df = spark.createDataFrame([("a", i, i % 4) for i in range(200)] + [("b", 1, 1)], "g string, id int, v int")
    got = [(r.g, r.rank, r.id) for r in top_k(df, ["g"], F.desc("v"), "id", 60).orderBy("g", "rank").collect()]
    want = sorted(range(200), key=lambda i: (-(i % 4), i))[:60]
    assert got == [("a", n + 1, i) for n, i in enumerate(want)] + [("b", 1, 1)]


def test_top_k_without_groups(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(200)], "id int, v int").repartition(7)
    want = sorted(range(200), key=lambda i: (-(i % 4), i))[:60]
    assert [(r.rank, r.id) for r in top_k(df, [], F.desc("v"), "id", 60).orderBy("rank").collect()] == [(n + 1, i) for n, i in enumerate(want)]
    assert top_k(df.limit(0), [], F.desc("v"), "id", 60).count() == 0


def test_interleave_golden(spark):
    rows = [(i, "a" if i < 16 else "b" if i < 22 else "c") for i in range(27)]
    df = spark.createDataFrame(rows, "row_id bigint, lang string")
    out = combine.interleave_batches(df, ["a", "b", "c"], 2).orderBy("batch_id", "slot")
    assert [r.row_id for r in out.collect()] == [0, 1, 16, 17, 22, 23, 2, 3, 18, 19, 24, 25]
    assert combine.interleave_batches(df, ["a", "b", "x"], 2).count() == 0  # a corpus without rows
    mixed = combine.interleave_batches(df, ["a", "b", "c"], 2, shuffle_batches=True, shuffle_slots=True, seed=5)
    assert ids(mixed) == ids(out)
    assert check_batch_language(mixed).count() == 0
    slots = {r.row_id: (r.batch_id, r.slot) for r in mixed.collect()}
    assert len({slots[i][1] for i in (0, 16, 22, 2)}) == 1  # one permutation for all batches
    assert sorted({b for b, _ in slots.values()}) == list(range(6))


def test_positional_joins(spark):
    a = spark.createDataFrame([(0, "x", "en"), (1, "y", "en")], "row_index bigint, text string, lang string")
    b = spark.createDataFrame([(1, "v", "fr"), (0, "u", "fr")], "row_index bigint, text string, lang string")
    got = combine.zip_parallel(a, b).orderBy("row_index").collect()
    assert [(r.text, r.labels, r.labels_lang) for r in got] == [("x", "u", "fr"), ("y", "v", "fr")]
    with pytest.raises(Exception, match="sides differ in length"):
        combine.zip_parallel(a, b.where("row_index = 0")).collect()
    with pytest.raises(Exception, match="sides differ in length"):
        combine.hconcat_columns(a.where("row_index = 0").select("row_index", "text"), b.select("row_index", F.col("text").alias("t"))).collect()


def test_union_and_valid_as_train(corpus):
    assert ids(combine.union_corpora([corpus, corpus], seed=1)) == sorted(list(range(60)) * 2)
    split = corpus.withColumn("split", F.when(F.col("row_id") < 5, "valid").otherwise("test"))
    out = combine.train_from_valid(split)
    assert ids(out) == [0, 1, 2, 3, 4] and {r.split for r in out.collect()} == {"train"}


def test_batches(spark, corpus):
    out = assemble_batches(corpus, 8)
    assert sorted(Counter(r.batch_id for r in out.collect()).values()) == [4] + [8] * 7
    assert check_batch_language(out).count() == 8
    rows = spark.createDataFrame(
        [(0, [1, 2], [1, 1], [0, 0]), (1, [3], [1], [5]), (2, [4], [1], [6])],
        "row_id bigint, input_ids array<int>, attention_mask array<int>, labels array<int>",
    )
    got = {r.row_id: (r.input_ids, r.attention_mask, r.labels) for r in token_classification_batches(rows, 2).collect()}
    assert got == {0: ([1, 2], [1, 1], [0, 0]), 1: ([3, 1], [1, 0], [5, -100]), 2: ([4], [1], [6])}
    wide = {r.row_id: r.labels for r in pad_gathered(rows, {"labels": -100}).collect()}
    assert wide[2] == [6, -100]
    assert pad_batches(rows.withColumn("batch_id", F.lit(1)), {"labels": -100}).where("size(labels) <> 2").count() == 0


def test_null_row_keeps_its_neighbours(spark):
    """A null text in the middle of a pack group is an empty one through encode, pack and mask."""
    from duolex.operators import encode as E
    from duolex.operators.masking import whole_word_mask
    from duolex.operators.pack import pack_chunks
    from duolex.operators.vocab import learn_vocab, word_counts

    rows = [(0, "en", "red green blue"), (1, "en", None), (2, "en", "blue red")]
    df = spark.createDataFrame(rows, "row_id bigint, lang string, text string")
    vocab = learn_vocab(word_counts(df), 50, ["en"])
    out = E.encode(df, vocab).orderBy("row_id").collect()
    assert list(out[1].input_ids) == [0, 2] and list(out[1].word_ids) == [None, None]
    chunks = whole_word_mask(pack_chunks(E.encode(df, vocab), chunk_size=100), ["pack_group", "chunk"], 0.5, 1, "row_ids").collect()
    assert len(chunks) == 1 and len(chunks[0].input_ids) == sum(len(r.input_ids) for r in out) == len(chunks[0].labels)
    cut = E.encode(df, vocab, max_length=4).orderBy("row_id").collect()
    assert [list(r.input_ids) for r in cut] == [list(r.input_ids)[:3] + [2] if len(r.input_ids) > 4 else list(r.input_ids) for r in out]


@pytest.mark.parametrize("limit", [None, 2])
def test_lookups_agree_on_bad_input(spark, limit):
    """Unknown and null ids, ids without a token, tokens and ids that stand twice: shipped or joined, one result."""
    from duolex.operators import encode as E

    rows = [(0, "<s>"), (1, "<pad>"), (2, "</s>"), (3, "<unk>"), (4, "red"), (6, "blue"), (7, "red"), (6, "azur"), (9, None)]
    vocab = spark.createDataFrame([(i, t, i < 4) for i, t in rows], "token_id int, token string, is_special boolean")
    texts = spark.createDataFrame([(0, "red blue azur"), (1, None), (2, "green red")], "row_id bigint, text string")
    got = {r.row_id: list(r.input_ids) for r in E.encode(texts, vocab, limit=limit).collect()}
    assert got == {0: [0, 4, 3, 6, 2], 1: [0, 2], 2: [0, 3, 3, 4, 2]}
    ids = spark.createDataFrame([(0, [0, 4, 6, 99, -1, None, 5, 9, 7, 2]), (1, []), (2, None)], "row_id bigint, input_ids array<int>")
    assert {r.row_id: r.text for r in E.decode(ids, vocab, limit=limit).collect()} == {0: "red azur red", 1: "", 2: ""}


def test_padded_rows_as_text(spark):
    """As the padded arrays, joined: empty, null and full rows, null elements, one row much wider."""
    from duolex.functions import arrays as A

    rows = spark.createDataFrame([(0, [1, 2]), (1, []), (2, None), (3, [None, 5]), (4, [None]), (5, list(range(3000)))], "row_id bigint, x array<int>")
    text = pad_gathered(rows, {"x": -100}, as_text=True)
    plain = pad_gathered(rows, {"x": -100}).withColumn("x", A.joined(F.col("x")))
    assert sorted(text.collect()) == sorted(plain.collect()) and dict(text.dtypes)["x"] == "string"
    assert "array_repeat" not in text._jdf.queryExecution().executedPlan().toString()
    empty = pad_gathered(rows.where("row_id = 1"), {"x": 1}, as_text=True)
    assert empty.first().x == ""


def test_padded_text_is_small_on_disk(spark, tmp_path):
    """Padding costs next to nothing once written, by the session's defaults; a codec that was set stays."""
    codec = "spark.sql.parquet.compression.codec"

    def written(name):
        rows = spark.range(0, 200, 1, 1).select(F.col("id").alias("row_id"), F.when(F.col("id") == 0, F.sequence(F.lit(1), F.lit(20_000))).otherwise(F.array(F.col("id").cast("int"))).alias("x"))
        pad_gathered(rows, {"x": -100}, as_text=True).write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        assert back.where("length(x) < 90000").count() == 0 and back.where("row_id = 7").first().x == "7" + ",-100" * 19_999
        return sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))

    kept = spark.conf.getAll.get(codec)
    try:
        spark.conf.unset(codec)
        assert written("default") < 200_000  # 20 MB of text; snappy: 1 MB
        spark.conf.set(codec, "snappy")
        assert written("told") > 500_000 and spark.conf.get(codec) == "snappy"
    finally:
        spark.conf.unset(codec) if kept is None else spark.conf.set(codec, kept)
