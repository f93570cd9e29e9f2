"""Seeded numbers, noise, schedules, back-translation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolex.functions.rng import mix, mix_each, reseed, row_seed, uniform
from duolex.operators import backtrans as B
from duolex.operators import noise as N
from duolex.operators.encode import encode
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.plans.recipes import keyword_ids

SIZE = 64


def rows_of(spark, n, content=50, size=SIZE):
    rows = [(i, "en" if i % 2 else "fr", [0] + [100 + j for j in range(content)] + [2] + [1] * (size - content - 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, lang string, x array<int>")
    return df.withColumn("s", row_seed(1, "row_id")).withColumn("l", N.content_length(F.col("x")))


def run(df, column):
    return {r.row_id: (r.x, r.y) for r in df.withColumn("y", column).collect()}


def cols():
    return F.col("x"), F.col("l"), F.col("s")


SAMPLER = N.TokenSampler({"en": [(200 + i, 300 - i) for i in range(250)], "fr": [(500 + i, 10 + i % 3) for i in range(40)]})


def test_uniform_known_value(spark):
    got = spark.range(1).select(F.round(uniform(7, F.lit(3)), 12)).first()[0]
    import hashlib
    assert got == round(int(hashlib.md5(b"7|3").hexdigest()[:8], 16) / 2**32, 12)


def test_mix_is_even_and_partition_free(spark):
    df = spark.range(300).select("id", row_seed(5, "id").alias("s"))
    each = df.select("id", mix_each(F.col("s"), F.lit(100), 3, 7).alias("m"), F.transform(F.sequence(F.lit(7), F.lit(106)), lambda i: mix(F.col("s"), i, 3)).alias("n"))
    rows = each.repartition(7).collect()
    assert all(r.m == r.n for r in rows)
    values = [v / 2**31 for r in rows for v in r.m]
    cells = Counter(int(v * 20) for v in values)
    assert all(abs(c - 1500) < 200 for c in cells.values())
    pairs = Counter((int(a * 4), int(b * 4)) for a, b in zip(values, values[1:]))
    assert all(abs(c - 1875) < 260 for c in pairs.values())


def shared_pairs(*draws):
    """Pairs of neighbouring draws that occur twice, over lists of equally long rows of draws."""
    pairs = np.concatenate([((d[:, :-1] << 31) | d[:, 1:]).ravel() for d in draws])
    return len(pairs) - len(np.unique(pairs))


def test_rows_share_no_run_of_draws(spark):
    drawn = spark.range(1_000_000).select(mix_each(row_seed(5, "id"), F.lit(9), 2).alias("m")).toArrow()
    draws = drawn.column("m").combine_chunks().flatten().to_numpy().reshape(-1, 9)
    assert shared_pairs(draws) == 0  # of eight million


def test_steps_of_a_long_row_share_no_draws(spark):
    drawn = spark.range(1_200_000).coalesce(1).select(*[mix(row_seed(5, F.lit(1)), F.col("id"), salt).alias(f"m{salt}") for salt in range(4)]).toArrow()
    assert shared_pairs(*[drawn.column(k).to_numpy().reshape(1, -1) for k in range(4)]) == 0


def test_source_rows_of_a_chunk_draw_apart(spark):
    seeds = spark.range(-500, 500).select(reseed(row_seed(5, F.lit("chunk")), F.col("id")).alias("s"))
    drawn = seeds.select(mix_each(F.col("s"), F.lit(64)).alias("m")).toArrow()
    assert shared_pairs(drawn.column("m").combine_chunks().flatten().to_numpy().reshape(-1, 64)) == 0


def test_content_length(spark):
    df = spark.createDataFrame([([0, 10, 11, 2, 1, 1],), ([0, 10, 11],), ([2],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(N.content_length(F.col("x"))).collect()] == [3, 3, 0, 0]


def test_mask(spark):
    x, l, s = cols()
    for before, after in run(rows_of(spark, 50), N.noise_mask(x, l, 0.15, s)).values():
        changed = [i for i, (a, b) in enumerate(zip(before, after)) if a != b]
        assert len(after) == SIZE and 1 <= len(changed) <= 7
        assert all(after[i] == 4 and 1 <= i <= 50 for i in changed)


def test_dropout(spark):
    x, l, s = cols()
    got = run(rows_of(spark, 400), N.noise_dropout(x, l, 0.2, s, list(range(100, 125))))
    lost = Counter()
    for before, after in got.values():
        kept = [v for v in after if v >= 100]
        assert len(after) == SIZE and len(kept) == 40 and after[0] == 0 and after.index(2) == 41
        assert kept == [v for v in before if v in set(kept)]
        lost.update(set(before) - set(after))
    heavy = sum(c for v, c in lost.items() if v < 125)
    assert 1.6 < heavy / (4000 - heavy) < 2.1  # weight 2, drawn without replacement


def test_dropout_golden(spark):
    df = spark.createDataFrame([(0, [0, 10, 11, 2, 1, 1])], "row_id int, x array<int>")
    at = F.array(F.lit(2))
    out = df.select(N.A.pad_to(N._splice(F.col("x"), at, lambda j: F.array().cast("array<int>"), 1), F.size("x"), 1)).first()[0]
    assert out == [0, 10, 2, 1, 1, 1]


def test_insert_golden(spark):
    df = spark.createDataFrame([([0, 10, 11, 2, 1, 1],), ([0, 10, 11, 12, 13, 2],)], "x array<int>")
    y = N._put_tokens(F.col("x"), F.array(F.lit(1)), F.array(F.lit(99)), 0)
    out = df.select(N.A.let(y, lambda y: N.A.let(N.content_length(y) + 1, lambda m: N._refit(y, m, F.size("x"))))).collect()
    assert [r[0] for r in out] == [[0, 99, 10, 11, 2, 1], [0, 99, 10, 11, 12, 2]]


@pytest.mark.parametrize("kind", ["replace", "insert"])
def test_tokens_of_the_other_language(spark, kind):
    x, l, s = cols()
    other = F.when(F.col("lang") == "en", F.lit("fr")).otherwise(F.lit("en"))
    fn = N.noise_replace if kind == "replace" else N.noise_insert
    df = rows_of(spark, 100)
    langs = {r.row_id: r.lang for r in df.collect()}
    first = Counter()
    for i, (before, after) in run(df, fn(x, l, 0.2, s, SAMPLER, other)).items():
        new = [v for v in after if v >= 200]
        low, high = (500, 540) if langs[i] == "en" else (200, 450)
        assert len(after) == SIZE and all(low <= v < high for v in new) and len(new) == len(set(new)) == 10
        assert after[0] == 0 and after.index(2) == (51 if kind == "replace" else 61)
        first.update(new)
    assert len(first) > 100


def test_sampler_follows_the_frequencies(spark):
    sampler = N.TokenSampler({"en": [(1, 60), (2, 30), (3, 10)]})
    df = spark.range(3000).select(row_seed(2, "id").alias("s"))
    got = Counter(r[0][0] for r in df.select(sampler.draw(F.lit("en"), F.lit(1), F.col("s"), 5)).collect())
    assert abs(got[1] - 1800) < 120 and abs(got[2] - 900) < 110 and abs(got[3] - 300) < 80


def test_sampler_falls_back_to_the_whole_list(spark):
    rare = N.TokenSampler({"en": [(1, 10**9)] + [(i, 1) for i in range(2, 30)]})
    df = spark.range(200).select(row_seed(2, "id").alias("s"))
    out = [r[0] for r in df.select(rare.draw(F.lit("en"), F.lit(20), F.col("s"), 5)).collect()]
    assert all(len(v) == len(set(v)) == 20 and v[0] == 1 for v in out)
    assert len({tuple(v) for v in out}) > 190
    few = [r[0] for r in df.limit(1).select(rare.draw(F.lit("en"), F.lit(99), F.col("s"), 5)).collect()]
    assert sorted(few[0]) == list(range(1, 30))
    unknown = df.limit(1).select(rare.draw(F.lit("xx"), F.lit(3), F.col("s"), 5)).first()[0]
    assert unknown == []


def test_shuffle(spark):
    x, l, s = cols()
    moved = 0
    for before, after in run(rows_of(spark, 200), N.noise_shuffle(x, l, 1, s)).values():
        assert sorted(before) == sorted(after) and after[0] == 0 and after[51:] == before[51:]
        moved += before != after
    assert moved > 170
    for before, after in run(rows_of(spark, 20, content=8), N.noise_shuffle(x, l, 1, s)).values():
        assert before == after
    for before, after in run(rows_of(spark, 20), N.noise_shuffle(x, l, 0, s)).values():
        assert before == after


def test_degenerate_rows(spark):
    x, l, s = cols()
    df = spark.createDataFrame([(0, "en", [0, 2]), (1, "en", [2, 1]), (2, "en", [0, 7, 2]), (3, "en", [0] * 12), (4, "en", [])],
                               "row_id bigint, lang string, x array<int>")
    df = df.withColumn("s", row_seed(1, "row_id")).withColumn("l", N.content_length(F.col("x")))
    for noisy in (N.noise_mask(x, l, 0.9, s), N.noise_dropout(x, l, 0.9, s, []), N.noise_shuffle(x, l, 1, s),
                  N.noise_replace(x, l, 0.9, s, SAMPLER, F.lit("fr")), N.noise_insert(x, l, 0.9, s, SAMPLER, F.lit("fr"))):
        assert all(len(a) == len(b) for a, b in run(df, noisy).values())


def test_denoise(spark):
    df = rows_of(spark, 100).select("row_id", "lang", F.col("x").alias("input_ids"))
    out = N.denoise_examples(df, N.Ratios(0.15, 0.2, 0.1, 0.15, 1), SAMPLER, {"en": [101], "fr": []}, ["en", "fr"], ["row_id"], 4)
    again = {r.row_id: r.input_ids for r in out.repartition(5).collect()}
    for r in out.collect():
        assert r.lang == ("fr" if r.row_id % 2 else "en")
        assert r.labels[:52] == [0] + list(range(100, 150)) + [2] and set(r.labels[52:]) == {-100}
        assert len(r.input_ids) == SIZE and r.input_ids[0] == 0 and r.input_ids != r.labels
        assert r.attention_mask == [int(v != 1) for v in r.input_ids]
        assert again[r.row_id] == r.input_ids
    none = N.denoise_examples(df, N.Ratios(0.0, 0.0, 0.0, 0.0, 0), SAMPLER, {}, ["en", "fr"], ["row_id"], 4)
    assert {tuple(r.input_ids) for r in none.collect()} == {tuple(r.input_ids) for r in df.collect()}


def test_noise_schedule(spark):
    steps = spark.range(1, 8).withColumnRenamed("id", "step")
    got = B.noise_schedule(steps, 2).orderBy("step").collect()
    ratios = [(round(r.mask_ratio, 6), round(r.dropout_ratio, 6), r.replace_ratio, round(r.insert_ratio, 6)) for r in got]
    assert ratios == [(0.15, 0.2, 0.0, 0.15)] + [(0.2, 0.225, 0.0, 0.2)] * 6
    assert {r.updates for r in B.noise_schedule(steps, 0).collect()} == {0}
    assert [B.steps_between_updates(e, 1000, 10, 2) for e in ("epoch", "half_epoch", "quarter_epoch", "7")] == [50, 25, 12, 7]
    rng = random.Random(1)
    for _ in range(20):
        m, d, p, q, cap, every = rng.random() / 5, rng.random() / 5, rng.random() / 9 + 0.01, rng.random() / 9, 0.6, rng.randint(1, 3)
        ratio, updates, want = [m, d, m], 0, []
        for step in range(1, 8):
            if step % every == 0 and sum(ratio) < cap:
                ratio, updates = [ratio[0] + p, ratio[1] + q, ratio[2] + p], updates + 1
            want.append(updates)
        got = B.noise_schedule(steps, every, m, d, 0.0, m, p, q, cap).orderBy("step").collect()
        assert [r.updates for r in got] == want


def test_objective_schedule(spark):
    steps = spark.range(1, 7).withColumnRenamed("id", "step")

    def short(**kw):
        return "".join(r.objective[0] for r in B.objective_schedule(steps, **kw).orderBy("step").collect())

    assert short(warmup=3) == "dddbdb" and short() == "dbdbdb" and short(warmup=1) == "dbdbdb"
    assert short(only="denoise") == "dddddd" and short(only="back_translate") == "bbbbbb"


def test_shift_right(spark):
    df = spark.createDataFrame([([0, 10, 2, -100, -100],)], "labels array<int>")
    r = B.shift_right(df, F.lit(6)).first()
    assert r.decoder_input_ids == [6, 0, 10, 2, 1] and r.decoder_attention_mask == [1, 1, 1, 1, 0]


def test_back_translation(spark):
    df = spark.createDataFrame([(0, "en", "the cat sat"), (1, "fr", "le chat")], "row_id bigint, lang string, text string")
    vocab = learn_vocab(word_counts(df), 40, ["en", "fr"])
    rows = encode(df, vocab, max_length=8, padding="max").drop("text").withColumn("batch_id", F.lit(0).cast("bigint"))
    out = B.generate(
        rows.select("row_id", "input_ids"),
        lambda b: b[["row_id"]].assign(output_ids=b["input_ids"].map(lambda v: [7] + list(v)[:-2])),
        "row_id bigint, output_ids array<int>",
    )
    got = {r.row_id: r for r in B.back_translation_pairs(rows, out, vocab, ["en", "fr"], 16).collect()}
    assert got[0].lang == "fr" and got[1].lang == "en"
    assert len(got[0].input_ids) == len(got[1].input_ids)
    for r in rows.collect():
        clean = list(r.input_ids)[:-2]
        assert got[r.row_id].input_ids[1:len(clean) + 1] == clean  # special tokens are found again
        assert got[r.row_id].labels == [v if v != 1 else -100 for v in r.input_ids]
    target = {r.row_id: (r.target_lang, r.decoder_start_id) for r in B.target_language(df, vocab, ["en", "fr"]).collect()}
    assert target == {0: ("fr", 7), 1: ("en", 5)}


def test_keyword_ids(spark):
    df = spark.createDataFrame([("for while return",)], "text string")
    vocab = learn_vocab(word_counts(df), 40, ["en"])
    known = {r.token: r.token_id for r in vocab.collect()}
    assert keyword_ids(vocab, {"en": ["for", "return"], "fr": ["absent"]}) == {
        "en": sorted([known["for"], known["retu"], known["##rn"]]), "fr": []}


def test_rows_beyond_a_million_positions(spark):
    size = (1 << 20) + 5000
    content = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i.cast("int") + 10)
    df = spark.range(1).select(F.concat(F.array(F.lit(0)), content, F.array(F.lit(2))).alias("x"))
    x = F.col("x")
    y = df.select(N.noise_dropout(x, N.content_length(x), 0.2, F.lit(7).cast("bigint"), []).alias("y"))
    row = y.select(F.size("y").alias("n"), F.size(F.filter("y", lambda v: v > 10)).alias("kept")).first()
    assert row.n == size + 2 and row.kept == size - int((size + 1) * 0.2)
