"""Schedules, target languages, back-translation pairs and decoder inputs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.operators.encode import encode, lookup_tokens, mask_pad
from duolex.functions import text as X
from duolex.operators.noise import Ratios
from duolex.schemas import IGNORE, PAD, lang_start, special_tokens
from duolex.session import small_batches


def steps_between_updates(every, n_rows: int, batch_size: int, processes=1) -> int:
    """A number, or 'epoch', 'half_epoch', 'quarter_epoch' of the batches per process."""
    share = {"epoch": 1, "half_epoch": 2, "quarter_epoch": 4}
    if every in share:
        return n_rows // batch_size // processes // share[every]
    return int(every)


def updates_until_cap(mask, dropout, replace, insert, p, pd, cap) -> int:
    """How often the ratios grow before their sum reaches ``cap``; -1 without end."""
    if 2 * p + pd <= 0:
        return 0 if mask + dropout + replace + insert >= cap else -1
    n = 0
    while (mask + n * p) + (dropout + n * pd) + replace + (insert + n * p) < cap:
        n += 1
    return n


def noise_schedule(batches: DataFrame, every: int, mask=0.15, dropout=0.20, replace=0.0, insert=0.15,
                   p=0.05, pd=0.025, cap=0.6, step="step") -> DataFrame:
    """Noise ratios per batch.  Counted from 1, every ``every`` steps mask and insert
    grow by ``p`` and dropout by ``pd`` while their sum is below ``cap``."""
    most = updates_until_cap(mask, dropout, replace, insert, p, pd, cap)
    n = F.lit(0).cast("bigint") if not every else A.div(F.col(step), every)
    if most >= 0:
        n = F.least(n, F.lit(most))
    return (
        batches.withColumn("updates", n)
        .withColumn("mask_ratio", F.lit(mask) + F.col("updates") * p)
        .withColumn("dropout_ratio", F.lit(dropout) + F.col("updates") * pd)
        .withColumn("replace_ratio", F.lit(replace))
        .withColumn("insert_ratio", F.lit(insert) + F.col("updates") * p)
    )


def scheduled_ratios(shuffle=1) -> Ratios:
    """The columns of ``noise_schedule`` as ratios of ``denoise_examples``."""
    return Ratios(*[F.col(f"{name}_ratio") for name in ("mask", "dropout", "replace", "insert")], shuffle)


def objective_schedule(batches: DataFrame, warmup=0, only=None, step="step") -> DataFrame:
    """``denoise`` or ``back_translate`` per batch, steps counted from 1: fixed by
    ``only``, denoise before step ``warmup``, then in turn."""
    if only:
        return batches.withColumn("objective", F.lit(only))
    first = max(warmup, 1)
    return batches.withColumn(
        "objective",
        F.when((F.col(step) < warmup) | ((F.col(step) - first) % 2 == 0), F.lit("denoise")).otherwise(
            F.lit("back_translate")
        ),
    )


def target_language(df: DataFrame, vocab: DataFrame, langs, col="lang") -> DataFrame:
    """The other language of the pair and the id of its start token."""
    first, second = langs
    starts = vocab.where(F.col("token").isin(lang_start(first), lang_start(second))).select(
        F.col("token").alias("_start"), F.col("token_id").alias("decoder_start_id")
    )
    return (
        df.withColumn("target_lang", F.when(F.col(col) == first, F.lit(second)).otherwise(F.lit(first)))
        .withColumn("_start", F.concat(F.lit("<"), F.upper("target_lang"), F.lit(">")))
        .join(F.broadcast(starts), "_start", "left")
        .drop("_start")
    )


def generate(df: DataFrame, fn, schema) -> DataFrame:
    """Run a user's generator (batches of pandas rows) over encoded rows."""
    return small_batches(df).mapInPandas(lambda batches: (fn(b) for b in batches), schema)


def back_translation_pairs(df: DataFrame, generated: DataFrame, vocab: DataFrame, langs,
                           max_length=512, id_col="row_id", all_langs=None) -> DataFrame:
    """Generated ids (row_id, output_ids), without their first id, are decoded and
    encoded again as inputs padded to the longest row of the batch; the original
    ids are the labels and ``lang`` is the language of the inputs.  Special tokens
    in the decoded text are recognised.
    """
    out = generated.select(id_col, A.drop_first(F.col("output_ids"), F.lit(1)).alias("_out"))
    out = lookup_tokens(out, "_out", "_names", vocab, id_col)
    out = out.select(id_col, X.join_pieces(F.col("_names")).alias("_noisy"))
    first, second = langs
    rows = df.select(
        id_col, "batch_id",
        F.when(F.col("lang") == first, F.lit(second)).otherwise(F.lit(first)).alias("lang"),
        mask_pad(F.col("input_ids")).alias("_labels"),
    ).join(out, id_col)
    specials = [t for _, t, special in special_tokens(all_langs or langs) if special]
    enc = encode(rows, vocab, "_noisy", max_length, "longest", id_col=id_col, specials=specials)
    return enc.select(id_col, "batch_id", "lang", "input_ids", "attention_mask", F.col("_labels").alias("labels"))


def shifted(ids: Column, start: Column) -> Column:
    moved = F.concat(F.array(start), A.take(ids, F.size(ids) - 1))
    return F.transform(moved, lambda x: F.when(x == IGNORE, F.lit(PAD)).otherwise(x))


def shift_right(df: DataFrame, start: Column, ids="labels") -> DataFrame:
    """Decoder inputs: start id in front, last id off, ignored positions padded."""
    return df.withColumn("decoder_input_ids", shifted(F.col(ids), start)).withColumn(
        "decoder_attention_mask", A.not_equal_mask(F.col("decoder_input_ids"), PAD)
    )
