"""Masked-language examples."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.functions.rng import mix_array, mix_uniform, reseed, row_seed
from duolex.schemas import BOS, EOS, IGNORE, MASK, PAD
from duolex.session import small_batches


def _apply(df, ids, labels, flags):
    """Replace flagged ids by the mask id; labels keep the original there."""
    old = F.col(labels) if labels in df.columns else F.col(ids)
    return (
        df.withColumn("_f", flags)
        .withColumn(labels, F.zip_with(old, "_f", lambda x, f: F.when(f, x).otherwise(IGNORE)))
        .withColumn(ids, F.zip_with(ids, "_f", lambda x, f: F.when(f, F.lit(MASK)).otherwise(x)))
        .drop("_f")
    )


def whole_word_mask(df: DataFrame, key, p=0.15, seed=0, row_ids=None,
                    ids="input_ids", word_ids="word_ids", labels="labels") -> DataFrame:
    """Mask whole words: all tokens of a word share one draw.

    ``key`` (column names) identifies the row and seeds it.  A word is its word
    id inside the row; in packed chunks ``row_ids`` names the column with the
    source row of every token, so that neighbouring rows do not run together.
    """

    def flags(s):
        if row_ids is None:
            return F.transform(
                F.col(word_ids), lambda w: w.isNotNull() & (mix_uniform(s, F.coalesce(w, F.lit(0))) < p)
            )
        return F.zip_with(
            word_ids, row_ids,
            lambda w, r: w.isNotNull()
            & (mix_uniform(reseed(s, r), F.coalesce(w, F.lit(0))) < p),
        )

    return _apply(df, ids, labels, A.let(row_seed(seed, *key), flags))


def token_mask(df: DataFrame, key, vocab_size: int, n_special: int, p=0.15, seed=0,
               ids="input_ids", labels="labels") -> DataFrame:
    """Token-level alternative: of the chosen tokens 80 % become the mask id, 10 % a
    random ordinary id (``n_special``.. ``vocab_size``-1), 10 % stay; special tokens
    are never chosen."""

    kind = df.schema[ids].dataType.elementType.simpleString()
    call = _token_masker(vocab_size, n_special, p, kind)
    # settled by the generator, as the lookups of tokens are
    return (
        small_batches(df).select("*", F.explode(F.array(call(F.col(ids), row_seed(seed, *key)))).alias("_m"))
        .withColumn(ids, F.col("_m.id"))
        .withColumn(labels, F.col("_m.label"))
        .drop("_m")
    )


def _token_masker(vocab_size: int, n_special: int, p: float, kind: str):
    """Function of ids and row seed: the masked ids and their labels, whole batches at a time."""

    @F.arrow_udf(f"struct<id array<{kind}>, label array<{kind}>>")
    def masked(rows: pa.Array, seeds: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        x = flat.fill_null(0).to_numpy(zero_copy_only=False)
        s, ends = np.repeat(seeds.to_numpy(zero_copy_only=False), sizes), np.cumsum(sizes)
        pos = np.arange(len(x)) - np.repeat(ends - sizes, sizes)
        chosen = (mix_array(s, pos) / 2147483648.0 < p) & ~(np.isin(x, (BOS, EOS, PAD)) & known)
        at = np.flatnonzero(chosen)
        u = mix_array(s[at], pos[at], 1) / 2147483648.0
        other = (mix_array(s[at], pos[at], 2) * (vocab_size - n_special) >> 31) + n_special
        new, gone, label = x.copy(), ~known, np.full_like(x, IGNORE)
        new[at] = np.where(u < 0.8, MASK, np.where(u < 0.9, other, x[at]))
        gone[at] &= u >= 0.9
        label[at] = np.where(known[at], x[at], IGNORE)
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, values, mask=rows.is_null())
            for values in (pa.array(new, flat.type, mask=gone), pa.array(label, flat.type))
        ]
        return pa.StructArray.from_arrays(lists, names=["id", "label"])

    return masked


def masked_eval_set(df: DataFrame, key, seed=0, p=0.15, whole_words=True, vocab_size=None,
                    n_special=None, split="test") -> DataFrame:
    """The test split, masked once with a fixed seed; word ids dropped."""
    part = df.where(F.col("split") == split)
    if whole_words:
        part = whole_word_mask(part, key, p, seed)
    else:
        part = token_mask(part, key, vocab_size, n_special, p, seed)
    return part.drop("word_ids")
