"""Token frequencies per language."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions import text as X
from duolex.operators.index import top_k


def token_frequency(df: DataFrame, first_lang=None, ids="input_ids") -> DataFrame:
    """(lang, token_id, freq).  With ``first_lang`` all other languages are counted
    together as ``other``."""
    lang = F.col("lang")
    if first_lang is not None:
        lang = F.when(lang == first_lang, lang).otherwise(F.lit("other"))
    return (
        df.select(lang.alias("lang"), F.explode(ids).alias("token_id"))
        .groupBy("lang", "token_id").agg(F.count(F.lit(1)).alias("freq"))
    )


def top_k_tokens(freq: DataFrame, vocab: DataFrame, k=3000) -> DataFrame:
    """The k most frequent ids per language (ties by id), special ids removed
    afterwards, so fewer than k may stay.  The rank is taken again over what stays."""
    best = top_k(freq, ["lang"], F.desc("freq"), "token_id", k, "_r")
    named = best.join(vocab, "token_id").where(~F.col("is_special"))
    return named.select(
        "lang", F.row_number().over(W.partitionBy("lang").orderBy("_r")).alias("rank"), "token_id",
        X.join_pieces(F.array("token")).alias("token"), "freq",
    )


def top_k_side_by_side(top: DataFrame, first: str, second: str) -> DataFrame:
    """i-th token of one language next to the i-th of the other, cut to the shorter."""

    def side(lang, n):
        return top.where(F.col("lang") == lang).select(
            "rank",
            F.col("token_id").alias(f"token_id_{n}"),
            F.col("token").alias(f"token_{n}"),
            F.col("freq").alias(f"freq_{n}"),
        )

    return side(first, 1).join(side(second, 2), "rank")


def zipped_long(side: DataFrame, first: str, second: str) -> DataFrame:
    """The side-by-side table as (lang, rank, token_id, freq) rows."""
    return side.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(lang).alias("lang"), "rank",
                        F.col(f"token_id_{n}").alias("token_id"), F.col(f"freq_{n}").alias("freq"),
                    )
                    for n, lang in ((1, first), (2, second))
                ]
            )
        )
    )


def token_probabilities(freq: DataFrame) -> DataFrame:
    """freq / sum(freq) per language, over the cut list."""
    return freq.withColumn("prob", F.col("freq") / F.sum("freq").over(W.partitionBy("lang")))
