"""Seeded sampling and shuffling; exact sizes, independent of partitioning."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions.rng import hash32
from duolex.functions.text import rstrip
from duolex.operators.index import first_k, mark_first_k


def balance_corpora(df: DataFrame, by="lang", id_col="row_id", seed=0) -> DataFrame:
    """Cut every corpus to a random subset as large as the smallest one."""

    def smallest(sizes):
        return sizes.select(by, F.min("n").over(W.partitionBy(F.lit(0))).alias("k"))

    return first_k(df, smallest, [by], id_col, seed)


def downsample(df: DataFrame, k: int, by="lang", id_col="row_id", seed=0) -> DataFrame:
    """Exactly ``k`` random rows per corpus.

    Sample pairs by passing their pair id as ``id_col`` and the split as ``by``:
    one pair is one row, so the sides stay together.  Fails when a corpus has
    fewer than ``k`` rows.
    """

    def enough(sizes):
        short = F.format_string("corpus %s has %s rows, fewer than the limit", F.col(by).cast("string"), F.col("n").cast("string"))
        return sizes.select(
            by,
            F.when(F.col("n") >= k, F.lit(k).cast("bigint"))
            .otherwise(F.raise_error(short).cast("bigint")).alias("k"),
        )

    return first_k(df, enough, [by], id_col, seed)


def seeded_shuffle(df: DataFrame, id_col="row_id", seed=0) -> DataFrame:
    """Random total order, as a range-partitioned sort."""
    return df.withColumn("_h", hash32(seed, id_col)).orderBy("_h", id_col).drop("_h")


def sample_and_complement(df: DataFrame, n: int, id_col="row_id", text="text", seed=0) -> DataFrame:
    """Right-trimmed lines with ``in_sample`` true for exactly ``n`` of them."""
    keyed = df.withColumn("_all", F.lit(1)).withColumn(text, rstrip(F.col(text)))
    marked = mark_first_k(
        keyed, lambda sizes: sizes.select("_all", F.lit(n).cast("bigint").alias("k")), ["_all"], id_col, seed
    )
    return marked.select(*df.columns, "in_sample")
