"""Batches: assembling, checking, padding."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.operators.index import global_index
from duolex.schemas import IGNORE, PAD
from duolex.session import materialise, zstd_files


def assemble_batches(df: DataFrame, batch_size: int, id_col="row_id", by=(), seed=None) -> DataFrame:
    """``batch_id`` and ``slot`` by position: consecutive rows, or a seeded order."""
    return (
        global_index(df, id_col, by, seed, out="_idx")
        .withColumn("batch_id", A.div(F.col("_idx"), batch_size))
        .withColumn("slot", (F.col("_idx") % batch_size).cast("int"))
        .drop("_idx")
    )


def pad_batches(df: DataFrame, pads: dict, by=("batch_id",)) -> DataFrame:
    """Pad array columns (name -> pad value) to the longest one of their batch."""
    batch = W.partitionBy(*by)
    for c, value in pads.items():
        df = df.withColumn("_to", F.max(F.size(c)).over(batch)).withColumn(
            c, A.pad_to(F.col(c), F.col("_to"), value)
        )
    return df.drop("_to")


def token_classification_batches(df: DataFrame, batch_size: int, id_col="row_id", seed=None) -> DataFrame:
    """Batches with ids, mask and labels padded to the longest row."""
    return pad_batches(
        assemble_batches(df, batch_size, id_col, seed=seed),
        {"input_ids": PAD, "attention_mask": 0, "labels": IGNORE},
    )


def check_batch_language(df: DataFrame) -> DataFrame:
    """Batches that hold more than one language; empty when all is well."""
    return (
        df.groupBy("batch_id")
        .agg(F.min("lang").alias("lang_low"), F.max("lang").alias("lang_high"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("lang_low") != F.col("lang_high"))
    )


def pad_gathered(df: DataFrame, pads: dict, as_text=False) -> DataFrame:
    """Pad array columns to the widest one of the whole table, which is written once
    and read for the widths and for the rows.

    ``as_text`` gives the padded arrays as comma separated text: with one long row in
    a large table nearly all cells are padding, which text repeats in one go and
    ``zstd_files`` keeps small on disk.
    """
    df = materialise(zstd_files(df) if as_text else df, "gathered")
    widths = df.agg(*[F.max(F.size(c)).alias(c) for c in pads]).head()
    pad = A.joined_padded if as_text else A.pad_to
    for c, value in pads.items():
        df = df.withColumn(c, pad(F.col(c), F.lit(widths[c] or 0), value))
    return df
