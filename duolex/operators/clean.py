"""Cleaning and projections."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions import text as X
from duolex.session import small_batches


def add_lang_column(df: DataFrame, lang: str) -> DataFrame:
    return df.withColumn("lang", F.lit(lang))


def strip_repo_prefix(df: DataFrame, col="text", sep="|") -> DataFrame:
    """Text behind the first separator.  Rows without one are kept as they are
    and flagged in ``had_prefix``."""
    return df.withColumn("had_prefix", F.contains(F.col(col), F.lit(sep))).withColumn(
        col, X.after_separator(F.col(col), sep)
    )


def remove_cpp_comments(df: DataFrame, col="text") -> DataFrame:
    return df.withColumn(col, X.without_c_comments(F.col(col)))


def remove_fortran_comments(df: DataFrame, col="text") -> DataFrame:
    return df.withColumn(col, X.without_fortran_comments(F.col(col)))


def remove_comments_string_aware(df: DataFrame, src="content", dst="text") -> DataFrame:
    return df.withColumn(dst, X.without_comments_keep_literals(F.col(src)))


def apply_cleaner_by_lang(df: DataFrame, col="text", c_like=("cpp",)) -> DataFrame:
    """C-style cleaning for the languages in ``c_like``, Fortran-style for the others."""
    return df.withColumn(
        col,
        F.when(F.col("lang").isin(*c_like), X.without_c_comments(F.col(col))).otherwise(
            X.without_fortran_comments(F.col(col))
        ),
    )


def rename_drop_columns(df: DataFrame, rename=None, drop=(), keep=None) -> DataFrame:
    df = df.withColumnsRenamed(rename or {}).drop(*drop)
    return df.select(*keep) if keep else df


def map_batched(df: DataFrame, fn, schema, batch_size=None) -> DataFrame:
    """``fn(pandas.DataFrame) -> pandas.DataFrame`` over batches of rows; the row
    count and the columns may change.

    With ``batch_size`` every batch has exactly so many rows, but for the last one of a task:
    what Spark sends is cut and joined anew, and at most one batch is held.  Else the
    batches are those of ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be positive")

    def run(batches):
        if batch_size is None:
            yield from map(fn, batches)
            return
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.iloc[at:at + batch_size - size]
                held.append(part)
                size, at = size + len(part), at + len(part)
                if size == batch_size:
                    yield fn(pd.concat(held, ignore_index=True))
                    held, size = [], 0
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return small_batches(df).mapInPandas(run, schema)
