"""Row filters and their audits."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions import text as X
from duolex.keywords import CUDA, CUDA_STRICT
from duolex.session import small_batches


def keyword_predicate(df: DataFrame, col: str, keywords, mode="any"):
    """Substring test on text, element test on token arrays.

    ``mode='first'`` tests the first keyword only.
    """
    keywords = list(keywords)[:1] if mode == "first" else list(keywords)
    if df.schema[col].dataType.typeName() == "array":
        return F.arrays_overlap(F.col(col), F.array(*[F.lit(k) for k in keywords]))
    return X.contains_any(F.col(col), keywords)


def keyword_filter(df: DataFrame, col="text", keywords=CUDA, mode="any") -> DataFrame:
    return df.where(keyword_predicate(df, col, keywords, mode))


def keyword_filter_strict(df: DataFrame, col="cuda", keywords=CUDA_STRICT) -> DataFrame:
    return keyword_filter(df, col, keywords)


def length_predicate(col="text", min_unique=20, max_words=2000):
    split = X.space_words(F.col(col))
    return (F.size(split) <= max_words) & (F.size(F.array_distinct(split)) >= min_unique)


def length_filter(df: DataFrame, col="text", min_unique=20, max_words=2000) -> DataFrame:
    return df.where(length_predicate(col, min_unique, max_words))


def filter_audit(df: DataFrame, predicate, by="lang") -> DataFrame:
    """Rows before, after and removed, in one pass."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(predicate).alias("rows_after"),
        F.count_if(~predicate).alias("rows_removed"),
    )


def keyword_profile(df: DataFrame, lists, col="text", id_col="row_id") -> DataFrame:
    """How often the keywords of each list occur in a row (rows with a hit).

    A keyword that is one word counts as a word, any other as a substring.  The
    lists become hash-set membership tests on the row's own words: nothing is
    exploded or shuffled.
    """

    def hits_of(name, keywords):
        single = [k for k in keywords if re.fullmatch(r"\w+", k)]
        n = F.size(F.filter(F.col("_w"), lambda w: w.isin(*single)))
        for phrase in keywords:
            if phrase not in single:
                n = n + X.occurrences(F.col("_t"), phrase)
        return F.struct(F.lit(name).alias("list_name"), n.alias("hits"))

    hits = [hits_of(name, keywords) for name, keywords in lists.items()]
    return (
        df.select(id_col, F.col(col).alias("_t"), X.words(F.col(col), lower=False).alias("_w"))
        .select(id_col, F.inline(F.array(*hits)))
        .where(F.col("hits") > 0)
    )


def filter_rows(df: DataFrame, fn) -> DataFrame:
    """Keep rows where ``fn(pandas.DataFrame) -> boolean Series`` holds: the escape
    hatch for predicates that native expressions cannot state.  Rows are sent one way only."""

    @F.pandas_udf("boolean")
    def kept(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(batch.index.isin(batch[fn(batch)].index))

    return small_batches(df).where(kept(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
