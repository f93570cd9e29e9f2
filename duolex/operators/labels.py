"""Token labels for tagging."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.schemas import IGNORE, TAG_NAMES


def aligned(tags: Column, word_ids: Column) -> Column:
    """Word tags spread over the word's tokens: the first token keeps the tag, a
    later one turns an odd (B-) tag into the I- tag behind it, tokens outside
    words are ignored."""

    def spread(tags, words):
        def one(w, i):
            tag = F.get(tags, w)
            inside = F.when(tag % 2 == 1, tag + 1).otherwise(tag)
            return (
                F.when(w.isNull(), F.lit(IGNORE))
                .when(F.get(words, i - 1) == w, inside)
                .otherwise(tag)
            )

        return F.transform(words, one)

    return A.let(tags, lambda t: A.let(word_ids, lambda w: spread(t, w)))


def align_labels(df: DataFrame, tags="tags", word_ids="word_ids", out="labels") -> DataFrame:
    return df.withColumn(out, aligned(F.col(tags), F.col(word_ids)))


def shift_labels(df: DataFrame, tags="tags") -> DataFrame:
    """Tag 2 becomes 3."""
    return df.withColumn(tags, F.transform(F.col(tags), lambda x: F.when(x == 2, F.lit(3)).otherwise(x)))


def label_names(df: DataFrame, tags="tags", out="names") -> DataFrame:
    """Tag ids to names; ignored positions are left out."""
    names = F.array(*[F.lit(n) for n in TAG_NAMES])
    kept = F.filter(F.col(tags), lambda x: x != IGNORE)
    return df.withColumn(out, F.transform(kept, lambda x: F.get(names, x)))


def label_ids(df: DataFrame, names="names", out="tags") -> DataFrame:
    """Names back to tag ids."""
    known = F.array(*[F.lit(n) for n in TAG_NAMES])
    return df.withColumn(
        out, F.transform(F.col(names), lambda x: (F.array_position(known, x) - 1).cast("int"))
    )
