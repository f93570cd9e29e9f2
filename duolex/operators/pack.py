"""Packing encoded rows into chunks of fixed length."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions.arrays import div
from duolex.operators.index import global_index


def pack_chunks(df: DataFrame, cols=("input_ids", "attention_mask", "word_ids"), chunk_size=512,
                group_rows=1000, id_col="row_id", by=(), seed=None) -> DataFrame:
    """Concatenate the lists of every ``group_rows`` consecutive rows, cut into
    ``chunk_size``; the remainder is dropped unless it is the group's only chunk.
    Rows stand in the order of their ids or, with a ``seed``, in a random one.

    ``labels`` = ``input_ids``; ``row_ids`` tells the source row of every
    element, so that equal word ids of neighbouring rows stay apart.  Rows move
    as whole slices, one per chunk they touch; nothing is exploded to tokens.
    """
    by = list(by)
    main = cols[0]
    rows = global_index(df.select(id_col, *by, *cols), id_col, by, seed, "_idx")
    rows = rows.withColumn("pack_group", div(F.col("_idx"), group_rows)).withColumn("_n", F.size(main))
    group = [*by, "pack_group"]
    before = W.partitionBy(*group).orderBy("_idx").rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(W.partitionBy(*group)))
        .where(F.col("_n") > 0)
    )
    first = div(F.col("_off"), chunk_size)
    last = div(F.col("_off") + F.col("_n") - 1, chunk_size)
    parts = rows.withColumn("chunk", F.explode(F.sequence(first, last))).where(
        (F.col("_total") < chunk_size) | ((F.col("chunk") + 1) * chunk_size <= F.col("_total"))
    )
    start = F.greatest(F.col("chunk") * chunk_size - F.col("_off"), F.lit(0))
    stop = F.least((F.col("chunk") + 1) * chunk_size - F.col("_off"), F.col("_n").cast("bigint"))

    def cut(c):
        return F.slice(c, (start + 1).cast("int"), (stop - start).cast("int")).alias(c)

    parts = parts.select(
        *group, "chunk", "_idx",
        *[cut(c) for c in cols],
        F.array_repeat(F.col(id_col), (stop - start).cast("int")).alias("row_ids"),
    )
    packed = parts.groupBy(*group, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("_idx", *cols, "row_ids"))).alias("_l")
    )
    return packed.select(
        *group, "chunk",
        *[F.flatten(F.col(f"_l.{c}")).alias(c) for c in cols],
        F.flatten(F.col("_l.row_ids")).alias("row_ids"),
        F.flatten(F.col(f"_l.{main}")).alias("labels"),
    )
