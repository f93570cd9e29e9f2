"""Putting corpora together."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions.arrays import div
from duolex.operators.index import global_index
from duolex.operators.sampling import seeded_shuffle


def union_corpora(dfs, id_col="row_id", seed=None) -> DataFrame:
    """Bag union, shuffled when a seed is given."""
    out = reduce(lambda a, b: a.unionByName(b), dfs)
    return out if seed is None else seeded_shuffle(out, id_col, seed)


def _positional(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Join on position; unequal lengths raise."""
    right = b.withColumn("_r", F.lit(True))
    both = a.withColumn("_l", F.lit(True)).join(right, on, "full")
    checked = F.when(F.col("_l") & F.col("_r"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("sides differ in length at position "), F.col(on).cast("string"))).cast("boolean")
    )
    return both.where(checked).drop("_l", "_r")


def zip_parallel(a: DataFrame, b: DataFrame, on="row_index") -> DataFrame:
    """i-th row of ``a`` with i-th row of ``b``; b's text and lang become
    ``labels`` and ``labels_lang``."""
    return _positional(
        a, b.select(on, F.col("text").alias("labels"), F.col("lang").alias("labels_lang")), on
    )


def hconcat_columns(a: DataFrame, b: DataFrame, on="row_index") -> DataFrame:
    return _positional(a, b, on)


def interleave_batches(
    df: DataFrame, langs, batch_size: int, id_col="row_id",
    shuffle_batches=False, shuffle_slots=False, seed=0,
) -> DataFrame:
    """One-language batches that alternate between the corpora.

    Adds ``batch_id`` and ``slot``.  With k the row's position in its corpus and
    D corpora: batch ``(k div size) * D + d``, slot ``k mod size``; rows beyond
    the last full batch of the shortest corpus are dropped.
    """
    number = F.create_map(*[x for d, l in enumerate(langs) for x in (F.lit(l), F.lit(d))])

    def full_batches(sizes):
        everything = W.partitionBy(F.lit(0))
        shortest = F.when(F.count(F.lit(1)).over(everything) == len(langs), F.min("n").over(everything)).otherwise(0)
        return sizes.select("lang", (div(shortest, batch_size) * batch_size).alias("k"))

    out = (
        global_index(df.where(F.col("lang").isin(*langs)), id_col, ["lang"], out="_idx", limits=full_batches)
        .withColumn("_d", F.try_element_at(number, F.col("lang")).cast("bigint"))
        .withColumn("batch_id", div(F.col("_idx"), batch_size) * len(langs) + F.col("_d"))
        .withColumn("slot", (F.col("_idx") % batch_size).cast("int"))
        .drop("_idx", "_d")
    )
    if shuffle_batches:
        out = _reorder_batches(out, seed)
    if shuffle_slots:
        order = slot_order(batch_size, seed)
        table = F.array(*[F.lit(s) for s in order])
        out = out.withColumn("slot", table[F.col("slot")])
    return out


def _reorder_batches(df: DataFrame, seed) -> DataFrame:
    """Replace batch ids by their rank under a seeded order."""
    ids = global_index(df.select("batch_id").distinct(), "batch_id", seed=seed, out="_new")
    return (
        df.join(ids, "batch_id").drop("batch_id").withColumnRenamed("_new", "batch_id")
    )


def slot_order(batch_size: int, seed) -> list[int]:
    """One permutation of the slots, applied to every batch alike: element s is
    the new slot of old slot s."""
    import hashlib

    order = sorted(range(batch_size), key=lambda s: (hashlib.md5(f"{seed}|slot|{s}".encode()).hexdigest()[:8], s))
    new = [0] * batch_size
    for rank, s in enumerate(order):
        new[s] = rank
    return new


def train_from_valid(df: DataFrame) -> DataFrame:
    """Use the validation rows as training rows."""
    return df.where(F.col("split") == "valid").withColumn("split", F.lit("train"))
