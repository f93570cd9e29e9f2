"""Exact row positions without a single-partition sort.

A monotone bucket of the sort key splits the rows evenly; a row's position is
the number of rows in earlier buckets plus its rank inside its own bucket.  A hashed
key is even by itself; ids are cut at quantiles, be they dense, sparse, hashed or negative.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions.arrays import div
from duolex.functions.rng import hash32
from duolex.session import materialise, small_side

HASH_BITS = 16  # buckets per group under a hashed order: 2**16
BUCKET_ROWS = 100_000  # rows per bucket under file order
MOST_BUCKETS = 1 << 14


def id_bounds(ids: DataFrame, id_col: str, bucket_rows=None) -> list:
    """Ascending values that cut the ids into buckets of about ``bucket_rows`` rows
    (larger ones beyond ``MOST_BUCKETS``): quantiles from a sketch, whose size follows the number
    of buckets."""
    bucket_rows, rows = bucket_rows or BUCKET_ROWS, ids.count()
    busy = min(ids.sparkSession.sparkContext.defaultParallelism, rows // 1000 + 1)  # smaller inputs fill the cores
    n = max(min(rows // bucket_rows + 1, MOST_BUCKETS), busy)
    if n == 1:
        return []
    shares = F.lit([k / n for k in range(1, n)])
    return sorted(set(ids.agg(F.percentile_approx(id_col, shares, 10 * n).alias("q")).first()["q"] or []))


def bucket_of(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by bisection; 0 for null."""
    if not bounds:
        return F.lit(0).cast("bigint")
    size = 1 << len(bounds).bit_length()
    table, steps = F.lit(bounds), F.lit([size >> k for k in range(1, size.bit_length())])
    # beyond the table ``get`` is null, which leaves the place as it is
    at = F.aggregate(steps, F.lit(0), lambda a, h: F.when(F.get(table, a + h - 1) <= value, a + h).otherwise(a))
    return at.cast("bigint")


def _ordered(df, by, id_col, seed, bounds=()):
    """Add ``_b`` (bucket) and ``_k`` (sort key inside the bucket)."""
    if seed is None:
        return df.withColumn("_k", F.lit(0).cast("bigint")).withColumn("_b", bucket_of(F.col(id_col), bounds))
    return df.withColumn("_k", hash32(seed, id_col)).withColumn(
        "_b", F.shiftright(F.col("_k"), 32 - HASH_BITS)
    )


def bucket_offsets(counts: DataFrame, by) -> DataFrame:
    """(by.., _b, _n) -> adds ``_lo``, the number of rows in earlier buckets.

    Two levels, so that no window sees more than a few thousand buckets.
    """
    c = counts.withColumn("_s", div(F.col("_b"), 4096))
    inner = W.partitionBy(*by, "_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    group = W.partitionBy(*(by or [F.lit(0)])).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    tops = (
        counts.groupBy(*by, div(F.col("_b"), 4096).alias("_s"))
        .agg(F.sum("_n").alias("_t"))
        .withColumn("_up", F.coalesce(F.sum("_t").over(group), F.lit(0)))
        .drop("_t")
    )
    return c.join(tops, [*by, "_s"]).select(*by, "_b", "_n", (F.col("_in") + F.col("_up")).alias("_lo"))


def global_index(df: DataFrame, id_col="row_id", by=(), seed=None, out="idx", limits=None) -> DataFrame:
    """0-based position of every row inside its ``by`` group.

    Order: by ``id_col``, or, with a ``seed``, by (hash of id, id).  ``id_col``
    is a unique BIGINT.  The input is read twice: for the narrow keys, from which
    bounds and bucket counts come, and for the rows, which move once; the join and the window
    share one partitioning.

    ``limits`` maps the group sizes (by.., n) to limits (by.., k): only positions
    below ``k`` are kept, and buckets beyond it are left out before rows move.
    """
    by, bounds = list(by), ()
    keys = df.select(*by, id_col)
    if seed is None:
        keys = materialise(keys, "keys")
        bounds = id_bounds(keys, id_col)
    counts = materialise(
        _ordered(keys, by, id_col, seed, bounds).groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")), "counts"
    )
    offsets = bucket_offsets(counts, by).drop("_n")
    if limits is not None:
        k = limits(counts.groupBy(*by).agg(F.sum("_n").alias("n"))).withColumnRenamed("k", "_limit")
        offsets = offsets.join(k, by).where(F.col("_lo") < F.col("_limit"))
    # as a table of known size it is broadcast while small; else the join shuffles
    # by the window's keys and nothing moves twice
    offsets = materialise(offsets, "offsets")
    rank = W.partitionBy(*by, "_b").orderBy("_k", id_col)
    ranked = (
        _ordered(df, by, id_col, seed, bounds).join(offsets, [*by, "_b"])
        .withColumn(out, F.col("_lo") + F.row_number().over(rank) - 1)
    )
    if limits is not None:
        ranked = ranked.where(F.col(out) < F.col("_limit"))
    return ranked.select(*df.columns, out)


def mark_first_k(df: DataFrame, limits, by, id_col, seed, out="in_sample") -> DataFrame:
    """Add a boolean: is the row's seeded position in its ``by`` group below the
    group's ``k``?

    ``limits`` maps the group sizes (by.., n) to the limits (by.., k).  The input
    is read twice, whatever it costs to compute: once to write its narrow keys
    (group, id, hash), once for the result.  Of the keys only the bucket that
    holds a group's k-th row is ranked; it yields a cut value per group, and the
    full rows are compared with it without a shuffle.  Groups without a limit
    are dropped.
    """
    by = list(by)
    keys = materialise(_ordered(df.select(*by, id_col), by, id_col, seed), "keys")
    counts = materialise(keys.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")), "counts")
    limits = limits(counts.groupBy(*by).agg(F.sum("_n").alias("n")))
    edge = (
        bucket_offsets(counts, by).join(limits, by)
        .where((F.col("_lo") < F.col("k")) & (F.col("k") <= F.col("_lo") + F.col("_n")))
        .select(*by, "_b", (F.col("k") - F.col("_lo")).alias("_need"))
    )
    rank = W.partitionBy(*by, "_b").orderBy("_k", id_col)
    cut = (
        keys.join(small_side(edge), [*by, "_b"])
        .withColumn("_r", F.row_number().over(rank))
        .where(F.col("_r") == F.col("_need"))
        .select(*by, F.col("_k").alias("_ck"), F.col(id_col).alias("_cid"))
    )
    # a group without an edge bucket is shorter than its limit and kept whole,
    # unless the limit is 0
    bounds = limits.select(*by, "k").join(cut, by, "left")
    inside = (
        F.when(F.col("k") <= 0, F.lit(False))
        .when(F.col("_ck").isNull(), F.lit(True))
        .otherwise(
            (F.col("_k") < F.col("_ck"))
            | ((F.col("_k") == F.col("_ck")) & (F.col(id_col) <= F.col("_cid")))
        )
    )
    return (
        _ordered(df, by, id_col, seed).join(small_side(bounds), by)
        .select(*df.columns, inside.alias(out))
    )


def first_k(df: DataFrame, limits, by, id_col, seed) -> DataFrame:
    """The rows that ``mark_first_k`` marks."""
    return mark_first_k(df, limits, by, id_col, seed, "_in").where("_in").drop("_in")


def top_k(df: DataFrame, by, order, tie, k: int, out="rank", salts=None) -> DataFrame:
    """The ``k`` first rows per group under ``order`` then ``tie`` (unique in the
    group), numbered from 1.

    Without groups every task keeps its best k.  A large group is ranked in
    ``salts`` parts first, as many as a shuffle has tasks; only their best k meet.
    """
    by = list(by)
    whole = W.partitionBy(*(by or [F.lit(0)])).orderBy(order, tie)
    if not by:
        return df.orderBy(order, tie).limit(k).withColumn(out, F.row_number().over(whole))
    if salts is None:
        salts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = W.partitionBy(*by, "_salt").orderBy(order, tie)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
        .withColumn(out, F.row_number().over(part)).where(F.col(out) <= k).drop("_salt")
        .withColumn(out, F.row_number().over(whole)).where(F.col(out) <= k)
    )
