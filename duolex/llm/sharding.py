"""Sharding by extendible hashing.

Documents are addressed by the leading bits of a 60-bit hash of their id.  A
bucket that exceeds the byte limit splits on one more bit, and only that one;
the directory maps a fixed number of leading bits to the buckets below them.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.llm.mixing import HASH_BITS, key_hash
from duolex.session import materialise, small_side

STEP_BITS = 10


def bucket_leaves(sized: DataFrame, limit: int) -> DataFrame:
    """(h, n_bytes) to the buckets (lo, depth, shard_bytes, shard_docs).

    One pass adds up cells of ten bits and rolls them up to every depth; the
    next pass reads only the cells that are still too large.  A bucket of one
    document, or of one hash, cannot split.
    """
    closed, base, cells = None, 0, None
    while True:
        deep = min(base + STEP_BITS, HASH_BITS)
        inside = sized
        if cells is not None:
            inside = sized.join(small_side(cells.select(F.col("cell").alias("c"))),
                                F.shiftright("h", HASH_BITS - base) == F.col("c"), "left_semi")
        sums = materialise(
            inside.groupBy(F.shiftright("h", HASH_BITS - deep).alias("cell")).agg(
                F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1")),
            "shard-cells",
        )
        depths = F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")
        nodes = (
            sums.select("*", depths)
            .groupBy("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix"))
            .agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
            .where((F.col("b") <= limit) | (F.col("h0") == F.col("h1")))
        )
        # a cell belongs to the shallowest node above it that fits
        leaf = (
            sums.select("cell", depths)
            .withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
            .join(nodes, ["depth", "prefix"])
            .groupBy("cell").agg(F.min(F.struct("depth", "prefix", "b", "n")).alias("leaf"))
        )
        found = leaf.select(
            F.expr(f"shiftleft(leaf.prefix, {HASH_BITS} - leaf.depth)").alias("lo"), "leaf.depth",
            F.col("leaf.b").alias("shard_bytes"), F.col("leaf.n").alias("shard_docs")).distinct()
        closed = found if closed is None else closed.unionByName(found)
        cells = sums.join(leaf, "cell", "left_anti")
        base = deep
        if cells.isEmpty():
            return materialise(closed, "shard-leaves")


def shard_by_bytes(docs: DataFrame, *, limit=8 << 20, key="doc_id", text="text", seed=13) -> DataFrame:
    """All columns of ``docs`` plus ``n_bytes, shard, shard_depth, shard_bytes,
    shard_docs, oversize`` (columns of these names are replaced).

    ``shard`` spells the bits of the bucket; one bucket for all is ``''``.  Null
    text has no bytes, a null id hashes like the empty string.  Rows that share
    an id (repeated rows) share a shard.  A bucket above ``limit`` remains only
    where all its rows share one id; ``oversize`` marks it.  An empty table
    gives an empty result.
    """
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    sized = materialise(docs.select(key_hash(key, seed).alias("h"), n_bytes.alias("n_bytes")), "shard-sized")
    leaves = bucket_leaves(sized, limit)
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(max(math.ceil(math.log2(total / limit + 1)) + 1, 1), 20)
    # directory: 2**bits entries, each with the buckets at or below it
    first, last = F.shiftright("lo", HASH_BITS - bits), F.expr(f"shiftright(lo + shiftleft(1L, {HASH_BITS} - depth) - 1, {HASH_BITS - bits})")
    directory = (
        leaves.select("*", F.explode(F.sequence(first, last)).alias("entry"))
        .groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("lo", "depth", "shard_bytes", "shard_docs"))).alias("buckets"))
    )
    own = ["n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs", "oversize"]
    bucket = F.element_at(F.filter("buckets_", lambda b: b["lo"] <= F.col("h_")), -1)
    kept = [F.col("row_").getField(c).alias(c) for c in docs.columns if c not in own]
    name = F.when(F.col("b_.depth") == 0, F.lit("")).otherwise(
        F.lpad(F.bin(F.expr(f"shiftright(b_.lo, {HASH_BITS} - b_.depth)")), F.col("b_.depth").cast("int"), F.lit("0")))
    return (
        docs.select(F.struct(*docs.columns).alias("row_"), key_hash(key, seed).alias("h_"), n_bytes.alias("n_bytes"))
        .join(small_side(directory.select(F.col("entry").alias("entry_"), F.col("buckets").alias("buckets_"))),
              F.shiftright("h_", HASH_BITS - bits) == F.col("entry_"))
        .withColumn("b_", bucket)
        .select(*kept, "n_bytes", name.alias("shard"), F.col("b_.depth").alias("shard_depth"), F.col("b_.shard_bytes").alias("shard_bytes"),
                F.col("b_.shard_docs").alias("shard_docs"), (F.col("b_.shard_bytes") > limit).alias("oversize"))
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder per shard.  Rows of a shard meet in one task, which its
    byte limit bounds."""
    shard_by_bytes(docs, **options).repartition("shard").write.partitionBy("shard").parquet(path)


SHARD_SQL = """
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, CAST('0x' || substr(md5('13|' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
nodes AS (
  SELECT doc_id, n_bytes, d, h >> (60 - d) AS prefix, sum(n_bytes) OVER w AS b, count(*) OVER w AS n, min(h) OVER w AS h0, max(h) OVER w AS h1
  FROM sized, range(0, 61) t(d) WINDOW w AS (PARTITION BY d, h >> (60 - d))),
leaf AS (
  SELECT doc_id, n_bytes, min(d) AS d, arg_min(prefix, d) AS prefix, arg_min(b, d) AS b, arg_min(n, d) AS n
  FROM nodes WHERE b <= 8388608 OR h0 = h1 GROUP BY doc_id, n_bytes)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(prefix), d::INT, '0') END AS shard, d::INT AS shard_depth,
       b::BIGINT AS shard_bytes, n::BIGINT AS shard_docs, b > 8388608 AS oversize
FROM leaf
"""
