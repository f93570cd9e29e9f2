"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id.  A source that owes a part of
an epoch takes the documents whose hash lies below one threshold, so smaller
budgets are nested in larger ones and nothing is sorted.  The threshold is found
from sums of sizes per (source, hash bucket); only the bucket on the boundary is
split again, 12 bits at a time, until it holds one document.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duolex.session import materialise, small_side

HASH_BITS = 60
STEP_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words of a text, null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def key_hash(key, seed):
    """60 bits of md5 over seed and key as a BIGINT; a null key hashes like the empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights, budget, max_repeat) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights repeat over the sources in code point order, null last.  A target
    stops at ``max_repeat`` times its source's size; what is cut off goes to the
    others by weight until none is above.  One row per source: the windows here
    see the list of sources, never documents.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("w", weight.cast("double"))
        .withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    )
    # the source whose cap is reached first comes first; before it: what is already shared out
    filling = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    rows = (
        rows.withColumn("pos", F.row_number().over(filling))
        .withColumn("left", total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open_w"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("first", F.min(F.when(F.col("fits"), F.col("pos"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("pos") == F.col("first"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("pos") >= F.col("first"), F.col("w") * F.col("level")).otherwise(F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def hash_thresholds(sized: DataFrame, owed: DataFrame) -> DataFrame:
    """``owed``: (source, part), the size to take from a source, less than all of it.
    Returns (source, threshold): taking ``h < threshold`` comes nearest to it."""
    spark = sized.sparkSession
    # [lo, lo + 2**shift) holds the boundary; base: the size below lo
    edge = owed.select("source", "part", F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("base"))
    done = None
    shift = HASH_BITS
    while shift:
        inside = sized.join(
            small_side(edge.select(F.col("source").alias("s"), "lo")),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.shiftright("lo", shift)),
        )
        shift -= STEP_BITS
        bucket = F.shiftleft(F.shiftright("h", shift), shift)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        running = Window.partitionBy("source").orderBy("bucket")  # 2**12 rows per source at most
        crossing = (
            sums.withColumn("upto", F.sum("size").over(running))
            .join(small_side(edge.select(F.col("source").alias("s"), "part", "base")), F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("base") + F.col("upto") > F.col("part"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "size", "n", "part", "base")).alias("c"))
            .select("source", "c.part", F.col("c.bucket").alias("lo"),
                    (F.col("c.base") + F.col("c.upto") - F.col("c.size")).alias("base"), "c.size", "c.n")
        )
        crossing = materialise(crossing, "mix-edge")
        final = (F.col("n") <= 1) | F.lit(shift == 0)
        # the last document (or the documents of one hash) goes in if that is nearer
        taken = F.col("part") - F.col("base") >= F.col("size") / 2
        ended = crossing.where(final).select(
            "source", (F.col("lo") + F.when(taken & (F.col("part") > 0), F.lit(1 << shift)).otherwise(F.lit(0))).alias("threshold")
        )
        done = ended if done is None else done.unionByName(ended)
        edge = crossing.where(~final).select("source", "part", "lo", "base")
        if edge.isEmpty():
            break
    return done


def mix_plan(sized: DataFrame, *, weights=(5, 2, 1), budget=1.0, max_repeat=3) -> DataFrame:
    """(source, size, h) rows to one row per source: (s_, source_size_, target_,
    epochs_, threshold_).  Every document is taken ``epochs_`` times, those below
    the threshold once more."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, max_repeat)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets = targets.withColumn("epochs", epochs).withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = materialise(targets, "mix-targets")
    cuts = hash_thresholds(sized, targets.where("part > 0").select("source", "part"))
    return targets.join(cuts.select(F.col("source").alias("s"), "threshold"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s_"), F.col("source_size").alias("source_size_"), F.col("target").alias("target_"),
        F.col("epochs").alias("epochs_"), F.coalesce("threshold", F.lit(0)).alias("threshold_"))


def copies_of_row():
    return F.col("epochs_") + F.when(F.col("h_") < F.col("threshold_"), F.lit(1)).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, *, key="doc_id", source="source", size=None, seed=11, **options) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, copies, taken).

    ``size`` is a column, default the number of words of ``text``.  ``copies``
    says how often the mix takes the document, ``taken`` is ``copies * size``.
    Null text has size 0; null sources form one source, last in order; a source
    without words gets target 0 and no copies; rows that share an id go the same
    way together; an empty table gives an empty result.  Other columns of
    ``docs`` do not matter.
    """
    size = word_count("text") if size is None else size
    sized = materialise(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key_hash(key, seed).alias("h")),
        "mix-sized",
    )
    return (
        sized.withColumnRenamed("h", "h_").join(small_side(mix_plan(sized, **options)), F.col("source").eqNullSafe(F.col("s_")))
        .withColumn("copies", copies_of_row())
        .select("doc_id", "source", "size", F.col("source_size_").alias("source_size"), F.col("target_").alias("target"), "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix_documents(docs: DataFrame, *, key="doc_id", source="source", size=None, seed=11, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.  Texts
    stay in their partition, as the decision needs only a row's id and source."""
    size = word_count("text") if size is None else size
    sized = materialise(docs.select(F.col(source).alias("source"), size.alias("size"), key_hash(key, seed).alias("h")), "mix-sized")
    names = docs.columns
    return (
        docs.select(F.struct(*names).alias("row_"), F.col(source).alias("source_"), key_hash(key, seed).alias("h_"))
        .join(small_side(mix_plan(sized, **options)), F.col("source_").eqNullSafe(F.col("s_")))
        .select("row_", F.explode(F.array_repeat(F.lit(1), copies_of_row().cast("int"))))
        .select(*[F.col("row_").getField(n).alias(n) for n in names])
    )


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('11|' || doc_id), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         (source_size * 3)::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s0),
s2 AS (
  SELECT *, row_number() OVER f AS pos, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER e, 0) AS left_,
         sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS open_w
  FROM s1 WINDOW f AS (ORDER BY cap / w, rk), e AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT min(pos) AS first_, arg_min(left_ / open_w, pos) AS level_ FROM s2 WHERE left_ / open_w * w <= cap),
s4 AS (SELECT source, source_size, CASE WHEN pos >= first_ THEN w * level_ ELSE cap END AS target FROM s2, s3),
s5 AS (
  SELECT *, floor(target / source_size)::BIGINT AS epochs, target - floor(target / source_size)::BIGINT * source_size AS part
  FROM s4 WHERE source_size > 0),
r AS (
  SELECT doc_id, sized.source, size, source_size, target, epochs, part,
         sum(size) OVER (PARTITION BY sized.source ORDER BY h) AS upto
  FROM sized JOIN s5 ON sized.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN part > 0 AND (upto <= part OR part - (upto - size) >= size / 2 AND upto - size <= part)
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
