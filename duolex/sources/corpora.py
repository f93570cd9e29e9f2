"""Corpus readers.

File names: ``{lang}.mono.train.{fmt}``, ``{lang}.para.valid.{fmt}`` and
``{lang}.para.test.{fmt}``; tagged corpora put ``aer.`` before the format.
"""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.schemas import FREQUENCY_CSV, TAGGED_JSON, TEXT_JSON, pair_json
from duolex.session import materialise, small_side

SPLITS = {"train": "mono.train", "valid": "para.valid", "test": "para.test"}


def corpus_path(root: str, lang: str, split: str, fmt: str, tagged=False) -> str:
    return os.path.join(root, f"{lang}.{SPLITS[split]}.{'aer.' if tagged else ''}{fmt}")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tag(df, lang, split):
    return df.withColumn("lang", F.lit(lang)).withColumn("split", F.lit(split))


def _with_blocks(df):
    """Add the file block a row was read from, and its place in reading order."""
    return df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _number(lines: DataFrame, out: str) -> DataFrame:
    """0-based numbers over all rows of ``_with_blocks``, file by file.

    The rows are written once with their block, as another scan may cut the files
    in other places.  A row's place in its block is the distance to the block's
    first row; a prefix sum over the blocks' row counts makes it global.
    """
    block = ["_file", "_start"]
    lines = materialise(lines, "lines")
    counts = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = W.partitionBy(F.lit(0)).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lo"))
    return (
        lines.join(small_side(offsets), block)
        .withColumn(out, F.col("_lo") + F.col("_seq") - F.col("_first"))
        .drop("_file", "_start", "_seq", "_first", "_lo")
    )


def numbered_lines(df: DataFrame, out="row_index") -> DataFrame:
    """Add the 0-based line number over all files of a file reader."""
    return _number(_with_blocks(df), out)


def _load(parts, row_id):
    """Union of (reader, lang, split), numbered when ``row_id`` names a column."""
    if row_id is None:
        return _union([_tag(df, lang, split) for df, lang, split in parts])
    return _number(_union([_tag(_with_blocks(df), lang, split) for df, lang, split in parts]), row_id)


def load_text_corpus(spark: SparkSession, root: str, langs, fmt="tok", splits=tuple(SPLITS), row_id=None) -> DataFrame:
    """(text, lang, split): one row per line; with ``row_id``, numbered over all files."""
    return _load([
        (spark.read.text(corpus_path(root, lang, split, fmt)).withColumnRenamed("value", "text"), lang, split)
        for lang in langs for split in splits
    ], row_id)


def load_parallel_only(spark: SparkSession, root: str, langs) -> DataFrame:
    """Validation and test rows only, always in the ``tok`` format."""
    return load_text_corpus(spark, root, langs, "tok", ("valid", "test"))


def load_json_corpus(spark: SparkSession, root: str, langs, splits=tuple(SPLITS), schema=TEXT_JSON, row_id=None,
                     mode="FAILFAST") -> DataFrame:
    """JSON lines with ``text``; a malformed line is an error, or left out with ``mode='DROPMALFORMED'``."""
    return _load([
        (spark.read.schema(schema).json(corpus_path(root, lang, split, "jsonl"), mode=mode), lang, split)
        for lang in langs for split in splits
    ], row_id)


def load_tagged_corpus(spark: SparkSession, root: str, langs, splits=tuple(SPLITS), row_id=None, mode="FAILFAST") -> DataFrame:
    """JSON lines with ``tokens`` and ``tags``."""
    return _load([
        (spark.read.schema(TAGGED_JSON).json(corpus_path(root, lang, split, "jsonl", True), mode=mode), lang, split)
        for lang in langs for split in splits
    ], row_id)


def load_parallel_text(spark: SparkSession, root: str, lang: str, split: str, fmt="tok") -> DataFrame:
    """(row_index, text, lang, split) with line numbers, ready for positional joins."""
    lines = spark.read.text(corpus_path(root, lang, split, fmt)).withColumnRenamed("value", "text")
    return _tag(numbered_lines(lines), lang, split)


def load_synthetic_pairs(spark: SparkSession, root: str, src: str, tgt: str, mode="FAILFAST") -> DataFrame:
    """(src, tgt, split): synthetic pairs to train on, whose ``generated_{tgt}`` column
    is renamed; validation and test pairs from two text files, line by line."""
    from duolex.operators.combine import hconcat_columns

    raw = pair_json(src, f"generated_{tgt}")
    train = (
        spark.read.schema(raw).json(os.path.join(root, f"{src}.{tgt}.train.synthetic.jsonl"), mode=mode)
        .withColumnRenamed(f"generated_{tgt}", tgt).withColumn("split", F.lit("train"))
    )
    parts = [train]
    for split in ("valid", "test"):
        a, b = (
            load_parallel_text(spark, root, lang, split).select("row_index", F.col("text").alias(lang))
            for lang in (src, tgt)
        )
        parts.append(hconcat_columns(a, b).drop("row_index").withColumn("split", F.lit(split)))
    return _union(parts)


def read_frequency_csv(spark: SparkSession, path: str) -> DataFrame:
    """(lang, token_id, freq, rank) from the ``|``-separated table."""
    return spark.read.schema(FREQUENCY_CSV).csv(path, sep="|", header=True)
