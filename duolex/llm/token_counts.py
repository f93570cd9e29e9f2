"""Token counts without token ids.

A text is cut where a single space stands between two characters that are no
white space; no byte-level merge crosses such a cut.  Every distinct pre-token is
encoded once.  The most frequent ones (a bounded table) are looked up where the
documents are read; the others leave per-document frequencies, which are joined
with their piece counts and added up.
"""

import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.session import materialise

ODD_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
CUT = re.compile(r"(?<=\S)(?= \S)")


def pre_tokens(text):
    """Pre-tokens of a text; those that begin with one space are given without
    it, all others after a line feed."""
    if ODD_SPACE.search(text) is None:
        head, *rest = text.split(" ")
        rest.append("\n" + head)
        return rest
    return [p[1:] if p[0] == " " and p[1:2].strip() else "\n" + p for p in CUT.split(text)]


def surface(pre_token):
    return pre_token[1:] if pre_token.startswith("\n") else " " + pre_token


def count_pre_tokens(texts: DataFrame, distinct_limit=1 << 20) -> DataFrame:
    """(pre_token, n): frequencies over all texts, added up per task first."""

    def run(batches):
        def flushed(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pre_token", "n"])

        counts = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(pre_tokens(text))
                if len(counts) > distinct_limit:
                    yield flushed(counts)
                    counts = Counter()
        yield flushed(counts)

    return texts.mapInArrow(run, "pre_token string, n bigint").groupBy("pre_token").agg(F.sum("n").alias("n"))


def count_pieces(pre_tokens_: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``pieces``: the library's number of tokens for each pre-token."""
    spec = pre_tokens_.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(spec.value)
        encoder.no_truncation()
        encoder.no_padding()
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                encoded = encoder.encode_batch([surface(p) for p in part.column("pre_token").to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(e) for e in encoded], pa.int64())], names=[*part.schema.names, "pieces"])

    return pre_tokens_.mapInArrow(run, pre_tokens_.select("*").schema.add("pieces", "long"))


def head_bound(pieces: DataFrame, max_head: int) -> int:
    """The least frequency that at most ``max_head`` pre-tokens reach."""
    octave = F.floor(F.log2("n") * 8).cast("int")
    rows = pieces.groupBy(octave.alias("o")).agg(F.count("*").alias("c"), F.min("n").alias("n")).collect()  # 512 at most
    bound, total = 1 << 62, 0
    for row in sorted(rows, reverse=True):
        total += row["c"]
        if total > max_head:
            break
        bound = row["n"]
    return bound


def count_tokens(docs: DataFrame, tokenizer_path: str, *, key="doc_id", text="text", limit=1024, max_head=1 << 18) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_tokens, over_limit).

    ``tokenizer_path``: a ``tokenizers`` file with byte-level pieces.  Begin and
    end tokens are not added; strings of added tokens in a text count as the
    library treats them by default.  Null texts count as empty, with no tokens;
    repeated rows are reported each; an empty table gives an empty result.
    ``max_head`` bounds the broadcast table of frequent pre-tokens; all others
    are joined by shuffle.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    spark = docs.sparkSession
    pieces = materialise(count_pieces(count_pre_tokens(docs.select(F.col(text).alias("text"))), tokenizer), "pre-tokens")
    bound = head_bound(pieces, max_head)
    head_rows = pieces.where(F.col("n") >= bound).select("pre_token", "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(head_rows.column(0).to_pylist(), head_rows.column(1).to_pylist())))

    narrow = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row_"), F.col(text).alias("text"))
    schema = narrow.select("doc_id", "row_").schema.add("n_bytes", "long").add("known", "long").add("rare", "string").add("n", "long")
    id_type = narrow.schema["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        known = head.value
        get = known.get
        kind = to_arrow_type(id_type)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            n_bytes, sums, rare, rare_row, rare_n = [], [], [], [], []
            for row, value in zip(rows, batch.column(2).to_pylist()):
                value = value or ""
                n_bytes.append(len(value.encode()))
                parts = pre_tokens(value) if value else []
                found = list(map(get, parts))
                if None in found:
                    others = Counter(p for p, c in zip(parts, found) if c is None)
                    rare += others
                    rare_n += others.values()
                    rare_row += [row] * len(others)
                    found = [c for c in found if c is not None]
                sums.append(sum(found))
            none = pa.nulls(len(rows), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), none, pa.nulls(len(rows), pa.int64())],
                names=schema.names)
            if rare:
                gap = pa.nulls(len(rare), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(rare), kind), pa.array(rare_row, pa.int64()), gap, gap, pa.array(rare, pa.string()), pa.array(rare_n, pa.int64())],
                    names=schema.names)

    # a document's own row must not meet all others under one null key
    joined = F.coalesce(F.concat(F.lit("t"), F.col("rare")), F.concat(F.lit("d"), F.col("row_").cast("string")))
    parts = narrow.mapInArrow(run, schema).withColumn("k_", joined)
    counts = pieces.where(F.col("n") < bound).select(F.concat(F.lit("t"), F.col("pre_token")).alias("k_"), "pieces")
    summed = (
        parts.join(counts, "k_", "left")
        .groupBy("row_")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
             (F.coalesce(F.sum("known"), F.lit(0)) + F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0))).alias("n_tokens"))
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
