"""The dataflows over training, validation and test rows.

What trains is filtered, balanced and cut to its size; validation and test rows are
only sampled, where a limit is given.  Rows of other languages, of other splits or
without either are left out; null texts and token lists are empty ones.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions import text as X
from duolex.functions.arrays import div
from duolex.operators import encode as E
from duolex.operators.filters import keyword_predicate
from duolex.operators.index import first_k, global_index
from duolex.operators.labels import align_labels, shift_labels
from duolex.operators.masking import whole_word_mask
from duolex.operators.merges import learn_merges
from duolex.operators.pack import pack_chunks
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.session import materialise
from duolex.sources.corpora import SPLITS


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary and, where words are cut by learned merges, these."""

    vocab: DataFrame
    merges: DataFrame | None = None

    def encode(self, rows: DataFrame, max_length=None, pad_length=None) -> DataFrame:
        if self.merges is None:
            out = E.encode(rows, self.vocab, max_length=max_length)
        else:
            out = E.encode_learned(rows, None, self.vocab, max_length=max_length, merges=self.merges)
        return E.pad_encoded(out, "max" if pad_length else None, pad_length)


def train_tokenizer(rows: DataFrame, size: int, langs, n_merges=None) -> Tokenizer:
    """Pieces of the texts' words; with ``n_merges`` the words are cut by as many learned merges."""
    counts = word_counts(rows)
    if not n_merges:
        return Tokenizer(materialise(learn_vocab(counts, size, langs), "vocab"))
    merges, segments = learn_merges(counts, n_merges)
    return Tokenizer(materialise(learn_vocab(segments, size, langs), "vocab"), materialise(merges, "merges"))


def _known(corpus, langs):
    return corpus.where(F.col("lang").isin(*langs) & F.col("split").isin(*SPLITS))


def _training(corpus):
    return corpus.where(F.col("split") == "train")


def select_splits(corpus: DataFrame, langs, keywords=None, mode="any", strip_prefix=False, balance=True,
                  train_limit=None, held_limit=None, col="text", id_col="row_id", seed=0) -> DataFrame:
    """The rows that go into a dataflow.

    ``keywords`` maps languages to the keywords of which a training row must hold one
    (``mode='first'``: the first one).  ``strip_prefix`` takes the repository off the
    training texts.  ``balance`` cuts the languages' training rows to the smallest of them
    (to none if a language has none).  ``train_limit`` and ``held_limit`` are rows per
    language and split, an error where there are fewer.  Balance and limits are one
    seeded choice by ``id_col``, unique in split and language.
    """
    rows, train = _known(corpus, langs), F.col("split") == "train"
    for lang, words in (keywords or {}).items():
        hit = F.coalesce(keyword_predicate(rows, col, words, mode), F.lit(False))
        rows = rows.where(~train | (F.col("lang") != lang) | hit)
    if strip_prefix:
        rows = rows.withColumn(col, F.when(train, X.after_separator(F.col(col), "|")).otherwise(F.col(col)))
    if not (balance or train_limit or held_limit):
        return rows

    def limits(sizes):
        split = W.partitionBy("split")
        even = F.when(F.count(F.lit(1)).over(split) == len(langs), F.min("n").over(split)).otherwise(F.lit(0))
        sizes = sizes.withColumn("k", F.when(train & F.lit(balance), even).otherwise(F.col("n")))
        limit = F.when(train, F.lit(train_limit or None)).otherwise(F.lit(held_limit or None)).cast("bigint")
        short = F.format_string("%s rows of %s are %s, fewer than the limit", "split", "lang", F.col("k").cast("string"))
        cut = F.when(F.col("k") >= limit, limit).otherwise(F.raise_error(short).cast("bigint"))
        return sizes.select("split", "lang", F.when(limit.isNull(), F.col("k")).otherwise(cut).alias("k"))

    return first_k(rows, limits, ["split", "lang"], id_col, seed)


def masked_language_splits(corpus: DataFrame, langs, vocab_size=30_000, n_merges=None, chunk_size=512, max_length=None,
                           group_rows=1000, p=0.15, seed=0, **selection) -> DataFrame:
    """learn on all training rows -> select -> encode -> shuffle and pack -> mask, split by split.

    Training rows are packed as they are (``max_length`` cuts them before); validation and
    test rows are padded to ``chunk_size`` first, so that short ones fill a chunk each.
    Packing order is random inside a split.  (split, pack_group, chunk, input_ids, attention_mask,
    word_ids, row_ids, labels); ``selection`` goes to ``select_splits``.
    """
    tokenizer = train_tokenizer(_training(_known(corpus, langs)), vocab_size, langs, n_merges)
    rows = materialise(select_splits(corpus, langs, seed=seed, **selection).select("row_id", "lang", "split", "text"), "selected")
    encoded = tokenizer.encode(_training(rows), max_length).unionByName(
        tokenizer.encode(rows.where(F.col("split") != "train"), pad_length=chunk_size)
    )
    packed = pack_chunks(materialise(encoded.drop("text", "lang"), "encoded"), chunk_size=chunk_size,
                         group_rows=group_rows, by=["split"], seed=seed)
    return whole_word_mask(packed, ["split", "pack_group", "chunk"], p, seed, "row_ids")


def tagging_data(corpus: DataFrame, langs, vocab: DataFrame, chunk_size=512, shift=False, seed=0, **selection) -> DataFrame:
    """select -> encode (tokens, tags) -> align -> random position in the split.

    Rows of all languages are mixed; ``position`` runs from 0 in each split.  ``shift`` makes tag 2
    a 3 before, as a second corpus needs it whose tags are numbered otherwise.
    (row_id, lang, split, position, input_ids, attention_mask, labels).
    """
    chosen = select_splits(corpus, langs, col="tokens", seed=seed, **selection).select("row_id", "lang", "split", "tokens", "tags")
    chosen = chosen.withColumn("tags", F.coalesce("tags", F.array().cast(corpus.schema["tags"].dataType)))
    rows = materialise(shift_labels(chosen) if shift else chosen, "selected")
    encoded = align_labels(E.encode_pretokenized(rows, vocab, max_length=chunk_size))
    return global_index(
        encoded.select("row_id", "lang", "split", "input_ids", "attention_mask", "labels"), "row_id", ["split"], seed, "position"
    )


def fine_tuning_data(pairs: DataFrame, langs, vocab: DataFrame, src="src", tgt="tgt", id_col="pair_id", keywords=None,
                     chunk_size=512, batch_rows=1000) -> DataFrame:
    """filter -> batches in id order -> encode both sides -> pad to the longest of the batch.

    ``langs`` names source and target language; ``keywords`` of which a training row's target must
    hold one.  (split, batch_id, id, lang_id, input_ids, attention_mask, labels), batches counted
    in each split; labels ignore their padding.
    """
    rows = pairs.where(F.col("split").isin(*SPLITS)).select(id_col, "split", src, tgt)
    if keywords:
        rows = rows.where((F.col("split") != "train") | F.coalesce(keyword_predicate(rows, tgt, keywords), F.lit(False)))
    rows = global_index(rows, id_col, ["split"], out="_i")
    rows = rows.select(
        id_col, "split", F.col(src).alias("text"), F.col(tgt).alias("labels"), F.lit(langs[0]).alias("lang"),
        F.struct("split", div(F.col("_i"), batch_rows).alias("n")).alias("batch_id"),
    )
    out = E.encode_pairs(rows, vocab, langs, max_length=chunk_size, padding="longest", id_col=id_col)
    return out.select("split", F.col("batch_id.n").alias("batch_id"), id_col, "lang_id", "input_ids", "attention_mask", "labels")
