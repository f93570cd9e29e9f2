"""Text to token ids and back.

A learned vocabulary has a fixed size, so a lookup normally ships it to the
tasks as one Arrow array and maps whole batches there: no row leaves its
partition.  A vocabulary that proves larger than ``INLINE_LIMIT`` goes through a
salted join instead.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.functions import text as X
from duolex.operators.index import top_k
from duolex.schemas import BOS, EOS, IGNORE, PAD, UNK, lang_start
from duolex.session import small_batches

INLINE_LIMIT = 1_000_000
HOT_WORDS = 10_000
SALTS = 16
HELD_WORDS = 100_000


def inline_tokens(vocab: DataFrame, limit=None):
    """Tokens in id order as an Arrow array, or None when there are too many.

    Of tokens that share an id the least counts, of ids that share a token the
    first, here and in ``_join_lookup``.
    """
    limit = INLINE_LIMIT if limit is None else limit
    rows = vocab.select("token_id", "token").limit(limit + 1).collect()
    top = max((r.token_id for r in rows), default=-1)
    if len(rows) > limit or top >= 2 * limit:
        return None
    tokens = [None] * (top + 1)
    for r in rows:
        if r.token is not None and (tokens[r.token_id] is None or r.token < tokens[r.token_id]):
            tokens[r.token_id] = r.token
    return pa.array(tokens, pa.string())


def _relist(source: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in the list layout of ``source``."""
    ends = pa.array(pc.cumulative_sum(pc.fill_null(pc.list_value_length(source), 0)), pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, values)


def _to_ids(tokens: pa.Array):
    @F.arrow_udf("array<int>")
    def ids(pieces: pa.Array) -> pa.Array:
        found = pc.index_in(pieces.flatten(), value_set=tokens, skip_nulls=True)
        return _relist(pieces, pc.fill_null(found, UNK).cast(pa.int32()))

    return ids


def _to_tokens(tokens: pa.Array):
    @F.arrow_udf("array<string>")
    def names(ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
        return _relist(ids, tokens.take(pc.if_else(known, flat, pa.scalar(None, flat.type))))

    return names


def _single(vocab: DataFrame, key) -> DataFrame:
    """One value per key, as in the array: the least token of an id, the first id of a token."""
    one = vocab.where("token IS NOT NULL").groupBy("token_id").agg(F.min("token").alias("token"))
    return one.groupBy("token").agg(F.min("token_id").alias("token_id")) if key == "token" else one


def _lists(cells: DataFrame, id_col) -> DataFrame:
    """(id, _l): the values of (id, _p, _v) by place, equal places by value.

    A task sends its cells as they are: gathered before they are sent, all cells of a
    task are sorted and spilled.  A number travels with its place as one number, numbers
    behind their place in one list.
    """
    kind = cells.schema["_v"].dataType.simpleString()
    if kind == "int":
        low = F.lit(1 << 31)
        cell = F.shiftleft(F.col("_p").cast("bigint"), 32).bitwiseOR(F.col("_v").cast("bigint") + low)
        value = lambda c: (c.bitwiseAND(F.lit((1 << 32) - 1)) - low).cast("int")
    elif kind == "array<int>":
        cell, value = F.concat(F.array("_p"), "_v"), lambda c: A.drop_first(c, F.lit(1))
    else:
        cell, value = F.struct("_p", "_v"), lambda c: c["_v"]
    sent = cells.select(id_col, cell.alias("_c")).repartition(id_col)
    return sent.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list("_c")), value).alias("_l"))


def _join_lookup(df, col, out, vocab, id_col, key, value, default):
    """The same lookup as a join: frequent tokens are spread over ``SALTS`` copies
    of the vocabulary."""
    v = _single(vocab, key).select(
        F.col(key).alias("_t"), F.col(value).alias("_v"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    cells = (
        df.select(id_col, F.posexplode(col).alias("_p", "_t"))
        .withColumn("_salt", F.col("_p") % SALTS)
        .join(v, ["_t", "_salt"], "left")
        .select(id_col, "_p", F.coalesce("_v", F.lit(default)).alias("_v"))
    )
    found = _lists(cells, id_col).withColumnRenamed("_l", out)
    empty = F.array().cast(found.schema[out].dataType)
    return df.join(found, id_col, "left").withColumn(out, F.coalesce(F.col(out), empty))


def _called(df: DataFrame, col: str, out: str, call) -> DataFrame:
    """Adds ``out``, the Python function ``call`` of the list column ``col``.

    As the one row of a generator it is settled for the optimizer: filters on other columns
    move below it, down to the scan; filters on it stay above, and are not copied with
    the call into places where Spark 4.1 fails to run calls with nested lambdas.
    """
    return small_batches(df).select("*", F.explode(F.array(call(F.col(col)))).alias(out))


def lookup_ids(df: DataFrame, col: str, out: str, vocab: DataFrame, id_col="row_id", limit=None) -> DataFrame:
    tokens = inline_tokens(vocab, limit)
    if tokens is None:
        return _join_lookup(df, col, out, vocab, id_col, "token", "token_id", UNK)
    return _called(df, col, out, _to_ids(tokens))


def lookup_tokens(df: DataFrame, col: str, out: str, vocab: DataFrame, id_col="row_id", limit=None) -> DataFrame:
    tokens = inline_tokens(vocab, limit)
    if tokens is None:
        return _join_lookup(df, col, out, vocab, id_col, "token_id", "token", None)
    return _called(df, col, out, _to_tokens(tokens))


def _framed(df, pieces: Column, owner: Column, vocab, max_length, id_col, limit=None):
    """Adds input_ids, attention_mask, word_ids for pieces and their word numbers."""
    if max_length is not None:
        pieces, owner = A.take(pieces, F.lit(max_length - 2)), A.take(owner, F.lit(max_length - 2))
    df = df.withColumn("_pieces", pieces).withColumn("_owner", owner).drop("_words")
    return _with_frame(lookup_ids(df, "_pieces", "_ids", vocab, id_col, limit).drop("_pieces"))


def _with_frame(df):
    """input_ids, attention_mask, word_ids for the columns _ids and _owner."""
    none = F.array(F.lit(None).cast("int"))
    df = df.withColumn(
        "input_ids", F.concat(F.array(F.lit(BOS)), F.col("_ids"), F.array(F.lit(EOS)))
    ).withColumn("word_ids", F.concat(none, F.col("_owner"), none))
    df = df.drop("_owner", "_ids")
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def _encode_words(df, words: Column, vocab, max_length, id_col, specials=(), limit=None):
    # a null text is an empty one; a null list would wipe the rows it is packed with
    words = F.coalesce(words, F.array().cast("array<string>"))
    if max_length is not None:  # a word has one piece at least
        words = A.take(words, F.lit(max_length - 2))
    pieces = F.flatten(F.transform(F.col("_words"), lambda w: X.word_pieces(w, specials)))
    owner = F.flatten(
        F.transform(F.col("_words"), lambda w, i: F.array_repeat(i.cast("int"), X.piece_count(w, specials)))
    )
    return _framed(df.withColumn("_words", words), pieces, owner, vocab, max_length, id_col, limit)


def pad_encoded(df: DataFrame, padding, length=None) -> DataFrame:
    """padding: None, 'max' (to ``length``; longer rows stay), or 'longest' (to the
    longest row of the batch, column ``batch_id``)."""
    if padding is None:
        return df
    if padding == "longest":
        df = df.withColumn("_to", F.max(F.size("input_ids")).over(W.partitionBy("batch_id")))
    else:
        df = df.withColumn("_to", F.lit(length))
    gap = F.greatest(F.col("_to") - F.size("input_ids"), F.lit(0))
    return (
        df.withColumn("word_ids", F.concat("word_ids", F.array_repeat(F.lit(None).cast("int"), gap)))
        .withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), gap)))
        .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(PAD), gap)))
        .drop("_to")
    )


def encode(df: DataFrame, vocab: DataFrame, col="text", max_length=None, padding=None,
           pad_length=None, id_col="row_id", specials=(), limit=None) -> DataFrame:
    """``<s>`` pieces ``</s>`` with attention mask and word ids.  ``limit`` is the
    largest vocabulary to be shipped to the tasks, ``INLINE_LIMIT`` if not given.

    ``max_length`` truncates; ``padding='max'`` pads to ``pad_length`` (default
    ``max_length``); ``padding='longest'`` to the longest row of a ``batch_id``.
    Tokens in ``specials`` are recognised inside the text.
    """
    out = _encode_words(df, X.words(F.col(col), specials), vocab, max_length, id_col, specials, limit)
    return pad_encoded(out, padding, pad_length or max_length)


def encode_pretokenized(df: DataFrame, vocab: DataFrame, col="tokens", max_length=None, id_col="row_id") -> DataFrame:
    """Input already split into words."""
    lower = F.transform(F.col(col), lambda w: F.lower(w))
    return _encode_words(df, lower, vocab, max_length, id_col)


def cut_word(word: str, ranks: dict) -> list:
    """Pieces of a word: its symbols with one merge after the other, in rank order."""
    symbols, last = list(word), 0
    while True:
        later = [(ranks[p], p) for p in zip(symbols, symbols[1:]) if ranks.get(p, 0) > last]
        if not later:
            return symbols
        last, pair = min(later)
        merged, i = [], 0
        while i < len(symbols):
            step = 2 if tuple(symbols[i:i + 2]) == pair else 1
            merged.append("".join(symbols[i:i + step]))
            i += step
        symbols = merged


def _to_pieces(merges: DataFrame):
    """Function of a row's words: their marked pieces, and the word number of each."""
    ranks = {(r.left, r.right): r.rank for r in merges.select("rank", "left", "right").collect()}  # one row per merge

    cut = {}

    def cut_once(word):
        if word not in cut:
            if len(cut) >= HELD_WORDS:
                cut.clear()
            cut[word] = [p if i == 0 else f"##{p}" for i, p in enumerate(cut_word(word, ranks))]
        return cut[word]

    @F.arrow_udf("struct<pieces array<string>, owner array<int>>")
    def pieces(words: pa.Array) -> pa.Array:
        known = words.flatten().dictionary_encode()  # a word of the task is cut once, unless there are too many
        cuts = pa.array([cut_once(w) for w in known.dictionary.to_pylist()], pa.list_(pa.string())).take(known.indices)
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(cuts).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(len(cuts)) - np.repeat(np.cumsum(n) - n, n)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
        offsets = pa.array(ends, pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, values)
            for values in (cuts.flatten(), pa.array(np.repeat(place, sizes), pa.int32()))
        ]
        return pa.StructArray.from_arrays(lists, names=["pieces", "owner"])

    return pieces


def _segmented(df: DataFrame, segments: DataFrame, vocab: DataFrame, col, id_col) -> DataFrame:
    """Adds _words: the ids of every word's pieces.  They are looked up once for each word
    of ``segments``, so that what comes back to a row are numbers."""
    whole = F.coalesce("pieces", F.array("word"))
    segments = lookup_ids(segments.select("word", "n", X.marked(whole).alias("_m")), "_m", "_k", vocab, "word")
    words = df.select(id_col, F.posexplode(X.words(F.col(col))).alias("_p", "word"))
    hot = F.broadcast(top_k(segments, [], F.desc("n"), "word", HOT_WORDS).select("word", "_k"))
    near = words.join(hot, "word").select(id_col, "_p", F.col("_k").alias("_v"))
    itself = _single(vocab, "token").withColumnsRenamed({"token": "word", "token_id": "_i"})
    far = words.join(hot, "word", "left_anti").join(segments.select("word", "_k"), "word", "left").join(itself, "word", "left").select(
        id_col, "_p", F.coalesce("_k", F.array(F.coalesce("_i", F.lit(UNK)))).alias("_v")
    )
    cut = _lists(near.unionByName(far), id_col).withColumnRenamed("_l", "_words")
    return df.join(cut, id_col, "left").withColumn("_words", F.coalesce("_words", F.array().cast("array<array<int>>")))


def encode_learned(df: DataFrame, segments: DataFrame, vocab: DataFrame, col="text", max_length=None,
                   id_col="row_id", merges=None) -> DataFrame:
    """As ``encode``, with words cut by learned merges.

    With ``merges`` (rank, left, right) any word is cut, whether it was counted or
    not: the merges have a fixed size and travel to the tasks, rows stay in their
    partition, ``segments`` is not used.  Without them words are cut as
    ``segments`` (word, n, pieces) says and unknown words stay whole: the
    ``HOT_WORDS`` most frequent words are broadcast, so a word that makes up a
    large share of the text is never shuffled; the others join by word.
    """
    if merges is None:
        rows = _segmented(df, segments, vocab, col, id_col)
    else:
        words = F.coalesce(X.words(F.col(col)), F.array().cast("array<string>"))
        if max_length is not None:  # a word has one piece at least
            words = A.take(words, F.lit(max_length - 2))
        rows = _called(df.withColumn("_words", words), "_words", "_cut", _to_pieces(merges))
        return _framed(rows, F.col("_cut.pieces"), F.col("_cut.owner"), vocab, max_length, id_col).drop("_cut")
    found = F.flatten("_words")
    owner = F.flatten(F.transform("_words", lambda p, i: F.array_repeat(i.cast("int"), F.size(p))))
    if max_length is not None:
        found, owner = A.take(found, F.lit(max_length - 2)), A.take(owner, F.lit(max_length - 2))
    return _with_frame(rows.withColumn("_ids", found).withColumn("_owner", owner).drop("_words"))


def lang_to_id(df: DataFrame, vocab: DataFrame, langs, col="lang", out="lang_id") -> DataFrame:
    """Language word to its vocabulary id: one small map, as the words are few and fixed."""
    ids = vocab.where(F.col("token").isin(*langs)).select(
        F.col("token").alias(col), F.col("token_id").alias(out)
    )
    return df.join(F.broadcast(ids), col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(UNK)))


def mask_pad(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.when(x == PAD, F.lit(IGNORE)).otherwise(x))


def mask_pad_labels(df: DataFrame, col="labels") -> DataFrame:
    """Padding in labels becomes the ignore index."""
    return df.withColumn(col, mask_pad(F.col(col)))


def encode_pairs(df: DataFrame, vocab: DataFrame, langs, src="text", tgt="labels", max_length=512,
                 padding="max", id_col="row_id") -> DataFrame:
    """Source text to inputs, target text to labels with padding ignored."""
    target = df.withColumnRenamed(tgt, "_tgt")
    keep = [c for c in target.columns if c != "_tgt"]
    left = encode(target, vocab, src, max_length, padding, id_col=id_col)
    left = left.withColumnsRenamed({c: f"_s_{c}" for c in ("input_ids", "attention_mask", "word_ids")})
    both = encode(left, vocab, "_tgt", max_length, padding, id_col=id_col)
    both = both.select(
        *keep,
        F.col("_s_input_ids").alias("input_ids"),
        F.col("_s_attention_mask").alias("attention_mask"),
        mask_pad(F.col("input_ids")).alias("labels"),
    )
    return lang_to_id(both, vocab, langs)


def decode(df: DataFrame, vocab: DataFrame, col="input_ids", out="text", skip_special=True, id_col="row_id",
           limit=None) -> DataFrame:
    """Ids to text: specials skipped, continuation pieces glued to their word.  Ids
    that the vocabulary does not have are left out."""
    ids = F.col(col)
    if skip_special:
        specials = [r.token_id for r in vocab.where("is_special").select("token_id").collect()]
        ids = F.filter(ids, lambda x: ~x.isin(*specials))
    df = lookup_tokens(df.withColumn("_ids", ids), "_ids", "_names", vocab, id_col, limit)
    return df.withColumn(out, X.join_pieces(F.col("_names"))).drop("_ids", "_names")


def start_id(vocab: DataFrame, lang: str) -> int:
    """Id of a language's start token."""
    return vocab.where(F.col("token") == lang_start(lang)).head().token_id
