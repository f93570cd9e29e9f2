"""Vocabulary learning: word counts, piece vocabulary, byte-pair merges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions import text as X
from duolex.operators.index import top_k
from duolex.schemas import special_tokens
from duolex.session import materialise

VOCAB_SCHEMA = "token_id int, token string, is_special boolean"


def word_counts(df: DataFrame, col="text") -> DataFrame:
    """(word, n) over all texts."""
    return (
        df.select(F.explode(X.words(F.col(col))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


def add_special_tokens(spark, langs) -> DataFrame:
    """The fixed rows that open a vocabulary."""
    return spark.createDataFrame(special_tokens(langs), VOCAB_SCHEMA)


def learn_vocab(counts: DataFrame, size: int, langs) -> DataFrame:
    """Specials, then the most frequent pieces (ties by piece) up to ``size`` rows.

    Words are cut into pieces of fixed length, or as their column ``pieces`` says.
    """
    specials = special_tokens(langs)
    cut = X.marked(F.col("pieces")) if "pieces" in counts.columns else X.word_pieces(F.col("word"))
    pieces = (
        counts.select(F.explode(cut).alias("token"), "n")
        .groupBy("token").agg(F.sum("n").alias("n"))
        .where(~F.col("token").isin(*[t for _, t, _ in specials]))
    )
    numbered = top_k(pieces, [], F.desc("n"), "token", max(size - len(specials), 0)).select(
        (F.col("rank") - 1 + len(specials)).alias("token_id"), "token", F.lit(False).alias("is_special")
    )
    return add_special_tokens(counts.sparkSession, langs).unionByName(numbered)


# Symbols of a word are held as one string, each wrapped in the two marks, so
# that a merge is a native left-to-right replace.
_L, _R = "\u0001", "\u0002"


def _symbols(word):
    return F.regexp_replace(word, r"(?s)(.)", f"{_L}$1{_R}")


def _split_symbols(symbols):
    return F.split(F.substr(symbols, F.lit(2), F.length(symbols) - 2), f"{_R}{_L}", -1)


def _pairs(words: DataFrame) -> DataFrame:
    """(left, right, n) for all adjacent symbols of (symbols, n)."""
    count = F.size("s") - 1
    zipped = F.arrays_zip(
        F.slice("s", F.lit(1), count).alias("left"), F.slice("s", F.lit(2), count).alias("right")
    )
    split = words.select(_split_symbols(F.col("symbols")).alias("s"), "n")
    return split.where(F.size("s") > 1).select(F.inline(zipped), "n")


def _pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def _merged(symbols, merges):
    for left, right in merges:
        symbols = F.replace(
            symbols, F.lit(f"{_L}{left}{_R}{_L}{right}{_R}"), F.lit(f"{_L}{left}{right}{_R}")
        )
    return symbols


def _independent(ranked, exhausted: bool, room: int):
    """Leading pairs of ``ranked`` (left, right, n) that can be merged in one pass
    with the same result as one by one.

    A merge changes only counts of pairs that share one of its symbols or its
    product, and every pair it creates counts no more than such a pair did.  So a
    pair may follow as long as all pairs that count as much as it are taken
    already or disjoint from all symbols taken.
    """
    taken, symbols = [], set()
    floor = 0 if exhausted else ranked[-1][2]
    for left, right, n in ranked:
        if len(taken) == room:
            break
        if taken:
            peers = [(l, r) for l, r, m in ranked if m >= n and (l, r) not in taken]
            if n <= floor or any(l in symbols or r in symbols for l, r in peers):
                break
        taken.append((left, right))
        symbols |= {left, right, left + right}
    return taken


def learn_bpe_merges(counts: DataFrame, n_merges: int, look=256, checkpoint_every=20):
    """Byte-pair merges over the distinct words.

    Returns (merges, words): ``merges`` holds (rank, left, right), ``words`` the
    distinct words with their final pieces.  Each round fetches the best ``look``
    pairs, applies every merge that provably does not depend on another one of the
    round, and updates the pair counts from the words that changed only.
    """
    spark = counts.sparkSession
    state = materialise(counts.select("word", "n", _symbols(F.col("word")).alias("symbols")), "bpe")
    pairs = materialise(_pair_counts(_pairs(state)), "pairs")
    merges, pending = [], 0
    while len(merges) < n_merges:
        rows = pairs.orderBy(F.desc("n"), "left", "right").limit(look).collect()
        if not rows:
            break
        best = _independent([tuple(r) for r in rows], len(rows) < look, n_merges - len(merges))
        merges += best
        after = _merged(F.col("symbols"), best)
        if len(merges) < n_merges:
            changed = state.select("n", F.col("symbols").alias("old"), after.alias("new")).where("old <> new")
            both = changed.select(F.inline(F.array(
                F.struct(F.col("old").alias("symbols"), (-F.col("n")).alias("n")),
                F.struct(F.col("new").alias("symbols"), "n"),
            )))
            pairs = materialise(_pair_counts(pairs.unionByName(_pairs(both))), "pairs")
        state = state.withColumn("symbols", after)
        pending += len(best)
        if pending >= checkpoint_every:
            state, pending = materialise(state, "bpe"), 0
    table = spark.createDataFrame(
        [(i + 1, l, r) for i, (l, r) in enumerate(merges)], "rank int, left string, right string"
    )
    return table, state.select("word", "n", _split_symbols(F.col("symbols")).alias("pieces"))
