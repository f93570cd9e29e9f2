"""The three dataflows, end to end.  Cleaned rows, vocabulary and encoded rows are
written to the shared folder, as later stages read them several times."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.functions import text as X
from duolex.operators import encode as E
from duolex.operators.backtrans import noise_schedule, objective_schedule, scheduled_ratios
from duolex.operators.clean import apply_cleaner_by_lang, strip_repo_prefix
from duolex.operators.combine import interleave_batches
from duolex.operators.filters import length_filter
from duolex.operators.frequency import (
    token_frequency, token_probabilities, top_k_side_by_side, top_k_tokens, zipped_long,
)
from duolex.operators.index import top_k
from duolex.operators.masking import whole_word_mask
from duolex.operators.metrics import corpus_bleu, weighted_ngram_match
from duolex.operators.noise import Ratios, TokenSampler, denoise_examples
from duolex.operators.pack import pack_chunks
from duolex.operators.sampling import balance_corpora
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.session import materialise


def frequent_tokens(corpus: DataFrame, seed=0, k=3000) -> DataFrame:
    """Words per language: filter, balance, count, rank, probabilities."""
    rows = balance_corpora(length_filter(corpus), "lang", "row_id", seed)
    freq = (
        rows.select("lang", F.explode(X.words(F.col("text"))).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("freq"))
    )
    return token_probabilities(top_k(freq, ["lang"], F.desc("freq"), "word", k))


def clean_corpus(corpus: DataFrame, strip_prefix=False, c_like=("cpp",), balance=True, seed=0) -> DataFrame:
    """Clean, filter and balance (row_id, lang, text)."""
    rows = strip_repo_prefix(corpus).drop("had_prefix") if strip_prefix else corpus
    rows = length_filter(apply_cleaner_by_lang(rows, "text", c_like))
    if not balance:
        return rows
    return balance_corpora(rows, "lang", "row_id", seed)


def vocabulary(rows: DataFrame, size: int, langs) -> DataFrame:
    return materialise(learn_vocab(word_counts(rows), size, langs), "vocab")


def masked_language_data(corpus: DataFrame, langs, vocab_size=30_000, chunk_size=512, p=0.15, seed=0, max_length=None) -> DataFrame:
    """read -> clean -> filter -> balance -> encode -> pack -> mask.  Long texts fill
    several chunks; ``max_length`` cuts them before."""
    rows = materialise(clean_corpus(corpus, seed=seed), "clean")
    vocab = vocabulary(rows, vocab_size, langs)
    encoded = materialise(E.encode(rows, vocab, max_length=max_length).drop("text"), "encoded")
    packed = pack_chunks(encoded, chunk_size=chunk_size)
    return whole_word_mask(packed, ["pack_group", "chunk"], p, seed, "row_ids")


def denoise_data(corpus: DataFrame, langs, keywords, vocab_size=30_000, chunk_size=512, batch_size=32,
                 k=3000, ratios=Ratios(replace=0.05), seed=0, schedule=None) -> DataFrame:
    """interleave -> encode -> frequencies -> schedule -> noisy examples.

    Batches scheduled for back-translation leave with their clean ids; pair them
    with generated outputs by ``back_translation_pairs``.  With a ``schedule``, the
    arguments of ``noise_schedule``, noise grows with the step instead of keeping to ``ratios``;
    ``warmup`` among them holds back-translation off so long.
    """
    part = corpus.where(F.col("lang").isin(*langs))
    rows = materialise(clean_corpus(part, balance=False, seed=seed), "clean")
    vocab = vocabulary(rows, vocab_size, langs)
    mixed = interleave_batches(rows, langs, batch_size)
    encoded = materialise(
        E.encode(mixed, vocab, max_length=chunk_size, padding="max").drop("text", "word_ids"), "encoded"
    )
    top = top_k_tokens(token_frequency(encoded), vocab, k)
    probs = zipped_long(top_k_side_by_side(top, *langs), *langs)
    sampler = TokenSampler.from_table(probs)
    ids = keyword_ids(vocab, keywords)
    # the trainer counts its own batches, here one step per pair of languages
    schedule = dict(schedule or {})
    steps = objective_schedule(encoded.withColumn("step", F.col("batch_id") + 1), schedule.pop("warmup", 0))
    if schedule:
        steps, ratios = noise_schedule(steps, **schedule), scheduled_ratios(ratios.shuffle)
    noisy = denoise_examples(steps.where(F.col("objective") == "denoise"), ratios, sampler, ids, langs, ["row_id"], seed)
    clean = steps.where(F.col("objective") != "denoise").withColumn("labels", E.mask_pad(F.col("input_ids")))
    return noisy.unionByName(clean)


def keyword_ids(vocab: DataFrame, keywords: dict) -> dict:
    """Vocabulary ids of each language's keywords, specials excluded: the lists are
    short and fixed, and encoded once."""
    spark = vocab.sparkSession
    words = spark.createDataFrame([(lang, " ".join(ks)) for lang, ks in keywords.items()], "row_id string, text string")
    tokens = vocab.where(~F.col("is_special")).select("token_id")
    ids = E.encode(words, vocab).select("row_id", F.explode("input_ids").alias("token_id")).distinct()
    out = {lang: [] for lang in keywords}
    for r in ids.join(tokens, "token_id").orderBy("row_id", "token_id").collect():
        out[r.row_id].append(r.token_id)
    return out


def evaluation_scores(pairs: DataFrame, keywords, by=()) -> DataFrame:
    """Scores of (pair_id, prediction, reference) rows."""
    bleu = corpus_bleu(pairs, by=by).select(*by, "bleu")
    weighted = weighted_ngram_match(pairs, keywords, by=by).select(*by, "weighted_ngram_match")
    if by:
        return bleu.join(weighted, list(by))
    return bleu.withColumn("_1", F.lit(1)).join(weighted.withColumn("_1", F.lit(1)), "_1").drop("_1")
