"""Several candidates per source, scored against the source's reference."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.operators.grams import FIELDS, row_totals
from duolex.operators.metrics import MAX_ORDER, bleu_tokens, combined_code_score, plain_tokens, score_totals
from duolex.session import materialise, small_batches

PLAIN, WEIGHTED = 0, 1  # punctuation apart; white-space words with keyword weights


def candidate_totals(candidates: DataFrame, references: DataFrame, keywords, other=0.2, max_order=MAX_ORDER,
                     key="pair_id", number="candidate_no") -> DataFrame:
    """(key, number, kind, n, matched, in_prediction, in_reference, hyp_len, ref_len).

    ``candidates`` (key, number, prediction) and ``references`` (key, reference) are unique
    by their keys; candidates without a reference are left out, a null text is an empty
    one.  The texts meet by source and are cut there; n-grams are counted inside their row, so
    that none is sorted or travels.
    """
    rows = candidates.select(key, number, F.coalesce("prediction", F.lit("")).alias("_t")).join(
        references.select(key, F.coalesce("reference", F.lit("")).alias("_q")), key
    )
    cut = rows.select(key, number, *[
        cut(F.col(c)).alias(f"{c}{kind}") for kind, cut in ((PLAIN, bleu_tokens), (WEIGHTED, plain_tokens)) for c in ("_t", "_q")
    ])
    plain = row_totals(max_order)(f"_t{PLAIN}", f"_q{PLAIN}")
    weighted = row_totals(max_order, keywords, other)(f"_t{WEIGHTED}", f"_q{WEIGHTED}")
    both = small_batches(cut).select(key, number, plain.alias("_0"), weighted.alias("_1"))

    def of(kind):
        return F.transform(f"_{kind}", lambda t: F.struct(F.lit(kind).alias("kind"), *[t[c].alias(c) for c in FIELDS]))

    return both.select(key, number, F.inline(F.concat(of(PLAIN), of(WEIGHTED))))


def rank_candidates(totals: DataFrame, max_order=MAX_ORDER, key="pair_id", number="candidate_no") -> DataFrame:
    """(key, number, sentence_bleu, rank): from the totals of the plain words, orders above the
    first smoothed by one.  Scores equal in nine digits rank by number."""
    one = F.when(F.col("n") > 1, F.lit(1.0)).otherwise(F.lit(0.0))
    share = (F.col("matched") + one) / F.nullif(F.col("in_prediction") + one, F.lit(0.0))
    first = F.col("n") == 1
    rows = totals.where(F.col("kind") == PLAIN).groupBy(key, number).agg(
        F.sum(F.when(share > 0, F.ln(share))).alias("_logs"), F.count_if(share > 0).alias("_orders"),
        F.max(F.when(first, F.col("hyp_len"))).alias("_h"), F.max(F.when(first, F.col("ref_len"))).alias("_r"),
    )
    short = F.when(F.col("_h") > F.col("_r"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("_r") / F.nullif(F.col("_h"), F.lit(0)))
    )
    score = F.when(F.col("_orders") < max_order, F.lit(0.0)).otherwise(short * F.exp(F.col("_logs") / max_order))
    best = W.partitionBy(key).orderBy(F.desc("sentence_bleu"), number)
    return rows.select(key, number, F.round(score, 9).alias("sentence_bleu")).withColumn("rank", F.row_number().over(best))


def evaluate_candidates(candidates: DataFrame, references: DataFrame, keywords, weights=(0.25, 0.25, 0.25, 0.25), other=0.2,
                        against="in_prediction", key="pair_id", number="candidate_no",
                        parts=("syntax_match", "dataflow_match")) -> DataFrame:
    """Two rows of corpus scores: over ``all`` candidates, and over the ``best`` one of each source.

    (selection, n_candidates, bleu, weighted_ngram_match, the means of ``parts``, code_score).
    ``parts`` are columns of ``candidates`` with scores from elsewhere; nulls are left out of a mean.
    Without any candidate that has a reference there are no rows.
    """
    totals = materialise(candidate_totals(candidates, references, keywords, other, key=key, number=number), "totals")
    ranks = materialise(rank_candidates(totals, key=key, number=number), "ranks")
    chosen = F.explode(F.when(F.col("rank") == 1, F.array(F.lit("all"), F.lit("best"))).otherwise(F.array(F.lit("all"))))
    selected = ranks.select(key, number, chosen.alias("selection"))
    sums = totals.join(selected, [key, number]).groupBy("selection", "kind", "n").agg(
        *[F.sum(c).alias(c) for c in ("matched", "in_prediction", "in_reference")],
        F.sum(F.when(F.col("n") == 1, F.col("hyp_len"))).alias("hyp_len"),
        F.sum(F.when(F.col("n") == 1, F.col("ref_len"))).alias("ref_len"),
    )
    sums = materialise(sums, "sums")

    def score(kind, out, side="in_prediction"):
        return score_totals(sums.where(F.col("kind") == kind), ["selection"], out=out, against=side).select("selection", out)

    means = candidates.select(key, number, *parts).join(selected, [key, number]).groupBy("selection").agg(
        F.count(F.lit(1)).alias("n_candidates"), *[F.avg(p).alias(p) for p in parts]
    )
    names = ("bleu", "weighted_ngram_match", *parts)
    table = means.join(score(PLAIN, names[0]), "selection").join(score(WEIGHTED, names[1], against), "selection")
    return combined_code_score(table, weights, names).select("selection", "n_candidates", *names, "code_score")
