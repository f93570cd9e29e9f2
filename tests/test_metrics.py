"""Scores against published formulas, brute force and traced cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duolex.operators import metrics as M
from duolex.plans.recipes import evaluation_scores


def brute_bleu(pairs, weight=None, against="h"):
    match, total, ref_len, hyp_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in pairs:
        hyp_len, ref_len = hyp_len + len(hyp), ref_len + len(ref)
        for n in range(1, 5):
            h = Counter(tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1))
            r = Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
            w = (lambda g: weight(g[0])) if weight and n == 1 else (lambda g: 1)
            match[n - 1] += sum(min(c, r[g]) * w(g) for g, c in h.items())
            total[n - 1] += sum(c * w(g) for g, c in (h if against == "h" else r).items())
    if not all(match):
        return 0.0
    bp = 1 if hyp_len > ref_len else math.exp(1 - ref_len / hyp_len)
    return bp * math.exp(sum(math.log(m / t) for m, t in zip(match, total)) / 4)


def frame(spark, pairs):
    rows = [(i, " ".join(h), " ".join(r)) for i, (h, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "pair_id bigint, prediction string, reference string")


def test_bleu_golden(spark):
    assert round(M.corpus_bleu(frame(spark, [("abcde", "abcdf")])).first().bleu, 6) == 0.668740
    assert M.corpus_bleu(frame(spark, [("abcd", "abcd")])).first().bleu == 1.0
    assert M.corpus_bleu(frame(spark, [("ab", "ab")])).first().bleu == 0.0
    assert M.corpus_bleu(frame(spark, [("", "abcd")])).first().bleu == 0.0


@pytest.mark.parametrize("seed", [0, 1])
def test_bleu_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(30):
        ref = rng.choices("abcdef", k=rng.randint(0, 25))
        pairs.append(([w for w in ref if rng.random() > 0.15], ref))
    df = frame(spark, pairs)
    assert M.corpus_bleu(df).first().bleu == pytest.approx(brute_bleu(pairs))
    weight = lambda w: 1.0 if w in "ab" else 0.2
    assert M.weighted_ngram_match(df, ["a", "b"]).first()[0] == pytest.approx(brute_bleu(pairs, weight))
    recall = M.weighted_ngram_match(df, ["a", "b"], against="in_reference").first()[0]
    assert recall == pytest.approx(brute_bleu(pairs, weight, "r"))
    by = M.corpus_bleu(df.withColumn("g", F.col("pair_id") % 2), by=["g"]).orderBy("g").collect()
    assert [r.bleu for r in by] == pytest.approx([brute_bleu(pairs[0::2]), brute_bleu(pairs[1::2])])
    both = evaluation_scores(df, ["a", "b"]).first()
    assert (both.bleu, both.weighted_ngram_match) == pytest.approx((brute_bleu(pairs), brute_bleu(pairs, weight)))


def test_bleu_tokens(spark):
    text = 'f(x)=1.5; a-b 3-4 "q", end.\n&lt;b&gt; x,y 1,000'
    got = spark.createDataFrame([(text,)], "t string").select(M.bleu_tokens(F.col("t"))).first()[0]
    assert got == ["f", "(", "x", ")", "=", "1.5", ";", "a-b", "3", "-", "4", '"', "q", '"', ",", "end", ".", "<", "b",
                   ">", "x", ",", "y", "1,000"]


def test_prediction_table_stays_aligned(spark):
    refs = spark.createDataFrame([(1, "r1"), (2, "r2")], "pair_id int, reference string")
    cand = spark.createDataFrame([(1, 0, "p10"), (1, 1, "p11"), (2, 0, "p20"), (2, 1, "p21")], "pair_id int, candidate_no int, prediction string")
    got = {(r.pair_id, r.candidate_no): (r.label, r.prediction) for r in M.prediction_table(cand, refs).collect()}
    assert got == {(1, 0): ("r1", "p10"), (1, 1): ("r1", "p11"), (2, 0): ("r2", "p20"), (2, 1): ("r2", "p21")}


def brute_spans(tags):
    spans, start = set(), None
    for i, t in enumerate(list(tags) + [0]):
        kind = (t + 1) // 2
        if start is not None and (t == 0 or t % 2 == 1 or kind != start[0]):
            spans.add((*start, i))
            start = None
        if t and start is None:
            start = (kind, i)
    return spans


def test_entities(spark):
    golden = spark.createDataFrame([([1, 2, 0, 3], [1, 0, 0, 3])], "labels array<int>, predictions array<int>")
    r = M.entity_prf(golden).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.5, 0.5, 0.5, 0.75)
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        n = rng.randint(0, 15)
        true = [rng.choice([0, 0, 1, 2, 2, 3, 4, -100]) for _ in range(n)]
        rows.append((true, [rng.choice([0, 1, 2, 2, 4]) if rng.random() < 0.4 else max(t, 0) for t in true]))
    tp = pred = gold = 0
    for true, guess in rows:
        kept = [(t, p) for t, p in zip(true, guess) if t != -100]
        a, b = brute_spans([t for t, _ in kept]), brute_spans([p for _, p in kept])
        tp, pred, gold = tp + len(a & b), pred + len(b), gold + len(a)
    r = M.entity_prf(spark.createDataFrame(rows, golden.schema)).first()
    assert (r.tp, r.n_pred, r.n_true) == (tp, pred, gold)
    none = M.entity_prf(spark.createDataFrame([([0], [0])], golden.schema)).first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_perplexity(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 16), (1, 0, 3.0, 4), (1, 1, 1e6, 1)], "run_id int, epoch int, loss double, n_rows bigint")
    got = [r.perplexity for r in M.perplexity(df).orderBy("epoch").collect()]
    assert round(got[0], 6) == 9.025013 and got[1] == float("inf")


def test_early_stop(spark):
    rows = [(run, e, v) for run, vs in {1: [5, 4, 4.5, 4.6], 2: [5, 4.5, 4.2], 3: [5, 4, 3]}.items() for e, v in enumerate(vs)]
    df = spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], "run_id int, epoch int, value double").repartition(3)
    stop = {r.run_id: r.stop_epoch for r in M.early_stop(df, 0.0, 2).collect()}
    assert stop == {1: 3, 2: None, 3: None}
    blocks = {r.run_id: (r.stop_epoch, r.n_epochs) for r in M.early_stop(df, 0.0, 2, block=2).collect()}
    assert blocks == {1: (3, 4), 2: (None, 3), 3: (None, 3)}
    assert {r.run_id: r.stop_epoch for r in M.early_stop(df, 1.0, 2).collect()}[2] == 2
    rng = random.Random(5)
    long = spark.createDataFrame([(r, e, float(rng.randint(0, 40))) for r in range(4) for e in range(5 + 9 * r)], df.schema)
    for threshold in (0.0, 2.5):
        assert sorted(M.early_stop(long, threshold, 3).collect()) == sorted(M.early_stop(long, threshold, 3, block=7).collect())
    rising = {r.run_id: r.stop_epoch for r in M.early_stop(df, 0.0, 2, "max").collect()}
    assert rising == {1: 2, 2: 2, 3: 2}
    best = {r.run_id: (r.best_epoch, r.best_value) for r in M.best_epoch(df).collect()}
    assert best == {1: (1, 4.0), 2: (2, 4.2), 3: (2, 3.0)}
    ties = spark.createDataFrame([(1, e, 7.0) for e in range(3)], df.schema)
    assert M.best_epoch(ties).first().best_epoch == M.best_epoch(ties, "max").first().best_epoch == 0


def test_small_scores(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],)], "scores array<double>")
    assert M.argmax_labels(df).first().label == 1
    parts = spark.createDataFrame([(0.4, 0.8, 1.0, 0.0)], "ngram_match double, weighted_ngram_match double, syntax_match double, dataflow_match double")
    assert M.combined_code_score(parts).first().code_score == pytest.approx(0.55)
    ids = spark.createDataFrame([([1],), ([2],), ([1, 2],)], "input_ids array<int>")
    assert sorted(r.length for r in M.distinct_lengths(ids).collect()) == [1, 2]
    log = spark.createDataFrame([(1, 0, "test", "bleu", 0.12345678), (1, 0, "test", "ppl", 2.0)], "run_id int, epoch int, split string, metric string, value double")
    r = M.metric_report(log, ["bleu", "ppl"], percent=["bleu"]).first()
    assert r.bleu == pytest.approx(12.3457) and r.ppl == 2.0
