"""Dataflows over three splits, candidates against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duolex.operators.candidates import candidate_totals, evaluate_candidates, rank_candidates
from duolex.operators.encode import cut_word
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.plans import splits as P

ROW = "row_id bigint, lang string, split string, text string"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROW).repartition(3)


def parts(df):
    return Counter((r.split, r.lang) for r in df.collect())


@pytest.fixture
def three(spark):
    rows = []
    for i in range(90):
        split = "valid" if i % 10 == 0 else "test" if i % 10 == 1 else "train"
        lang = "ab"[i % 3 == 0]
        rows.append((i, lang, split, f"repo{i} | {'key ' if i % 4 else ''}word{i % 7} tail"))
    rows += [(900, "a", "train", None), (901, None, "train", "key"), (902, "a", None, "key"), (903, "c", "train", "key"),
             (904, "a", "extra", "key"), (905, "b", "train", "")]
    return rows


def test_selection(spark, three):
    got = P.select_splits(rows_of(spark, three), ["a", "b"], {"b": ["key"]}, strip_prefix=True, seed=3).collect()
    train = [r for r in got if r.split == "train"]
    hit = [r for r in three if r[1] == "b" and r[2] == "train" and "key" in (r[3] or "")]
    assert Counter(r.lang for r in train) == {"a": len(hit), "b": len(hit)}
    assert {r.row_id for r in train if r.lang == "b"} == {r[0] for r in hit}
    assert not any("|" in (r.text or "") for r in train)
    held = {r[0]: r[3] for r in three if r[2] in ("valid", "test")}
    assert {r.row_id: r.text for r in got if r.split != "train"} == held


def test_selection_is_the_same_in_any_partitioning(spark, three):
    frame = spark.createDataFrame(three, ROW)
    a, b = (P.select_splits(frame.repartition(n), ["a", "b"], train_limit=5, held_limit=2, seed=1) for n in (1, 7))
    assert sorted(r.row_id for r in a.collect()) == sorted(r.row_id for r in b.collect())
    assert parts(a) == {("train", "a"): 5, ("train", "b"): 5, **{(s, x): 2 for s in ("valid", "test") for x in "ab"}}


def test_limits_and_absent_languages(spark, three):
    frame = rows_of(spark, three)
    with pytest.raises(PySparkException, match="fewer than the limit"):
        P.select_splits(frame, ["a", "b"], train_limit=1000).collect()
    # a language without training rows leaves none to the others
    gone = parts(P.select_splits(frame, ["a", "b"], {"b": ["nowhere"]}))
    assert {k for k in gone if k[0] == "train"} == set() and gone[("valid", "a")] > 0
    whole = parts(P.select_splits(frame, ["a", "b"], balance=False))
    assert whole == Counter((r[2], r[1]) for r in three if r[1] in ("a", "b") and r[2] in ("train", "valid", "test"))
    assert P.select_splits(frame.where("false"), ["a", "b"]).count() == 0
    # further columns stay
    assert P.select_splits(frame.withColumn("extra", F.lit(1)), ["a", "b"]).columns[-1] == "extra"


def test_held_rows_fill_chunks(spark, three):
    frame = rows_of(spark, three)
    out = P.masked_language_splits(frame, ["a", "b"], 200, chunk_size=8, group_rows=20, seed=5).collect()
    assert {r.split for r in out} == {"train", "valid", "test"}
    assert all(len(r.input_ids) == len(r.labels) == len(r.row_ids) == len(r.word_ids) == 8 for r in out)
    held = [r for r in out if r.split == "test"]
    # "repoN | key wordN tail": more than 8 pieces or padded to 8, so every row starts where a chunk or a row ended
    assert {i for r in held for i in r.row_ids} <= {r[0] for r in three if r[2] == "test"}
    for r in out:
        for x, y in zip(r.input_ids, r.labels):
            assert (x == 4) == (y != -100)
    # rows stand in random order inside a split
    order = [i for r in sorted(out, key=lambda r: (r.pack_group, r.chunk)) if r.split == "train" for i in r.row_ids]
    firsts = list(dict.fromkeys(order))
    assert firsts != sorted(firsts)


def test_learned_merges_in_the_dataflow(spark, three):
    frame = rows_of(spark, three)
    out = P.masked_language_splits(frame, ["a", "b"], 300, 25, 8, p=0.0, seed=5, balance=False).collect()
    tokenizer = P.train_tokenizer(frame.where("lang in ('a', 'b') and split = 'train'"), 300, ["a", "b"], 25)
    ranks = {(r.left, r.right): r.rank for r in tokenizer.merges.collect()}
    assert len(ranks) == 25
    names = {r.token_id: r.token for r in tokenizer.vocab.collect()}
    seen = {}
    for r in sorted(out, key=lambda r: (r.pack_group, r.chunk)):
        for i, w, x in zip(r.row_ids, r.word_ids, r.input_ids):
            if w is not None:
                seen.setdefault((i, w), []).append(names[x])
    row = next(r for r in three if r[2] == "valid")
    words = row[3].lower().split()
    for w, word in enumerate(words):
        pieces = cut_word(word, ranks)
        want = [("##" if k else "") + p for k, p in enumerate(pieces)]
        got = seen.get((row[0], w))
        if got is not None and len(got) == len(want):
            assert [g for g, x in zip(got, want) if g != "<unk>"] == [x for g, x in zip(got, want) if g != "<unk>"]
    assert any(len(v) < len(words[k[1]]) for k, v in seen.items() if k[0] == row[0] and k[1] < len(words))


def test_tagging(spark):
    rows = [(i, "ab"[i % 2], ["train", "valid"][i % 3 == 0], ["Longword", "x"], [1, 2]) for i in range(30)]
    rows += [(50, "a", "train", None, None), (51, "b", "train", [], []), (52, "b", "train", ["y"], None)]
    frame = spark.createDataFrame(rows, "row_id bigint, lang string, split string, tokens array<string>, tags array<int>")
    vocab = learn_vocab(word_counts(spark.createDataFrame([("longword x y",)], "text string")), 50, ["a", "b"])
    out = P.tagging_data(frame, ["a", "b"], vocab, shift=True, balance=False, seed=2).collect()
    assert len(out) == 33
    for split in ("train", "valid"):
        assert sorted(r.position for r in out if r.split == split) == list(range(sum(r.split == split for r in out)))
    by = {r.row_id: r for r in out}
    assert by[0].labels == [-100, 1, 2, 3, -100] and len(by[0].input_ids) == 5  # the shifted tag 2 is 3
    assert by[50].labels == by[51].labels == [-100, -100] and by[52].labels == [-100, None, -100]
    keyed = P.tagging_data(frame, ["a", "b"], vocab, keywords={"b": ["y"]}, balance=False).collect()
    assert {r.row_id for r in keyed if r.split == "train" and r.lang == "b"} == {52}


def test_fine_tuning(spark):
    rows = [(i, ["train", "test"][i % 4 == 0], "w " * (i % 5), "v " * (i % 3) + ("key" if i % 2 else "")) for i in range(40)]
    rows += [(90, "train", None, None), (91, None, "w", "key"), (92, "train", None, "key")]
    frame = spark.createDataFrame(rows, "pair_id bigint, split string, src string, tgt string").repartition(4)
    vocab = learn_vocab(word_counts(spark.createDataFrame([("w v key",)], "text string")), 50, ["a", "b"])
    out = P.fine_tuning_data(frame, ["a", "b"], vocab, keywords=["key"], batch_rows=4).collect()
    kept = [r for r in rows if r[1] == "test" or (r[1] == "train" and "key" in (r[3] or ""))]
    assert {r.pair_id for r in out} == {r[0] for r in kept}
    for split in ("train", "test"):
        ids = sorted(r[0] for r in kept if r[1] == split)
        for b in range(0, len(ids), 4):
            batch = [r for r in out if r.split == split and r.batch_id == b // 4]
            assert sorted(r.pair_id for r in batch) == ids[b:b + 4]
            source = {r[0]: len((r[2] or "").split()) + 2 for r in kept}
            assert {len(r.input_ids) for r in batch} == {max(source[r.pair_id] for r in batch)}
            assert all(sum(r.attention_mask) == source[r.pair_id] for r in batch)
            assert len({len(r.labels) for r in batch}) == 1 and not any(1 in r.labels for r in batch)


KEYS = ["if", "for"]


def counts(text, n):
    words = text.split()
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def corpus_score(pairs, weight):
    logs, h1, r1 = [], 0, 0
    for n in range(1, 5):
        m = t = 0.0
        for p, q in pairs:
            a, b = counts(p, n), counts(q, n)
            m += sum(min(c, b[g]) * weight(g) for g, c in a.items())
            t += sum(c * weight(g) for g, c in a.items())
            if n == 1:
                h1, r1 = h1 + sum(a.values()), r1 + sum(b.values())
        if m == 0:
            return 0.0
        logs.append(math.log(m / t))
    return math.exp(sum(logs) / 4) * (1.0 if h1 > r1 else math.exp(1 - r1 / h1))


def sentence_score(p, q):
    logs = []
    for n in range(1, 5):
        a, b, one = counts(p, n), counts(q, n), float(n > 1)
        m, t = sum(min(c, b[g]) for g, c in a.items()) + one, sum(a.values()) + one
        if not m or not t:
            return 0.0
        logs.append(math.log(m / t))
    h, r = len(p.split()), len(q.split())
    return round(math.exp(sum(logs) / 4) * (1.0 if h > r else math.exp(1 - r / h)), 9)


def test_candidates_against_brute_force(spark):
    rng = random.Random(8)
    words = ["if", "for", "x", "y", "z", "run"]
    refs = {i: " ".join(rng.choices(words, k=rng.randint(0, 9))) for i in range(25)}
    cands = [(i, c, " ".join(rng.choices(words, k=rng.randint(0, 9))) if c else refs[i % 20], rng.random(), None if c == 2 else 0.5)
             for i in range(25) for c in range(4)]
    cands += [(77, 0, "x y z run if", 1.0, 1.0)]  # no reference: left out
    cands += [(3, 9, None, 0.25, None)]  # null: empty
    refs[88] = "x y"  # no candidate
    got_c = spark.createDataFrame(cands, "pair_id bigint, candidate_no int, prediction string, syntax_match double, dataflow_match double")
    got_r = spark.createDataFrame(list(refs.items()), "pair_id bigint, reference string")
    known = [c for c in cands if c[0] in refs]
    score = {(c[0], c[1]): sentence_score(c[2] or "", refs[c[0]]) for c in known}
    ranks = rank_candidates(candidate_totals(got_c.repartition(3), got_r.repartition(2), KEYS)).collect()
    assert {(r.pair_id, r.candidate_no): r.sentence_bleu for r in ranks} == pytest.approx(score)
    best = {}
    for i, c in sorted(score, key=lambda k: (k[0], -score[k], k[1])):
        best.setdefault(i, c)
    assert {r.pair_id: r.candidate_no for r in ranks if r.rank == 1} == best
    table = {r.selection: r for r in evaluate_candidates(got_c, got_r, KEYS).collect()}
    for name, chosen in (("all", known), ("best", [c for c in known if best[c[0]] == c[1]])):
        pairs = [(c[2] or "", refs[c[0]]) for c in chosen]
        bleu = corpus_score(pairs, lambda g: 1.0)
        weighted = corpus_score(pairs, lambda g: 1.0 if len(g) > 1 or g[0] in KEYS else 0.2)
        flow = [c[4] for c in chosen if c[4] is not None]
        syntax = sum(c[3] for c in chosen) / len(chosen)
        r = table[name]
        assert r.n_candidates == len(chosen)
        assert (r.bleu, r.weighted_ngram_match, r.syntax_match) == pytest.approx((bleu, weighted, syntax))
        assert r.code_score == pytest.approx((bleu + weighted + syntax + sum(flow) / len(flow)) / 4)
    assert evaluate_candidates(got_c.where("false"), got_r, KEYS).count() == 0


def test_ngrams_stay_in_their_row(spark):
    c = spark.createDataFrame([(1, 0, "a b")], "pair_id bigint, candidate_no int, prediction string")
    r = spark.createDataFrame([(1, "a b")], "pair_id bigint, reference string")
    plan = candidate_totals(c, r.hint("merge"), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan  # the texts of both sides, once
