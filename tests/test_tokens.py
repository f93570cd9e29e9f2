"""Vocabulary, encoding, packing, labels and masks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duolex.operators import encode as E
from duolex.operators import labels as L
from duolex.operators import masking as M
from duolex.operators.frequency import (
    token_frequency, token_probabilities, top_k_side_by_side, top_k_tokens, zipped_long,
)
from duolex.operators.pack import pack_chunks
from duolex.operators.vocab import VOCAB_SCHEMA, learn_bpe_merges, learn_vocab, word_counts
from duolex.schemas import special_tokens

LANGS = ["en", "fr"]


@pytest.fixture(scope="module")
def vocab(spark):
    tokens = [t for _, t, _ in special_tokens(LANGS)]
    words = ["the", "cats", "##andd", "##ogs", "a", ",", "élan", "##s", "int", "x", "=", "1", ";"]
    rows = special_tokens(LANGS) + [(len(tokens) + i, w, False) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def ids(vocab, *tokens):
    known = {r.token: r.token_id for r in vocab.collect()}
    return [known.get(t, 3) for t in tokens]


def test_word_counts_and_vocab(spark):
    df = spark.createDataFrame([("The the catsand, en",), ("élan élan",), ("",)], "text string")
    counts = word_counts(df)
    assert {r.word: r.n for r in counts.collect()} == {"the": 2, "catsand": 1, ",": 1, "en": 1, "élan": 2}
    got = [(r.token_id, r.token, r.is_special) for r in learn_vocab(counts, 13, LANGS).orderBy("token_id").collect()]
    assert got[:9] == special_tokens(LANGS)
    assert [t for _, t, _ in got[9:]] == ["the", "élan", "##and", ","]  # "en" is taken, ties by piece


def brute_bpe(counts, n):
    words = {w: list(w) for w in counts}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for w, syms in words.items():
            for p in zip(syms, syms[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        for w, syms in words.items():
            out, i = [], 0
            while i < len(syms):
                if tuple(syms[i:i + 2]) == best:
                    out.append(syms[i] + syms[i + 1])
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            words[w] = out
    return merges, words


@pytest.mark.parametrize("seed,look,n", [(0, 256, 25), (1, 4, 12), (2, 1, 6)])
def test_bpe_against_brute_force(spark, seed, look, n):
    rng = random.Random(seed)
    counts = {"".join(rng.choices("abcd", k=rng.randint(1, 9))): rng.randint(1, 6) for _ in range(40)}
    counts["aaaa"] = 9
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    merges, words = learn_bpe_merges(df, n, look=look, checkpoint_every=7)
    want, pieces = brute_bpe(counts, n)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == want
    assert {r.word: r.pieces for r in words.collect()} == pieces
    ranks = {pair: i + 1 for i, pair in enumerate(want)}
    assert {w: E.cut_word(w, ranks) for w in counts} == pieces


def test_encode(spark, vocab):
    df = spark.createDataFrame([(0, "The catsanddogs, élans!"), (1, ""), (2, "</s> a")], "row_id bigint, text string")
    got = {r.row_id: r for r in E.encode(df, vocab).collect()}
    assert got[0].input_ids == [0, *ids(vocab, "the", "cats", "##andd", "##ogs", ",", "élan", "##s", "!"), 2]
    assert got[0].word_ids == [None, 0, 1, 1, 1, 2, 3, 3, 4, None]
    assert got[0].attention_mask == [1] * 10
    assert got[1].input_ids == [0, 2] and got[1].word_ids == [None, None]
    plain = E.encode(df.where("row_id = 2"), vocab).first().input_ids
    known = E.encode(df.where("row_id = 2"), vocab, specials=["</s>"]).first().input_ids
    assert 2 not in plain[1:-1] and known == [0, 2, *ids(vocab, "a"), 2]


def test_encode_with_learned_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(0, "low lower lowest low"), (1, ""), (2, "newer low")], "row_id bigint, text string")
    merges, words = learn_bpe_merges(word_counts(df), 4)
    vocab = learn_vocab(words, 60, LANGS)
    known = {r.word: r.pieces for r in words.collect()}
    ids_of = {r.token: r.token_id for r in vocab.collect()}

    def want(text):
        out = [0]
        for w in text.split():
            out += [ids_of[("##" if k else "") + p] for k, p in enumerate(known[w])]
        return out + [2]

    for hot in (10_000, 1):
        monkeypatch.setattr(E, "HOT_WORDS", hot)
        got = {r.row_id: r for r in E.encode_learned(df, words, vocab).collect()}
        assert got[0].input_ids == want("low lower lowest low") and got[1].input_ids == [0, 2]
        assert [w for w in got[2].word_ids if w is not None] == [0] * len(known["newer"]) + [1] * len(known["low"])
    assert E.decode(E.encode_learned(df, words, vocab), vocab).where("row_id = 0").first().text == "low lower lowest low"


def test_merges_cut_words_that_were_not_counted(spark):
    train = spark.createDataFrame([(0, "lower lowest newer newest wider low low new")], "row_id bigint, text string")
    merges, words = learn_bpe_merges(word_counts(train), 6)
    vocab = learn_vocab(words, 60, LANGS)
    ranks = {(r.left, r.right): r.rank for r in merges.collect()}
    df = spark.createDataFrame([(0, "newlow slow"), (1, None), (2, ""), (3, "low wider")], "row_id bigint, text string")
    out = E.encode_learned(df, None, vocab, merges=merges)
    got = {r.row_id: r for r in out.collect()}
    assert E.cut_word("newlow", ranks) == ["new", "low"] and E.cut_word("slow", ranks) == ["s", "low"]
    ids_of = {r.token: r.token_id for r in vocab.collect()}
    want = [ids_of.get(p, 3) for p in ("new", "##low", "s", "##low")]
    assert got[0].input_ids == [0, *want, 2] and got[0].word_ids == [None, 0, 0, 1, 1, None]
    assert got[1].input_ids == got[2].input_ids == [0, 2]
    assert got[3].input_ids == E.encode_learned(df, words, vocab).where("row_id = 3").first().input_ids
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_encode_padding(spark, vocab):
    df = spark.createDataFrame([(0, 0, "a a a a"), (1, 0, "a"), (2, 1, "a a")], "row_id bigint, batch_id bigint, text string")
    a = ids(vocab, "a")[0]
    cut = {r.row_id: r.input_ids for r in E.encode(df, vocab, max_length=4, padding="max").collect()}
    assert cut == {0: [0, a, a, 2], 1: [0, a, 2, 1], 2: [0, a, a, 2]}
    longest = {r.row_id: (r.input_ids, r.attention_mask) for r in E.encode(df, vocab, padding="longest").collect()}
    assert longest[1] == ([0, a, 2, 1, 1, 1], [1, 1, 1, 0, 0, 0]) and longest[2][0] == [0, a, a, 2]
    # padded but not truncated
    loose = {r.row_id: len(r.input_ids) for r in E.encode(df, vocab, padding="max", pad_length=5).collect()}
    assert loose == {0: 6, 1: 5, 2: 5}


def test_large_vocabulary_goes_through_a_join(spark, vocab, corpus, monkeypatch):
    learned = learn_vocab(word_counts(corpus), 40, LANGS)
    inline = {r.row_id: r.input_ids for r in E.encode(corpus, learned).collect()}
    back = {r.row_id: r.text for r in E.decode(E.encode(corpus, learned), learned).collect()}
    monkeypatch.setattr(E, "INLINE_LIMIT", 10)
    assert E.inline_tokens(learned) is None
    joined = E.encode(corpus.unionByName(corpus.limit(1).withColumn("row_id", F.lit(99).cast("bigint")).withColumn("text", F.lit(""))), learned)
    got = {r.row_id: r.input_ids for r in joined.collect()}
    assert got.pop(99) == [0, 2] and got == inline
    assert {r.row_id: r.text for r in E.decode(E.encode(corpus, learned), learned).collect()} == back


def test_decode_round_trip(spark, vocab):
    df = spark.createDataFrame([(0, "the catsanddogs , x = 1 ;")], "row_id bigint, text string")
    rows = E.encode(df, vocab, max_length=64, padding="max").drop("text")
    assert E.decode(rows, vocab).first().text == "the catsanddogs , x = 1 ;"
    assert E.decode(rows, vocab, skip_special=False).first().text.startswith("<s> the")


def test_decode_survives_nested_lambdas(spark, vocab):
    df = spark.createDataFrame([(0, "the x"), (1, "a")], "row_id bigint, text string")
    rows = E.encode(df, vocab).drop("text")
    nested = F.flatten(F.transform("input_ids", lambda v: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: v)))
    got = {r.row_id: r.text for r in E.decode(rows.withColumn("input_ids", nested), vocab).collect()}
    assert got == {0: "the the x x", 1: "a a"}


def test_lang_ids_and_pairs(spark, vocab):
    df = spark.createDataFrame([(0, "en", "a", "x = 1"), (1, "fr", "a a", "x")], "row_id bigint, lang string, text string, labels string")
    got = {r.row_id: r for r in E.encode_pairs(df, vocab, LANGS, max_length=6).collect()}
    assert got[0].lang_id == 6 and got[1].lang_id == 8
    x = ids(vocab, "x")[0]
    assert got[1].labels == [0, x, 2, -100, -100, -100] and len(got[1].input_ids) == 6
    other = spark.createDataFrame([("xx",)], "lang string")
    assert E.lang_to_id(other, vocab, LANGS).first().lang_id == 3
    assert E.start_id(vocab, "fr") == 7


def brute_pack(rows, chunk, group):
    out = []
    for g in range(0, len(rows), group):
        flat = [v for r in rows[g:g + group] for v in r]
        total = len(flat) // chunk * chunk if len(flat) >= chunk else len(flat)
        out += [flat[i:i + chunk] for i in range(0, total, chunk)]
    return out


@pytest.mark.parametrize("chunk,group", [(4, 1000), (4, 3), (7, 5), (1000, 2), (3, 1)])
def test_pack_against_brute_force(spark, chunk, group):
    rng = random.Random(chunk * group)
    rows = [[rng.randint(5, 99) for _ in range(rng.choice([0, 1, 3, 12, 30]))] for _ in range(17)]
    df = spark.createDataFrame([(i * 3, r, [i] * len(r)) for i, r in enumerate(rows)],
                               "row_id bigint, input_ids array<int>, word_ids array<int>").repartition(3)
    out = pack_chunks(df, ("input_ids", "word_ids"), chunk, group).orderBy("pack_group", "chunk").collect()
    assert [r.input_ids for r in out] == brute_pack(rows, chunk, group)
    assert all(r.labels == r.input_ids and [w * 3 for w in r.word_ids] == r.row_ids for r in out)


def test_align_and_shift(spark):
    df = spark.createDataFrame([([1, 0, 3], [None, 0, 0, 1, 2, 2, None]), ([2], [None, None])], "tags array<int>, word_ids array<int>")
    assert [r.labels for r in L.align_labels(df).collect()] == [[-100, 1, 2, 0, 3, 4, -100], [-100, -100]]
    assert L.shift_labels(spark.createDataFrame([([0, 1, 2, 3],)], "tags array<int>")).first().tags == [0, 1, 3, 3]
    named = L.label_names(spark.createDataFrame([([0, -100, 16, 3],)], "tags array<int>"))
    assert named.first().names == ["O", "I-CONS", "B-FUNC"]
    assert L.label_ids(named.drop("tags")).first().tags == [0, 16, 3]


def test_whole_word_mask(spark):
    rows = [(i, [0] + [10 + j for j in range(12)] + [2], [None] + [j // 2 for j in range(12)] + [None]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, input_ids array<int>, word_ids array<int>")
    out = M.whole_word_mask(df, ["row_id"], 0.15, 1).collect()
    masked = 0
    for r in out:
        for a in range(1, 13, 2):
            one, two = (r.input_ids[a], r.labels[a]), (r.input_ids[a + 1], r.labels[a + 1])
            assert (one[0] == 4) == (two[0] == 4)
            assert one == ((4, 9 + a) if one[0] == 4 else (9 + a, -100))
            masked += one[0] == 4
        assert r.input_ids[0] == 0 and r.labels[0] == -100 and r.input_ids[-1] == 2
    assert 0.12 < masked / 2400 < 0.18
    every = M.whole_word_mask(df, ["row_id"], 1.1, 1).first()
    assert every.input_ids == [0] + [4] * 12 + [2]


def test_packed_rows_keep_their_words_apart(spark):
    rows = [(i, [10, 11], [0, 0], [1, 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "c bigint, input_ids array<int>, word_ids array<int>, row_ids array<bigint>")
    out = M.whole_word_mask(df, ["c"], 0.5, 1, "row_ids").collect()
    kinds = Counter((r.input_ids[0] == 4, r.input_ids[1] == 4) for r in out)
    assert len(kinds) == 4  # one draw would know two kinds only


def test_token_mask(spark):
    df = spark.createDataFrame([(i, [0] + [20] * 50 + [2, 1]) for i in range(200)], "row_id bigint, input_ids array<int>")
    out = M.token_mask(df, ["row_id"], 100, 9, 0.15, 3).collect()
    new = Counter("mask" if v == 4 else "same" if v == 20 else "other"
                  for r in out for v, l in zip(r.input_ids, r.labels) if l == 20)
    total = sum(new.values())
    assert 0.13 < total / 10_000 < 0.17 and 0.75 < new["mask"] / total < 0.85
    assert all(r.input_ids[0] == 0 and r.input_ids[-2:] == [2, 1] and r.labels[0] == -100 for r in out)
    assert all(v >= 9 or v == 4 for r in out for v in r.input_ids[1:-2])
    test = df.withColumn("split", F.when(F.col("row_id") < 10, "test").otherwise("train"))
    frozen = M.masked_eval_set(test.withColumn("word_ids", F.col("input_ids")), ["row_id"], 3)
    assert frozen.count() == 10 and "word_ids" not in frozen.columns


def test_frequencies(spark, vocab):
    a, b, c = ids(vocab, "a", "x", "=")
    df = spark.createDataFrame([("en", [1] * 50 + [a] * 10 + [b] * 5 + [c] * 5), ("fr", [c, c, b]), ("de", [a])], "lang string, input_ids array<int>")
    freq = token_frequency(df, "en")
    assert {(r.lang, r.token_id): r.freq for r in freq.collect()} == {
        ("en", 1): 50, ("en", a): 10, ("en", b): 5, ("en", c): 5, ("other", c): 2, ("other", b): 1, ("other", a): 1}
    top = top_k_tokens(freq, vocab, 3)
    side = top_k_side_by_side(top, "en", "other")
    assert [(r.token_1, r.token_2) for r in side.orderBy("rank").collect()] == [("a", "="), ("x", "a")]  # padding took a place
    probs = token_probabilities(zipped_long(side, "en", "other")).where("lang = 'en'").orderBy("rank").collect()
    assert [round(r.prob, 6) for r in probs] == [0.666667, 0.333333]


def test_workers_need_not_find_the_package(tmp_path):
    """The same lookup from a folder where workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from duolex.operators.encode import encode
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.session import build_session
spark = build_session("far", "local[1]", **{{"spark.ui.enabled": "false"}})
df = spark.createDataFrame([(0, "a b")], "row_id bigint, text string")
print("IDS", encode(df, learn_vocab(word_counts(df), 9, ["en"])).first().input_ids)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "IDS [0, 7, 8, 2]" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("kind,values", [
    ("int", [5, -7, 0, 2**31 - 1, -2**31]), ("string", ["b", "a", "", "é", "##c"]), ("array<int>", [[3, 1], [], [-4], [2**31 - 1], [0, 0, 0]])])
def test_cells_come_back_in_order(spark, kind, values):
    """Values by place, equal places by value, null ids apart; no task gathers before it sends."""
    rows = [(i % 3 or None, p, values[(p + i) % 5]) for i in range(6) for p in range(40)]
    random.Random(1).shuffle(rows)
    out = E._lists(spark.createDataFrame(rows, f"row_id bigint, _p int, _v {kind}").repartition(5), "row_id")
    assert {r.row_id: r._l for r in out.collect()} == {k: [v for _, v in sorted(x[1:] for x in rows if x[0] == k)] for k in (1, 2, None)}
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "Exchange" not in lines[next(i for i, x in enumerate(lines) if "partial_collect_list" in x) - 1]


def test_learned_pieces_come_back_as_ids(spark, monkeypatch):
    """Words of no segment stay whole and are known if the vocabulary has them; only numbers travel to the row."""
    monkeypatch.setattr(E, "HOT_WORDS", 1)
    df = spark.createDataFrame([(0, "ab cd ab zz yy"), (1, None), (None, "ab")], "row_id bigint, text string")
    segments = spark.createDataFrame([("ab", 5, ["a", "b"]), ("cd", 1, ["cd"])], "word string, n bigint, pieces array<string>")
    vocab = spark.createDataFrame([(4, "a", False), (5, "##b", False), (6, "yy", False), (7, "yy", False)], VOCAB_SCHEMA)
    out = E.encode_learned(df, segments, vocab)
    got = {r.row_id: (r.input_ids, r.word_ids) for r in out.collect()}
    assert got[0] == ([0, 4, 5, 3, 4, 5, 3, 6, 2], [None, 0, 0, 1, 2, 2, 3, 4, None])
    assert got[1][0] == [0, 2] and got[None][0] == [0, 2]
    assert E.encode_learned(df, segments, vocab, max_length=4).where("row_id = 0").first().input_ids == [0, 4, 5, 2]
    assert dict(E._segmented(df, segments, vocab, "text", "row_id").dtypes)["_words"] == "array<array<int>>"
