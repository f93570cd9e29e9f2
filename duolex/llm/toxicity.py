"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary text, read each word.  Up
to three characters they share their counts, so that rare expressions fall back
on the same ground; longer contexts are counted per class.  A word's
log-likelihood ratio is divided by its length; a document is described by the
ratio per character of all its words and of the words that stand out most, and a
logistic curve, fitted on rows that neither model has seen, turns that into a score.

All n-grams of all learning rows count, whatever their number: levels, discounts
and back-off weights are tables.  A distinct word is read once through them, by joins
on its n-grams, a bounded bucket of words at a time.  The words that the learning rows use
most are read first and travel as a broadcast of bounded size; the others of each text are
joined by word.  The bound has no influence on the result.
"""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duolex.llm.language_id import held_out_fold
from duolex.llm.token_counts import head_bound
from duolex.session import materialise, small_batches

ORDER = 6
SHARED = 3  # characters up to which both classes share their counts
WORD = re.compile(r"\w+")
TOP = 3  # words that stand out
CACHE = 200_000  # n-grams or short words counted before they are sent on, about 20 MB
SENT = 20_000  # rows of a record batch
BUCKET = 1_000_000  # characters of words that are read together
LONG = 32  # characters from which a word is named by its digest
UNIT = 1 << 26  # log-likelihoods are added up as whole numbers, in any order


def class_counts(first, second, name):
    """Two counters as record batches (name, c0, c1)."""
    keys = list(first.keys() | second.keys())
    for at in range(0, len(keys), SENT):
        some = keys[at:at + SENT]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.string())] + [pa.array([c[k] for k in some], pa.int64()) for c in (first, second)], names=[name, "c0", "c1"])


def count_words(labelled: DataFrame) -> DataFrame:
    """(toxic, text) to (word, c0, c1): how often each class uses a word."""

    def run(batches):
        counts, long = (Counter(), Counter()), 0
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1)):
                words = WORD.findall(text.as_py().lower())
                counts[toxic.as_py()].update(words)
                long += sum(len(w) for w in words if len(w) > LONG)
                if len(counts[0]) + len(counts[1]) + long // 100 > CACHE:
                    yield from class_counts(*counts, "word")
                    counts, long = (Counter(), Counter()), 0
        yield from class_counts(*counts, "word")

    return small_batches(labelled).mapInArrow(run, "word string, c0 bigint, c1 bigint").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def count_grams(words: DataFrame) -> DataFrame:
    """(gram, c0, c1): the longest n-gram that ends at each character of a word."""

    def run(batches):
        counts = Counter(), Counter()
        for batch in batches:
            for word, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                padded = f"^{word}$"
                for i in range(1, len(padded)):
                    gram = padded[max(0, i - ORDER + 1):i + 1]
                    if a:
                        counts[0][gram] += a
                    if b:
                        counts[1][gram] += b
                if len(counts[0]) + len(counts[1]) > CACHE:
                    yield from class_counts(*counts, "gram")
                    counts = Counter(), Counter()
        yield from class_counts(*counts, "gram")

    return small_batches(words).mapInArrow(run, "gram string, c0 bigint, c1 bigint").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def gram_levels(grams: DataFrame) -> dict[int, DataFrame]:
    """Length to (gram, k0, k1).  Grams that begin a word count how often they
    stand there, the longest ones too; all others in how many contexts they continue."""
    levels = {}
    for n in range(ORDER, 0, -1):
        level = grams.where(F.char_length("gram") == n).select("gram", F.col("c0").alias("k0"), F.col("c1").alias("k1"))
        if n < ORDER:
            continued = levels[n + 1].select(
                F.expr("substring(gram, 2)").alias("gram"), *[(F.col(k) > 0).cast("bigint").alias(k) for k in ("k0", "k1")])
            level = level.unionByName(continued).groupBy("gram").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
        levels[n] = materialise(level, f"toxic-level-{n}")
    for n in range(1, SHARED + 1):
        both = F.col("k0") + F.col("k1")
        levels[n] = levels[n].select(
            "gram", *[F.when(F.col("gram").startswith("^"), F.col(k)).otherwise(both).alias(k) for k in ("k0", "k1")])
    return levels


def ratio_tables(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (gram, ratio): log P1/P0 of its last character, and (context, backoff): log of the
    back-off weights' ratio."""
    levels = gram_levels(grams)
    every = None
    for n, level in levels.items():
        level = level.withColumn("n", F.lit(n))
        every = level if every is None else every.unionByName(level)
    spread = {r["n"]: r for r in every.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(F.when(F.col(f"k{c}") == m, 1)).alias(f"s{c}{m}") for c in (0, 1) for m in (1, 2)]).collect()}

    def discount(n, c):
        one, two = (spread[n][f"s{c}{m}"] if n in spread else 0 for m in (1, 2))
        return one / (one + 2 * two) if one and two else 0.75

    n_chars = (spread[1]["rows"] if 1 in spread else 0) + 1
    contexts = every.groupBy(F.expr("substring(gram, 1, n - 1)").alias("context")).agg(F.max("n").alias("n"), *[
        f.alias(f"{name}{c}") for c in (0, 1) for name, f in (("t", F.sum(f"k{c}")), ("kinds", F.count(F.when(F.col(f"k{c}") > 0, 1))))])
    weights = [
        F.when(F.col(f"t{c}") > 0, F.array(*[F.lit(discount(n, c)) for n in range(1, ORDER + 1)])[F.col("n") - 1]
               * F.col(f"kinds{c}") / F.col(f"t{c}")).alias(f"w{c}") for c in (0, 1)]
    contexts = materialise(contexts.select("context", "n", "t0", "t1", *weights), "toxic-contexts")
    ratios, lower = None, None
    for n in range(1, ORDER + 1):
        level = levels[n].withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        level = level.join(contexts.where(F.col("n") == n).drop("n"), "context")
        if n == 1:
            level = level.withColumns({"p0": F.lit(1 / n_chars), "p1": F.lit(1 / n_chars)})
        else:
            level = level.withColumn("tail", F.expr("substring(gram, 2)")).join(lower.withColumnRenamed("gram", "tail"), "tail")
        p = [F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"k{c}") - discount(n, c), F.lit(0.0)) / F.col(f"t{c}") + F.col(f"w{c}") * F.col(f"p{c}"))
             .otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1)]
        lower = materialise(level.select("gram", *p), f"toxic-p-{n}")
        ratio = lower.select("gram", F.log(F.col("p1") / F.col("p0")).alias("ratio"))
        ratios = ratio if ratios is None else ratios.unionByName(ratio)
    one = F.lit(1.0)
    backoff = F.log(F.coalesce("w1", one) / F.coalesce("w0", one))
    return ratios, contexts.where("context != ''").select("context", backoff.alias("backoff"))


def word_key(word):
    """A word's name in joins; long words would travel once for each of their n-grams."""
    return word if len(word) <= LONG else "#" + hashlib.md5(word.encode()).hexdigest()


def windows_of(word):
    """The n-gram that ends at each character of a word, filled up to ORDER characters on
    its left with marks that no n-gram of the model has."""
    padded = "^" * (ORDER - 1) + word + "$"
    return [padded[i:i + ORDER] for i in range(len(word) + 1)]


def units(ratio):
    return F.round(ratio * UNIT).cast("bigint")


def read_grams(grams: DataFrame, ratios: DataFrame, backoffs: DataFrame) -> DataFrame:
    """Distinct filled (gram) to (gram, u): the ratio of its last character in whole units,
    from the longest n-gram that the model knows and the weights of the longer contexts."""
    parts = grams.select(F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("n"), "gram")
    parts = parts.select("n", F.expr("substring(gram, -n)").alias("gram")).distinct()
    parts = parts.join(ratios, "gram", "left").withColumn("context", F.expr("substring(gram, 1, n - 1)"))
    parts = materialise(parts.join(backoffs, "context", "left").select("n", "gram", "ratio", "backoff"), "toxic-parts")
    read = None
    for n in range(1, ORDER + 1):
        part = parts.where(F.col("n") == n)
        fallback = F.lit(0.0)
        if read is not None:
            part = part.withColumn("tail", F.expr("substring(gram, 2)")).join(
                read.select(F.col("gram").alias("tail"), F.col("s").alias("lower")), "tail")
            fallback = F.coalesce("backoff", F.lit(0.0)) + F.col("lower")
        read = part.select("gram", F.coalesce("ratio", fallback).alias("s"))
    return read.select("gram", units(F.col("s")).alias("u"))


def word_totals(words: DataFrame, ratios: DataFrame, backoffs: DataFrame) -> DataFrame:
    """Distinct (word) to (key, chars, total): its log-likelihood ratio is total / UNIT.

    Words are dealt into buckets of about BUCKET characters.  A bucket asks once for each
    of its n-grams, and adds up its words when the answers have come.
    """
    words = small_batches(materialise(words.select("word"), "toxic-words"))
    n_chars = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    words = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(n_chars // BUCKET + 1)))

    def asked(group):
        found = {g for word in group.column("word").to_pylist() for g in windows_of(word)}
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()] * len(found), pa.int64()), "gram": pa.array(list(found), pa.string())})

    def added(group, answers):
        known = dict(zip(answers.column("gram").to_pylist(), answers.column("u").to_pylist()))
        own = group.column("word").to_pylist()
        return pa.table({"key": pa.array([word_key(w) for w in own], pa.string()), "chars": pa.array([len(w) + 1 for w in own], pa.int64()),
                         "total": pa.array([sum(map(known.__getitem__, windows_of(w))) for w in own], pa.int64())})

    asks = materialise(words.groupBy("bucket").applyInArrow(asked, "bucket bigint, gram string"), "toxic-asks")
    answers = asks.join(read_grams(asks.select("gram").distinct(), ratios, backoffs), "gram")
    totals = words.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(added, "key string, chars bigint, total bigint")
    return materialise(totals, "toxic-totals")


def fit_logistic(x, y, ridge=1e-2, rounds=50):
    """Weights (intercept last) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] / scale * mean).sum())


def small_labels(labels: DataFrame, max_rows=5_000_000) -> DataFrame:
    """Narrow labels, broadcast if they prove to be few; else the join shuffles."""
    return F.broadcast(labels) if labels.count() <= max_rows else labels


def word_features(words, known):
    """Of a list of words: characters read, total of the known ones, leading ratios of the known ones, the others' counts."""
    chars, total, leading, rare = 0, 0, [], []
    for word, n in Counter(words).items():
        chars += (len(word) + 1) * n
        found = known.get(word)
        if found is None:
            rare.append({"word": word, "times": n})
        else:
            total += found * n
            leading.append(found / UNIT / (len(word) + 1))
    return chars, total, sorted(leading, reverse=True)[:TOP], rare


class ToxicityModel:
    """Two models and a curve.  Counting goes over all labelled rows of folds 1 to
    3 (of five; fold 0 is held out) and keeps every n-gram; the curve is fitted on
    fold 4, on at most about ``max_curve_rows`` rows of it.  ``max_words`` bounds the
    broadcast table of frequent words, all others are joined by shuffle.

    ``features`` describes the rows of ``docs`` once: for the curve, and for what asks for the
    same rows again.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", max_words=200_000, max_curve_rows=20_000):
        toxic = (
            labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
            .withColumn("fold", held_out_fold("doc_id", 5)).where("fold > 0")
            .groupBy(F.col("doc_id").alias("l_"), "fold").agg(F.max("toxic").cast("int").alias("toxic"))
        )
        toxic = small_labels(materialise(toxic, "toxic-labels"))
        n_curve = toxic.where("fold = 4").count()
        rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k_"), F.col(text).alias("text"))
        labelled = rows.join(toxic.where("fold < 4"), F.col("k_") == F.col("l_"))
        words = materialise(count_words(labelled.select("toxic", "text")), "toxic-counts")
        self.ratios, self.backoffs = ratio_tables(materialise(count_grams(words), "toxic-grams"))
        words = words.select("word", (F.col("c0") + F.col("c1")).alias("n")).where(F.char_length("word") <= LONG)
        frequent = words.where(F.col("n") >= head_bound(words, max_words))
        frequent = word_totals(frequent, self.ratios, self.backoffs).select("key", "total").toArrow()  # max_words at most
        self.known = dict(zip(*(c.to_pylist() for c in frequent.columns)))
        self.docs, self.key, self.text = docs, key, text
        self.features = materialise(self.described(self.named(docs, key, text)), "toxic-features")
        share = F.pmod(F.xxhash64("l_"), F.lit(max(n_curve, 1))) < max_curve_rows
        curve = self.features.where("filled_").join(toxic.where("fold = 4").where(share), F.col("k_") == F.col("l_"))
        curve = curve.select("toxic", "whole", "top", "leading").toArrow()
        y = curve.column("toxic").to_numpy().astype(float)
        x = np.stack([curve.column(c).to_numpy() for c in ("whole", "top", "leading")], axis=1)
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
        # one class only, or no rows: the curve is flat at the share of toxic rows
        self.curve = fit_logistic(x, y) if 0 < y.sum() < len(y) else np.array([0.0, 0.0, 0.0, 10.0 if len(y) and y.all() else -10.0])

    @staticmethod
    def named(docs, key, text):
        return docs.select(F.col(key).alias("k_"), text_digest(text).alias("digest_"), F.col(text).isNotNull().alias("filled_"), F.col(text).alias("text"))

    def rows_described(self, docs, key, text):
        """(k_, digest_, filled_, whole, top, leading) of every row."""
        if docs is self.docs and (key, text) == (self.key, self.text):
            return self.features
        return self.described(self.named(docs, key, text))

    def described(self, rows: DataFrame) -> DataFrame:
        """(id, .., text) to (id, .., whole, top, leading): ratio per character of the
        whole text, of its leading word, and of its leading words together."""
        head = rows.sparkSession.sparkContext.broadcast(self.known)
        names = [c for c in rows.columns if c != "text"]
        rows = rows.select(*names, F.monotonically_increasing_id().alias("row_"), "text")
        added = "chars bigint, known bigint, leading array<double>, rare array<struct<word: string, times: bigint>>"
        schema = StructType(rows.drop("text").schema.fields + StructType.fromDDL(added).fields)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))]

        def run(batches):
            known = head.value
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    found = [word_features(WORD.findall((t.as_py() or "").lower()), known) for t in part.column(part.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays(
                        part.columns[:-1] + [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=schema.names)

        parts = materialise(small_batches(rows).mapInArrow(run, schema), "toxic-rows")
        head.unpersist()
        key = F.when(F.char_length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit("#"), F.md5("word")))
        rare = parts.select("row_", F.inline("rare"))
        totals = word_totals(rare.select("word").distinct(), self.ratios, self.backoffs)
        rare = rare.select("row_", "times", key.alias("key")).join(totals, "key").groupBy("row_").agg(
            F.sum(F.col("times") * F.col("total")).alias("others"),
            F.slice(F.sort_array(F.collect_list(F.col("total") / UNIT / F.col("chars")), False), 1, TOP).alias("more"))
        both = F.slice(F.sort_array(F.concat("leading", F.coalesce("more", F.array().cast("array<double>"))), False), 1, TOP)
        total = F.col("known") + F.coalesce("others", F.lit(0))
        read = parts.drop("rare").join(rare, "row_", "left").withColumn("leading", both)
        some = F.col("chars") > 0
        whole = F.when(some, total / UNIT / F.col("chars")).otherwise(0.0)
        top = F.when(some, F.get("leading", F.lit(0))).otherwise(0.0)
        return read.select(*names, whole.alias("whole"), top.alias("top"),
                           (F.aggregate("leading", F.lit(0.0), lambda s, v: s + v) / TOP).alias("leading"))

    def margin(self):
        """The curve's log-odds; toxic from 0."""
        a, b, c, d = (float(v) for v in self.curve)
        return F.col("whole") * a + F.col("top") * b + F.col("leading") * c + d

    def score(self, docs: DataFrame, *, key="doc_id", text="text") -> DataFrame:
        """One row per row of ``docs``: (doc_id, held_out, score, predicted).

        Null and empty texts, and texts without a word, get the score of neutral
        words.  Repeated rows are scored each; an empty table gives an empty result.
        """
        z = F.greatest(F.least(self.margin(), F.lit(700.0)), F.lit(-700.0))
        scored = self.rows_described(docs, key, text).withColumn("score", 1 / (1 + F.exp(-z)))
        return scored.select(F.col("k_").alias("doc_id"), (held_out_fold("k_", 5) == 0).alias("held_out"), "score",
                             (F.col("score") >= 0.5).cast("int").alias("predicted"))


def text_digest(text):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, key="doc_id", text="text", max_broadcast=500_000) -> DataFrame:
    """``docs`` without those that the model calls toxic; all columns stay.

    Toxic texts come back as digests, broadcast if they prove to be few, so that texts
    are not shuffled then.  Null and empty texts and texts without a word are neutral and stay; repeated
    rows go or stay together; null ids are judged like others; an empty table stays empty.
    """
    names = docs.columns
    judged = model.rows_described(docs, key, text)
    toxic = materialise(judged.where(model.margin() >= 0).select(F.col("digest_").alias("toxic_")).distinct(), "toxic-texts")
    toxic = small_labels(toxic, max_broadcast)
    marked = docs.select(F.struct(*names).alias("row_"), text_digest(text).alias("digest_"))
    kept = marked.join(toxic, F.col("digest_") == F.col("toxic_"), "left_anti")
    return kept.select(*[F.col("row_").getField(n).alias(n) for n in names])
