"""Corpus-level scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.functions import text as X
from duolex.operators.encode import decode
from duolex.operators.grams import row_totals
from duolex.operators.index import global_index
from duolex.schemas import IGNORE, PAD
from duolex.session import materialise, small_batches

MAX_ORDER = 4
_GRAM_MARK = "\u0001"
_SHARES = ("matched", "in_prediction", "in_reference")


def decode_predictions(df: DataFrame, vocab: DataFrame, col="labels", out="text", id_col="row_id") -> DataFrame:
    """Ignored positions become padding; decoded without specials and trimmed."""
    clean = df.withColumn("_l", F.transform(F.col(col), lambda x: F.when(x == IGNORE, F.lit(PAD)).otherwise(x)))
    return decode(clean, vocab, "_l", out, id_col=id_col).withColumn(out, X.strip(F.col(out))).drop("_l")


def bleu_tokens(text: Column) -> Column:
    """The usual BLEU tokens: punctuation apart, except inside numbers."""
    t = F.replace(text, F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([{-~\[-` -&(-+:-@/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return plain_tokens(t)


def plain_tokens(text: Column) -> Column:
    """Split on white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+", -1), lambda t: t != "")


def _grams(tokens: Column, max_order: int, side: str) -> Column:
    """(n, gram, in prediction, in reference) for every n-gram position."""

    def order(n):
        return F.transform(
            A.positions(F.size(tokens) - (n - 1)),
            lambda i: F.struct(
                F.lit(n).alias("n"),
                F.array_join(F.slice(tokens, i + 1, F.lit(n)), _GRAM_MARK).alias("gram"),
                F.lit(int(side == "hyp")).cast("bigint").alias("h"),
                F.lit(int(side == "ref")).cast("bigint").alias("r"),
            ),
        )

    return F.concat(*[order(n) for n in range(1, max_order + 1)])


def ngram_totals(df: DataFrame, keys=("pair_id",), by=(), max_order=MAX_ORDER, tokenize=bleu_tokens,
                 keywords=None, other=0.2, prediction="prediction", reference="reference") -> DataFrame:
    """(by.., n, matched, in_prediction, in_reference) over all pairs.

    The rows of a pair are brought together.  A row that is its pair's only one has its
    n-grams counted inside it; of the others n-grams are added up by pair.  With
    ``keywords``, single words weigh 1 in the list and ``other`` outside it.
    """
    by = list(by)
    pair = [*by, *keys]
    texts = [F.col(prediction).alias("_p"), F.col(reference).alias("_q")]
    # counted before the rows move: behind a Python call Spark would deal them out again
    rows = df.select(*pair, *texts).select("*", tokenize(F.col("_p")).alias("_h"), tokenize(F.col("_q")).alias("_r"))
    rows = small_batches(rows).select("*", F.explode(F.array(row_totals(max_order, keywords, other)("_h", "_r"))).alias("_s"))
    rows = rows.drop("_h", "_r").repartition(*pair).withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(*pair)))
    # words with the mark inside would not stay apart in a joined n-gram
    marked = F.contains(F.concat_ws("", "_p", "_q"), F.lit(_GRAM_MARK))
    rows = rows.withColumn("_alone", (F.col("_rows") == 1) & ~marked)
    rows = rows.select(*pair, "_alone", "_s", *[
        F.when(~F.col("_alone"), tokenize(F.col(c))).alias(side) for c, side in (("_p", "_h"), ("_q", "_r"))
    ])
    inside = F.transform(
        F.filter("_s", lambda t: t["hyp_len"] + t["ref_len"] > 0),
        lambda t: F.struct(
            t["n"].alias("n"), F.lit(None).cast("string").alias("gram"), t["hyp_len"].alias("h"), t["ref_len"].alias("r"),
            *[t[c].alias(c) for c in _SHARES],
        ),
    )
    across = F.transform(
        F.concat(_grams(F.col("_h"), max_order, "hyp"), _grams(F.col("_r"), max_order, "ref")),
        lambda g: F.struct(g["n"], g["gram"], g["h"], g["r"], *[F.lit(0.0).alias(c) for c in _SHARES]),
    )
    grams = rows.select(*pair, F.inline(F.when(F.col("_alone"), inside).otherwise(across)))
    counted = grams.groupBy(*pair, "n", "gram").agg(
        *[F.sum(c).alias(c) for c in ("h", "r", *_SHARES)]
    )
    weight = F.lit(1.0)
    if keywords is not None:
        weight = F.when((F.col("n") > 1) | F.col("gram").isin(*keywords), F.lit(1.0)).otherwise(F.lit(float(other)))
    counts = (F.least("h", "r"), F.col("h"), F.col("r"))
    return counted.groupBy(*by, "n").agg(
        *[F.sum(F.when(F.col("gram").isNull(), F.col(c)).otherwise(n * weight)).alias(c) for c, n in zip(_SHARES, counts)],
        F.sum(F.when(F.col("n") == 1, F.col("h"))).alias("hyp_len"),
        F.sum(F.when(F.col("n") == 1, F.col("r"))).alias("ref_len"),
    )


def score_totals(totals: DataFrame, by=(), max_order=MAX_ORDER, out="bleu", against="in_prediction") -> DataFrame:
    """Brevity penalty times the geometric mean of the n-gram shares; 0 if one is 0."""
    share = F.col("matched") / F.col(against)
    grouped = totals.groupBy(*by) if by else totals.groupBy()
    sums = grouped.agg(
        F.count_if((F.col(against) > 0) & (F.col("matched") > 0)).alias("_orders"),
        F.sum(F.when((F.col(against) > 0) & (F.col("matched") > 0), F.ln(share))).alias("_logs"),
        F.max("hyp_len").alias("hyp_len"),
        F.max("ref_len").alias("ref_len"),
    )
    bp = F.when(F.col("hyp_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("ref_len") / F.nullif(F.col("hyp_len"), F.lit(0)))
    )
    score = F.when(F.col("_orders") < max_order, F.lit(0.0)).otherwise(bp * F.exp(F.col("_logs") / max_order))
    return sums.select(*by, score.alias(out), "hyp_len", "ref_len")


def corpus_bleu(df: DataFrame, keys=("pair_id",), by=(), max_order=MAX_ORDER, tokenize=bleu_tokens) -> DataFrame:
    return score_totals(ngram_totals(df, keys, by, max_order, tokenize), by, max_order)


def weighted_ngram_match(df: DataFrame, keywords, other=0.2, keys=("pair_id",), by=(), max_order=MAX_ORDER,
                         against="in_prediction") -> DataFrame:
    """BLEU over white-space tokens with single words weighted by the keyword list.

    ``against='in_reference'`` takes the shares of the reference's n-grams instead.
    """
    totals = ngram_totals(df, keys, by, max_order, plain_tokens, keywords, other)
    return score_totals(totals, by, max_order, "weighted_ngram_match", against)


def combined_code_score(df: DataFrame, weights=(0.25, 0.25, 0.25, 0.25),
                        cols=("ngram_match", "weighted_ngram_match", "syntax_match", "dataflow_match"),
                        out="code_score") -> DataFrame:
    """Weighted sum of the component scores; syntax and data-flow scores are inputs."""
    total = F.lit(0.0)
    for w, c in zip(weights, cols):
        total = total + F.lit(float(w)) * F.col(c)
    return df.withColumn(out, total)


def prediction_table(candidates: DataFrame, references: DataFrame, key="pair_id") -> DataFrame:
    """Every candidate beside the reference of its own source."""
    return candidates.join(references, key).select(
        key, "candidate_no", F.col("reference").alias("label"), "prediction"
    )


def _spans(tags: Column) -> Column:
    """Entity spans (kind, start, end) of a tag-id array."""
    return A.let(tags, _spans_of)


def _spans_of(tags: Column) -> Column:
    def kind(t):
        return F.floor((t + 1) / 2)

    def boundary(t, i):
        return (t == 0) | (t % 2 == 1) | (i == 0) | (kind(F.get(tags, i - 1)) != kind(t))

    breaks = F.concat(
        F.filter(
            F.transform(tags, lambda t, i: F.when(boundary(t, i), i)), lambda p: p.isNotNull()
        ),
        F.array(F.size(tags)),
    )

    def spans(b):
        ends = F.transform(
            b,
            lambda p, k: F.when(
                F.coalesce(F.get(tags, p), F.lit(0)) != 0,
                F.struct(
                    kind(F.get(tags, p)).cast("int").alias("kind"), p.cast("int").alias("start"),
                    F.get(b, k + 1).cast("int").alias("end"),
                ),
            ),
        )
        return F.filter(ends, lambda v: v.isNotNull())

    return A.let(breaks, spans)


def entity_prf(df: DataFrame, true="labels", pred="predictions", by=()) -> DataFrame:
    """Entity precision, recall, F1 and token accuracy; positions whose true tag is
    ignored are left out.  Spans are matched inside their row."""
    both = F.filter(F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p")), lambda z: z["t"] != IGNORE)
    rows = df.select(*by, both.alias("_z"))
    rows = rows.select(*by, F.col("_z.t").alias("t"), F.col("_z.p").alias("p"))
    counts = rows.select(
        *by,
        F.size("t").alias("n"),
        F.size(F.filter(F.zip_with("t", "p", lambda a, b: a == b), lambda e: e)).alias("same"),
        _spans(F.col("t")).alias("st"), _spans(F.col("p")).alias("sp"),
    ).select(
        *by, "n", "same", F.size("st").alias("n_true"), F.size("sp").alias("n_pred"),
        F.size(F.array_intersect("st", "sp")).alias("tp"),
    )
    grouped = counts.groupBy(*by) if by else counts.groupBy()
    s = grouped.agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true", "same", "n")])

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return s.select(
        *by,
        ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        ratio(F.col("tp"), F.col("n_true")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_true")).alias("f1"),
        ratio(F.col("same"), F.col("n")).alias("accuracy"),
        "tp", "n_pred", "n_true",
    )


def argmax_labels(df: DataFrame, scores="scores", out="label") -> DataFrame:
    """Position of the first largest score."""
    return df.withColumn(out, (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int"))


def perplexity(losses: DataFrame, by=("run_id", "epoch"), loss="loss", rows="n_rows") -> DataFrame:
    """exp of the row-weighted mean loss; infinite where exp overflows."""
    return losses.groupBy(*by).agg(
        F.exp(F.sum(F.col(loss) * F.col(rows)) / F.sum(rows)).alias("perplexity"),
        F.sum(rows).alias("n_rows"),
    )


def early_stop(metrics: DataFrame, threshold=0.0, patience=5, direction="min", run="run_id",
               epoch="epoch", value="value", block=10_000) -> DataFrame:
    """Epoch at which each run stops (null: never).

    Fold over the run's epochs: an improvement of at least ``threshold`` resets
    the counter, anything else counts up to ``patience``.  Input: one row per run
    and epoch.  Runs longer than ``block`` epochs are folded block after block, so
    that no task holds a whole long run.
    """
    sign = 1.0 if direction == "min" else -1.0
    rows = metrics.select(run, F.col(epoch).cast("bigint").alias("_e"), (F.col(value) * sign).alias("_v"))
    longest = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 1
    blocks = -(-longest // block)
    if blocks == 1:
        rows = rows.withColumn("_b", F.lit(0))
    else:
        rows = global_index(rows, "_e", [run], out="_i").withColumn("_b", A.div(F.col("_i"), block))
        rows = materialise(rows, "epochs")
    start = F.struct(
        F.lit(float("inf")).alias("low"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"),
        F.lit(0).cast("bigint").alias("n"),
    )

    def step(acc, x):
        better = acc["low"] - x["v"] >= threshold
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        return F.struct(
            F.when(better, x["v"]).otherwise(acc["low"]).alias("low"),
            bad.alias("bad"),
            F.when(acc["stop"].isNull() & (bad >= patience), x["e"]).otherwise(acc["stop"]).alias("stop"),
            (acc["n"] + 1).alias("n"),
        )

    state = None
    for b in range(blocks):
        series = rows.where(F.col("_b") == b).groupBy(run).agg(
            F.array_sort(F.collect_list(F.struct(F.col("_e").alias("e"), F.col("_v").alias("v")))).alias("_l")
        )
        if state is None:
            state = series.select(run, F.aggregate("_l", start, step).alias("_st"))
            continue
        # a run that ended in an earlier block keeps its state
        state = materialise(state, "folded").join(series, run, "left").select(
            run, F.when(F.col("_l").isNull(), F.col("_st")).otherwise(F.aggregate("_l", F.col("_st"), step)).alias("_st")
        )
    return state.select(
        run, F.col("_st.stop").cast(metrics.schema[epoch].dataType).alias("stop_epoch"), F.col("_st.n").alias("n_epochs")
    )


def best_epoch(metrics: DataFrame, direction="min", run="run_id", epoch="epoch", value="value") -> DataFrame:
    """Epoch of the strictly best score (the earliest of equals)."""
    if direction == "min":
        best = F.min_by(F.struct(epoch, value), F.struct(F.col(value), F.col(epoch)))
    else:
        best = F.max_by(F.struct(epoch, value), F.struct(F.col(value), -F.col(epoch)))
    return metrics.groupBy(run).agg(best.alias("_b")).select(
        run, F.col(f"_b.{epoch}").alias("best_epoch"), F.col(f"_b.{value}").alias("best_value")
    )


def distinct_lengths(df: DataFrame, col="input_ids") -> DataFrame:
    return df.select(F.size(col).alias("length")).distinct()


def metric_report(metrics: DataFrame, names, percent=(), keys=("run_id", "epoch", "split")) -> DataFrame:
    """One row per epoch and split, one column per metric, rounded to 6 digits; those
    in ``percent`` times 100."""
    wide = metrics.groupBy(*keys).pivot("metric", list(names)).agg(F.max("value"))
    for n in names:
        rounded = F.round(F.col(n), 6)
        wide = wide.withColumn(n, rounded * 100 if n in percent else rounded)
    return wide
