"""Scores and metric tables."""

from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.functions.rng import mix, mix_uniform, row_seed
from duolex.operators import metrics as M
from duolex.plans.recipes import evaluation_scores
from registry.base import (
    PAIRS_SQL, SEED, docs, mix_sql, mixu_sql, pairs, query, row_seed_sql, table,
)
from registry.cleaning import SPACE
from registry.corpora import TAGGED_SQL, tagged

KEYWORDS = "the and of to in le la les de et und der die el que".split()


def predictions(spark, sf):
    """Assistant texts as references; the same texts without one word in ten as
    predictions."""

    def kept(s):
        return F.filter(F.split("tgt", " ", -1), lambda w, i: mix_uniform(s, i) >= 0.1)

    return pairs(spark, sf).select(
        "pair_id", "split",
        F.array_join(A.let(row_seed(SEED, "pair_id"), kept), " ").alias("prediction"),
        F.col("tgt").alias("reference"),
    )


PREDICTIONS_SQL = f"""
{PAIRS_SQL},
pr0 AS (SELECT pair_id, split, tgt, string_split(tgt, ' ') AS ws, {row_seed_sql(SEED, 'pair_id')} AS s FROM pairs),
pr AS (SELECT pair_id, split, tgt AS reference,
              array_to_string(list_filter(ws, lambda w, i: {mixu_sql('s', 'i - 1')} >= 0.1), ' ') AS prediction FROM pr0)"""


def bleu_tokens_sql(x):
    x = f"replace({x}, '<skipped>', '')"
    x = f"replace({x}, '-' || chr(10), '')"
    x = f"replace({x}, chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"' ' || {x} || ' '"
    x = rf"regexp_replace({x}, '([{{-~\[-` -&(-+:-@/])', ' \1 ', 'g')"
    x = rf"regexp_replace({x}, '([^0-9])([.,])', '\1 \2 ', 'g')"
    x = rf"regexp_replace({x}, '([.,])([^0-9])', ' \1 \2', 'g')"
    x = rf"regexp_replace({x}, '([0-9])(-)', '\1 \2 ', 'g')"
    return plain_tokens_sql(x)


def plain_tokens_sql(x):
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda t: t <> '')"


def totals_sql(tokens, by="", weight="1.0"):
    """CTE ``tot``: clipped matches and n-gram counts per order."""
    b = f"{by}, " if by else ""
    return f"""
tk AS (SELECT pair_id, {b}{tokens('prediction')} AS h, {tokens('reference')} AS r FROM pr),
gr AS (SELECT pair_id, {b}n, 1 AS h, 0 AS r, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], chr(1)))) AS gram
       FROM tk, range(1, 5) t(n)
       UNION ALL
       SELECT pair_id, {b}n, 0, 1, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1))))
       FROM tk, range(1, 5) t(n)),
cn AS (SELECT pair_id, {b}n, gram, sum(h) AS h, sum(r) AS r FROM gr GROUP BY ALL),
tot AS (SELECT {b}n, sum(least(h, r) * {weight}) AS m, sum(h * {weight}) AS h, sum(r * {weight}) AS r,
               sum(h) AS hc, sum(r) AS rc FROM cn GROUP BY {b}n)"""


def score_sql(by="", against="h", name="bleu"):
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {b}round(CASE WHEN count(*) FILTER (m > 0) < 4 THEN 0.0
       ELSE exp(sum(CASE WHEN m > 0 THEN ln(m / {against}) END) / 4)
            * CASE WHEN max(hc) FILTER (n = 1) > max(rc) FILTER (n = 1) THEN 1.0
                   ELSE exp(1 - (max(rc) FILTER (n = 1)) / (max(hc) FILTER (n = 1))) END END, 9) AS {name},
       CAST(max(hc) FILTER (n = 1) AS BIGINT) AS hyp_len, CAST(max(rc) FILTER (n = 1) AS BIGINT) AS ref_len
FROM tot {group}"""


WEIGHT = f"CASE WHEN n > 1 OR gram IN ({', '.join(repr(k) for k in KEYWORDS)}) THEN 1.0 ELSE 0.2 END"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("corpus_bleu", f"WITH {PREDICTIONS_SQL}, {totals_sql(bleu_tokens_sql)} {score_sql()}")
def corpus_bleu(spark, sf):
    return rounded(M.corpus_bleu(predictions(spark, sf)), "bleu")


@query("corpus_bleu_by_split", f"WITH {PREDICTIONS_SQL}, {totals_sql(bleu_tokens_sql, 'split')} {score_sql('split')}")
def corpus_bleu_by_split(spark, sf):
    return rounded(M.corpus_bleu(predictions(spark, sf), by=["split"]), "bleu")


@query("weighted_ngram_match", f"""
WITH {PREDICTIONS_SQL}, {totals_sql(plain_tokens_sql, weight=WEIGHT)} {score_sql(name='weighted_ngram_match')}""")
def weighted_ngram_match(spark, sf):
    return rounded(M.weighted_ngram_match(predictions(spark, sf), KEYWORDS), "weighted_ngram_match")


@query("weighted_ngram_match_recall", f"""
WITH {PREDICTIONS_SQL}, {totals_sql(plain_tokens_sql, weight=WEIGHT)} {score_sql(against='r', name='weighted_ngram_match')}""")
def weighted_ngram_match_recall(spark, sf):
    out = M.weighted_ngram_match(predictions(spark, sf), KEYWORDS, against="in_reference")
    return rounded(out, "weighted_ngram_match")


@query("combined_code_score", """
SELECT doc_id, round(0.25 * quality + 0.25 * toxic + 0.25 * (doc_id % 7) / 7 + 0.25 * (doc_id % 5) / 5, 9) AS code_score FROM labels""")
def combined_code_score(spark, sf):
    parts = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("ngram_match"), F.col("toxic").alias("weighted_ngram_match"),
        (F.col("doc_id") % 7 / 7).alias("syntax_match"), (F.col("doc_id") % 5 / 5).alias("dataflow_match"),
    )
    return rounded(M.combined_code_score(parts), "code_score").select("doc_id", "code_score")


@query("prediction_table", f"""
WITH {PAIRS_SQL}
SELECT pair_id, c AS candidate_no, tgt AS label, CASE c WHEN 0 THEN src ELSE lower(src) END AS prediction
FROM pairs, range(2) t(c)""")
def prediction_table(spark, sf):
    rows = pairs(spark, sf)
    candidates = rows.select("pair_id", F.posexplode(F.array("src", F.lower("src"))).alias("candidate_no", "prediction"))
    return M.prediction_table(
        candidates.withColumn("candidate_no", F.col("candidate_no").cast("bigint")),
        rows.select("pair_id", F.col("tgt").alias("reference")),
    )


def tag_predictions(spark, sf):
    """Tags as truth, one position in ten ignored; predictions with one in ten wrong."""
    rows = tagged(docs(spark, sf)).withColumn("s", row_seed(SEED, "row_id"))
    s = F.col("s")
    return rows.select(
        "row_id", "lang",
        F.transform("tags", lambda t, i: F.when(mix_uniform(s, i, 1) < 0.1, F.lit(-100)).otherwise(t)).alias("labels"),
        F.transform(
            "tags", lambda t, i: F.when(mix_uniform(s, i) < 0.1, (mix(s, i, 2) % 17).cast("int")).otherwise(t)
        ).alias("predictions"),
    )


def spans_sql(side):
    """Spans (row, type, start, end) of the tag column ``side``."""
    return f"""
{side}b AS (SELECT row_id, lang, i, {side} AS t, lag({side}) OVER (PARTITION BY row_id ORDER BY i) AS before FROM pos),
{side}s AS (SELECT *, sum(CASE WHEN t = 0 OR t % 2 = 1 OR before IS NULL OR (before + 1) // 2 <> (t + 1) // 2 THEN 1 ELSE 0 END)
                      OVER (PARTITION BY row_id ORDER BY i) AS g FROM {side}b),
{side}e AS (SELECT row_id, lang, (min(t) + 1) // 2 AS kind, min(i) AS a, max(i) AS b FROM {side}s WHERE t > 0 GROUP BY row_id, lang, g)"""


ENTITY_SQL = f"""
{TAGGED_SQL},
tt AS (SELECT row_id, lang, tags, {row_seed_sql(SEED, 'row_id')} AS s FROM tagged),
al AS (SELECT row_id, lang,
  list_transform(tags, lambda t, i: CASE WHEN {mixu_sql('s', 'i - 1', 1)} < 0.1 THEN -100 ELSE t END) AS t,
  list_transform(tags, lambda t, i: CASE WHEN {mixu_sql('s', 'i - 1')} < 0.1 THEN {mix_sql('s', 'i - 1', 2)} % 17 ELSE t END) AS p FROM tt),
un AS (SELECT row_id, lang, unnest(t) AS t, unnest(p) AS p, unnest(range(0, len(t))) AS i0 FROM al),
pos AS (SELECT row_id, lang, t AS gold, p AS guess, row_number() OVER (PARTITION BY row_id ORDER BY i0) - 1 AS i FROM un WHERE t <> -100),
{spans_sql('gold')}, {spans_sql('guess')},
hit AS (SELECT lang, count(*) AS tp FROM golde JOIN guesse USING (row_id, lang, kind, a, b) GROUP BY lang),
nt AS (SELECT lang, count(*) AS n_true FROM golde GROUP BY lang),
np AS (SELECT lang, count(*) AS n_pred FROM guesse GROUP BY lang),
ac AS (SELECT lang, avg(CASE WHEN gold = guess THEN 1.0 ELSE 0.0 END) AS accuracy FROM pos GROUP BY lang)"""


@query("entity_prf", f"""
WITH {ENTITY_SQL}
SELECT lang, round(tp / n_pred, 9) AS precision, round(tp / n_true, 9) AS recall, round(2 * tp / (n_pred + n_true), 9) AS f1,
       round(accuracy, 9) AS accuracy, tp, n_pred, n_true
FROM ac JOIN hit USING (lang) JOIN nt USING (lang) JOIN np USING (lang)""")
def entity_prf(spark, sf):
    out = M.entity_prf(tag_predictions(spark, sf), by=["lang"])
    return rounded(out, "precision", "recall", "f1", "accuracy")


@query("argmax_labels", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS label FROM embeddings")
def argmax_labels(spark, sf):
    return M.argmax_labels(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "label")


def losses(spark, sf):
    """Events as a loss log: a run per user, an epoch per day, rows from the payload."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.datediff("ts", F.lit("2024-01-01")).alias("epoch"),
        (F.col("value") / 100).alias("loss"),
        F.get_json_object("props", "$.k").cast("bigint").alias("n_rows"),
    )


LOSSES_SQL = """
lo AS (SELECT user_id AS run_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch, value / 100 AS loss,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS n_rows FROM events),
pp AS (SELECT run_id, epoch, round(exp(sum(loss * n_rows) / sum(n_rows)), 6) AS value, CAST(sum(n_rows) AS BIGINT) AS n FROM lo
       GROUP BY ALL HAVING sum(n_rows) > 0)"""


def scores(spark, sf):
    out = M.perplexity(losses(spark, sf)).where(F.col("n_rows") > 0)
    return out.select("run_id", "epoch", F.round("perplexity", 6).alias("value"), "n_rows")


@query("perplexity", f"WITH {LOSSES_SQL} SELECT run_id, epoch, value AS perplexity, n AS n_rows FROM pp")
def perplexity(spark, sf):
    return scores(spark, sf).withColumnRenamed("value", "perplexity")


def stop_sql(threshold, patience, sign=1):
    """The fold, epoch by epoch."""
    return f"""
WITH RECURSIVE {LOSSES_SQL},
o AS (SELECT run_id, epoch, {sign} * value AS v, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS k FROM pp),
f AS (
  SELECT run_id, 0::BIGINT AS k, 'inf'::DOUBLE AS low, 0 AS bad, NULL::BIGINT AS stop FROM (SELECT DISTINCT run_id FROM o)
  UNION ALL
  SELECT f.run_id, o.k, CASE WHEN f.low - o.v >= {threshold} THEN o.v ELSE f.low END,
         CASE WHEN f.low - o.v >= {threshold} THEN 0 ELSE f.bad + 1 END,
         CASE WHEN f.stop IS NULL AND NOT f.low - o.v >= {threshold} AND f.bad + 1 >= {patience} THEN o.epoch ELSE f.stop END
  FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1)
SELECT run_id, max(stop) AS stop_epoch, max(k) AS n_epochs FROM f GROUP BY run_id"""


@query("early_stop", stop_sql(0.0, 3))
def early_stop(spark, sf):
    return M.early_stop(scores(spark, sf), 0.0, 3)


@query("early_stop_rising", stop_sql(0.05, 2, -1))
def early_stop_rising(spark, sf):
    return M.early_stop(scores(spark, sf), 0.05, 2, "max")


@query("best_epoch", f"""
WITH {LOSSES_SQL}
SELECT run_id, epoch AS best_epoch, value AS best_value FROM pp
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY value, epoch) = 1""")
def best_epoch(spark, sf):
    return M.best_epoch(scores(spark, sf))


@query("best_epoch_rising", f"""
WITH {LOSSES_SQL}
SELECT run_id, epoch AS best_epoch, value AS best_value FROM pp
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY value DESC, epoch) = 1""")
def best_epoch_rising(spark, sf):
    return M.best_epoch(scores(spark, sf), "max")


@query("metric_report", f"""
WITH {LOSSES_SQL},
r AS (SELECT run_id, epoch, CASE run_id % 2 WHEN 0 THEN 'valid' ELSE 'test' END AS split, value, n FROM pp)
SELECT run_id, epoch, split, round(value, 6) AS perplexity, round(ln(value), 6) * 100 AS loss FROM r""")
def metric_report(spark, sf):
    rows = scores(spark, sf).withColumn("split", F.when(F.col("run_id") % 2 == 0, F.lit("valid")).otherwise(F.lit("test")))
    long = rows.select(
        "run_id", "epoch", "split",
        F.inline(F.array(
            F.struct(F.lit("perplexity").alias("metric"), F.col("value")),
            F.struct(F.lit("loss").alias("metric"), F.ln("value").alias("value")),
        )),
    )
    return M.metric_report(long, ["perplexity", "loss"], percent=["loss"])


@query("recipe_evaluation", f"""
WITH {PREDICTIONS_SQL}, {totals_sql(bleu_tokens_sql)}, a AS ({score_sql()}),
{totals_sql(plain_tokens_sql, weight=WEIGHT).replace('tk AS', 'tk2 AS').replace('FROM tk,', 'FROM tk2,').replace('gr AS', 'gr2 AS').replace('FROM gr', 'FROM gr2').replace('cn AS', 'cn2 AS').replace('FROM cn', 'FROM cn2').replace('tot AS', 'tot2 AS')},
b AS ({score_sql(name='weighted_ngram_match').replace('FROM tot', 'FROM tot2')})
SELECT a.bleu, b.weighted_ngram_match FROM a, b""")
def recipe_evaluation(spark, sf):
    return rounded(evaluation_scores(predictions(spark, sf), KEYWORDS), "bleu", "weighted_ngram_match")
