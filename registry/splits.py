"""The dataflows over three splits, and evaluation with several candidates."""

from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.functions.rng import mix_uniform, row_seed
from duolex.operators.candidates import evaluate_candidates, rank_candidates, candidate_totals
from duolex.plans import splits as P
from duolex.session import materialise
from registry.base import (
    DOCS_SQL, LANGS, PAIR, PAIRS_SQL, SEED, SPLIT_SQL, docs, encode_sql, framed_sql, h32, joined_sql, mixu_sql, padded_sql, pairs,
    query, reseed_sql, row_seed_sql, split_docs, split_of, vocab_sql,
)
from registry.cleaning import strip_sql
from registry.corpora import TAGGED_SQL, VOCAB, tagged
from registry.examples import ALIGNED
from registry.scoring import KEYWORDS, WEIGHT, bleu_tokens_sql, plain_tokens_sql, rounded
from registry.vocabulary import LENGTH, MASKED, shown, vocabulary

# frequent words stand in for the keywords that a training row of one language must hold
KEPT = {"fr": ["éeau", "éeux"]}
S_CHUNK, S_GROUP = 128, 1000


def with_repository(spark, sf):
    """Training texts behind the name of their source, as behind a repository."""
    text = F.when(F.col("split") == "train", F.concat_ws("| ", "source", "text")).otherwise(F.col("text"))
    return docs(spark, sf, "source").withColumn("split", split_of(F.col("row_id"))).withColumn("text", text)


def holds_sql(col, words):
    return " OR ".join(f"contains({col}, '{w}')" for w in words)


def chosen_sql(rows, name, n_langs):
    """CTE ``name``: of ``rows`` (row_id, lang, split, ..) as many per language as the smallest has, in training."""
    order = f"row_number() OVER (PARTITION BY split, lang ORDER BY {h32(SEED, 'row_id')}, row_id) - 1"
    return f"""
{name}_r AS (SELECT *, {order} AS i, count(*) OVER (PARTITION BY split, lang) AS n FROM {rows}),
{name} AS (SELECT * EXCLUDE (i, n) FROM {name}_r WHERE split <> 'train'
    OR i < (SELECT CASE count(DISTINCT lang) WHEN {n_langs} THEN min(n) ELSE 0 END FROM {name}_r WHERE split = 'train'))"""


def first_pair_sql(langs):
    names = ", ".join(f"'{lang}'" for lang in langs)
    kept = " AND ".join(f"(lang <> '{lang}' OR {holds_sql('text', words)})" for lang, words in KEPT.items())
    behind = f"CASE WHEN contains(text, '|') THEN {strip_sql('substr(text, instr(text, chr(124)) + 1)')} ELSE text END"
    return f"""
sp AS (SELECT doc_id AS row_id, lang, {SPLIT_SQL.format('doc_id')} AS split, source, text FROM documents WHERE lang IN ({names})),
raw AS (SELECT row_id, lang, split, CASE split WHEN 'train' THEN concat_ws('| ', source, text) ELSE text END AS text FROM sp),
kw AS (SELECT * FROM raw WHERE split <> 'train' OR ({kept})), {chosen_sql('kw', 'ch', len(langs))},
sel AS (SELECT row_id, lang, split, CASE split WHEN 'train' THEN {behind} ELSE text END AS text FROM ch)"""


@query("recipe_first_pair", f"WITH {first_pair_sql(PAIR)} SELECT row_id, lang, split, text FROM sel")
def recipe_first_pair(spark, sf):
    out = P.select_splits(with_repository(spark, sf), PAIR, KEPT, strip_prefix=True, seed=SEED)
    return out.select("row_id", "lang", "split", "text")


@query("recipe_masked_language_splits", f"""
WITH {first_pair_sql(LANGS)},
src AS (SELECT row_id, lang, text FROM raw WHERE split = 'train'), {vocab_sql(VOCAB)}, {encode_sql('sel', keep='split')},
fr AS (SELECT row_id, split, (row_number() OVER (PARTITION BY split ORDER BY {h32(SEED, 'row_id')}, row_id) - 1) AS place,
              {framed_sql()} AS x0, list_concat(list_concat([NULL], owner), [NULL]) AS o0 FROM enc),
f AS (SELECT row_id, split, place, place // {S_GROUP} AS pack_group,
             CASE split WHEN 'train' THEN x0 ELSE {padded_sql('x0', S_CHUNK)} END AS x,
             CASE split WHEN 'train' THEN o0 ELSE {padded_sql('o0', S_CHUNK, 'CAST(NULL AS BIGINT)')} END AS o FROM fr),
e AS (SELECT row_id, split, place, pack_group, unnest(x) AS id, unnest(o) AS w, unnest(range(0, len(x))) AS i FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY split, pack_group ORDER BY place, i) - 1 AS p,
             count(*) OVER (PARTITION BY split, pack_group) AS total FROM e),
k AS (SELECT * FROM c WHERE total < {S_CHUNK} OR p < total // {S_CHUNK} * {S_CHUNK}),
chunks AS (SELECT split, pack_group, p // {S_CHUNK} AS chunk, list(id ORDER BY p) AS ids, list(w ORDER BY p) AS ws,
                  list(row_id ORDER BY p) AS rs FROM k GROUP BY ALL),
sd AS (SELECT *, {row_seed_sql(SEED, 'split', 'pack_group', 'chunk')} AS s FROM chunks),
fl AS (SELECT split, pack_group, chunk, ids, list_transform(ws, lambda w, i: w IS NOT NULL
        AND {mixu_sql(reseed_sql('s', 'rs[i]'), 'coalesce(w, 0)')} < 0.15) AS f FROM sd)
SELECT split, pack_group, chunk, {joined_sql('list_transform(ids, lambda v, i: CASE WHEN f[i] THEN 4 ELSE v END)')} AS input_ids,
       {joined_sql('list_transform(ids, lambda v, i: CASE WHEN f[i] THEN v ELSE -100 END)')} AS labels FROM fl""")
def recipe_masked_language_splits(spark, sf):
    out = P.masked_language_splits(with_repository(spark, sf), LANGS, VOCAB, chunk_size=S_CHUNK, group_rows=S_GROUP,
                                   seed=SEED, keywords=KEPT, strip_prefix=True)
    return shown(out, "split", "pack_group", "chunk", "input_ids", "labels")


@query("recipe_tagging", f"""
WITH {DOCS_SQL}, {vocab_sql(VOCAB)}, {TAGGED_SQL.replace('tagged AS', 'tagged_all AS')},
ts AS (SELECT row_id, lang, {SPLIT_SQL.format('row_id')} AS split, tokens,
              list_transform(tags, lambda t: CASE WHEN t = 2 THEN 3 ELSE t END) AS tags FROM tagged_all),
kw AS (SELECT * FROM ts WHERE split <> 'train' OR lang <> 'fr' OR list_has_any(tokens, {KEPT['fr']})),
{chosen_sql('kw', 'tagged', len(LANGS))},
{encode_sql(src='tagged', words='list_transform(tokens, lambda w: lower(w))')}, {ALIGNED}
SELECT row_id, lang, split, row_number() OVER (PARTITION BY split ORDER BY {h32(SEED, 'row_id')}, row_id) - 1 AS position,
       {joined_sql('x')} AS input_ids, {joined_sql('labels')} AS labels FROM aligned JOIN tagged USING (row_id)""")
def recipe_tagging(spark, sf):
    out = P.tagging_data(tagged(split_docs(spark, sf)), LANGS, vocabulary(spark, sf), LENGTH, True, SEED, keywords=KEPT)
    return shown(out, "row_id", "lang", "split", "position", "input_ids", "labels")


TARGET_WORDS = ["der", "les", "que", "the"]
T_BATCH = 64


@query("recipe_fine_tuning", f"""
WITH {DOCS_SQL}, {vocab_sql(VOCAB)}, {PAIRS_SQL},
kp AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY pair_id) - 1) // {T_BATCH} AS batch_id
       FROM pairs WHERE split <> 'train' OR {holds_sql('tgt', TARGET_WORDS)}),
ps AS (SELECT pair_id AS row_id, src AS text FROM kp), pt AS (SELECT pair_id AS row_id, tgt AS text FROM kp),
{encode_sql('ps', name='es', keep='text')}, {encode_sql('pt', name='et', keep='text')},
fx AS (SELECT pair_id, split, batch_id, {framed_sql('es.ids', LENGTH)} AS x, {framed_sql('et.ids', LENGTH)} AS y
       FROM kp JOIN es ON es.row_id = pair_id JOIN et ON et.row_id = pair_id),
mx AS (SELECT *, max(len(x)) OVER (PARTITION BY split, batch_id) AS nx, max(len(y)) OVER (PARTITION BY split, batch_id) AS ny FROM fx)
SELECT pair_id, split, batch_id, 6 AS lang_id, {joined_sql(padded_sql('x', 'nx'))} AS input_ids,
       {joined_sql(MASKED.format(padded_sql('y', 'ny')))} AS labels FROM mx""")
def recipe_fine_tuning(spark, sf):
    out = P.fine_tuning_data(pairs(spark, sf), PAIR, vocabulary(spark, sf), keywords=TARGET_WORDS, chunk_size=LENGTH, batch_rows=T_BATCH)
    return shown(out, "pair_id", "split", "batch_id", "lang_id", "input_ids", "labels")


CANDIDATES = 3


def candidates(spark, sf):
    """Three candidates per source, each the reference without other words; lengths and
    numbers stand in for the scores of syntax and data flow."""

    def kept(salt):
        return lambda s: F.filter(F.split("tgt", " ", -1), lambda w, i: mix_uniform(s, i, salt) >= 0.1 * (salt + 1))

    texts = [F.array_join(A.let(row_seed(SEED, "pair_id"), kept(c)), " ") for c in range(CANDIDATES)]
    rows = pairs(spark, sf)
    found = rows.select("pair_id", F.posexplode(F.array(*texts)).alias("candidate_no", "prediction"), F.length("tgt").alias("l"))
    found = found.select(
        "pair_id", "candidate_no", "prediction",
        (F.length("prediction") / F.greatest("l", F.lit(1))).alias("syntax_match"),
        (F.lit(1.0) / (F.col("candidate_no") + 1)).alias("dataflow_match"),
    )
    return found, rows.select("pair_id", F.col("tgt").alias("reference"))


def _candidate_totals_sql(kind, tokens, weight):
    return f"""
tk{kind} AS (SELECT pair_id, candidate_no, {tokens('prediction')} AS h, {tokens('reference')} AS r FROM pr),
gr{kind} AS (
  SELECT pair_id, candidate_no, n, 1 AS h, 0 AS r, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], chr(1)))) AS gram
  FROM tk{kind}, range(1, 5) t(n)
  UNION ALL
  SELECT pair_id, candidate_no, n, 0, 1, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1))))
  FROM tk{kind}, range(1, 5) t(n)),
cn{kind} AS (SELECT pair_id, candidate_no, n, gram, sum(h) AS h, sum(r) AS r FROM gr{kind} GROUP BY ALL),
ct{kind} AS (SELECT pair_id, candidate_no, n, sum(least(h, r) * {weight}) AS m, sum(h * {weight}) AS h, sum(r * {weight}) AS r,
                    sum(h) AS hc, sum(r) AS rc FROM cn{kind} GROUP BY ALL)"""


CANDIDATES_SQL = f"""
{PAIRS_SQL},
p0 AS (SELECT pair_id, tgt, string_split(tgt, ' ') AS ws, {row_seed_sql(SEED, 'pair_id')} AS s FROM pairs),
pr AS ({' UNION ALL '.join(f"SELECT pair_id, {c} AS candidate_no, tgt AS reference, array_to_string(list_filter(ws, lambda w, i: {mixu_sql('s', 'i - 1', c)} >= 0.1 * {c + 1}), ' ') AS prediction FROM p0" for c in range(CANDIDATES))}),
{_candidate_totals_sql(0, bleu_tokens_sql, '1.0')}, {_candidate_totals_sql(1, plain_tokens_sql, WEIGHT)},
gd AS (SELECT pair_id, candidate_no, n, coalesce(m, 0) AS m, coalesce(h, 0) AS h, coalesce(hc, 0) AS hc, coalesce(rc, 0) AS rc
       FROM pr CROSS JOIN range(1, 5) t(n) LEFT JOIN ct0 USING (pair_id, candidate_no, n)),
sb AS (SELECT pair_id, candidate_no, max(hc) FILTER (n = 1) AS hl, max(rc) FILTER (n = 1) AS rl,
              sum(ln((m + 1) / (h + 1))) FILTER (n > 1) AS l, max(m) FILTER (n = 1) AS m1, max(h) FILTER (n = 1) AS h1 FROM gd GROUP BY ALL),
sc AS (SELECT pair_id, candidate_no, CASE WHEN m1 = 0 THEN 0.0
         ELSE round(exp((l + ln(m1 / h1)) / 4) * CASE WHEN hl > rl THEN 1.0 ELSE exp(1 - rl / hl) END, 9) END AS sentence_bleu FROM sb),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY sentence_bleu DESC, candidate_no) AS rank FROM sc),
sl AS (SELECT pair_id, candidate_no, 'all' AS selection FROM rk UNION ALL SELECT pair_id, candidate_no, 'best' FROM rk WHERE rank = 1)"""


def _corpus_sql(kind):
    return f"""
s{kind} AS (SELECT selection, n, sum(m) AS m, sum(h) AS h, sum(hc) AS hc, sum(rc) AS rc FROM ct{kind} JOIN sl USING (pair_id, candidate_no) GROUP BY ALL),
r{kind} AS (SELECT selection, CASE WHEN count(*) FILTER (m > 0) < 4 THEN 0.0
         ELSE exp(sum(CASE WHEN m > 0 THEN ln(m / h) END) / 4) * CASE WHEN max(hc) FILTER (n = 1) > max(rc) FILTER (n = 1) THEN 1.0
              ELSE exp(1 - (max(rc) FILTER (n = 1)) / (max(hc) FILTER (n = 1))) END END AS score FROM s{kind} GROUP BY selection)"""


@query("rank_candidates", f"WITH {CANDIDATES_SQL} SELECT pair_id, candidate_no, sentence_bleu, rank FROM rk")
def rank_candidates_query(spark, sf):
    found, references = candidates(spark, sf)
    return rank_candidates(materialise(candidate_totals(found, references, KEYWORDS), "totals"))


@query("recipe_evaluation_candidates", f"""
WITH {CANDIDATES_SQL}, {_corpus_sql(0)}, {_corpus_sql(1)},
mean AS (SELECT selection, count(*) AS n_candidates, avg(length(prediction) / greatest(length(reference), 1)) AS syntax_match,
                avg(1.0 / (candidate_no + 1)) AS dataflow_match FROM pr JOIN sl USING (pair_id, candidate_no) GROUP BY selection)
SELECT selection, n_candidates, round(r0.score, 9) AS bleu, round(r1.score, 9) AS weighted_ngram_match,
       round(syntax_match, 9) AS syntax_match, round(dataflow_match, 9) AS dataflow_match,
       round((r0.score + r1.score + syntax_match + dataflow_match) / 4, 9) AS code_score
FROM mean JOIN r0 USING (selection) JOIN r1 USING (selection)""")
def recipe_evaluation_candidates(spark, sf):
    found, references = candidates(spark, sf)
    out = evaluate_candidates(found, references, KEYWORDS)
    return rounded(out, "bleu", "weighted_ngram_match", "syntax_match", "dataflow_match", "code_score")
