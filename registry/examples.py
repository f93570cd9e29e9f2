"""Training examples: labels, masks, batches, back-translation."""

from pyspark.sql import functions as F

from duolex.functions.rng import mix_uniform, row_seed
from duolex.functions import arrays as A
from duolex.operators import backtrans as B
from duolex.operators import encode as E
from duolex.operators import labels as L
from duolex.operators import masking as M
from duolex.operators.batches import assemble_batches, pad_gathered, token_classification_batches
from duolex.operators.metrics import decode_predictions
from registry.base import (
    DOCS_SQL, LANGS, PAIR, SEED, SPLIT_SQL, WORD, below_sql, docs, encode_sql, framed_sql, joined_sql, mixu_sql,
    padded_sql, query, reseed_sql, row_seed_sql, special_rows, split_of, vocab_sql,
)
from registry.corpora import TAGGED_SQL, VOCAB, tagged
from registry.vocabulary import (
    BASE, LENGTH, MASKED, N_SPECIAL, PACKED_SQL, PAIR_BASE, PAIR_LENGTH, encoded, encoded_pairs,
    packed, shown, vocabulary,
)

TAGGED_ENC = f"""
{DOCS_SQL}, {vocab_sql(VOCAB)}, {TAGGED_SQL},
{encode_sql(src='tagged', words='list_transform(tokens, lambda w: lower(w))')}"""

ALIGNED = f"""
al AS (SELECT row_id, owner[1:{LENGTH - 2}] AS o, ids[1:{LENGTH - 2}] AS ids FROM enc),
ae AS (SELECT row_id, unnest(o) AS w, unnest(range(0, len(o))) AS i FROM al),
ag AS (SELECT *, lag(w) OVER (PARTITION BY row_id ORDER BY i) AS before FROM ae),
tagged_tokens AS (SELECT row_id, i, CASE WHEN w = before AND tags[w + 1] % 2 = 1 THEN tags[w + 1] + 1 ELSE tags[w + 1] END AS label
       FROM ag JOIN tagged USING (row_id)),
ll AS (SELECT row_id, list(label ORDER BY i) AS lab FROM tagged_tokens GROUP BY row_id),
aligned AS (SELECT row_id, list_concat(list_concat([0], al.ids), [2]) AS x,
                   list_concat(list_concat([-100], coalesce(lab, [])), [-100]) AS labels
            FROM al LEFT JOIN ll USING (row_id))"""


def tagged_rows(spark, sf):
    rows = E.encode_pretokenized(tagged(docs(spark, sf)), vocabulary(spark, sf), max_length=LENGTH)
    return L.align_labels(rows).select("row_id", "input_ids", "attention_mask", "word_ids", "tags", "labels")


@query("align_labels", f"WITH {TAGGED_ENC}, {ALIGNED} SELECT row_id, {joined_sql('labels')} AS labels FROM aligned")
def align_labels(spark, sf):
    return shown(tagged_rows(spark, sf), "row_id", "labels")


@query("shift_labels", f"""
WITH {TAGGED_SQL}
SELECT row_id, {joined_sql('list_transform(tags, lambda t: CASE WHEN t = 2 THEN 3 ELSE t END)')} AS tags FROM tagged""")
def shift_labels(spark, sf):
    return shown(L.shift_labels(tagged(docs(spark, sf))), "row_id", "tags")


@query("label_names", f"""
WITH {TAGGED_SQL}
SELECT row_id, {joined_sql("list_transform(tags, lambda t: ['O', 'B-VAR', 'I-VAR', '', '', '', '', '', '', 'B-NUM'][t + 1])")} AS names,
       {joined_sql('tags')} AS tags FROM tagged""")
def label_names(spark, sf):
    named = L.label_names(tagged(docs(spark, sf))).drop("tags")
    return shown(L.label_ids(named), "row_id", "names", "tags")


P = 0.15


@query("whole_word_mask", f"""
WITH {BASE},
x AS (SELECT row_id, {row_seed_sql(SEED, 'row_id')} AS s, {framed_sql()} AS x,
             list_concat(list_concat([NULL], owner), [NULL]) AS o FROM enc),
f AS (SELECT row_id, x, list_transform(o, lambda w: w IS NOT NULL AND {mixu_sql('s', 'coalesce(w, 0)')} < {P}) AS f FROM x)
SELECT row_id, {joined_sql('list_transform(x, lambda v, i: CASE WHEN f[i] THEN 4 ELSE v END)')} AS input_ids,
       {joined_sql('list_transform(x, lambda v, i: CASE WHEN f[i] THEN v ELSE -100 END)')} AS labels FROM f""")
def whole_word_mask(spark, sf):
    out = M.whole_word_mask(encoded(spark, sf)[0], ["row_id"], P, SEED)
    return shown(out, "row_id", "input_ids", "labels")


@query("whole_word_mask_packed", f"""
WITH {BASE}, {PACKED_SQL},
seeded AS (SELECT *, {row_seed_sql(SEED, 'pack_group', 'chunk')} AS s FROM chunks),
flags AS (SELECT pack_group, chunk, ids, list_transform(ws, lambda w, i: w IS NOT NULL
        AND {mixu_sql(reseed_sql('s', 'rs[i]'), 'coalesce(w, 0)')} < {P}) AS f FROM seeded)
SELECT pack_group, chunk, {joined_sql('list_transform(ids, lambda v, i: CASE WHEN f[i] THEN 4 ELSE v END)')} AS input_ids,
       {joined_sql('list_transform(ids, lambda v, i: CASE WHEN f[i] THEN v ELSE -100 END)')} AS labels FROM flags""")
def whole_word_mask_packed(spark, sf):
    out = M.whole_word_mask(packed(spark, sf)[0], ["pack_group", "chunk"], P, SEED, "row_ids")
    return shown(out, "pack_group", "chunk", "input_ids", "labels")


TOKEN_MASK_SQL = f"""
x AS (SELECT row_id, {row_seed_sql(SEED, 'row_id')} AS s, {framed_sql()} AS x FROM enc),
c AS (SELECT *, list_transform(x, lambda v, i: v NOT IN (0, 1, 2) AND {mixu_sql('s', 'i - 1')} < {P}) AS c FROM x),
tm AS (SELECT row_id, list_transform(x, lambda v, i:
  CASE WHEN NOT c[i] THEN v
       WHEN {mixu_sql('s', 'i - 1', 1)} < 0.8 THEN 4
       WHEN {mixu_sql('s', 'i - 1', 1)} < 0.9 THEN {N_SPECIAL} + {below_sql('s', 'i - 1', VOCAB - N_SPECIAL, 2)}
       ELSE v END) AS ids, list_transform(x, lambda v, i: CASE WHEN c[i] THEN v ELSE -100 END) AS labels FROM c)"""


@query("token_mask", f"""
WITH {BASE}, {TOKEN_MASK_SQL} SELECT row_id, {joined_sql('ids')} AS input_ids, {joined_sql('labels')} AS labels FROM tm""")
def token_mask(spark, sf):
    out = M.token_mask(encoded(spark, sf)[0], ["row_id"], VOCAB, N_SPECIAL, P, SEED)
    return shown(out, "row_id", "input_ids", "labels")


@query("masked_eval_set", f"""
WITH {BASE}, {TOKEN_MASK_SQL}
SELECT row_id, {joined_sql('ids')} AS input_ids, {joined_sql('labels')} AS labels FROM tm
WHERE {SPLIT_SQL.format('row_id')} = 'test'""")
def masked_eval_set(spark, sf):
    rows = encoded(spark, sf)[0].withColumn("split", split_of(F.col("row_id")))
    out = M.masked_eval_set(rows, ["row_id"], SEED, P, False, VOCAB, N_SPECIAL)
    return shown(out, "row_id", "input_ids", "labels")


@query("target_language", f"""
WITH {DOCS_SQL}, {vocab_sql(VOCAB)},
t AS (SELECT row_id, lang, CASE lang WHEN 'en' THEN 'fr' ELSE 'en' END AS target_lang FROM src WHERE lang IN ('en', 'fr'))
SELECT t.*, token_id AS decoder_start_id FROM t JOIN vocab ON token = '<' || upper(target_lang) || '>'""")
def target_language(spark, sf):
    rows = docs(spark, sf).where(F.col("lang").isin(*PAIR)).select("row_id", "lang")
    return B.target_language(rows, vocabulary(spark, sf), PAIR)


BT_BATCH, BT_LENGTH = 8, 128


def generated(rows):
    """Stand-in for a model's output: the target language's start token, then a seeded
    subset of the ids, then the padding a batch of outputs ends in."""
    start = F.when(F.col("lang") == "en", F.lit(7)).otherwise(F.lit(5))
    kept = A.let(
        row_seed(SEED, "row_id"),
        lambda s: F.filter("input_ids", lambda v, i: (mix_uniform(s, i) >= 0.1) & (v != 0) & (v != 2)),
    )
    return rows.select(
        "row_id", F.concat(F.array(start), F.array(F.lit(0)), kept, F.array(F.lit(2), F.lit(1))).alias("output_ids")
    )


_BT_WORDS = "|".join(
    t.replace("|", r"\|") for _, t, special in special_rows(LANGS) if special == "true"
)
_BT_TOKENS = f"regexp_extract_all(text, '{_BT_WORDS}|{WORD}')"
_SPECIAL_LIST = ", ".join(f"'{t}'" for _, t, special in special_rows(LANGS) if special == "true")

BT_SQL = f"""
x AS (SELECT row_id, lang, {row_seed_sql(SEED, 'row_id')} AS s, {framed_sql(max_length=BT_LENGTH)} AS x FROM enc WHERE lang IN ('en', 'fr')),
g AS (SELECT row_id, list_concat(list_concat([0], list_filter(x, lambda v, i: {mixu_sql('s', 'i - 1')} >= 0.1 AND v NOT IN (0, 2))), [2, 1]) AS y FROM x),
gt AS (SELECT row_id, string_agg(token, ' ' ORDER BY i) AS t FROM (
         SELECT row_id, unnest(y) AS token_id, unnest(range(0, len(y))) AS i FROM g) JOIN vocab USING (token_id) GROUP BY row_id),
noisy AS (SELECT row_id, replace(t, ' ##', '') AS text FROM gt),
nl AS (SELECT row_id, {_BT_TOKENS} AS ws FROM noisy),
nw AS (SELECT row_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS wi FROM nl),
np AS (SELECT row_id, wi, 0 AS k, word AS piece FROM nw WHERE word IN ({_SPECIAL_LIST})
       UNION ALL
       SELECT row_id, wi, k, CASE WHEN k > 0 THEN '##' ELSE '' END || substr(lower(word), k * 4 + 1, 4)
       FROM (SELECT *, unnest(range(0, (length(word) - 1) // 4 + 1)) AS k FROM nw WHERE word NOT IN ({_SPECIAL_LIST}))),
ne AS (SELECT row_id, list(coalesce(token_id, 3) ORDER BY wi, k) AS ids FROM np LEFT JOIN vocab ON piece = token GROUP BY row_id),
bt AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // {BT_BATCH} AS batch_id,
              CASE lang WHEN 'en' THEN 'fr' ELSE 'en' END AS lang, x, {framed_sql(max_length=BT_LENGTH)} AS ids FROM x JOIN ne USING (row_id))"""


@query("back_translation_pairs", f"""
WITH {BASE}, {BT_SQL}, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS n FROM bt)
SELECT row_id, batch_id, lang, {joined_sql(padded_sql('ids', 'n'))} AS input_ids,
       {joined_sql(padded_sql('x', BT_LENGTH, -100))} AS labels FROM m""")
def back_translation_pairs(spark, sf):
    vocab = vocabulary(spark, sf)
    rows = docs(spark, sf).where(F.col("lang").isin(*PAIR))
    rows = E.encode(rows, vocab, max_length=BT_LENGTH, padding="max").drop("text")
    rows = assemble_batches(rows, BT_BATCH)
    clean = rows.withColumn("input_ids", F.filter("input_ids", lambda v: v != 1))
    out = B.back_translation_pairs(rows, generated(clean), vocab, PAIR, BT_LENGTH, all_langs=LANGS)
    return shown(out, "row_id", "batch_id", "lang", "input_ids", "labels")


@query("generate", f"WITH {BASE} SELECT row_id, {joined_sql('list_reverse(' + framed_sql() + ')')} AS output_ids FROM enc")
def generate(spark, sf):
    def reverse(batch):
        return batch[["row_id"]].assign(output_ids=batch["input_ids"].map(lambda ids: ids[::-1]))

    out = B.generate(encoded(spark, sf)[0].select("row_id", "input_ids"), reverse, "row_id bigint, output_ids array<int>")
    return shown(out)


@query("shift_right", f"""
WITH {PAIR_BASE},
l AS (SELECT row_id, {MASKED.format(padded_sql(framed_sql('et.ids', PAIR_LENGTH), PAIR_LENGTH))} AS l FROM et),
d AS (SELECT row_id, list_transform(list_concat([7], l[1:{PAIR_LENGTH - 1}]), lambda x: CASE WHEN x = -100 THEN 1 ELSE x END) AS d FROM l)
SELECT row_id, {joined_sql('d')} AS decoder_input_ids,
       {joined_sql('list_transform(d, lambda x: CASE WHEN x = 1 THEN 0 ELSE 1 END)')} AS decoder_attention_mask FROM d""")
def shift_right(spark, sf):
    out = B.shift_right(encoded_pairs(spark, sf), F.lit(7))
    return shown(out, "row_id", "decoder_input_ids", "decoder_attention_mask")


@query("token_classification_batches", f"""
WITH {TAGGED_ENC}, {ALIGNED},
b AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch_id, x, labels FROM aligned),
m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS n FROM b)
SELECT row_id, batch_id, {joined_sql(padded_sql('x', 'n'))} AS input_ids, {joined_sql(padded_sql('labels', 'n', -100))} AS labels FROM m""")
def token_classification(spark, sf):
    out = token_classification_batches(tagged_rows(spark, sf), 8)
    return shown(out, "row_id", "batch_id", "input_ids", "labels")


@query("pad_gathered", f"""
WITH {BASE}, x AS (SELECT row_id, {framed_sql()} AS x FROM enc), n AS (SELECT max(len(x)) AS n FROM x)
SELECT row_id, {joined_sql(padded_sql('x', 'n'))} AS predictions, {joined_sql(padded_sql('x', 'n', -100))} AS labels FROM x, n""")
def pad_gathered_query(spark, sf):
    rows = encoded(spark, sf)[0].select(
        "row_id", F.col("input_ids").alias("predictions"), F.col("input_ids").alias("labels")
    )
    return pad_gathered(rows, {"predictions": 1, "labels": -100}, as_text=True)


@query("decode_predictions", f"""
WITH {PAIR_BASE},
t AS (SELECT row_id, unnest(ids[1:{PAIR_LENGTH - 2}]) AS token_id, unnest(range(0, len(ids[1:{PAIR_LENGTH - 2}]))) AS i FROM et),
d AS (SELECT row_id, string_agg(token, ' ' ORDER BY i) AS text FROM t JOIN vocab USING (token_id) WHERE NOT is_special GROUP BY row_id)
SELECT row_id, trim(coalesce(replace(text, ' ##', ''), '')) AS text FROM et LEFT JOIN d USING (row_id)""")
def decode_predictions_query(spark, sf):
    rows = encoded_pairs(spark, sf)
    return decode_predictions(rows, vocabulary(spark, sf)).select("row_id", "text")
