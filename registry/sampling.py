"""Sampling, shuffling, unions, interleaving and batches."""

from pyspark.sql import functions as F

from duolex.operators import batches, combine, sampling
from duolex.operators.index import global_index
from duolex.plans.recipes import frequent_tokens
from registry.base import (
    LANGS, PAIR, PAIRS_SQL, SEED, SPLIT_SQL, WORD, docs, h32, pairs, query, split_docs,
)
from registry.cleaning import LENGTH_OK

BATCH = 8
ORDERED = f"row_number() OVER (PARTITION BY lang ORDER BY {h32(SEED, 'doc_id')}, doc_id) - 1"


@query("balance_corpora", f"""
WITH r AS (SELECT doc_id AS row_id, lang, {ORDERED} AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT row_id, lang FROM r WHERE i < (SELECT min(n) FROM r)""")
def balance_corpora(spark, sf):
    return sampling.balance_corpora(docs(spark, sf), "lang", "row_id", SEED).select("row_id", "lang")


@query("downsample", f"""
WITH r AS (SELECT doc_id AS row_id, lang, {ORDERED} AS i FROM documents) SELECT row_id, lang FROM r WHERE i < 15""")
def downsample(spark, sf):
    return sampling.downsample(docs(spark, sf), 15, "lang", "row_id", SEED).select("row_id", "lang")


@query("downsample_pairs", f"""
WITH {PAIRS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id % 2 ORDER BY {h32(SEED, 'pair_id')}, pair_id) - 1 AS i FROM pairs)
SELECT pair_id, src, tgt FROM r WHERE i < 2""")
def downsample_pairs(spark, sf):
    rows = pairs(spark, sf).withColumn("part", F.col("pair_id") % 2)
    return sampling.downsample(rows, 2, "part", "pair_id", SEED).select("pair_id", "src", "tgt")


@query("seeded_shuffle", f"""
SELECT doc_id AS row_id, row_number() OVER (ORDER BY {h32(SEED, 'doc_id')}, doc_id) - 1 AS position FROM documents""")
def seeded_shuffle(spark, sf):
    shuffled = sampling.seeded_shuffle(docs(spark, sf), "row_id", SEED)
    return global_index(shuffled, "row_id", seed=SEED, out="position").select("row_id", "position")


@query("sample_and_complement", f"""
WITH r AS (SELECT doc_id AS row_id, text, row_number() OVER (ORDER BY {h32(SEED, 'doc_id')}, doc_id) - 1 AS i FROM documents)
SELECT row_id, i < 100 AS in_sample, regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '') AS text FROM r""")
def sample_and_complement(spark, sf):
    return sampling.sample_and_complement(docs(spark, sf), 100, seed=SEED).select("row_id", "in_sample", "text")


@query("union_corpora", "SELECT doc_id AS row_id, lang, text FROM documents")
def union_corpora(spark, sf):
    rows = docs(spark, sf)
    return combine.union_corpora([rows.where(F.col("lang") == lang) for lang in LANGS], seed=SEED)


IN_LANG = "row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1"
INTERLEAVED = f"""
r AS (SELECT doc_id AS row_id, lang, {IN_LANG} AS k, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS d
      FROM documents WHERE lang IN ('en', 'fr')),
nb AS (SELECT min(n) // {BATCH} AS nb FROM (SELECT count(*) AS n FROM r GROUP BY lang)),
inter AS (SELECT row_id, lang, (k // {BATCH}) * 2 + d AS batch_id, k % {BATCH} AS slot FROM r, nb WHERE k < nb * {BATCH})"""


@query("interleave_batches", f"WITH {INTERLEAVED} SELECT * FROM inter")
def interleave_batches(spark, sf):
    out = combine.interleave_batches(docs(spark, sf), PAIR, BATCH)
    return out.select("row_id", "lang", "batch_id", "slot")


@query("interleave_batches_shuffled", f"""
WITH {INTERLEAVED},
bo AS (SELECT batch_id, row_number() OVER (ORDER BY {h32(SEED, 'batch_id')}, batch_id) - 1 AS new_id
       FROM (SELECT DISTINCT batch_id FROM inter)),
so AS (SELECT slot, row_number() OVER (ORDER BY substr(md5('{SEED}|slot|' || slot), 1, 8), slot) - 1 AS new_slot
       FROM (SELECT unnest(range({BATCH})) AS slot))
SELECT row_id, lang, new_id AS batch_id, new_slot AS slot FROM inter JOIN bo USING (batch_id) JOIN so USING (slot)""")
def interleave_batches_shuffled(spark, sf):
    out = combine.interleave_batches(docs(spark, sf), PAIR, BATCH, shuffle_batches=True, shuffle_slots=True, seed=SEED)
    return out.select("row_id", "lang", "batch_id", "slot")


INTERLEAVED_ALL = f"""
r AS (SELECT doc_id AS row_id, lang, {IN_LANG} AS k, list_position({LANGS}, lang) - 1 AS d FROM documents),
nb AS (SELECT min(n) // {BATCH} AS nb FROM (SELECT count(*) AS n FROM r GROUP BY lang)),
inter AS (SELECT row_id, lang, (k // {BATCH}) * {len(LANGS)} + d AS batch_id, k % {BATCH} AS slot FROM r, nb WHERE k < nb * {BATCH})"""


@query("interleave_batches_all", f"WITH {INTERLEAVED_ALL} SELECT * FROM inter")
def interleave_batches_all(spark, sf):
    """All corpora of the table."""
    out = combine.interleave_batches(docs(spark, sf), LANGS, BATCH)
    return out.select("row_id", "lang", "batch_id", "slot")


@query("interleave_batches_shuffled_all", f"""
WITH {INTERLEAVED_ALL},
bo AS (SELECT batch_id, row_number() OVER (ORDER BY {h32(SEED, 'batch_id')}, batch_id) - 1 AS new_id
       FROM (SELECT DISTINCT batch_id FROM inter)),
so AS (SELECT slot, row_number() OVER (ORDER BY substr(md5('{SEED}|slot|' || slot), 1, 8), slot) - 1 AS new_slot
       FROM (SELECT unnest(range({BATCH})) AS slot))
SELECT row_id, lang, new_id AS batch_id, new_slot AS slot FROM inter JOIN bo USING (batch_id) JOIN so USING (slot)""")
def interleave_batches_shuffled_all(spark, sf):
    out = combine.interleave_batches(docs(spark, sf), LANGS, BATCH, shuffle_batches=True, shuffle_slots=True, seed=SEED)
    return out.select("row_id", "lang", "batch_id", "slot")


@query("train_from_valid", f"""
SELECT doc_id AS row_id, lang, 'train' AS split FROM documents WHERE {SPLIT_SQL.format('doc_id')} = 'valid'""")
def train_from_valid(spark, sf):
    return combine.train_from_valid(split_docs(spark, sf)).select("row_id", "lang", "split")


@query("assemble_batches", f"""
SELECT doc_id AS row_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch_id,
       (row_number() OVER (ORDER BY doc_id) - 1) % {BATCH} AS slot FROM documents""")
def assemble_batches(spark, sf):
    return batches.assemble_batches(docs(spark, sf), BATCH).select("row_id", "batch_id", "slot")


@query("check_batch_language", f"""
WITH b AS (SELECT lang, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch_id FROM documents)
SELECT batch_id, min(lang) AS lang_low, max(lang) AS lang_high, count(*) AS n_rows
FROM b GROUP BY batch_id HAVING count(DISTINCT lang) > 1""")
def check_batch_language(spark, sf):
    return batches.check_batch_language(batches.assemble_batches(docs(spark, sf), BATCH))


@query("frequent_tokens", f"""
WITH f AS (SELECT * FROM documents WHERE {LENGTH_OK}),
r AS (SELECT *, {ORDERED} AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM r WHERE i < (SELECT min(n) FROM r)),
c AS (SELECT lang, word, count(*) AS freq FROM w GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS rank FROM c QUALIFY rank <= 3000)
SELECT lang, word, freq, rank, round(freq / sum(freq) OVER (PARTITION BY lang), 9) AS prob FROM t""")
def frequent_tokens_query(spark, sf):
    out = frequent_tokens(docs(spark, sf), SEED)
    return out.select("lang", "word", "freq", "rank", F.round("prob", 9).alias("prob"))
