"""Vocabulary, encoding, packing and token frequencies."""

from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.operators import encode as E
from duolex.operators import frequency as Q
from duolex.operators.batches import assemble_batches
from duolex.operators.merges import learn_merges
from duolex.operators.metrics import distinct_lengths
from duolex.operators.pack import pack_chunks
from duolex.operators.vocab import add_special_tokens, learn_bpe_merges, learn_vocab, word_counts
from duolex.schemas import special_tokens
from duolex.session import materialise
from registry.base import (
    DOCS_SQL, LANGS, PAIR, PAIRS_SQL, WORD, docs, encode_sql, framed_sql, joined_sql, padded_sql, pairs, query,
    special_rows, vocab_sql,
)
from registry.corpora import VOCAB, TAGGED_SQL, TOP_SQL, tagged, top_tokens

LENGTH = 512
N_SPECIAL = len(special_tokens(LANGS))
BASE = f"{DOCS_SQL}, {vocab_sql(VOCAB)}, {encode_sql()}"


def vocabulary(spark, sf):
    return materialise(learn_vocab(word_counts(docs(spark, sf)), VOCAB, LANGS), "vocab")


def encoded(spark, sf, max_length=None, padding=None):
    vocab = vocabulary(spark, sf)
    return E.encode(docs(spark, sf), vocab, max_length=max_length, padding=padding).drop("text"), vocab


def shown(df, *keep):
    """Array columns as text."""
    cols = [
        A.joined(F.col(f.name), "-").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields if not keep or f.name in keep
    ]
    return df.select(*cols)


@query("word_counts", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents) GROUP BY word""")
def word_counts_query(spark, sf):
    return word_counts(docs(spark, sf))


@query("learn_vocab", f"WITH {DOCS_SQL}, {vocab_sql(VOCAB)} SELECT * FROM vocab")
def learn_vocab_query(spark, sf):
    return learn_vocab(word_counts(docs(spark, sf)), VOCAB, LANGS)


def _special_sql():
    values = ", ".join(f"({i}, '{t}', {s})" for i, t, s in special_rows())
    return f"""
WITH s AS (SELECT * FROM (VALUES {values}) AS t(token_id, token, is_special)),
w AS (SELECT '<' || upper(lang) || '>' AS token, lang, count(*) AS n FROM documents GROUP BY lang)
SELECT token_id, token, lang, n FROM w JOIN s USING (token)"""


@query("add_special_tokens", _special_sql())
def add_special_tokens_query(spark, sf):
    langs = docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    tokens = add_special_tokens(spark, LANGS)
    return langs.withColumn("token", F.concat(F.lit("<"), F.upper("lang"), F.lit(">"))).join(tokens, "token").select(
        "token_id", "token", "lang", "n"
    )


MERGES = 12


def _bpe_ctes(n, counted="count(*)"):
    """The merges one by one: symbols stand between the marks chr(1) and chr(2).
    Words that are not ``counted`` have no say in the merges, but are cut by them."""
    ctes = [
        f"w AS (SELECT word, {counted} AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents) GROUP BY word)",
        "s0 AS MATERIALIZED (SELECT word, n, regexp_replace(word, '([\\s\\S])', chr(1) || '\\1' || chr(2), 'g') AS y FROM w)",
    ]
    for i in range(n):
        ctes += [
            f"p{i} AS (SELECT n, string_split(substr(y, 2, length(y) - 2), chr(2) || chr(1)) AS l FROM s{i})",
            f"q{i} AS (SELECT n, unnest(l[:-2]) AS a, unnest(l[2:]) AS b FROM p{i} WHERE len(l) > 1)",
            f"m{i} AS MATERIALIZED (SELECT {i + 1} AS rank, a, b FROM q{i} GROUP BY a, b ORDER BY sum(n) DESC, a, b LIMIT 1)",
            f"s{i + 1} AS MATERIALIZED (SELECT word, n, replace(y, chr(1) || a || chr(2) || chr(1) || b || chr(2), chr(1) || a || b || chr(2)) AS y FROM s{i}, m{i})",
        ]
    ctes.append(f"seg AS (SELECT word, n, string_split(substr(y, 2, length(y) - 2), chr(2) || chr(1)) AS pieces FROM s{n})")
    return ", ".join(ctes)


def _bpe_sql(n):
    union = " UNION ALL ".join(f'SELECT rank, a AS "left", b AS "right" FROM m{i}' for i in range(n))
    return f"WITH {_bpe_ctes(n)} {union}"


@query("learn_bpe_merges", _bpe_sql(MERGES))
def learn_bpe_query(spark, sf):
    merges, _ = learn_bpe_merges(word_counts(docs(spark, sf)), MERGES)
    return merges


@query("learn_bpe_merges_500")
def learn_bpe_merges_500(spark, sf):
    """Drafted ahead and checked on all words.  A statement of 500 steps does not run;
    tests compare with merging one by one."""
    return learn_merges(word_counts(docs(spark, sf)), 500)[0]


def _special_values():
    return ", ".join(f"({i}, '{t}', {s})" for i, t, s in special_rows())


def _known():
    return ", ".join(f"'{t}'" for _, t, _ in special_rows())


def _learned_sql(counted="count(*)"):
    return f"""
WITH {_bpe_ctes(MERGES, counted)},
pc AS (SELECT word, n, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS k FROM seg),
pm AS (SELECT word, n, k, CASE WHEN k > 0 THEN '##' ELSE '' END || piece AS piece FROM pc),
pt AS (SELECT piece, sum(n) AS n FROM pm WHERE n > 0 AND piece NOT IN ({_known()}) GROUP BY piece ORDER BY n DESC, piece LIMIT {VOCAB - N_SPECIAL}),
vocab AS (SELECT * FROM (VALUES {_special_values()}) AS t(token_id, token, is_special)
          UNION ALL SELECT {N_SPECIAL - 1} + row_number() OVER (ORDER BY n DESC, piece), piece, false FROM pt),
dl AS (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents),
dw AS (SELECT row_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS wi FROM dl),
di AS (SELECT row_id, wi, k, coalesce(token_id, 3) AS id FROM dw JOIN pm USING (word) LEFT JOIN vocab ON piece = token),
dg AS (SELECT row_id, list(id ORDER BY wi, k) AS ids, list(wi ORDER BY wi, k) AS owner FROM di GROUP BY row_id)
SELECT row_id, {joined_sql(framed_sql('coalesce(ids, [])'))} AS input_ids,
       {joined_sql('coalesce(owner, [])')} AS word_ids
FROM dl LEFT JOIN dg USING (row_id)"""


@query("encode_learned", _learned_sql())
def encode_learned(spark, sf):
    _, segments = learn_bpe_merges(word_counts(docs(spark, sf)), MERGES)
    segments = materialise(segments, "segments")
    vocab = materialise(learn_vocab(segments, VOCAB, LANGS), "vocab")
    out = E.encode_learned(docs(spark, sf), segments, vocab)
    inner = F.filter("word_ids", lambda w: w.isNotNull())
    return shown(out.withColumn("word_ids", inner), "row_id", "input_ids", "word_ids")


@query("encode_learned_unseen", _learned_sql("count(*) FILTER (WHERE lang = 'en')"))
def encode_learned_unseen(spark, sf):
    """Merges and vocabulary of one corpus, applied to all of them."""
    rows = docs(spark, sf)
    merges, segments = learn_bpe_merges(word_counts(rows.where("lang = 'en'")), MERGES)
    vocab = materialise(learn_vocab(materialise(segments, "segments"), VOCAB, LANGS), "vocab")
    out = E.encode_learned(rows, None, vocab, merges=merges)
    inner = F.filter("word_ids", lambda w: w.isNotNull())
    return shown(out.withColumn("word_ids", inner), "row_id", "input_ids", "word_ids")


ATTENTION = "list_transform({0}, lambda z: 1)"


@query("encode", f"""
WITH {BASE}
SELECT row_id, {joined_sql(framed_sql())} AS input_ids,
       {joined_sql(ATTENTION.format(framed_sql()))} AS attention_mask,
       '-' || CASE WHEN len(owner) > 0 THEN ',' || {joined_sql('owner')} ELSE '' END || ',-' AS word_ids
FROM enc""")
def encode_query(spark, sf):
    rows, _ = encoded(spark, sf, None)
    return shown(rows, "row_id", "input_ids", "attention_mask", "word_ids")


@query("encode_truncated", f"""
WITH {BASE}
SELECT row_id, {joined_sql(framed_sql(max_length=128))} AS input_ids FROM enc""")
def encode_truncated(spark, sf):
    return shown(encoded(spark, sf, 128)[0], "row_id", "input_ids")


@query("encode_by_join", f"""
WITH {BASE}
SELECT row_id, {joined_sql(framed_sql())} AS input_ids FROM enc""")
def encode_by_join(spark, sf):
    """The way beyond the size at which a vocabulary is shipped to the tasks."""
    return shown(E.encode(docs(spark, sf), vocabulary(spark, sf), limit=100), "row_id", "input_ids")


PADDED = padded_sql(framed_sql(max_length=LENGTH), LENGTH)


@query("encode_padded_max", f"""
WITH {BASE}
SELECT row_id, {joined_sql(PADDED)} AS input_ids,
       {joined_sql(padded_sql(ATTENTION.format(framed_sql(max_length=LENGTH)), LENGTH, 0))} AS attention_mask
FROM enc""")
def encode_padded_max(spark, sf):
    return shown(encoded(spark, sf, LENGTH, "max")[0], "row_id", "input_ids", "attention_mask")


@query("encode_padded_untruncated", f"""
WITH {BASE} SELECT row_id, {joined_sql(padded_sql(framed_sql(), LENGTH))} AS input_ids FROM enc""")
def encode_padded_untruncated(spark, sf):
    out = E.encode(docs(spark, sf), vocabulary(spark, sf), padding="max", pad_length=LENGTH)
    return shown(out, "row_id", "input_ids")


@query("encode_padded_longest", f"""
WITH {BASE},
b AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch_id, {framed_sql(max_length=LENGTH)} AS x FROM enc),
m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS n FROM b)
SELECT row_id, batch_id, {joined_sql(padded_sql('x', 'n'))} AS input_ids FROM m""")
def encode_padded_longest(spark, sf):
    vocab = vocabulary(spark, sf)
    rows = assemble_batches(docs(spark, sf), 8)
    out = E.encode(rows, vocab, max_length=LENGTH, padding="longest")
    return shown(out, "row_id", "batch_id", "input_ids")


@query("encode_pretokenized", f"""
WITH {DOCS_SQL}, {vocab_sql(VOCAB)}, {TAGGED_SQL},
{encode_sql(src='tagged', words='list_transform(tokens, lambda w: lower(w))')}
SELECT row_id, {joined_sql(framed_sql(max_length=LENGTH))} AS input_ids, {joined_sql(f'owner[1:{LENGTH - 2}]')} AS word_ids FROM enc""")
def encode_pretokenized(spark, sf):
    out = E.encode_pretokenized(tagged(docs(spark, sf)), vocabulary(spark, sf), max_length=LENGTH)
    inner = F.filter("word_ids", lambda w: w.isNotNull())
    return shown(out.withColumn("word_ids", inner), "row_id", "input_ids", "word_ids")


@query("lang_to_id", f"""
WITH {DOCS_SQL}, {vocab_sql(VOCAB)}
SELECT row_id, lang, token_id AS lang_id FROM src JOIN vocab ON token = lang""")
def lang_to_id(spark, sf):
    return E.lang_to_id(docs(spark, sf), vocabulary(spark, sf), LANGS).select("row_id", "lang", "lang_id")


MASKED = "list_transform({0}, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END)"


@query("mask_pad_labels", f"WITH {BASE} SELECT row_id, {joined_sql(MASKED.format(PADDED))} AS labels FROM enc")
def mask_pad_labels(spark, sf):
    rows = encoded(spark, sf, LENGTH, "max")[0].withColumn("labels", F.col("input_ids"))
    return shown(E.mask_pad_labels(rows), "row_id", "labels")


PAIR_LENGTH = 256


def encoded_pairs(spark, sf, padding="max"):
    rows = pairs(spark, sf).select(F.col("pair_id").alias("row_id"), F.lit("en").alias("lang"),
                                   F.col("src").alias("text"), F.col("tgt").alias("labels"))
    return E.encode_pairs(rows, vocabulary(spark, sf), LANGS, max_length=PAIR_LENGTH, padding=padding)


PAIR_BASE = f"""
{DOCS_SQL}, {vocab_sql(VOCAB)}, {PAIRS_SQL},
ps AS (SELECT pair_id AS row_id, 'en' AS lang, src AS text FROM pairs),
pt AS (SELECT pair_id AS row_id, 'en' AS lang, tgt AS text FROM pairs),
{encode_sql('ps', name='es')}, {encode_sql('pt', name='et')}"""


@query("encode_pairs", f"""
WITH {PAIR_BASE}
SELECT row_id, 6 AS lang_id, {joined_sql(padded_sql(framed_sql('es.ids', PAIR_LENGTH), PAIR_LENGTH))} AS input_ids,
       {joined_sql(MASKED.format(padded_sql(framed_sql('et.ids', PAIR_LENGTH), PAIR_LENGTH)))} AS labels
FROM es JOIN et USING (row_id)""")
def encode_pairs(spark, sf):
    return shown(encoded_pairs(spark, sf), "row_id", "lang_id", "input_ids", "labels")


@query("decode", f"""
WITH {BASE}, t AS (SELECT row_id, unnest(ids) AS token_id, unnest(range(0, len(ids))) AS i FROM enc),
d AS (SELECT row_id, string_agg(token, ' ' ORDER BY i) AS text FROM t JOIN vocab USING (token_id) WHERE NOT is_special GROUP BY row_id)
SELECT row_id, coalesce(replace(text, ' ##', ''), '') AS text FROM enc LEFT JOIN d USING (row_id)""")
def decode(spark, sf):
    rows, vocab = encoded(spark, sf)
    return E.decode(rows, vocab).select("row_id", "text")


CHUNK = 128
GROUP = 100


def packed(spark, sf):
    rows, vocab = encoded(spark, sf)
    return pack_chunks(materialise(rows, "encoded"), chunk_size=CHUNK, group_rows=GROUP), vocab


def packed_sql(chunk, group):
    """CTEs from ``enc`` to ``chunks``, token by token."""
    return f"""
f AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // {group} AS pack_group,
             {framed_sql()} AS x,
             list_concat(list_concat([NULL], owner), [NULL]) AS o FROM enc),
e AS (SELECT row_id, pack_group, unnest(x) AS id, unnest(o) AS w, unnest(range(0, len(x))) AS i FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY pack_group ORDER BY row_id, i) - 1 AS p,
             count(*) OVER (PARTITION BY pack_group) AS total FROM e),
k AS (SELECT * FROM c WHERE total < {chunk} OR p < total // {chunk} * {chunk}),
chunks AS (SELECT pack_group, p // {chunk} AS chunk, list(id ORDER BY p) AS ids, list(w ORDER BY p) AS ws,
                  list(row_id ORDER BY p) AS rs FROM k GROUP BY ALL)"""


PACKED_SQL = packed_sql(CHUNK, GROUP)


@query("pack_chunks", f"""
WITH {BASE}, {PACKED_SQL}
SELECT pack_group, chunk, {joined_sql('ids')} AS input_ids, {joined_sql('ids')} AS labels,
       {joined_sql("list_transform(ws, lambda w: coalesce(CAST(w AS VARCHAR), '-'))")} AS word_ids, {joined_sql('rs')} AS row_ids
FROM chunks""")
def pack_chunks_query(spark, sf):
    return shown(packed(spark, sf)[0], "pack_group", "chunk", "input_ids", "labels", "word_ids", "row_ids")


@query("token_frequency", f"""
WITH {BASE}
SELECT CASE lang WHEN 'en' THEN 'en' ELSE 'other' END AS lang, token_id, count(*) AS freq
FROM (SELECT lang, unnest({framed_sql()}) AS token_id FROM enc) GROUP BY ALL""")
def token_frequency(spark, sf):
    return Q.token_frequency(encoded(spark, sf)[0], "en")


@query("top_k_tokens", f"WITH {TOP_SQL} SELECT lang, rank, token_id, token, freq FROM top")
def top_k_tokens(spark, sf):
    return top_tokens(spark, sf)


SIDE_SQL = """
side AS (SELECT a.rank, a.token_id AS token_id_1, a.token AS token_1, a.freq AS freq_1,
                b.token_id AS token_id_2, b.token AS token_2, b.freq AS freq_2
         FROM top a JOIN top b ON a.rank = b.rank AND a.lang = 'en' AND b.lang = 'fr')"""


@query("top_k_side_by_side", f"WITH {TOP_SQL}, {SIDE_SQL} SELECT * FROM side")
def top_k_side_by_side(spark, sf):
    return Q.top_k_side_by_side(top_tokens(spark, sf), *PAIR)


PROBS_SQL = """
cut AS (SELECT 'en' AS lang, rank, token_id_1 AS token_id, freq_1 AS freq FROM side
        UNION ALL SELECT 'fr', rank, token_id_2, freq_2 FROM side)"""


@query("token_probabilities", f"""
WITH {TOP_SQL}, {SIDE_SQL}, {PROBS_SQL}
SELECT lang, rank, token_id, freq, round(freq / sum(freq) OVER (PARTITION BY lang), 9) AS prob FROM cut""")
def token_probabilities(spark, sf):
    side = Q.top_k_side_by_side(top_tokens(spark, sf), *PAIR)
    out = Q.token_probabilities(Q.zipped_long(side, *PAIR))
    return out.select("lang", "rank", "token_id", "freq", F.round("prob", 9).alias("prob"))


@query("distinct_lengths", f"""
WITH {BASE} SELECT DISTINCT len({framed_sql()}) AS length FROM enc""")
def distinct_lengths_query(spark, sf):
    return distinct_lengths(encoded(spark, sf)[0])
