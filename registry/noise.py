"""Noise on encoded rows, schedules."""

from pyspark.sql import functions as F

from duolex.functions.rng import row_seed
from duolex.operators import backtrans as B
from duolex.operators import noise as N
from duolex.operators.batches import assemble_batches
from duolex.operators.encode import encode
from duolex.operators.frequency import (
    token_frequency, token_probabilities, top_k_side_by_side, top_k_tokens, zipped_long,
)
from duolex.plans.recipes import denoise_data, keyword_ids, masked_language_data
from duolex.session import materialise
from registry.base import (
    LANGS, PAIR, SEED, below_sql, docs, encode_sql, framed_sql, h32, joined_sql, mix_sql, mixu_sql, padded_sql, query,
    reseed_sql, row_seed_sql, vocab_sql,
)
from registry.cleaning import LENGTH_OK, fortran_sql
from registry.corpora import VOCAB, top_sql
from registry.vocabulary import BASE, LENGTH, PADDED, PROBS_SQL, SIDE_SQL, packed_sql, shown, vocabulary

WORDS = {
    "en": "the and of to in that with for is as".split(),
    "fr": "le la les des de et un une que qui".split(),
}
WORDS_ALL = WORDS | {
    "de": "der die das und den mit von zu im ist".split(),
    "es": "el la los las de que y en con por".split(),
}
OTHER = "CASE lang WHEN 'en' THEN 'fr' ELSE 'en' END"

# --- each kind of noise as CTEs from a table (row_id, lang, x, s) to the next ----


def length_sql(src, dst):
    return f"""
{dst} AS (SELECT *, CASE WHEN list_position(x, 2) > 0 THEN list_position(x, 2) - 1 ELSE len(x) END AS l FROM {src})"""


def seeded_sql(src, x, dst="rows0"):
    return f"{dst} AS (SELECT row_id, lang, {x} AS x, {row_seed_sql(SEED, 'row_id')} AS s FROM {src})"


ROWS = f"{seeded_sql('enc', PADDED)}, {length_sql('rows0', 'rows')}"


def share_sql(ratio):
    return f"CAST(floor(l * {ratio}::DOUBLE) AS BIGINT)"


def mask_noise_sql(src, dst, ratio):
    return f"""
{dst}_h AS (SELECT *, list_transform(range(0, {share_sql(ratio)}), lambda k: {below_sql('s', 'k', 'l - 1', 1)} + 1) AS h FROM {src}),
{dst} AS (SELECT row_id, lang, s, list_transform(x, lambda v, i: CASE WHEN list_contains(h, i - 1) THEN 4 ELSE v END) AS x FROM {dst}_h)"""


def _word_list(lang):
    return ", ".join(f"'{w}'" for w in WORDS[lang])


def keyword_sql():
    """A keyword has four characters at most, so it is its own piece."""
    return f"""
kw AS (SELECT 'en' AS lang, list(token_id) AS kw FROM vocab WHERE NOT is_special AND token IN ({_word_list('en')})
       UNION ALL SELECT 'fr', list(token_id) FROM vocab WHERE NOT is_special AND token IN ({_word_list('fr')}))"""


def dropout_sql(src, dst, ratio, size):
    return f"""
{dst}_n AS (SELECT *, {share_sql(ratio)} AS n FROM {src} JOIN kw USING (lang)),
{dst}_d AS (SELECT *, list_transform(list_reverse_sort(list_transform(range(1, l), lambda i:
  ((CASE WHEN list_contains(kw, x[i + 1]) THEN CAST(floor(sqrt({mixu_sql('s', 'i', 2)}) * 2147483648.0::DOUBLE) AS BIGINT)
         ELSE {mix_sql('s', 'i', 2)} END) << 20) + i))[1:n], lambda p: p & 1048575) AS gone FROM {dst}_n),
{dst}_k AS (SELECT *, list_filter(x, lambda v, i: NOT list_contains(gone, i - 1)) AS k FROM {dst}_d),
{dst} AS (SELECT row_id, lang, s, {padded_sql('k', size)} AS x FROM {dst}_k)"""


def drawn_sql(src, p, ratio, salt_at, salt_token, stop, freq="cut"):
    """CTEs to ``{p}_picked``: positions and tokens drawn for each row.

    A token is the one whose span of running sums holds the draw; first
    occurrences are kept.
    """
    return f"""
{p}_cdf AS (SELECT lang, token_id, freq, sum(freq) OVER (PARTITION BY lang ORDER BY freq DESC, token_id) - freq AS lo,
               sum(freq) OVER (PARTITION BY lang) AS total FROM {freq}),
{p}_tot AS (SELECT lang AS other, max(total) AS total FROM {p}_cdf GROUP BY lang),
{p}_need AS (SELECT r.*, {OTHER} AS other, {share_sql(ratio)} AS n FROM {src} r WHERE lang IN ('en', 'fr')),
{p}_dr AS (SELECT row_id, other, n, k, floor({mixu_sql('s', 'k', salt_token)} * total) AS r
       FROM (SELECT q.*, total, unnest(range(0, 2 * n + 32)) AS k FROM {p}_need q JOIN {p}_tot USING (other))),
{p}_tk AS (SELECT row_id, n, k, token_id FROM {p}_dr d ASOF JOIN {p}_cdf c ON d.other = c.lang AND d.r >= c.lo),
{p}_fi AS (SELECT row_id, n, token_id, min(k) AS k FROM {p}_tk GROUP BY ALL),
{p}_ti AS (SELECT row_id, list(token_id ORDER BY k) AS tokens FROM (
         SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY k) AS q FROM {p}_fi) WHERE q <= n GROUP BY row_id),
{p}_picked AS (SELECT q.*, coalesce(tokens, []) AS tokens,
                  list_transform(list_sort(list_transform(range(1, {stop}), lambda i: ({mix_sql('s', 'i', salt_at)} << 20) + i))[1:n],
                                 lambda v: v & 1048575) AS spots
           FROM {p}_need q LEFT JOIN {p}_ti USING (row_id))"""


def replace_sql(src, dst, ratio, freq="cut"):
    return f"""{drawn_sql(src, dst, ratio, 4, 5, 'l', freq)},
{dst} AS (SELECT row_id, lang, s, l, list_transform(x, lambda v, i: coalesce(tokens[list_position(spots, i - 1)], v)) AS x FROM {dst}_picked)"""


def insert_sql(src, dst, ratio, size, freq="cut"):
    return f"""{drawn_sql(src, dst, ratio, 7, 8, 'l - 1', freq)},
{dst}_i AS (SELECT *, flatten(list_transform(x, lambda v, i: CASE WHEN tokens[list_position(spots, i - 1)] IS NULL THEN [v]
        ELSE [tokens[list_position(spots, i - 1)], v] END)) AS y FROM {dst}_picked),
{dst}_m AS (SELECT *, coalesce(nullif(list_position(y, 2), 0), len(y) + 1) AS m FROM {dst}_i),
{dst} AS (SELECT row_id, lang, s, CASE WHEN n < 1 THEN x WHEN m >= {size} THEN list_concat(y[1:{size - 1}], [2])
                 ELSE {padded_sql('y[1:m]', size)} END AS x FROM {dst}_m)"""


def shuffle_sql(src, dst):
    return f"""
{dst}_p AS (SELECT *, {below_sql('s', '0', 'l - 1', 10)} + 1 AS p, {below_sql('s', '1', 'l - 2', 10)} + 1 AS q0 FROM {src}),
{dst}_q AS (SELECT *, CASE WHEN q0 >= p THEN q0 + 1 ELSE q0 END AS q FROM {dst}_p),
{dst}_ab AS (SELECT *, least(p, q) AS a, greatest(p, q) AS b FROM {dst}_q),
{dst}_o AS (SELECT *, list_transform(list_sort(list_transform(range(0, b - a), lambda k: {{
        'key': {mix_sql('s', 'k', 11)}, 'k': k, 'v': x[a + k + 1]}})), lambda z: z.v) AS mid FROM {dst}_ab),
{dst} AS (SELECT row_id, lang, s, l, CASE WHEN l < 10 OR b - a < 2 THEN x
                 ELSE list_concat(list_concat(x[1:a], mid), x[b + 1:]) END AS x FROM {dst}_o)"""


def denoise_sql(src, size, dropout, replace, insert, mask, freq="cut"):
    """All kinds in order, from a table (row_id, lang, x, s) to ``noisy``."""
    return f"""{length_sql(src, 'z0')}, {keyword_sql()}, {dropout_sql('z0', 'z1', dropout, size)},
{length_sql('z1', 'z2')}, {replace_sql('z2', 'z3', replace, freq)}, {insert_sql('z3', 'z4', insert, size, freq)},
{length_sql('z4', 'z5')}, {shuffle_sql('z5', 'z6')}, {mask_noise_sql('z6', 'noisy', mask)}"""


# counted on rows of fixed length, as the noise steps get them
NOISE_TOP = top_sql(f"(SELECT lang, unnest({framed_sql(max_length=LENGTH)}) AS token_id FROM enc)")
NOISE_TABLES = f"{BASE}, {NOISE_TOP}, {SIDE_SQL}, {PROBS_SQL}"
SHOW_X = joined_sql("x")


def rows(spark, sf, langs=LANGS):
    """Padded rows with their seed ``s`` and content length ``l``."""
    vocab = vocabulary(spark, sf)
    part = docs(spark, sf).where(F.col("lang").isin(*langs))
    out = encode(part, vocab, max_length=LENGTH, padding="max").select("row_id", "lang", "input_ids")
    out = out.withColumn("s", row_seed(SEED, "row_id")).withColumn("l", N.content_length(F.col("input_ids")))
    return out, vocab


def xls():
    """The row, its content length and its seed."""
    return F.col("input_ids"), F.col("l"), F.col("s")


@query("content_length", f"WITH {BASE}, {ROWS} SELECT row_id, l FROM rows")
def content_length(spark, sf):
    return rows(spark, sf)[0].select("row_id", "l")


@query("noise_mask", f"WITH {BASE}, {ROWS}, {mask_noise_sql('rows', 'done', 0.15)} SELECT row_id, {SHOW_X} AS input_ids FROM done")
def noise_mask(spark, sf):
    x, l, s = xls()
    out = rows(spark, sf)[0].select("row_id", N.noise_mask(x, l, 0.15, s).alias("input_ids"))
    return shown(out)


@query("noise_dropout", f"""
WITH {BASE}, {ROWS}, {keyword_sql()}, {dropout_sql('rows', 'done', 0.2, LENGTH)} SELECT row_id, {SHOW_X} AS input_ids FROM done""")
def noise_dropout(spark, sf):
    data, vocab = rows(spark, sf, PAIR)
    ids = keyword_ids(vocab, WORDS)
    x, l, s = xls()
    noisy = F.when(F.col("lang") == "en", N.noise_dropout(x, l, 0.2, s, ids["en"])).otherwise(
        N.noise_dropout(x, l, 0.2, s, ids["fr"])
    )
    return shown(data.select("row_id", noisy.alias("input_ids")))


def keyword_all_sql():
    lists = [
        f"SELECT '{lang}' AS lang, list(token_id) AS kw FROM vocab WHERE NOT is_special AND token IN ({', '.join(repr(w) for w in words)})"
        for lang, words in WORDS_ALL.items()
    ]
    return f"kw AS ({' UNION ALL '.join(lists)})"


@query("noise_dropout_all", f"""
WITH {BASE}, {ROWS}, {keyword_all_sql()}, {dropout_sql('rows', 'done', 0.2, LENGTH)} SELECT row_id, {SHOW_X} AS input_ids FROM done""")
def noise_dropout_all(spark, sf):
    """All corpora of the table."""
    data, vocab = rows(spark, sf)
    ids = keyword_ids(vocab, WORDS_ALL)
    x, l, s = xls()
    noisy = F.coalesce(*[F.when(F.col("lang") == lang, N.noise_dropout(x, l, 0.2, s, ids[lang])) for lang in LANGS])
    return shown(data.select("row_id", noisy.alias("input_ids")))


def sampler(data, vocab):
    """Frequencies of the encoded rows, cut to the top and zipped."""
    freq = token_frequency(data)
    side = top_k_side_by_side(top_k_tokens(freq, vocab, 3000), *PAIR)
    return N.TokenSampler.from_table(token_probabilities(zipped_long(side, *PAIR)))


@query("noise_replace", f"""
WITH {NOISE_TABLES}, {ROWS}, {replace_sql('rows', 'done', 0.1)} SELECT row_id, {SHOW_X} AS input_ids FROM done""")
def noise_replace(spark, sf):
    data, vocab = rows(spark, sf, PAIR)
    data = materialise(data, "encoded")
    other = F.when(F.col("lang") == "en", F.lit("fr")).otherwise(F.lit("en"))
    x, l, s = xls()
    noisy = N.noise_replace(x, l, 0.1, s, sampler(unpadded(data), vocab), other)
    return shown(data.select("row_id", noisy.alias("input_ids")))


def unpadded(data):
    return data.withColumn("input_ids", F.filter("input_ids", lambda v: v != 1))


@query("noise_insert", f"""
WITH {NOISE_TABLES}, {ROWS}, {insert_sql('rows', 'done', 0.1, LENGTH)} SELECT row_id, {SHOW_X} AS input_ids FROM done""")
def noise_insert(spark, sf):
    data, vocab = rows(spark, sf, PAIR)
    data = materialise(data, "encoded")
    other = F.when(F.col("lang") == "en", F.lit("fr")).otherwise(F.lit("en"))
    x, l, s = xls()
    noisy = N.noise_insert(x, l, 0.1, s, sampler(unpadded(data), vocab), other)
    return shown(data.select("row_id", noisy.alias("input_ids")))


@query("noise_shuffle", f"WITH {BASE}, {ROWS}, {shuffle_sql('rows', 'done')} SELECT row_id, {SHOW_X} AS input_ids FROM done")
def noise_shuffle(spark, sf):
    x, l, s = xls()
    out = rows(spark, sf)[0].select("row_id", N.noise_shuffle(x, l, 1, s).alias("input_ids"))
    return shown(out)


IGNORED = "list_transform({0}, lambda v: CASE WHEN v = 1 THEN -100 ELSE v END)"


@query("denoise_examples", f"""
WITH {NOISE_TABLES}, {seeded_sql('enc', PADDED)}, {denoise_sql('rows0', LENGTH, 0.2, 0.05, 0.15, 0.15)}
SELECT row_id, CASE noisy.lang WHEN 'en' THEN 'fr' ELSE 'en' END AS lang, {joined_sql('noisy.x')} AS input_ids,
       {joined_sql('list_transform(noisy.x, lambda v: CASE WHEN v = 1 THEN 0 ELSE 1 END)')} AS attention_mask,
       {joined_sql(IGNORED.format('rows0.x'))} AS labels
FROM noisy JOIN rows0 USING (row_id)""")
def denoise_examples(spark, sf):
    data, vocab = rows(spark, sf, PAIR)
    data = materialise(data.drop("s", "l"), "encoded")
    out = N.denoise_examples(
        data, N.Ratios(0.15, 0.2, 0.05, 0.15, 1), sampler(unpadded(data), vocab), keyword_ids(vocab, WORDS),
        PAIR, ["row_id"], SEED,
    )
    return shown(out, "row_id", "lang", "input_ids", "attention_mask", "labels")


def steps(spark, sf):
    """One row per batch of the documents, counted from 1."""
    batches = assemble_batches(docs(spark, sf).select("row_id"), 4).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return batches.select((F.col("batch_id") + 1).alias("step"), "n_rows")


STEPS = """
b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS b FROM documents),
st AS (SELECT b + 1 AS step, count(*) AS n_rows FROM b GROUP BY b)"""


@query("noise_schedule", f"""
WITH {STEPS},
u AS (SELECT *, least(step // 10, (SELECT min(n) FROM range(200) t(n) WHERE 0.15 + n * 0.05 >= 0.58)) AS updates FROM st)
SELECT step, n_rows, updates, round(0.05 + updates * 0.02, 6) AS mask_ratio, round(0.05 + updates * 0.01, 6) AS dropout_ratio,
       0.0::DOUBLE AS replace_ratio, round(0.05 + updates * 0.02, 6) AS insert_ratio FROM u""")
def noise_schedule(spark, sf):
    out = B.noise_schedule(steps(spark, sf), 10, 0.05, 0.05, 0.0, 0.05, 0.02, 0.01, 0.58)
    ratios = [c for c in out.columns if c.endswith("_ratio")]
    return out.withColumns({c: F.round(c, 6) for c in ratios})


@query("objective_schedule", f"""
WITH {STEPS}
SELECT step, n_rows, CASE WHEN step < 6 OR step % 2 = 0 THEN 'denoise' ELSE 'back_translate' END AS objective FROM st""")
def objective_schedule(spark, sf):
    return B.objective_schedule(steps(spark, sf), 6)


def _scheduled(name):
    """A row's ratio, looked up while the steps of noise pass only the row on."""
    return f"(SELECT {name} FROM sched WHERE rid = row_id)"


@query("denoise_scheduled", f"""
WITH {NOISE_TABLES}, {seeded_sql('enc', PADDED)},
bs AS (SELECT row_id AS rid, (row_number() OVER (ORDER BY row_id) - 1) // 4 + 1 AS step FROM enc WHERE lang IN ('en', 'fr')),
up AS (SELECT rid, step, least(step // 5, (SELECT min(n) FROM range(200) t(n) WHERE 0.15 + n * 0.05 >= 0.58)) AS u FROM bs),
sched AS (SELECT rid, step, 0.05::DOUBLE + u * 0.02::DOUBLE AS grown, 0.05::DOUBLE + u * 0.01::DOUBLE AS grown_d FROM up),
{denoise_sql('rows0', LENGTH, _scheduled('grown_d'), 0.0, _scheduled('grown'), _scheduled('grown'))}
SELECT row_id, step, {joined_sql('noisy.x')} AS input_ids, {joined_sql(IGNORED.format('rows0.x'))} AS labels
FROM noisy JOIN rows0 USING (row_id) JOIN sched ON rid = row_id""")
def denoise_scheduled(spark, sf):
    """Noise that grows with the step of the row's batch."""
    data, vocab = rows(spark, sf, PAIR)
    data = materialise(data.drop("s", "l"), "encoded")
    stepped = assemble_batches(data, 4).withColumn("step", F.col("batch_id") + 1)
    out = N.denoise_examples(
        B.noise_schedule(stepped, 5, 0.05, 0.05, 0.0, 0.05, 0.02, 0.01, 0.58), B.scheduled_ratios(),
        sampler(unpadded(data), vocab), keyword_ids(vocab, WORDS), PAIR, ["row_id"], SEED,
    )
    return shown(out, "row_id", "step", "input_ids", "labels")


R_CHUNK, R_LENGTH, R_BATCH = 128, 256, 8


def cleaned_sql(langs):
    """Comment-free documents of normal length."""
    names = ", ".join(f"'{lang}'" for lang in langs)
    return f"""
cl AS (SELECT doc_id, lang, {fortran_sql('text')} AS text FROM documents WHERE lang IN ({names})),
ok AS (SELECT doc_id AS row_id, lang, text FROM cl WHERE {LENGTH_OK})"""


@query("recipe_masked_language", f"""
WITH {cleaned_sql(LANGS)},
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {h32(SEED, 'row_id')}, row_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM ok),
src AS (SELECT row_id, lang, text FROM rk WHERE i < (SELECT min(n) FROM rk)),
{vocab_sql(VOCAB)}, {encode_sql()}, {packed_sql(R_CHUNK, 1000)},
sd AS (SELECT *, {row_seed_sql(SEED, 'pack_group', 'chunk')} AS s FROM chunks),
fl AS (SELECT pack_group, chunk, ids, list_transform(ws, lambda w, i: w IS NOT NULL
        AND {mixu_sql(reseed_sql('s', 'rs[i]'), 'coalesce(w, 0)')} < 0.15) AS f FROM sd)
SELECT pack_group, chunk, {joined_sql('list_transform(ids, lambda v, i: CASE WHEN f[i] THEN 4 ELSE v END)')} AS input_ids,
       {joined_sql('list_transform(ids, lambda v, i: CASE WHEN f[i] THEN v ELSE -100 END)')} AS labels FROM fl""")
def recipe_masked_language(spark, sf):
    out = masked_language_data(docs(spark, sf), LANGS, VOCAB, R_CHUNK, seed=SEED)
    return shown(out, "pack_group", "chunk", "input_ids", "labels")


@query("recipe_denoise", f"""
WITH {cleaned_sql(PAIR)},
src AS (SELECT * FROM ok), {vocab_sql(VOCAB, langs=PAIR)}, {encode_sql()},
r AS (SELECT row_id, lang, row_number() OVER (PARTITION BY lang ORDER BY row_id) - 1 AS k, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS d FROM src),
nb AS (SELECT min(n) // {R_BATCH} AS nb FROM (SELECT count(*) AS n FROM r GROUP BY lang)),
inter AS (SELECT row_id, (k // {R_BATCH}) * 2 + d AS batch_id, k % {R_BATCH} AS slot FROM r, nb WHERE k < nb * {R_BATCH}),
e AS (SELECT row_id, lang, batch_id, slot, {padded_sql(framed_sql(max_length=R_LENGTH), R_LENGTH)} AS x FROM enc JOIN inter USING (row_id)),
{top_sql('(SELECT lang, unnest(x) AS token_id FROM e)')}, {SIDE_SQL}, {PROBS_SQL},
{seeded_sql('e', 'x')}, {denoise_sql('rows0', R_LENGTH, 0.2, 0.05, 0.15, 0.15)},
j AS (SELECT e.*, CASE batch_id % 2 WHEN 0 THEN 'denoise' ELSE 'back_translate' END AS objective FROM e)
SELECT row_id, batch_id, slot, objective, {joined_sql(IGNORED.format('j.x'))} AS labels,
       CASE WHEN objective <> 'denoise' THEN j.lang WHEN j.lang = 'en' THEN 'fr' ELSE 'en' END AS lang,
       CASE objective WHEN 'denoise' THEN {joined_sql('noisy.x')} ELSE {joined_sql('j.x')} END AS input_ids
FROM j JOIN noisy USING (row_id)""")
def recipe_denoise(spark, sf):
    out = denoise_data(docs(spark, sf), PAIR, WORDS, VOCAB, R_LENGTH, R_BATCH, seed=SEED)
    return shown(out, "row_id", "lang", "batch_id", "slot", "objective", "input_ids", "labels")
