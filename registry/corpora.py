"""Sources and sinks."""

from pyspark.sql import functions as F

from duolex.operators import clean
from duolex.operators.combine import hconcat_columns, zip_parallel
from duolex.operators.encode import encode
from duolex.operators.frequency import token_frequency, token_probabilities, top_k_side_by_side, top_k_tokens
from duolex.operators.index import global_index
from duolex.operators.vocab import learn_vocab, word_counts
from duolex.session import materialise, work_path
from duolex.sources import corpora as C
from duolex.sources import sinks
from registry.base import (
    DOCS_SQL, LANGS, PAIRS_SQL, SPLIT_SQL, WORD, docs, encode_sql, framed_sql, pairs, query, split_docs, vocab_sql,
)

ONE_LINE = "translate(text, chr(10) || chr(13), '  ')"
VOCAB = 4000


def one_line(col):
    return F.translate(col, "\n\r", "  ")


def written_lines(spark, sf, splits=tuple(C.SPLITS)):
    """The documents as text files, one folder per language and split."""
    root = work_path(spark, "text")
    rows = split_docs(spark, sf)
    for lang in LANGS:
        for split in splits:
            part = rows.where((F.col("lang") == lang) & (F.col("split") == split))
            part.select(one_line(F.col("text"))).write.text(C.corpus_path(root, lang, split, "tok"))
    return root


LINES_SQL = f"SELECT {ONE_LINE} AS text, lang, {SPLIT_SQL.format('doc_id')} AS split FROM documents"


@query("load_text_corpus", LINES_SQL)
def load_text_corpus(spark, sf):
    return C.load_text_corpus(spark, written_lines(spark, sf), LANGS)


@query("load_numbered_corpus", f"""
SELECT {ONE_LINE} AS text, lang, {SPLIT_SQL.format('doc_id')} AS split,
       row_number() OVER (ORDER BY lang || '.' || CASE {SPLIT_SQL.format('doc_id')} WHEN 'train' THEN 'mono.' ELSE 'para.' END
                                   || {SPLIT_SQL.format('doc_id')}, doc_id) - 1 AS row_id
FROM documents""")
def load_numbered_corpus(spark, sf):
    root = work_path(spark, "text")
    rows = split_docs(spark, sf)
    for lang in LANGS:
        for split in C.SPLITS:
            part = rows.where((F.col("lang") == lang) & (F.col("split") == split)).orderBy("row_id")
            part.select(one_line(F.col("text"))).write.text(C.corpus_path(root, lang, split, "tok"))
    return C.load_text_corpus(spark, root, LANGS, row_id="row_id")


@query("load_parallel_only", f"SELECT * FROM ({LINES_SQL}) WHERE split <> 'train'")
def load_parallel_only(spark, sf):
    return C.load_parallel_only(spark, written_lines(spark, sf, ("valid", "test")), LANGS)


@query("load_json_corpus", f"SELECT text, lang, {SPLIT_SQL.format('doc_id')} AS split FROM documents")
def load_json_corpus(spark, sf):
    root = work_path(spark, "json")
    rows = split_docs(spark, sf)
    for lang in LANGS:
        for split in C.SPLITS:
            part = rows.where((F.col("lang") == lang) & (F.col("split") == split))
            part.select("text").write.json(C.corpus_path(root, lang, split, "jsonl"))
    return C.load_json_corpus(spark, root, LANGS)


def tagged(df):
    """Words as tokens; tag 9 for a leading digit, 1 (B-VAR) or, behind another such
    word, 2 (I-VAR) for a capital letter, else 0."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))

    def capital(w):
        return F.rlike(w, F.lit(r"^\p{Lu}"))

    def tag(w, i):
        before = F.coalesce(F.get(F.col("tokens"), i - 1), F.lit(""))
        return (
            F.when(F.rlike(w, F.lit(r"^\p{N}")), F.lit(9))
            .when(capital(w) & capital(before), F.lit(2))
            .when(capital(w), F.lit(1))
            .otherwise(F.lit(0))
        )

    return df.withColumn("tokens", words).withColumn("tags", F.transform("tokens", tag))


TAGGED_SQL = rf"""
tagged_l AS (SELECT doc_id AS row_id, lang, regexp_extract_all(text, '{WORD}') AS tokens FROM documents),
tagged AS (SELECT row_id, lang, tokens, list_transform(tokens, lambda w, i:
  CASE WHEN regexp_matches(w, '^\p{{N}}') THEN 9
       WHEN regexp_matches(w, '^\p{{Lu}}') AND i > 1 AND regexp_matches(coalesce(tokens[i - 1], ''), '^\p{{Lu}}') THEN 2
       WHEN regexp_matches(w, '^\p{{Lu}}') THEN 1 ELSE 0 END) AS tags FROM tagged_l)"""


@query("load_tagged_corpus", f"""
WITH {TAGGED_SQL}
SELECT lang, {SPLIT_SQL.format('row_id')} AS split, array_to_string(tokens, ' ') AS tokens, array_to_string(tags, ',') AS tags FROM tagged""")
def load_tagged_corpus(spark, sf):
    root = work_path(spark, "tagged")
    rows = tagged(split_docs(spark, sf))
    for lang in LANGS:
        for split in C.SPLITS:
            part = rows.where((F.col("lang") == lang) & (F.col("split") == split))
            part.select("tokens", "tags").write.json(C.corpus_path(root, lang, split, "jsonl", True))
    return C.load_tagged_corpus(spark, root, LANGS).select(
        "lang", "split", F.array_join("tokens", " ").alias("tokens"),
        F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"),
    )


@query("load_synthetic_pairs", f"""
WITH {PAIRS_SQL}
SELECT CASE split WHEN 'train' THEN src ELSE translate(src, chr(10) || chr(13), '  ') END AS en,
       CASE split WHEN 'train' THEN tgt ELSE translate(tgt, chr(10) || chr(13), '  ') END AS fr, split FROM pairs""")
def load_synthetic_pairs(spark, sf):
    root = work_path(spark, "pairs")
    rows = pairs(spark, sf)
    rows.where("split = 'train'").select(F.col("src").alias("en"), F.col("tgt").alias("generated_fr")).write.json(
        f"{root}/en.fr.train.synthetic.jsonl"
    )
    for split in ("valid", "test"):
        part = rows.where(F.col("split") == split).orderBy("pair_id")
        part.select(one_line(F.col("src"))).write.text(C.corpus_path(root, "en", split, "tok"))
        part.select(one_line(F.col("tgt"))).write.text(C.corpus_path(root, "fr", split, "tok"))
    return C.load_synthetic_pairs(spark, root, "en", "fr")


@query("add_lang_column", "SELECT doc_id AS row_id, lang, length(text) AS n_chars FROM documents")
def add_lang_column(spark, sf):
    rows = docs(spark, sf)
    parts = [clean.add_lang_column(rows.where(F.col("lang") == lang).drop("lang"), lang) for lang in LANGS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("row_id", "lang", F.length("text").cast("bigint").alias("n_chars"))


@query("save_sharded", f"SELECT doc_id AS row_id, lang, {SPLIT_SQL.format('doc_id')} AS split, text FROM documents")
def save_sharded(spark, sf):
    path = work_path(spark, "encoded")
    assert sinks.load_if_cached(spark, path) is None
    sinks.save_sharded(split_docs(spark, sf), path, max_records=300)
    return sinks.load_if_cached(spark, path).select("row_id", "lang", F.col("split").cast("string").alias("split"), "text")


@query("load_if_cached", """
SELECT lang, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def load_if_cached(spark, sf):
    path = work_path(spark, "cached")
    for _ in range(2):  # built the first time, read the second
        saved = sinks.load_if_cached(spark, path)
        if saved is None:
            sinks.save_sharded(split_docs(spark, sf), path)
    return saved.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


def top_tokens(spark, sf, k=3000):
    rows = docs(spark, sf)
    vocab = materialise(learn_vocab(word_counts(rows), VOCAB, LANGS), "vocab")
    freq = token_frequency(encode(rows, vocab))
    return top_k_tokens(freq, vocab, k)


def top_sql(flat):
    """CTEs from (lang, token_id) occurrences to the ranked tokens ``top``."""
    return f"""
flat AS {flat},
freq AS (SELECT lang, token_id, count(*) AS freq FROM flat GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, token_id) AS r FROM freq),
top AS (
  SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY r.r) AS rank, r.token_id, v.token, r.freq
  FROM ranked r JOIN vocab v USING (token_id) WHERE r.r <= 3000 AND NOT v.is_special)"""


TOP_SQL = f"""
{DOCS_SQL}, {vocab_sql(VOCAB)}, {encode_sql()},
{top_sql(f"(SELECT lang, unnest({framed_sql()}) AS token_id FROM enc)")}"""


@query("write_frequency_csv", f"WITH {TOP_SQL} SELECT lang, token_id, freq, rank FROM top")
def write_frequency_csv(spark, sf):
    path = sinks.write_frequency_csv(top_tokens(spark, sf), work_path(spark, "freq"))
    return C.read_frequency_csv(spark, path)


@query("write_frequent_words", f"""
WITH {TOP_SQL}
SELECT a.token AS en, b.token AS fr FROM top a JOIN top b ON a.rank = b.rank AND a.lang = 'en' AND b.lang = 'fr'""")
def write_frequent_words(spark, sf):
    side = top_k_side_by_side(top_tokens(spark, sf), "en", "fr")
    path = sinks.write_frequent_words(side, work_path(spark, "words"), "en", "fr")
    return spark.read.schema("en string, fr string").csv(path, sep="|", header=True, quote='"', escape='"')


@query("read_frequency_csv", f"""
WITH {TOP_SQL}
SELECT lang, token_id, round(freq / sum(freq) OVER (PARTITION BY lang), 9) AS prob FROM top""")
def read_frequency_csv(spark, sf):
    path = sinks.write_frequency_csv(top_tokens(spark, sf), work_path(spark, "freq"))
    table = token_probabilities(C.read_frequency_csv(spark, path))
    return table.select("lang", "token_id", F.round("prob", 9).alias("prob"))


@query("write_predictions", f"WITH {PAIRS_SQL} SELECT tgt AS Label, src AS Prediction FROM pairs")
def write_predictions(spark, sf):
    table = pairs(spark, sf).select(F.col("tgt").alias("label"), F.col("src").alias("prediction"))
    return sinks.read_predictions(spark, sinks.write_predictions(table, work_path(spark, "predictions")))


def sides(spark, sf):
    rows = global_index(pairs(spark, sf), "pair_id", out="row_index")
    left = rows.select("row_index", F.col("src").alias("text"), F.lit("en").alias("lang"))
    right = rows.select("row_index", F.col("tgt").alias("text"), F.lit("fr").alias("lang"))
    return left, right


@query("zip_parallel", f"""
WITH {PAIRS_SQL}
SELECT row_number() OVER (ORDER BY pair_id) - 1 AS row_index, src AS text, 'en' AS lang, tgt AS labels, 'fr' AS labels_lang FROM pairs""")
def zip_parallel_query(spark, sf):
    return zip_parallel(*sides(spark, sf))


@query("hconcat_columns", f"""
WITH {PAIRS_SQL}
SELECT row_number() OVER (ORDER BY pair_id) - 1 AS row_index, src AS cpp, tgt AS cuda FROM pairs""")
def hconcat_query(spark, sf):
    left, right = sides(spark, sf)
    return hconcat_columns(
        left.select("row_index", F.col("text").alias("cpp")), right.select("row_index", F.col("text").alias("cuda"))
    )
