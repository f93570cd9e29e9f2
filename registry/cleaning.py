"""Cleaning, projections and filters."""

import re

from pyspark.sql import functions as F

from duolex.keywords import KEYWORDS
from duolex.operators import clean, filters
from registry.base import WORD, docs, query, table

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
STRIP = rf"^{SPACE}+|{SPACE}+$"


def strip_sql(x):
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


# frequent words of the test corpora stand in for code keywords
WORDS = ["pour", "und", "para", "that ", "__global__"]


def commented(df):
    """Documents wrapped in C comments, as the corpora hold none."""
    return df.withColumn(
        "text", F.concat(F.lit("// "), "source", F.lit("\n"), "text", F.lit(" /* "), "lang", F.lit(" */\n"))
    )


COMMENTED = "'// ' || source || chr(10) || text || ' /* ' || lang || ' */' || chr(10)"


def c_sql(x):
    x = rf"regexp_replace({x}, '//[^\n]*\n', chr(10), 'g')"
    x = rf"regexp_replace({x}, '/\*[\s\S]*?\*/', '', 'g')"
    lines = rf"regexp_split_to_array({x}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"array_to_string(list_filter({lines}, lambda l: NOT regexp_matches(l, '^{SPACE}*$')), chr(10))"


def fortran_sql(x):
    x = rf"regexp_replace({x}, '(?m)![^$](?-s:.)*?$|^[cC*](?-s:.)*?$', '', 'g')"
    return rf"regexp_replace({x}, '\n{{2,}}', chr(10), 'g')"


@query("strip_repo_prefix", f"""
SELECT doc_id AS row_id, contains(text, '|') AS had_prefix,
       CASE WHEN contains(text, '|') THEN {strip_sql("substr(text, instr(text, '|') + 1)")} ELSE text END AS text
FROM documents""")
def strip_repo_prefix(spark, sf):
    return clean.strip_repo_prefix(docs(spark, sf)).select("row_id", "had_prefix", "text")


@query("remove_cpp_comments", f"SELECT doc_id AS row_id, {c_sql(COMMENTED)} AS text FROM documents")
def remove_cpp_comments(spark, sf):
    return clean.remove_cpp_comments(commented(docs(spark, sf, "source"))).select("row_id", "text")


@query("remove_fortran_comments", f"SELECT doc_id AS row_id, {fortran_sql('text')} AS text FROM documents")
def remove_fortran_comments(spark, sf):
    return clean.remove_fortran_comments(docs(spark, sf)).select("row_id", "text")


_LITERALS = (
    r"(''(?:\\[\s\S]|[^\\''])*''"
    r'|"(?:\\[\s\S]|[^\\"])*"'
    r"|#[^\r\n]*(?:\\\r?\n[^\r\n]*)*)"
    r"|//[^\n]*|/\*[\s\S]*?\*/"
)


@query("remove_comments_string_aware", rf"""
SELECT doc_id AS row_id, translate(replace(regexp_replace(
  {COMMENTED}, '{_LITERALS}', chr(57344) || '\1' || chr(57345), 'g'),
  chr(57344) || chr(57345), ' '), chr(57344) || chr(57345), '') AS text
FROM documents""")
def remove_comments_string_aware(spark, sf):
    rows = commented(docs(spark, sf, "source")).withColumnRenamed("text", "content")
    return clean.remove_comments_string_aware(rows).select("row_id", "text")


@query("apply_cleaner_by_lang", f"""
SELECT doc_id AS row_id, lang, CASE WHEN lang = 'en' THEN {c_sql(COMMENTED)} ELSE {fortran_sql(COMMENTED)} END AS text
FROM documents""")
def apply_cleaner_by_lang(spark, sf):
    rows = commented(docs(spark, sf, "source"))
    return clean.apply_cleaner_by_lang(rows, c_like=("en",)).select("row_id", "lang", "text")


@query("rename_drop_columns", "SELECT doc_id AS sample, text AS cpp FROM documents")
def rename_drop_columns(spark, sf):
    raw = table(spark, sf, "documents")
    return clean.rename_drop_columns(raw, {"doc_id": "sample", "text": "cpp"}, ["n_chars", "source"], ["sample", "cpp"])


@query("map_batched", """
SELECT doc_id AS row_id, unnest(string_split(text, chr(10))) AS line FROM documents""")
def map_batched(spark, sf):
    def lines(batch):
        out = batch[["row_id"]].assign(line=batch["text"].str.split("\n"))
        return out.explode("line")

    return clean.map_batched(docs(spark, sf), lines, "row_id bigint, line string")


def _any(keywords):
    return " OR ".join(f"contains(text, '{k}')" for k in keywords)


@query("keyword_filter", f"SELECT doc_id AS row_id, lang FROM documents WHERE {_any(WORDS)}")
def keyword_filter(spark, sf):
    return filters.keyword_filter(docs(spark, sf), "text", WORDS).select("row_id", "lang")


@query("keyword_filter_first", f"SELECT doc_id AS row_id, lang FROM documents WHERE {_any(WORDS[:1])}")
def keyword_filter_first(spark, sf):
    return filters.keyword_filter(docs(spark, sf), "text", WORDS, "first").select("row_id", "lang")


@query("keyword_filter_tokens", f"""
SELECT doc_id AS row_id, lang FROM documents
WHERE list_has_any(regexp_extract_all(text, '{WORD}'), ['und', 'pour', 'para'])""")
def keyword_filter_tokens(spark, sf):
    rows = docs(spark, sf).withColumn("tokens", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return filters.keyword_filter(rows, "tokens", ["und", "pour", "para"]).select("row_id", "lang")


@query("keyword_filter_strict", f"SELECT doc_id AS row_id, lang FROM documents WHERE {_any(['les', 'the', 'der'])}")
def keyword_filter_strict(spark, sf):
    rows = docs(spark, sf).withColumnRenamed("text", "cuda")
    return filters.keyword_filter_strict(rows, "cuda", ["les", "the", "der"]).select("row_id", "lang")


LENGTH_OK = "len(list_distinct(string_split(text, ' '))) >= 20 AND len(string_split(text, ' ')) <= 2000"


@query("length_filter", f"SELECT doc_id AS row_id, lang FROM documents WHERE {LENGTH_OK}")
def length_filter(spark, sf):
    return filters.length_filter(docs(spark, sf)).select("row_id", "lang")


@query("filter_audit", f"""
SELECT lang, count(*) AS rows_before, count(*) FILTER ({LENGTH_OK}) AS rows_after,
       count(*) FILTER (NOT ({LENGTH_OK})) AS rows_removed
FROM documents GROUP BY lang""")
def filter_audit(spark, sf):
    return filters.filter_audit(docs(spark, sf), filters.length_predicate())


def _profile_sql():
    single = ", ".join(f"('{name}', '{k}')" for name, ks in KEYWORDS.items() for k in ks if re.fullmatch(r"\w+", k))
    phrases = ", ".join(f"('{name}', '{k}')" for name, ks in KEYWORDS.items() for k in ks if not re.fullmatch(r"\w+", k))
    return f"""
WITH kw AS (SELECT * FROM (VALUES {single}) AS t(list_name, keyword)),
ph AS (SELECT * FROM (VALUES {phrases}) AS t(list_name, keyword)),
w AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM documents),
h AS (SELECT row_id, list_name, count(*) AS hits FROM w JOIN kw ON word = keyword GROUP BY ALL
      UNION ALL
      SELECT doc_id, list_name, (length(text) - length(replace(text, keyword, ''))) // length(keyword)
      FROM documents JOIN ph ON contains(text, keyword))
SELECT row_id, list_name, CAST(sum(hits) AS BIGINT) AS hits FROM h GROUP BY ALL"""


@query("keyword_profile", _profile_sql())
def keyword_profile(spark, sf):
    return filters.keyword_profile(docs(spark, sf), KEYWORDS)


@query("filter_rows", "SELECT doc_id AS row_id, lang FROM documents WHERE length(text) % 2 = 0")
def filter_rows(spark, sf):
    rows = filters.filter_rows(docs(spark, sf), lambda batch: batch["text"].str.len() % 2 == 0)
    return rows.select("row_id", "lang")
