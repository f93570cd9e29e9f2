"""Registration and the stand-in tables."""

from pyspark.sql import functions as F

from duolex.session import spread

QUERIES, ORACLES = {}, {}
LANGS = ["en", "fr", "de", "es"]
PAIR = ["en", "fr"]
SEED = 7


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf, name):
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def split_of(key):
    return F.when(key % 10 == 0, F.lit("valid")).when(key % 10 == 1, F.lit("test")).otherwise(F.lit("train"))


def docs(spark, sf, *extra):
    """Mono-lingual corpora: (row_id, lang, text, ..)."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang", "text", *extra)


def split_docs(spark, sf):
    return docs(spark, sf).withColumn("split", split_of(F.col("row_id")))


def pairs(spark, sf):
    """A user turn and the assistant turn that follows it: (pair_id, split, src, tgt)."""
    turns = table(spark, sf, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    key = F.col("conv_id") * 1000 + F.col("turn")
    return user.join(reply, ["conv_id", "turn"]).select(
        key.alias("pair_id"), split_of(F.col("conv_id")).alias("split"), "src", "tgt"
    )


SPLIT_SQL = "CASE {0} % 10 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END"

PAIRS_SQL = f"""
pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS pair_id, {SPLIT_SQL.format('u.conv_id')} AS split, u.text AS src, a.text AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


# --- the seeded numbers, in SQL -------------------------------------------------


def h32(seed, *cols):
    keys = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 8) AS BIGINT)"


def row_seed_sql(seed, *cols):
    keys = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 15) AS BIGINT)"


def reseed_sql(s, key):
    return f"xor({s}, ({key} & 2147483647) * 536870913)"


def mix_sql(s, pos, salt=0):
    start = f"((({s} & 2147483647) + {salt * 1640531527}) & 2147483647)"
    step = f"(((({s} >> 31) + {salt * 1013904223}) & 2147483647) | 1)"
    h0 = f"(({start} + CAST({pos} AS BIGINT) * {step}) & 2147483647)"
    h1 = f"((xor({h0}, {h0} >> 16) * 2146121005) & 2147483647)"
    return f"((xor({h1}, {h1} >> 15) * 2221713035) & 2147483647)"


def mixu_sql(s, pos, salt=0):
    return f"({mix_sql(s, pos, salt)} / 2147483648.0::DOUBLE)"


def below_sql(s, pos, n, salt=0):
    return f"(({mix_sql(s, pos, salt)} * CAST({n} AS BIGINT)) >> 31)"


def joined_sql(expr):
    """Array as comma separated text."""
    return f"array_to_string({expr}, ',')"


# --- words, pieces, vocabulary and encoding, in SQL ------------------------------

WORD = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
DOCS_SQL = "src AS (SELECT doc_id AS row_id, lang, text FROM documents)"


def special_rows(langs=LANGS):
    names = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]
    rows = [(i, n, "true") for i, n in enumerate(names)]
    for lang in langs:
        rows += [(len(rows), f"<{lang.upper()}>", "true"), (len(rows) + 1, lang, "false")]
    return rows


def vocab_sql(size, src="src", langs=LANGS, name="vocab"):
    """CTEs from ``src(row_id, lang, text)`` to the vocabulary."""
    rows = special_rows(langs)
    values = ", ".join(f"({i}, '{t}', {s})" for i, t, s in rows)
    known = ", ".join(f"'{t}'" for _, t, _ in rows)
    return f"""
{name}_w AS (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM {src}),
{name}_p AS (
  SELECT CASE WHEN k > 0 THEN '##' ELSE '' END || substr(word, k * 4 + 1, 4) AS piece
  FROM (SELECT word, unnest(range(0, (length(word) - 1) // 4 + 1)) AS k FROM {name}_w)),
{name}_t AS (
  SELECT piece, count(*) AS n FROM {name}_p WHERE piece NOT IN ({known})
  GROUP BY piece ORDER BY n DESC, piece LIMIT {size - len(rows)}),
{name} AS (
  SELECT * FROM (VALUES {values}) AS t(token_id, token, is_special)
  UNION ALL
  SELECT {len(rows) - 1} + row_number() OVER (ORDER BY n DESC, piece), piece, false FROM {name}_t)"""


def encode_sql(src="src", vocab="vocab", name="enc", words=None, keep="lang"):
    """CTE ``name(row_id, {keep}, ids, owner)``: piece ids and word numbers, no specials."""
    words = words or f"regexp_extract_all(lower(text), '{WORD}')"
    return f"""
{name}_l AS (SELECT row_id, {keep}, {words} AS ws FROM {src}),
{name}_w AS (SELECT row_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS wi FROM {name}_l),
{name}_p AS (
  SELECT row_id, wi, k, CASE WHEN k > 0 THEN '##' ELSE '' END || substr(word, k * 4 + 1, 4) AS piece
  FROM (SELECT *, unnest(range(0, (length(word) - 1) // 4 + 1)) AS k FROM {name}_w)),
{name}_g AS (
  SELECT row_id, list(coalesce(token_id, 3) ORDER BY wi, k) AS ids, list(wi ORDER BY wi, k) AS owner
  FROM {name}_p LEFT JOIN {vocab} ON piece = token GROUP BY row_id),
{name} AS (
  SELECT row_id, {keep}, coalesce(ids, []) AS ids, coalesce(owner, []) AS owner
  FROM {name}_l LEFT JOIN {name}_g USING (row_id))"""


def framed_sql(ids="ids", max_length=None):
    """``<s>`` ids ``</s>``, truncated."""
    body = f"{ids}[1:{max_length - 2}]" if max_length else ids
    return f"list_concat(list_concat([0], {body}), [2])"


def padded_sql(expr, n, value=1):
    return f"list_concat({expr}, list_transform(range(0, greatest({n} - len({expr}), 0)), lambda z: {value}))"
