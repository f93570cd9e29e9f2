"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by
the token windows of every training document.

Words are numbered in their document, windows get a hash from the hashes of
their words by doubling, and the windows stream through one broadcast hash join.
A hit counts only when the words themselves agree.  All of it is DataFrame code.
"""

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.session import materialise, small_side

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text):
    """Words of a text with A-Z in lower case; null: none."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def with_window_hashes(df: DataFrame, words: str, lengths) -> DataFrame:
    """Adds ``hashes``: for each length the hashes of all its windows, one length
    after the other."""
    last = F.size(words)
    df = df.withColumn("p1_", F.transform(words, lambda w: F.xxhash64(w)))
    have, k = [1], 1
    while 2 * k <= max(lengths):
        shifted = F.slice(f"p{k}_", k + 1, F.greatest(last, F.lit(1)))
        df = df.withColumn(f"p{2 * k}_", F.zip_with(f"p{k}_", shifted, lambda a, b: F.xxhash64(a, b)))
        k *= 2
        have.append(k)
    parts = []
    for n in lengths:
        out, used = None, 0
        for k in reversed(have):  # n as a sum of powers of two
            if n & k:
                piece = F.col(f"p{k}_") if not used else F.slice(f"p{k}_", used + 1, F.greatest(last, F.lit(1)))
                out = piece if out is None else F.zip_with(out, piece, lambda a, b: F.xxhash64(a, b))
                used += k
        parts.append(F.slice(out, 1, F.greatest(last - n + 1, F.lit(0))))
    df = df.withColumn("hashes", F.concat(*parts) if len(parts) > 1 else parts[0])
    return df.drop(*[f"p{k}_" for k in have])


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(hash, gram, gram_n, items): every distinct window of the items, with the
    items it stands in.  An item of fewer words than ``n`` is one window."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normal_words("text").alias("w")
    ).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.slice(F.col("w"), i, width))
    return (
        items.select("item", F.explode(grams).alias("gram"))
        .groupBy("gram").agg(F.collect_set("item").alias("items"))
        .withColumn("gram_n", F.size("gram"))
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, *, n=10, key="doc_id", text="text", max_windows=1_000_000) -> DataFrame:
    """One row per document row: (doc_id, th, n_words, n_hit, n_items, items, spans).

    ``spans`` lists the hit windows as (pos, n) in words, ``items`` the ids of the
    items they come from, sorted as strings, ``th`` is a hash of the text.  The window table is broadcast if it
    has at most ``max_windows`` rows, beyond it is joined by shuffle.  Null or
    empty texts have no words, null item ids count as ``''``, repeated rows are
    reported each, an empty benchmark hits nothing.
    """
    grams = benchmark_windows(benchmark, n)
    lengths = sorted((r[0] for r in grams.select("gram_n").distinct().collect()), reverse=True) or [n]
    grams = with_window_hashes(grams.withColumnRenamed("gram", "g_"), "g_", [n])
    # a window's own hash: that of its full length
    per_length = [with_window_hashes(grams.drop("hashes").where(F.col("gram_n") == k), "g_", [k]) for k in lengths]
    windows = per_length[0]
    for other in per_length[1:]:
        windows = windows.unionByName(other)
    windows = windows.select(F.element_at("hashes", 1).alias("hash_"), F.col("g_").alias("gram"), "gram_n", "items")

    words = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.monotonically_increasing_id().alias("row_"),
                        normal_words(text).alias("w_"))
    scanned = with_window_hashes(words, "w_", lengths).withColumn("n_words", F.size("w_").cast("bigint"))
    scanned = scanned.select("doc_id", "th", "row_", "n_words", "w_", F.posexplode_outer("hashes").alias("at_", "hash"))
    begins, before = {}, F.lit(0).cast("bigint")
    for k in lengths:
        begins[k] = before
        before = before + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    start = F.col("at_")
    for k in lengths[1:]:
        start = F.when(F.col("gram_n") == k, F.col("at_") - begins[k]).otherwise(start)
    same = (F.col("hash") == F.col("hash_")) & (F.slice("w_", (start + 1).cast("int"), F.col("gram_n")) == F.col("gram"))
    found = (
        scanned.join(small_side(windows, max_windows), same, "left")
        .where(F.col("gram_n").isNotNull() | F.col("at_").isNull() | (F.col("at_") == 0))
        .select("doc_id", "th", "row_", "n_words", "items",
                F.when(F.col("gram_n").isNotNull(), F.struct(start.cast("int").alias("pos"), F.col("gram_n").alias("n"))).alias("span"))
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1))))
    return (
        found.groupBy("row_").agg(
            F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.first("n_words").alias("n_words"),
            F.sort_array(F.collect_set("span")).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("doc_id", "th", "n_words", F.size(covered).cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                "items", "spans")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_hits`` as fixed columns: the item list as a digest."""
    return find_hits(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, key="doc_id", text="text", **options) -> DataFrame:
    """``docs`` without the rows that share a window with an item.  Every row is
    judged by its own text, also where ids are null or shared."""
    found = find_hits(docs, benchmark, key=key, text=text, **options).where("n_hit > 0")
    hit = materialise(found.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_")).distinct(), "hits")
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row_"), F.col(key).alias("id_"), F.xxhash64(F.col(text)).alias("th_"))
    same = F.col("id_").eqNullSafe(F.col("d_")) & (F.col("th_") == F.col("t_"))
    return rows.join(small_side(hit), same, "left_anti").select(*[F.col("row_").getField(n).alias(n) for n in names])


def mask_spans(docs: DataFrame, benchmark: DataFrame, *, key="doc_id", text="text", **options) -> DataFrame:
    """(doc_id, kept_words), one row per row of ``docs``: the normalised words that
    no benchmark window covers, in order."""
    hits = find_hits(docs, benchmark, key=key, text=text, **options).where(F.size("spans") > 0)
    # equal texts under one id have equal spans
    hits = hits.groupBy(F.col("doc_id").alias("id_"), F.col("th").alias("t_")).agg(F.first("spans").alias("spans"))
    gone = F.flatten(F.transform(F.coalesce("spans", F.array().cast("array<struct<pos:int,n:int>>")),
                                 lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    return (
        docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th_"), normal_words(text).alias("w_"))
        .join(hits, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th_") == F.col("t_")), "left")
        .withColumn("gone_", gone)
        .select("doc_id", F.filter("w_", lambda w, i: ~F.array_contains(F.col("gone_"), i)).alias("kept_words"))
    )


DECONTAMINATION_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
dg AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, dg.n, p, item FROM dg JOIN g ON dg.gram = g.gram AND dg.n = g.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
