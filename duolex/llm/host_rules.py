"""Quality rules judged per host.

Each document is measured and held against simple rules.  The failures are added
up per host, a host's failure rate is shrunk with a beta prior fitted to all
hosts, and the host's verdict is joined back to its documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.llm.bytesets import IS_SPACE, U, Powers, per_row, prefix_sums, span_prints, spread_bits, text_slices, windows, word_spans
from duolex.session import small_side

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
GRAM = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def row_key(prints, rows):
    return spread_bits(prints + rows.astype(np.uint64) * U(0xD6E8FEB86659FD93))


def repeated(keys):
    """(each key's place is one of several, number of distinct ones among the places before it in key order)."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    several, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    several[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return several, later


def measure(data, offsets, powers):
    """The five measures of every row of a slice."""
    n = len(offsets) - 1
    sums = prefix_sums(data, powers)
    starts, ends, rows = word_spans(data, offsets)
    n_words = np.bincount(rows, minlength=n)
    gap = IS_SPACE[data]
    word_chars = per_row(~gap & ((data & 0xC0) != 0x80), offsets)
    n_symbols = per_row(SYMBOLS[data], offsets)

    # lines with a word
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~gap, out=filled[1:])
    line_ends = np.append(line_starts[1:], len(data))
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    has_word = filled[line_ends] > filled[line_starts]
    line_starts, line_ends, line_rows = line_starts[has_word], line_ends[has_word], line_rows[has_word]
    line_ends = line_ends - (data[line_ends - 1] == 0x0A)
    _, later = repeated(row_key(span_prints(sums, line_starts, line_ends, powers), line_rows))
    n_dup_lines = np.bincount(line_rows[later], minlength=n)

    # words inside a window that occurs twice or more in the row
    grams, first = windows(span_prints(sums, starts, ends, powers), rows, GRAM)
    several, _ = repeated(row_key(grams, rows[first]))
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, first[several], 1)
    np.add.at(cover, first[several] + GRAM, -1)
    n_repeat = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def measure_documents(docs: DataFrame, *, key="doc_id", host="source", text="text") -> DataFrame:
    """(doc_id, host) and the measures of every row."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    schema = narrow.select("doc_id", "host").schema
    for name in MEASURES:
        schema = schema.add(name, "long")

    def run(batches):
        powers = Powers()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch):
                columns = [batch.column(i).slice(first, last - first) for i in range(2)]
                columns += [pa.array(m.astype(np.int64)) for m in measure(data, offsets, powers)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "host", *MEASURES])

    return narrow.mapInArrow(run, schema)


def with_rules(measured: DataFrame) -> DataFrame:
    """``base_failed`` (too short, or repeating itself) and ``failed`` (any rule)."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    symbols = 10 * F.col("n_symbols") > F.col("n_words")
    lines = 10 * F.col("n_dup_lines") > F.col("n_words")
    lengths = (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("failed", base | symbols | lines | lengths)


def host_verdicts(ruled: DataFrame, max_rate: float) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept): posterior mean failure rates.

    The prior has the mean of the hosts' rates and, from their variance, a
    strength between 1 and 1000 documents (1000 where the rates do not differ).
    """
    hosts = ruled.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.lit(1000.0)))
        .otherwise(F.lit(1000.0)).alias("s"))
    rate = (F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    # one row of prior, joined on a constant
    return (
        hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior.withColumn("one", F.lit(1))), "one")
        .select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))
    )


def judge_by_host(docs: DataFrame, *, key="doc_id", host="source", text="text", max_rate=0.5) -> DataFrame:
    """One row per row of ``docs``: (doc_id, host, measures, base_failed, failed, rate, host_kept, kept).

    Null and empty texts have no words and fail; null hosts count as one host;
    repeated rows are judged each; an empty table gives an empty result.  The
    host table is broadcast only if it is small, a hot host is added up in parts.
    """
    ruled = with_rules(measure_documents(docs, key=key, host=host, text=text))
    verdicts = host_verdicts(ruled, max_rate).select(F.col("host").alias("h_"), "rate", "host_kept")
    return (
        ruled.join(small_side(verdicts), F.col("host").eqNullSafe(F.col("h_")))
        .withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("h_")
    )


HOST_SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
r AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 8)) AS k FROM g WHERE (doc_id, gram) IN (SELECT (doc_id, gram) FROM g GROUP BY doc_id, gram HAVING count(*) > 1))
  GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words
         OR word_chars < 3 * n_words OR word_chars > 14 * n_words AS failed
  FROM m),
h AS (SELECT source, count(*) AS n, sum(failed::INT) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS m, CASE WHEN var_pop(f / n) > 0 THEN least(greatest(avg(f / n) * (1 - avg(f / n)) / var_pop(f / n) - 1, 1), 1000) ELSE 1000 END AS s FROM h),
v AS (SELECT source, (f + m * s) / (n + s) <= 0.5 AS host_kept FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
