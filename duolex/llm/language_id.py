"""Language identification by cross-parsing entropy.

From a bounded sample of labelled text per language a suffix automaton is built.
A document is parsed greedily into longest matches against each automaton; the
language that needs the fewest phrases, weighted by the cost of pointing into its
sample, wins.  The automata are completed to transition tables, so that a batch
of texts is parsed one character at a time for all of them at once.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duolex.llm.bytesets import text_slices
from duolex.session import small_side

#: The parse starts anew every so many bytes, which bounds the steps of a batch.
SEGMENT = 2048


def letter_classes(samples):
    """Byte to class: 0 unknown, 1 gap, then every byte of the samples that may belong to a letter."""
    classes = np.zeros(256, np.uint8)
    classes[:128] = 1
    letters = sorted({b for s in samples for b in s if b >= 128} | set(range(ord("a"), ord("z") + 1)))
    for i, b in enumerate(letters):
        classes[b] = i + 2
    return classes, len(letters) + 2


def classify(data, offsets, classes):
    """Classes of a slice with runs of gaps shortened to one; new offsets."""
    coded = classes[data]
    gap = coded == 1
    keep = np.ones(len(coded), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[offsets[:-1][offsets[:-1] < len(coded)]] = True
    moved = np.zeros(len(coded) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    return coded[keep], moved[offsets]


def suffix_automaton(symbols, n_classes):
    """Transitions of the suffix automaton of a sequence: int32[state, class], -1 where none."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        here = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = here
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    table = np.full((len(edges), n_classes), -1, np.int32)
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = to
    return table


def parser_table(sample_codes, n_classes):
    """One flat table for all languages.  An entry is ``2 * offset of the next
    state's row + 1 if a phrase starts``; also the offset of each root."""
    tables, roots, base = [], [], 0
    for codes in sample_codes:
        steps = suffix_automaton(codes.tolist(), n_classes)
        ends = steps < 0
        steps = np.where(ends, np.where(steps[0] < 0, 0, steps[0]), steps)
        flags = ends.astype(np.int32)
        flags[0] = 1
        tables.append((steps + base) * (2 * n_classes) + flags)
        roots.append(base * n_classes)
        base += len(steps)
    return np.concatenate(tables).reshape(-1).astype(np.int32), np.array(roots, np.int32)


def phrases(coded, offsets, table, roots):
    """Number of phrases per (language, row)."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[row] + nth * SEGMENT
    size = np.minimum(SEGMENT, offsets[row + 1] - start)
    order = np.argsort(-size, kind="stable")
    start, size, row = start[order], size[order], row[order]
    # lanes still running at each step
    running = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
    state = np.repeat(roots[:, None], len(size), axis=1)
    count = np.zeros(state.shape, np.int32)
    for step, lanes in enumerate(running):
        entry = table.take(state[:, :lanes] + coded[start[:lanes] + step])
        count[:, :lanes] += entry & 1
        np.right_shift(entry, 1, out=state[:, :lanes])
    return np.stack([np.bincount(row, weights=c, minlength=len(sizes)) for c in count])


def sample_texts(labelled: DataFrame, max_rows: int, max_bytes: int) -> dict:
    """lang -> lower-case text of at most ``max_bytes`` bytes: whole documents of
    400 to 4,000 bytes, picked by the hash of their id; others only where a
    language has too few of them."""
    size = F.octet_length("text")
    ranked = Window.partitionBy("lang").orderBy((size < 400) | (size > 4000), F.md5(F.col("id")), "id", "th")
    labelled = labelled.withColumn("th", F.xxhash64("text"))
    ids = labelled.where(size > 0).select("id", "th", "lang", F.row_number().over(ranked).alias("k")).where(F.col("k") <= max_rows)
    chosen = labelled.select("id", "th", "lang", F.substring("text", 1, max_bytes).alias("text"))
    # repeated rows are one sample each time they were drawn
    rows = chosen.join(small_side(ids), ["id", "th", "lang"]).select("lang", "k", "text").dropDuplicates(["lang", "k"]).collect()
    out = {}
    for lang, _, text in sorted(rows):
        out[lang] = (out.get(lang, b"") + b" " + text.lower().encode())[:max_bytes]
    return out


def held_out_fold(key, folds):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def identify_languages(docs: DataFrame, *, key="doc_id", text="text", lang="lang", folds=3, held_out=1, max_rows=32,
                       max_bytes=24_000) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, lang_pred, score).

    Learns from at most ``max_rows`` documents and ``max_bytes`` bytes for each
    language, taken from the rows outside the held-out fold; predicts every
    whole text.  Null text, or one without a letter, is ``und`` with score 0, as is
    everything if nothing is labelled.  Ties go to the first language in order.
    ``score`` is the runner-up's share of the two best costs, 0.5 to 1 (1 for a
    single language).  Repeated rows are reported each; an empty table gives an
    empty result.
    """
    fold = held_out_fold(key, folds)
    labelled = docs.where((fold != held_out) & F.col(lang).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    samples = sample_texts(labelled, max_rows, max_bytes)
    langs = sorted(samples)
    classes, n_classes = letter_classes(samples.values())
    codes = [classify(np.frombuffer(samples[name], np.uint8), np.array([0, len(samples[name])]), classes)[0] for name in langs]
    weights = np.array([math.log2(len(c) + 1) for c in codes])
    table, roots = parser_table(codes, n_classes) if langs else (None, None)
    model = docs.sparkSession.sparkContext.broadcast((langs, classes, weights, table, roots))
    narrow = docs.select(F.col(key).alias("doc_id"), (fold == held_out).alias("held_out"), F.col(text).alias("text"))
    schema = narrow.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        langs, classes, weights, table, roots = model.value
        names = pa.array([*langs, "und"], pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(2).fill_null("")
                lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                lower = pa.RecordBatch.from_arrays([pc.utf8_lower(texts)], names=["text"])
                for first, last, data, offsets in text_slices(lower, limit=8 << 20):
                    best = np.full(last - first, len(langs))
                    score = np.zeros(last - first)
                    if langs:
                        cost = phrases(*classify(data, offsets, classes), table, roots) * weights[:, None]
                        best = cost.argmin(axis=0)
                        two = np.partition(cost, 1, axis=0)[:2] if len(langs) > 1 else None
                        score = two[1] / np.maximum(two.sum(axis=0), 1) if two is not None else np.ones(last - first)
                        best = np.where(lettered[first:last], best, len(langs))
                        score = np.where(lettered[first:last], score, 0.0)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(first, last - first), part.column(1).slice(first, last - first), names.take(pa.array(best)), pa.array(score)],
                        names=schema.names)

    return narrow.mapInArrow(run, schema)
