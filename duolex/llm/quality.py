"""Quality by random Fourier features of document statistics.

Each text is described by a few statistics, which are written once as a narrow
table.  Random cosines and sines of the standardised statistics stand for a
Gaussian kernel; every task sums the normal equations of its labelled rows, in whole
numbers, so that the sum does not depend on the order.  Their solution, a ridge
regression, is made a probability by isotonic regression on rows it has not seen.

All labelled rows outside the held-out fold count.  The driver sees sums only: a square
of the number of features, and a fixed number of score bins.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from duolex.llm.bytesets import Powers, per_row, prefix_sums, span_prints, text_slices, word_spans
from duolex.llm.host_rules import measure, repeated, row_key
from duolex.llm.language_id import held_out_fold
from duolex.llm.toxicity import small_labels
from duolex.session import materialise

STATS = ["log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "non_ascii", "gaps", "new_words",
         "same_words", "dup_lines", "repeat_words", "lines", "entropy", "ends"]
UNIT = 1 << 14  # features are rounded to 1/UNIT, sums of their products are exact
BINS = 1000  # bins of raw scores for the calibration
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3

UPPER, DIGIT, SYMBOL, MARK, STOP = (np.zeros(256, bool) for _ in range(5))
UPPER[ord("A"):ord("Z") + 1] = True
DIGIT[ord("0"):ord("9") + 1] = True
SYMBOL[[ord(c) for c in "#*$%&|<>@^~=+_\\{}[]"]] = True
MARK[[ord(c) for c in "!?;:\"'()-/"]] = True
STOP[[ord(c) for c in ".,"]] = True


def describe(data, offsets, powers):
    """The statistics of every row of a slice, one column each."""
    n = len(offsets) - 1
    n_words, word_chars, _, n_dup_lines, n_repeat = measure(data, offsets, powers)
    size = np.maximum(np.diff(offsets), 1)
    some = np.maximum(n_words, 1)

    def share(table):
        return per_row(table[data], offsets) / size

    # upper case beyond ASCII: the letters between A-grave and Thorn, whose bytes are C3 80 .. C3 9E
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    starts, ends, rows = word_spans(data, offsets)
    prints = span_prints(prefix_sums(data, powers), starts, ends, powers)
    _, later = repeated(row_key(prints, rows))
    same = np.zeros(len(rows), bool)
    same[1:] = (prints[1:] == prints[:-1]) & (rows[1:] == rows[:-1])
    counts = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 256 + data, minlength=256 * n).reshape(n, 256) / size[:, None]
    entropy = -(counts * np.log2(np.where(counts > 0, counts, 1.0))).sum(axis=1) / 8
    marked = SYMBOL[data[ends - 1]] | MARK[data[ends - 1]]
    return np.stack([
        np.log1p(np.diff(offsets)) / 10, np.log1p(n_words) / 10, np.minimum(word_chars / some, 50) / 10,
        share(UPPER) + per_row(second, offsets) / size, share(DIGIT), share(SYMBOL), share(MARK), share(STOP),
        per_row(data >= 0xC0, offsets) / size, 1 - per_row(data > 0x20, offsets) / size,
        1 - np.bincount(rows[later], minlength=n) / some, np.bincount(rows[same], minlength=n) / some,
        np.minimum(n_dup_lines / some, 1), n_repeat / some, np.minimum(per_row(data == 0x0A, offsets) / some, 1), entropy,
        np.bincount(rows[marked], minlength=n) / some], axis=1)


def document_statistics(docs: DataFrame, *, key="doc_id", text="text") -> DataFrame:
    """(k_, statistics) of every row; null and empty texts have zeros."""
    narrow = docs.select(F.col(key).alias("k_"), F.col(text).alias("text"))
    schema = StructType([narrow.schema["k_"], *[StructField(s, DoubleType()) for s in STATS]])

    def run(batches):
        powers = Powers()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch):
                found = describe(data, offsets, powers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *[pa.array(np.ascontiguousarray(c)) for c in found.T]], names=schema.names)

    return narrow.mapInArrow(run, schema)


def rounded(x, digits=6):
    """To significant digits: sums of floats differ in their last ones from run to run."""
    return np.array([float(f"{v:.{digits}g}") for v in x])


def isotonic(counts, sums):
    """Non-decreasing means of bins (pool adjacent violators); each bin has rows."""
    blocks = []
    for n, s in zip(counts, sums):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, s, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, blocks[-1][2] + k]
    return np.concatenate([np.full(k, s / n) for n, s, k in blocks])


class QualityModel:
    """Ridge regression on random Fourier features, calibrated.

    ``labels`` with a null id or a label other than 0 and 1 are left out, of several labels of an id
    the larger counts.  Rows of fold 2 (of four) are held out, fold 3 calibrates, the
    others fit.  Without a row to fit or to calibrate, the score is the share of
    label 1, or 0.5 without labels.  ``described`` is the table of
    ``document_statistics``.
    """

    def __init__(self, described: DataFrame, labels: DataFrame, *, label="quality", features=256, width=3.0, ridge=1e-3, seed=11):
        marks = (
            labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).withColumn("fold", held_out_fold("doc_id", FOLDS))
            .where(F.col("fold") != HELD_OUT).groupBy(F.col("doc_id").alias("l_"), "fold").agg(F.max(label).cast("double").alias("y"))
        )
        rows = materialise(described.join(small_labels(marks), F.col("k_") == F.col("l_")).select("fold", "y", *STATS), "quality-labelled")
        fitted = rows.where(F.col("fold") != CALIBRATION)
        totals = rows.agg(
            F.count("*").alias("n"), F.sum("y").alias("y"),
            *[f(s).alias(f"{name}_{s}") for s in STATS for name, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        self.flat = (totals["y"] or 0.0) / totals["n"] if totals["n"] else 0.5
        self.mean = rounded([totals[f"m_{s}"] or 0.0 for s in STATS])
        self.scale = np.maximum(rounded([totals[f"d_{s}"] or 0.0 for s in STATS]), 1e-4)
        rng = np.random.default_rng(seed)
        self.waves = rng.standard_normal((len(STATS), features // 2)) / width
        self.weights = None
        sums = self.normal_equations(fitted)
        if sums[0, 0]:
            f = len(sums) - 1
            grid = sums.astype(float) / UNIT ** 2 / (float(sums[0, 0]) / UNIT ** 2)  # means over the rows
            self.weights = np.linalg.solve(grid[:f, :f] + ridge * np.diag([0.0] + [1.0] * (f - 1)), grid[:f, f])
        self.values = self.calibration(rows.where(F.col("fold") == CALIBRATION))

    def lifted(self, x):
        """Whole-number features of rows of statistics, the first one constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.waves
        return np.rint(np.hstack([np.ones((len(z), 1)), np.cos(z), np.sin(z)]) * UNIT)

    def normal_equations(self, rows: DataFrame):
        """Sums of products of the features and of the label, exact."""
        size, lifted = self.waves.shape[1] * 2 + 2, self.lifted

        def run(batches):
            total = np.zeros((size, size), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    x = np.stack([c.to_numpy() for c in batch.slice(at, 4096).columns], axis=1)
                    z = np.hstack([lifted(x[:, 1:]), x[:, :1] * UNIT])
                    total += (z.T @ z).astype(np.int64)  # below 2**53: exact
            i, j = np.triu_indices(size)
            filled = total[i, j] != 0
            yield pa.RecordBatch.from_arrays([pa.array((i * size + j)[filled]), pa.array(total[i, j][filled])], names=["cell", "v"])

        parts = rows.select("y", *STATS).mapInArrow(run, "cell bigint, v bigint")
        found = parts.groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(size * size, np.int64)
        total[found.column("cell").to_numpy()] = found.column("v").to_numpy()
        total = total.reshape(size, size)
        return np.triu(total) + np.triu(total, 1).T

    def raw(self, x):
        return np.zeros(len(x)) if self.weights is None else self.lifted(x) @ self.weights / UNIT

    def calibration(self, rows: DataFrame):
        """Probability at the middle of each bin of raw scores, or None."""
        raw = self.raw

        def run(batches):
            n, s = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
            for batch in batches:
                x = np.stack([c.to_numpy() for c in batch.columns], axis=1)
                at = bins(raw(x[:, 1:]))
                n += np.bincount(at, minlength=BINS)
                s += np.bincount(at, weights=x[:, 0], minlength=BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(s)], names=["bin", "n", "s"])

        parts = rows.select("y", *STATS).mapInArrow(run, "bin bigint, n bigint, s bigint")
        found = parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").orderBy("bin").collect()
        if not found or self.weights is None:
            return None
        at = np.array([r["bin"] for r in found])
        return np.interp(np.arange(BINS), at, isotonic([r["n"] for r in found], [r["s"] for r in found]))

    def probability(self, x):
        """Scores of rows of statistics, from 0 to 1; within a step of the calibration the raw score still orders rows a little."""
        if self.values is None:
            return np.full(len(x), self.flat)
        raw = self.raw(x)
        place = np.clip((raw + 0.5) * (BINS / 2) - 0.5, 0, BINS - 1)
        return 0.99 * np.interp(place, np.arange(BINS), self.values) + 0.01 * np.clip((raw + 0.5) / 2, 0, 1)

    def score(self, described: DataFrame, *, key="doc_id", threshold=0.7) -> DataFrame:
        """One row per row of ``described``: (doc_id, held_out, score, predicted)."""
        probability = self.probability
        narrow = described.select(F.col("k_").alias(key), (held_out_fold("k_", FOLDS) == HELD_OUT).alias("held_out"), *STATS)
        schema = StructType([*narrow.schema.fields[:2], StructField("score", DoubleType())])

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = np.stack([c.to_numpy() for c in part.columns[2:]], axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(probability(x))], names=schema.names)

        return narrow.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def bins(raw):
    """Bins of raw scores between -0.5 and 1.5."""
    return np.clip(((raw + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def score_quality(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", **model) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    Null and empty texts and texts without a word are scored by their statistics, zeros; rows of a
    null id are scored, not learned from; repeated rows are scored each, and count each where they are
    labelled; an empty table gives an empty result.
    """
    described = materialise(document_statistics(docs, key=key, text=text), "quality-statistics")
    return QualityModel(described, labels, **model).score(described, key=key)
