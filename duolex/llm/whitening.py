"""Whitening by the exact characteristic polynomial of an integer scatter matrix.

Vectors become whole numbers.  Spark adds up their sums and products exactly, so
the scatter matrix is one of integers.  Its characteristic polynomial is found
modulo many primes (Hessenberg form, one Spark task for some primes each) and put
together by Chinese remaindering.  Its roots, all real, are isolated and narrowed
in whole-number arithmetic by Descartes' rule, which counts exactly here.  Each
component is the null space of the matrix less its root: inverse iteration, then
corrections from residuals computed in whole numbers.

What reaches the driver has the size of the matrix, whatever the number of rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duolex.session import materialise

LIMIT = 1 << 60  # whole numbers are held between -LIMIT and LIMIT
LIMB = 32  # exact sums travel in pieces of so many bits
PRECISION = 120  # bits of the components while they are corrected


def whole_vectors(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """Adds ``x_``, floor(scale * entry) per entry; rows with a null vector or a null
    or non-finite entry, and empty vectors, go."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    edge = F.lit(float(LIMIT))
    return kept.withColumn("x_", F.transform(vector, lambda c: F.floor(
        F.greatest(F.least(c.cast("double") * scale, edge), -edge)).cast("bigint")))


def vectors_of(column):
    """{dimension: (row numbers, int64 matrix)} of an Arrow list column without nulls."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    found = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        found[int(d)] = at, flat[starts[at][:, None] + np.arange(d)]
    return found


def product(x):
    """x^T x, exact: by floats while every sum stays below 2**53, else in Python's whole numbers."""
    top = int(np.abs(x).max()) if x.size else 0
    if top and len(x) * top * top >= 1 << 53:
        step = (1 << 53) // (top * top)
        if not step:
            wide = x.astype(object)
            return wide.T @ wide
        return sum((product(x[i:i + step]) for i in range(0, len(x), step)), np.zeros((x.shape[1],) * 2, object))
    floats = x.astype(float)
    return (floats.T @ floats).astype(np.int64).astype(object)


def exact_sums(distinct: DataFrame) -> dict:
    """{dimension: (n, sums, matrix of product sums)} over rows of ``x_``, in whole numbers.

    A task keeps one matrix per dimension it meets and sends each cell in pieces of
    32 bits, which Spark adds up."""

    def run(batches):
        sums = {}
        for batch in batches:
            for d, (_, x) in vectors_of(batch.column(0)).items():
                one = np.hstack([np.ones((len(x), 1), np.int64), x])
                sums[d] = sums[d] + product(one) if d in sums else product(one)
        for d, matrix in sums.items():
            cells, limbs, values = [], [], []
            for i in range(d + 1):
                for j in range(i, d + 1):
                    v, limb = int(matrix[i, j]), 0
                    sign = -1 if v < 0 else 1
                    v = abs(v)
                    while v:
                        cells.append(i * (d + 1) + j)
                        limbs.append(limb)
                        values.append(sign * (v & ((1 << LIMB) - 1)))
                        v >>= LIMB
                        limb += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(cells), pa.int64()), pa.array(cells, pa.int64()), pa.array(limbs, pa.int64()), pa.array(values, pa.int64())],
                names=["d", "cell", "limb", "v"])

    parts = distinct.select("x_").mapInArrow(run, "d bigint, cell bigint, limb bigint, v bigint")
    found = {}
    for d, cell, limb, v in parts.groupBy("d", "cell", "limb").agg(F.sum("v").alias("v")).toArrow().to_pandas().itertuples(index=False):
        matrix = found.setdefault(int(d), np.zeros((int(d) + 1,) * 2, object))
        i, j = divmod(int(cell), int(d) + 1)
        matrix[i, j] += int(v) << (LIMB * int(limb))
        matrix[j, i] = matrix[i, j]
    return {d: (m[0, 0], m[0, 1:], m[1:, 1:]) for d, m in found.items()}


def is_prime(n):
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return n > 1


def primes_for(bits):
    """Primes below 2**31 whose product exceeds 2**bits."""
    found, have, n = [], 0.0, (1 << 31) - 1
    while have <= bits + 1:
        if is_prime(n):
            found.append(n)
            have += math.log2(n)
        n -= 2
    return found


def polynomial_mod(matrix, p):
    """Coefficients, lowest first, of det(t - matrix) modulo the prime ``p``."""
    h = np.array([[int(v) % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for m in range(1, d - 1):
        pivot = m + int(np.argmax(h[m:, m - 1] != 0))
        if h[pivot, m - 1] == 0:
            continue
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = polys[k - 1, :-1]
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):  # weight of polys[i]
            weights[i] = h[i, k - 1] * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        polys[k] = (row - (polys[:k] * weights[:, None] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark, matrix):
    """Integer coefficients, lowest first; ``matrix`` is symmetric, without negative roots."""
    d = len(matrix)
    trace = sum(int(matrix[i, i]) for i in range(d))
    # the means of the roots' products bound every coefficient
    primes = primes_for(d * (math.log2(trace + d) - math.log2(d)) + 2)
    shared = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([polynomial_mod(shared.value, p).tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    slices = min(len(primes), max(spark.sparkContext.defaultParallelism, 1))
    table = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(slices, "p")
    found = dict(map(tuple, table.mapInArrow(run, "p bigint, c array<bigint>").collect()))
    shared.unpersist()
    whole = math.prod(primes)
    coefficients = [0] * (d + 1)
    for p, residues in found.items():
        rest = whole // p
        unit = rest * pow(rest, -1, p)
        coefficients = [c + r * unit for c, r in zip(coefficients, residues)]
    coefficients = [c % whole for c in coefficients]
    coefficients = [c - whole if c > whole // 2 else c for c in coefficients]
    assert coefficients[d] == 1 and coefficients[d - 1] == -trace
    return coefficients


def shifted(coefficients, a):
    """Coefficients of p(t + a)."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    return c


def roots_above(coefficients, a):
    """How many roots exceed ``a``, with multiplicity: sign changes, exact where all roots are real."""
    signs = [c > 0 for c in shifted(coefficients, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_sign(coefficients, a):
    total = 0
    for c in reversed(coefficients):
        total = total * a + c
    return (total > 0) - (total < 0)


def largest_roots(coefficients, k, bits):
    """The ``k`` largest positive roots times 2**bits, rounded up, falling; fewer where fewer are positive."""
    d = len(coefficients) - 1
    scaled = [c << (bits * (d - i)) for i, c in enumerate(coefficients)]
    k = min(k, roots_above(scaled, 0))
    top = max(-scaled[d - 1], 1)  # the trace
    known, roots = {0: roots_above(scaled, 0), top: 0}, []

    def above(a):
        if a not in known:
            known[a] = roots_above(scaled, a)
        return known[a]

    for j in range(1, k + 1):
        low = max(a for a, n in known.items() if n >= j)
        high = min(a for a, n in known.items() if n < j)
        while high - low > 1 and not (known[low] == j and known[high] == j - 1):
            middle = (low + high) // 2
            if above(middle) >= j:
                low = middle
            else:
                high = middle
        if high - low > 1:  # one root in (low, high]: its sign tells the side
            right = value_sign(scaled, high)
            while right and high - low > 1:
                middle = (low + high) // 2
                sign = value_sign(scaled, middle)
                if sign == 0:
                    high = middle
                    break
                if sign == right:
                    high = middle
                else:
                    low = middle
        roots.append(high)
    return roots


def components(matrix, roots, bits):
    """Unit eigenvectors (rows) of the integer matrix for ``roots`` / 2**bits, to double precision."""
    d = len(matrix)
    trace = sum(int(matrix[i, i]) for i in range(d))
    a = np.array([[int(v) / trace for v in row] for row in matrix])
    wide = np.array([[int(v) << bits for v in row] for row in matrix], object)  # like the roots
    unit = 1 << PRECISION
    out, rng = [], np.random.default_rng(7)
    for j, root in enumerate(roots):
        value = root / (trace << bits)
        near = [i for i in range(j) if abs(roots[i] - root) <= (trace << bits) >> 40]  # equal, or as good as
        v = rng.standard_normal(d)
        shift = a - (value + 2.0 ** -50) * np.eye(d)
        for _ in range(4):
            for i in near:
                v -= (v @ out[i]) * out[i]
            v /= np.linalg.norm(v)
            v = np.linalg.solve(shift, v)
        for i in near * 2:
            v -= (v @ out[i]) * out[i]
        v /= np.linalg.norm(v)
        if not near and not any(abs(r - root) <= (trace << bits) >> 40 for r in roots[j + 1:]):
            exact = np.array([int(c * (1 << 60)) << (PRECISION - 60) for c in v], object)
            for _ in range(6):
                residual = wide @ exact - root * exact  # times 2**(bits + PRECISION)
                lack = (unit * unit - int(exact @ exact)) >> PRECISION
                bordered = np.zeros((d + 1, d + 1))
                bordered[:d, :d] = a - value * np.eye(d)
                bordered[:d, d] = bordered[d, :d] = v
                size = max(max(abs(int(r)) for r in residual), 1)
                right = np.array([-(int(r) / size) for r in residual] + [0.0])
                step = np.linalg.solve(bordered, right)[:d]
                factor = (size << 60) // (trace << bits)  # step * size / (trace * 2**bits), 60 bits more
                exact = exact + np.array([(int(s * (1 << 60)) * factor) >> 120 for s in step], object) + exact * lack // (2 * unit)
            v = np.array([int(c) / unit for c in exact])
        v = v / math.sqrt(math.fsum(v * v))
        out.append(v * (1.0 if v[np.argmax(np.abs(v))] >= 0 else -1.0))
    return np.array(out).reshape(len(roots), d)


def centred(x, n, sums):
    """n * x - sums, exact: int64, or Python's whole numbers where that is too narrow."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max((abs(int(s)) for s in sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - sums


class Whitening:
    """A whitening fitted on the distinct vectors of ``rows``.

    Attributes: ``n`` and ``dim``, the integer ``sums``, ``values`` (eigenvalues of the
    covariance, falling), ``vectors`` (a component a row), ``explained`` and
    ``identity_error``.  The dimension is the one of most distinct vectors (the larger
    one of two); vectors of another dimension are left out.  Without rows, or where
    all vectors are equal, there is no component.
    """

    def __init__(self, rows: DataFrame, *, vector="embedding", scale=64, k=16):
        spark = rows.sparkSession
        self.vector, self.scale = vector, scale
        distinct = materialise(whole_vectors(rows.select(vector), vector, scale).select("x_").distinct(), "whiten-distinct")
        found = exact_sums(distinct)
        self.dim = max(found, key=lambda d: (found[d][0], d)) if found else 0
        self.n, self.sums, products = found.get(self.dim, (0, np.zeros(0, object), np.zeros((0, 0), object)))
        scatter = products * self.n - np.outer(self.sums, self.sums)  # n^2 times the covariance
        trace = sum(int(scatter[i, i]) for i in range(self.dim))
        self.values, self.explained, self.vectors, self.identity_error = [], [], np.zeros((0, self.dim)), 0.0
        if trace:
            bits = max(0, 100 - trace.bit_length())
            roots = largest_roots(characteristic_polynomial(spark, scatter), k, bits)
            self.values = [r / (self.n * self.n << bits) for r in roots]
            self.explained = [r / (trace << bits) for r in roots]
            self.vectors = components(scatter, roots, bits)
            self.identity_error = self.deviation_from_identity(distinct)

    def projector(self):
        """A function of int64 rows: (centred rows, whitened rows)."""
        n, sums, basis = self.n, self.sums, (self.vectors / np.sqrt(np.array(self.values))[:, None]).T

        def project(x):
            exact = centred(x, n, sums)
            return exact, (exact / n).astype(float) @ basis

        return project

    def deviation_from_identity(self, distinct: DataFrame) -> float:
        """Largest absolute entry of the whitened covariance over the fit list, less the identity."""
        project, dim, k = self.projector(), self.dim, len(self.values)

        def run(batches):
            total = np.zeros((k + 1, k + 1))
            for batch in batches:
                at, x = vectors_of(batch.column(0)).get(dim, ((), None))
                if len(at):
                    w = np.hstack([np.ones((len(at), 1)), project(x)[1]])
                    total += w.T @ w
            cells = np.arange((k + 1) ** 2)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "v"])

        sums = distinct.select("x_").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((k + 1) ** 2)
        for r in sums:
            total[r["cell"]] = r["v"]
        total = total.reshape(k + 1, k + 1) / self.n
        covariance = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])
        return float(np.abs(covariance - np.eye(k)).max())

    def transform(self, rows: DataFrame, key="vec_id") -> DataFrame:
        """(key, component, n, deviation, whitened, explained, identity_error): one row per
        row of ``rows`` that remains and component.

        A deviation beyond a long is null.  Repeated rows are whitened each, null keys
        stay null; an empty table gives an empty result.
        """
        project, dim, k, n = self.projector(), self.dim, len(self.values), self.n
        explained, error = np.array(self.explained), self.identity_error
        narrow = whole_vectors(rows.select(F.col(key).alias("k_"), F.col(self.vector).alias("v_")), "v_", self.scale).select("k_", "x_")
        schema = StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
        schema = StructType([narrow.schema["k_"], *schema.fields])

        def run(batches):
            for batch in batches:
                at, x = vectors_of(batch.column(1)).get(dim, ((), None))
                if not len(at) or not k:
                    continue
                exact, white = project(x)
                wide = exact.astype(float)
                if (wide * wide).sum(axis=1).max() < 2.0 ** 62:
                    deviation = pa.array((exact * exact).sum(axis=1).astype(np.int64))
                else:
                    squares = [sum(int(c) ** 2 for c in row) for row in exact]
                    deviation = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
                rows_of = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)).take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, n, np.int64)), deviation.take(rows_of), pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(at))), pa.array(np.full(len(at) * k, error))], names=schema.names)

        return narrow.mapInArrow(run, schema).withColumnRenamed("k_", key)
