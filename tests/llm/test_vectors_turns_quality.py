"""Whitening, conversation repair and the quality classifier against brute force, on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from math import isqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolex.llm import conversations, quality, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, n bigint, component string"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "x") for i, v in rows], VECTORS).repartition(3)


def brute_whitening(rows, k=16):
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], object)
    values, vectors = np.linalg.eigh((centred.T @ centred).astype(float) / float(n) ** 3)
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    return n, values[::-1][:k], vectors[:, ::-1][:, :k], deviation, x, np.array(sums, float) / n


def test_whitening_agrees_with_dense_algebra(spark):
    rng = np.random.default_rng(3)
    basis = rng.standard_normal((20, 20)) * np.geomspace(3, 0.05, 20)
    rows = [(i, [float(c) for c in (rng.standard_normal(20) @ basis).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # copies count once
    bad = [(2000, None), (2001, [float("nan")] * 20), (2002, [1.0] * 19 + [None]), (2003, [float("inf")] * 20), (2004, [])]
    frame = vector_rows(spark, rows + bad)
    n, values, vectors, deviation, x, mean = brute_whitening(rows)
    model = whitening.Whitening(frame)
    assert model.n == n == 400
    assert np.allclose(model.values, values, rtol=1e-12)
    assert np.abs(np.abs((model.vectors * vectors.T).sum(axis=1)) - 1).max() < 1e-12
    assert model.identity_error < 1e-12
    got = model.transform(frame).collect()
    assert len(got) == 600 * 16 and {r["vec_id"] for r in got} == set(x)
    for r in got[::97]:
        j = r["component"] - 1
        white = (np.array(x[r["vec_id"]]) - mean) @ model.vectors[j] / np.sqrt(values[j])
        assert r["deviation"] == deviation[r["vec_id"]] and abs(r["whitened"] - white) < 1e-9
        assert abs(r["explained"] - model.values[j] / np.trace(np.cov(np.array(sorted(set(map(tuple, x.values()))), float).T, bias=True))) < 1e-10


@pytest.mark.parametrize("p", [2147483647, 101])
def test_polynomial_of_a_matrix_modulo_a_prime(p):
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (7, 7))
    a[2:, 0] = 0  # no pivot in the first column
    a[1, 0] = 0
    expected = [round(c) % p for c in np.poly(a.astype(float))[::-1]]
    assert whitening.polynomial_mod(a, p).tolist() == expected


def test_roots_of_known_polynomial():
    coefficients = [1]
    for root in (0, 0, 2, 5, 5, 9, 1000):
        coefficients = [(coefficients[i - 1] if i else 0) - root * (coefficients[i] if i < len(coefficients) else 0) for i in range(len(coefficients) + 1)]
    assert whitening.largest_roots(coefficients, 16, 4) == [16 * r for r in (1000, 9, 5, 5, 2)]
    unit = 1 << 60  # roots 2 + sqrt 2 and 2 - sqrt 2
    assert whitening.largest_roots([2, -4, 1], 3, 60) == [2 * unit + isqrt(2 * unit ** 2) + 1, 2 * unit - isqrt(2 * unit ** 2)]


def test_whitening_awkward(spark):
    empty = vector_rows(spark, [(1, None)]).where("vec_id is null")
    assert whitening.Whitening(empty).transform(empty).collect() == []
    same = vector_rows(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert whitening.Whitening(same).transform(same).collect() == []
    # rank 1, other dimensions, a null id, equal eigenvalues, huge entries
    line = vector_rows(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)] + [(None, [0.0, 0.0, 0.0]), (9, [1.0])])
    got = whitening.Whitening(line).transform(line)
    assert got.count() == 7 and got.where("vec_id is null").count() == 1
    corners = vector_rows(spark, enumerate([float(c) for c in v] for v in itertools.product((0, 1), repeat=4)))
    model = whitening.Whitening(corners)
    assert len(model.values) == 4 and model.identity_error < 1e-9
    assert np.allclose(model.vectors @ model.vectors.T, np.eye(4), atol=1e-12)
    huge = vector_rows(spark, [(i, [float(i) * 1e30, float(i * i)]) for i in range(4)])
    model = whitening.Whitening(huge)
    assert model.identity_error < 1e-4 and model.transform(huge).where("deviation is null").count() == 4 * len(model.values)


def test_exact_sums_of_large_numbers(spark):
    rng = random.Random(2)
    rows = [[rng.randint(-2 ** 59, 2 ** 59), rng.randint(-9, 9)] for _ in range(50)]
    frame = spark.createDataFrame([(r,) for r in rows], "x_ array<bigint>").repartition(3)
    n, sums, products = whitening.exact_sums(frame)[2]
    assert n == 50 and list(sums) == [sum(c) for c in zip(*rows)]
    assert products.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(2)] for i in range(2)]


TURNS = "conv_id bigint, turn bigint, role string, text string, digest string, n int, part string"


def brute_repair(rows, damage):
    """Plain dynamic programme over single rows, the whole audits compared at every step."""
    groups = {}
    for c, t, r, x in rows:
        group = groups.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            group += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    wants, names = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    for c, group in groups.items():
        group.sort(key=lambda g: (g[0] is not None, g[0] or 0, g[1], hashlib.md5(g[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in group:
            left = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not left else "duplicate" if (r, x) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in group if t is not None]
        best = None
        for i in range(len(group), -1, -1):
            options = [[] for _ in range(4)]
            for state in range(4):
                if i == len(group):
                    if state in (0, 3):
                        options[state].append((0, "", ()))
                    continue
                _, r, x = group[i]
                more = [(3, "D", state, None)]
                if faults[i] not in ("blank", "duplicate"):
                    cut, target = faults[i] == "truncated", wants[state]
                    more.append((2 + cut, "R", target, f"{names[target]}:{x}"))
                    kept = {"s": 1, "u": 2, "a": 3}.get(r[:1])
                    if kept == target or (kept == 1 and state == 0):
                        more.append((cut, "K", kept, f"{r}:{x}"))
                for cost, letter, after, line in more:
                    if best[after]:
                        options[state].append((cost + best[after][0], letter + best[after][1], ((line,) if line is not None else ()) + best[after][2]))
            for _ in range(4):  # inserts, until nothing changes
                for state in range(4):
                    if options[wants[state]]:
                        cost, audit, lines = min(options[wants[state]])
                        options[state].append((cost + 2, "I" + audit, (f"{names[wants[state]]}:",) + lines))
            best = [min(o) if o else None for o in options]
        cost, audit, lines = best[0]
        yield (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
               sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(group)), cost, audit,
               hashlib.sha256("\n".join(lines).encode()).hexdigest())


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("damage", [True, False])
def test_repairs_agree_with_brute_force(spark, damage):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Hi.", "yes", "  ", " ok. ", "", None, "No!", "a\n", "b?"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [*range(150), None] for _ in range(rng.randint(1, 14))]
    # one conversation holds most rows: long runs, and a conversation over several tasks
    rows += [(1000, i, rng.choice(["user", "assistant"]) if i % 50 else "system", f"t{i % 37}.") for i in range(1500)]
    rows += [(1001, i, "user", "same.") for i in range(300)] + [(1002, i, "user", f"same {i}.") for i in range(400)]
    frame = spark.createDataFrame([(*r, "d", 1, "p") for r in rows], TURNS).repartition(5)
    got = sorted(map(tuple, conversations.repair_conversations(frame, damage=damage).select(*REPORT).collect()), key=str)
    assert got == sorted(brute_repair(rows, damage), key=str)


def test_repair_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = sorted(map(tuple, queries.QUERIES["op12_conversation_repair"](spark, SF).select(*REPORT).collect()))
    assert got == sorted(brute_repair(map(tuple, rows), True))


def test_powers_of_runs():
    powers = conversations.Powers()
    for symbol in range(9):
        after = conversations.CLOSE
        for length in range(1, 70):
            after = np.minimum((conversations.transition(symbol) + after).min(axis=1), conversations.FAR)
            assert powers.before(symbol, length, conversations.CLOSE).tolist() == after.tolist()


def test_repair_awkward(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.repair_conversations(empty, damage=True).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.", "", 1, "")], TURNS), damage=True).select(*REPORT).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = "word " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)]
    frame = spark.createDataFrame([(*r, "", 1, "") for r in rows], TURNS)
    assert [tuple(r) for r in conversations.repair_conversations(frame).select(*REPORT).collect()] == list(brute_repair(rows, False))


DOCS = "doc_id bigint, text string, lang string, k_ string, y double, fold int, upper string"


def plain_statistics(text):
    data, words = (text or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", text or "")
    size, some = max(len(data), 1), max(len(words), 1)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / size if data else np.zeros(256)
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    several = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in several for k in range(8)}
    marks = set("#*$%&|<>@^~=+_\\{}[]!?;:\"'()-/")
    return [
        np.log1p(len(data)) / 10, np.log1p(len(words)) / 10, min(sum(map(len, words)) / some, 50) / 10,
        (sum("A" <= c <= "Z" for c in text or "") + sum("À" <= c <= "Þ" for c in text or "")) / size, sum(c in "0123456789" for c in text or "") / size,
        sum(c in "#*$%&|<>@^~=+_\\{}[]" for c in text or "") / size, sum(c in "!?;:\"'()-/" for c in text or "") / size,
        sum(c in ".," for c in text or "") / size, sum(c >= "\x80" for c in text or "") / size, 1 - sum(b > 32 for b in data) / size,
        1 - (len(words) - len(set(words))) / some, sum(a == b for a, b in itertools.pairwise(words)) / some,
        min((len(lines) - len(set(lines))) / some, 1), len(covered) / some, min((text or "").count("\n") / some, 1),
        -sum(p * np.log2(p) for p in shares if p) / 8, sum(w[-1] in marks for w in words) / some]


def test_statistics_agree_with_plain_counting(spark):
    texts = ["", None, " \n\t ", "one", "Ünï ÇÖDÉ " * 9, "same line\n" * 30, "a | b | c! #x 12 (y)", "the end. the end. " * 12, "x" * 100_000, "Àé Þß ÷"]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["k_"]: [r[s] for s in quality.STATS] for r in quality.document_statistics(frame).collect()}
    assert len(got) == len(texts)
    for i, t in rows:
        assert np.allclose(got[i], plain_statistics(t)), (t, dict(zip(quality.STATS, zip(got[i], plain_statistics(t)))))


def test_normal_equations_are_the_sums_of_single_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    described = quality.document_statistics(docs).cache()
    model = quality.QualityModel(described, spark.read.parquet(f"{SF}/labels.parquet"), features=16)
    rows = described.withColumn("y", (F.col("k_") % 2).cast("double"))
    x = np.array(rows.select("y", *quality.STATS).collect())
    z = np.hstack([model.lifted(x[:, 1:]), x[:, :1] * quality.UNIT])
    for parts in (1, 7):
        assert (model.normal_equations(rows.repartition(parts)) == z.T @ z).all()


def test_isotonic():
    assert quality.isotonic([1, 1, 2, 1, 1], [0, 1, 1, 0, 1]).tolist() == [0, 0.5, 0.5, 0.5, 1]
    rng = np.random.default_rng(0)
    n, s = rng.integers(1, 9, 200), rng.integers(0, 3, 200)
    fit = quality.isotonic(n, s)
    sums = np.concatenate([[0], np.cumsum(s)])
    counts = np.concatenate([[0], np.cumsum(n)])
    for i in range(0, 200, 17):  # max over starts of the least mean over ends
        assert np.isclose(fit[i], max(min((sums[e] - sums[b]) / (counts[e] - counts[b]) for e in range(i + 1, 201)) for b in range(i + 1)))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.where("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    right = sum(r["quality"] == r["predicted"] for r in held) / len(held)
    low, high = ([r["score"] for r in held if r["quality"] == q] for q in (0, 1))
    assert len(held) > 60 and right > 0.95 and sum(a < b for a in low for b in high) / len(low) / len(high) > 0.97


def test_quality_awkward(spark):
    rows = [(i, t, "en", "k", 0.5, 1, "u") for i, t in [
        (0, None), (1, ""), (2, "word " * 300_000), (2, "word"), (None, "no id"), (3, "fine text, with words."), *((i, f"text {i}.") for i in range(4, 60))]]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (3, None, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(docs.where("false"), labels).collect() == []
    plain = quality.score_quality(docs, labels.where("false")).collect()
    assert {r["score"] for r in plain} == {0.5}
    only = quality.score_quality(docs, labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in only)
