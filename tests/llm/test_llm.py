"""The operators of duolex.llm against brute force, on awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check import canonical
from duolex.llm import decontamination, host_rules, language_id, minhash, mixing, queries, sharding, suffix_dedup, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, shard int, size double"
BASE = " ".join(f"w{i * 7919 % 1009}" for i in range(120))
TEXTS = [
    BASE, BASE, BASE + " tail words here", "x " + BASE, None, "", "   \n\t ", "one", "one", "a b", "Ünï çödé " * 12,
    "same line\n" * 30, BASE.replace("w5", "q5"), " ".join(f"z{i}" for i in range(9000)) + BASE, "#### $$$$ %%%% &&&&",
    "trailing space ", " leading", "two  spaces", "nb sp  em\x1c x", "it's <|endoftext|> we'll  <|endoftext|>",
]
ROWS = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 1, "n", 5, 0.5) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(docs):
    """Every row twice, and two rows without an id."""
    none = docs.where("doc_id in (0, 4)").withColumn("doc_id", F.lit(None).cast("bigint"))
    return docs.unionByName(docs).unionByName(none)


@pytest.fixture(scope="module")
def benchmark(spark):
    words = BASE.split()
    rows = [(1, " ".join(words[20:40]).upper()), (2, "tail, words!"), (3, None), (4, "..."), (1, " ".join(words[20:40])), (None, "nothing like it")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(con.execute(queries.ORACLES[name]).df())


def brute_repeats(rows, n):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            least[b[p:p + n]] = min(i, least.get(b[p:p + n], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if least[b[p:p + n]] < i:
                gone[p:p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1 << 13])
def test_repeats(docs, shard_bytes):
    got = suffix_dedup.remove_repeats(docs, shard_bytes=shard_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats([r[:2] for r in ROWS], 50))


def test_repeats_in_stretches(spark, monkeypatch):
    # texts that repeat themselves every few bytes, short and long, in pieces and across units
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    monkeypatch.setattr(suffix_dedup, "UNIT", 8192)
    monkeypatch.setattr(suffix_dedup, "CHAIN", 100)
    monkeypatch.setattr(suffix_dedup, "PAIRS", 300)
    stretches = [" " * 9000, "x" + " " * 3000 + "y", "=-" * 700 + "abc" * 300, ("=" * 60 + " head ") * 20, "abc" * 20 + "." + "=" * 51, "é" * 2000,
                 "0123456789" * 6 + BASE[:70] + "0123456789" * 9, " " * 49 + "z", "".join("ab" * (20 + i) + "#" for i in range(30)), " " * 4500]
    rows = list(enumerate(stretches + stretches[::-1]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for shard_bytes in (1 << 20, 1 << 12):
        got = suffix_dedup.remove_repeats(frame, shard_bytes=shard_bytes).collect()
        assert sorted(map(tuple, got)) == sorted(brute_repeats(rows, 50))


@pytest.mark.parametrize("text", [b" " * 100_000, b"=-" * 50_000, b"0123456789abcde" * 7_000])
def test_stretch_is_sent_once(text):
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    unit = [(data, np.array([0, len(data)]), np.array([3]), np.array([0]))]
    sent = [suffix_dedup.unpacked(blob) for _, _, blob in suffix_dedup.unit_rows(unit, 50, 4, suffix_dedup.Powers())]
    assert 0 < sum(a.nbytes for arrays in sent for a in arrays) < len(data) / 4


def test_repeats_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    monkeypatch.setattr(suffix_dedup, "UNIT", 8192)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats([r[:2] for r in ROWS], 50))


def test_repeats_awkward(repeated, empty):
    got = suffix_dedup.remove_repeats(repeated, with_kept=True)
    assert got.count() == 2 * len(ROWS) + 2
    assert got.where("doc_id = 0 and n_removed > 0").count() == 0  # copies under one id do not remove each other
    assert got.where("doc_id is null and n_removed = n_bytes").count() == 2
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_levels_merge_geometrically():
    import numpy as np

    words = np.zeros(100, np.uint64)
    family = suffix_dedup.LevelFamily(words, 50)
    for k in range(13):
        family.add(np.array([k], np.uint64), np.array([k]))
        assert len(family.levels) == bin(k + 1).count("1")
    assert family.known(np.arange(14).astype(np.uint64), np.zeros(14, int)).tolist() == [True] * 13 + [False]


def brute_groups(rows, k, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if j < i and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("words, num, den", [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates(spark, words, num, den):
    # chains of edits: neighbours are linked, ends are not; and many edits of one text
    rows, text = [r[:2] for r in ROWS], BASE.split()
    for i in range(30):
        text = text[:4 * i] + ["chain"] + text[4 * i + 1:]
        rows.append((100 + i, " ".join(text)))
        edited = BASE.split()
        for e in range(i % 7):
            edited[(i * 37 + e * 17) % 120] = f"e{i}x{e}"
        rows.append((200 + i, " ".join(edited)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = minhash.near_duplicates(frame, words=words, num=num, den=den)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute_groups(rows, words, num, den)


def test_near_duplicates_awkward(repeated, empty):
    found = minhash.near_duplicates(repeated)
    assert found.count() == 2 * len(ROWS) + 2
    assert found.where("component_id = 0 and first").count() == 1
    kept = minhash.drop_near_duplicates(repeated)
    assert kept.columns == repeated.columns
    assert kept.where("doc_id in (0, 1, 2, 3) or (doc_id is null and text is not null)").count() == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_mix(docs, repeated, empty):
    rows = mixing.mix_sources(repeated).collect()
    assert len(rows) == 2 * len(ROWS) + 2
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        size = sum(r.size for r in own)
        assert {r.source_size for r in own} == {size} and own[0].target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) * 2
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(repeated.repartition(7)).collect()))
    less = {r.doc_id: r.copies for r in mixing.mix_sources(docs, budget=0.4).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    assert all(less[i] <= more[i] for i in more)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().rdd.collectAsMap() == {i: c for i, c in more.items() if c}
    assert mixing.mix_sources(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = "<html><title>A &amp; B</title><script>x<p>y</script><!-- <p>no --><p>One<br>two &lt;3</p><a href='/l?a=1'>L</a>"
    rows = [(1, "http://a/x", page), (2, None, None), (3, "u", ""), (1, "http://a/x", page), (None, "u", "plain\r\n\r\ntext é")]
    responses = warc.responses_from_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    warc.write_responses(responses, str(tmp_path / "in"))
    again = warc.read_responses(spark, str(tmp_path / "in"))
    same = ["record_id", "target_uri", "warc_date", "http", "payload"]
    assert sorted(map(tuple, again.select(same).collect())) == sorted(map(tuple, responses.select(same).collect()))
    records = warc.derivatives(again)
    found = records.collect()
    assert len(found) == 2 * len(rows) and all(r.refers_to == r.source_id for r in found)
    own = {r.record_type: r for r in found if r.target_uri == "http://a/x"}
    assert own["conversion"].content == "A & B\nOne\ntwo <3\nL"
    assert "outlink: /l?a=1\r\n" in own["metadata"].content and "title: A & B\r\n" in own["metadata"].content
    assert "http-content-type: text/html; charset=utf-8\r\n" in own["metadata"].content
    assert own["conversion"].source_digest == warc.digest(page.encode())
    warc.write_warc(records, str(tmp_path / "out"))
    read = warc.read_warc(spark, str(tmp_path / "out"))
    assert sorted(bytes(r.content).decode() for r in read.collect()) == sorted(r.content for r in found)
    assert {r.headers["warc-refers-to"] for r in read.collect()} == {r.source_id for r in found}
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_warc_source_bytes(spark, tmp_path):
    """Other charsets, no blank line, no length, headers and digests of the source."""
    body = "<title>Élan</title><p>déjà vu</p>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1"
    sound = http + b"\r\n\r\n" + body

    def record(name, block, *headers, length=True):
        lines = [b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:%s>" % name, *headers]
        return b"\r\n".join(lines + [b"Content-Length: %d" % len(block)] * length) + b"\r\n\r\n" + block + b"\r\n\r\n"

    declared = b"WARC-Payload-Digest: sha1:DECLARED"
    (tmp_path / "a.warc").write_bytes(
        record(b"1", sound, declared, b"WARC-IP-Address: 10.0.0.1") + record(b"2", b"HTTP-less payload") + record(b"3", sound, length=False)
        + record(b"4", http) + record(b"5", "<meta charset='cp1251'>да".encode("cp1251")) + record(b"6", b"x <p charset=klingon>\xff"))
    found = warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()
    text = {r.source_id[5:-1]: r for r in found if r.record_type == "conversion"}
    fields = {r.source_id[5:-1]: r.content for r in found if r.record_type == "metadata"}
    assert {k: r.content for k, r in text.items()} == {
        "1": "Élan\ndéjà vu", "2": "HTTP-less payload", "3": "Élan\ndéjà vu", "4": "", "5": "да", "6": "x\n\ufffd"}
    assert text["1"].source_digest == text["3"].source_digest == warc.digest(body)
    assert f"source-block-digest: {warc.digest(sound)}\r\n" in fields["1"]
    assert "source-warc-payload-digest: sha1:DECLARED\r\nsource-warc-ip-address: 10.0.0.1\r\n" in fields["1"]
    assert "title: Élan\r\n" in fields["1"]
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), ("a", "u", "d", "", "<p>é", "x")],
                                "record_id string, target_uri string, warc_date string, http string, payload string, content string")
    assert sorted(r.content for r in warc.derivatives(odd).where("record_type = 'conversion'").collect()) == ["", "é"]


def test_warc_scanner_against_patterns():
    """The forward scanner against one pattern for each task, then on a megabyte of unclosed tags."""
    hidden = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
    title = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
    link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
    bits = ["<a ", "<A", "href=", " href = ", "'", '"', ">", "<title", "<title>", "</title >", "x", " ", "<script", "<STYLE>", "</style>", "</script>", "<p", "\n", "<"]
    rng = random.Random(5)
    for _ in range(20_000):
        page = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        assert warc.without_hidden(page) == hidden.sub(" ", page)
        assert warc.title_of(page) == (title.search(page) or ["", ""])[1]
        assert warc.links_of(page) == [next(filter(None, m.groups()), "") for m in link.finditer(page)]
        plain = warc.TAG.sub("", warc.BREAK.sub("\n", hidden.sub(" ", page)))
        assert warc.plain_text(page) == warc.LINES.sub("\n", warc.BLANKS.sub(" ", plain)).strip()
    for bit in ("<title>", "<a ", "<a href=x ", "<script ", "<p", "<style", "<!--", '<a href="', "</title "):
        start = time.process_time()
        list(warc.derive("r", "u", "d", b"", (bit * (1_000_000 // len(bit))).encode(), ()))
        assert time.process_time() - start < 3


def test_toxicity(spark, docs, empty):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.ToxicityModel(frame, labels)
    rows = model.score(frame).join(labels, "doc_id").where("held_out").collect()
    hits = [r.predicted for r in rows if r.toxic == 1]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9 and sum(hits) >= len(hits) / 2
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)
    scored = model.score(docs).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = toxicity.ToxicityModel(docs, labels.limit(0))
    assert none.score(docs).where("predicted = 1").count() == 0
    assert model.score(empty).count() == 0


def kneser_ney_ratios(grams, probabilities=False):
    """(gram, c0, c1) rows to {gram: log P1/P0 of its last character} and
    {context: log of the back-off weights' ratio}, in memory; or the probabilities and weights of each class."""
    counts = [{}, {}]
    for gram, *pair in grams:
        for c, n in zip(counts, pair):
            if n:
                c[gram] = n
    by_order = [[defaultdict(int) for _ in range(toxicity.ORDER + 1)] for _ in counts]
    for c, levels in zip(counts, by_order):
        for gram, n in c.items():
            levels[len(gram)][gram] += n
        for n in range(toxicity.ORDER, 1, -1):  # lower orders count in how many contexts they continue
            for gram in levels[n]:
                levels[n - 1][gram[1:]] += 1
    for n in range(1, toxicity.SHARED + 1):
        both = defaultdict(int)
        for levels in by_order:
            for gram, k in levels[n].items():
                if not gram.startswith("^"):
                    both[gram] += k
        for levels in by_order:
            levels[n] = {**{g: k for g, k in levels[n].items() if g.startswith("^")}, **both}
    n_chars = len(by_order[0][1]) + 1
    known = [{}, {}]
    weights = [{}, {}]
    ratios = {}
    for n in range(1, toxicity.ORDER + 1):
        grams_n = set(by_order[0][n]) | set(by_order[1][n])
        for levels, p, w in zip(by_order, known, weights):
            spread = Counter(levels[n].values())
            discount = spread[1] / (spread[1] + 2 * spread[2]) if spread[1] and spread[2] else 0.75
            total, kinds = defaultdict(int), defaultdict(int)
            for gram, k in levels[n].items():
                total[gram[:-1]] += k
                kinds[gram[:-1]] += 1
            for context, t in total.items():
                w[context] = discount * kinds[context] / t
            for gram in grams_n:
                context = gram[:-1]
                lower = p.get(gram[1:], 1 / n_chars) if n > 1 else 1 / n_chars
                if context in total:
                    p[gram] = max(levels[n].get(gram, 0) - discount, 0) / total[context] + w[context] * lower
                else:
                    p[gram] = lower
        for gram in grams_n:
            ratios[gram] = math.log(known[1][gram] / known[0][gram])
    contexts = set(weights[0]) | set(weights[1])
    if probabilities:
        return known, weights, n_chars
    return ratios, {c: math.log(weights[1].get(c, 1.0) / weights[0].get(c, 1.0)) for c in contexts if c}


def word_ratio(word, ratios, backoffs):
    """Log-likelihood ratio of a word, toxic over ordinary, per character read."""
    padded, total = f"^{word}$", 0.0
    for i in range(1, len(padded)):
        low = max(0, i - toxicity.ORDER + 1)
        while low <= i:
            found = ratios.get(padded[low:i + 1])
            if found is not None:
                total += found
                break
            total += backoffs.get(padded[low:i], 0.0)
            low += 1
    return total / (len(padded) - 1)


def test_kneser_ney_sums_to_one():
    words = {"^a": (3, 1), "^ab": (2, 1), "^aba": (2, 0), "^abab": (1, 0), "^ababc": (1, 2), "babcd": (1, 1), "ababcd": (3, 1), "babcd$": (4, 2)}
    ratios, backoffs = kneser_ney_ratios((g, *c) for g, c in words.items())
    assert ratios and all(abs(v) < 20 for v in (*ratios.values(), *backoffs.values()))
    assert word_ratio("ababcd", ratios, backoffs) != 0
    known, weights, n_chars = kneser_ney_ratios(((g, *c) for g, c in words.items()), probabilities=True)
    chars = {g for g in known[0] if len(g) == 1} | {"?"}  # one that was never seen
    assert len(chars) == n_chars
    for p, w in zip(known, weights):
        def chance(context, c):
            if context + c in p:
                return p[context + c]
            return w.get(context, 1.0) * (chance(context[1:], c) if context else 1 / n_chars)

        for context in w:
            assert sum(chance(context, c) for c in chars) == pytest.approx(1)


@pytest.fixture(scope="module")
def labelled_words(spark):
    """Rare words in plenty, some only in texts that are scored; one of very many characters."""
    kinds = ["".join(chr(97 + (i * 31 + j * j * 7 + i // (j + 1)) % 26) for j in range(3 + i % 9)) for i in range(400)]
    rows = [(i, " ".join(kinds[(i * 17 + j * (3 if i % 2 else 5)) % 400] for j in range(20)) + (" idiot" if i % 2 else "")) for i in range(200)]
    rows += [(200, "unseen wörter only idiotic"), (201, None), (202, "zq" * 5000 + " idiot"), (203, "...")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), labels


def test_toxicity_counts_all_grams(labelled_words):
    # the tables against the same model in memory, over every n-gram of the learning rows
    frame, labels = labelled_words
    model = toxicity.ToxicityModel(frame, labels, max_words=50)
    counts = {}
    for i, text in frame.where("doc_id < 200").collect():
        if 0 < zlib.crc32(str(i).encode()) % 5 < 4:
            for w in toxicity.WORD.findall(text.lower()):
                padded = f"^{w}$"
                for k in range(1, len(padded)):
                    counts.setdefault(padded[max(0, k - 5):k + 1], [0, 0])[i % 2] += 1
    ratios, backoffs = kneser_ney_ratios((g, *c) for g, c in counts.items())
    assert dict(map(tuple, model.ratios.collect())) == pytest.approx(ratios)
    assert dict(map(tuple, model.backoffs.collect())) == pytest.approx(backoffs)
    texts = dict(map(tuple, frame.collect()))
    for r in model.described(frame.select("doc_id", "text")).collect():
        words = toxicity.WORD.findall((texts[r.doc_id] or "").lower())
        got = {w: word_ratio(w, ratios, backoffs) for w in words}
        whole = sum(got[w] * (len(w) + 1) for w in words) / sum(len(w) + 1 for w in words) if words else 0
        best = sorted(got.values(), reverse=True)[:3] or [0]
        assert (r.whole, r.top, r.leading) == pytest.approx((whole, best[0], sum(best) / 3), abs=1e-6)


def test_toxicity_does_not_depend_on_bounds(labelled_words):
    frame, labels = labelled_words
    few, all_ = (toxicity.ToxicityModel(frame, labels, max_words=n) for n in (0, 200_000))
    one, other = (sorted(map(tuple, m.score(frame).collect())) for m in (few, all_))
    assert [r[0] for r in one] == list(range(204)) and one == other
    kept = [sorted(r.doc_id for r in toxicity.drop_toxic(frame, few, max_broadcast=n).collect()) for n in (0, 1000)]
    assert kept[0] == kept[1] == [r[0] for r in one if not r[3]]


def test_host_rules_awkward(repeated, empty):
    rows = host_rules.judge_by_host(repeated).collect()
    assert len(rows) == 2 * len(ROWS) + 2
    line = next(r for r in rows if r.doc_id == 11)
    assert (line.n_words, line.n_dup_lines, line.n_repeat_words, line.base_failed, line.kept) == (60, 29, 60, True, False)
    assert all(r.n_words == 0 and r.base_failed for r in rows if r.doc_id in (4, 5, 6))
    assert host_rules.judge_by_host(empty).count() == 0


CLASHING = ("row_ id_ th_ d_ t_ h_ b_ s_ k_ w_ hit_ entry_ buckets_ text_ source_ hash spans items th first h copies threshold_ "
            "epochs_ n_shingles component_id kept score n_words").split()


def test_clashing_names(docs, benchmark, spark):
    extra = docs.drop("shard").withColumns({c: F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")) for c in CLASHING})
    model = toxicity.ToxicityModel(extra, spark.createDataFrame([(0, 1), (1, 0), (7, 1), (9, 0)], "doc_id bigint, toxic int"))
    for out in (toxicity.drop_toxic(extra, model), minhash.drop_near_duplicates(extra), decontamination.drop_contaminated(extra, benchmark),
                mixing.mix_documents(extra), sharding.shard_by_bytes(extra, limit=500)):
        rows = out.collect()
        assert rows and out.columns[:len(extra.columns)] == extra.columns
        assert all(r[c] == f"{c}={r.doc_id}" for r in rows for c in CLASHING)
    for out in (mixing.mix_sources(extra), minhash.near_duplicates(extra), suffix_dedup.remove_repeats(extra), host_rules.judge_by_host(extra),
                language_id.identify_languages(extra), decontamination.find_hits(extra, benchmark), model.score(extra),
                token_counts.count_tokens(extra, public_tokenizers.path("byte_bpe_50k.json"))):
        assert out.count() == len(ROWS)


def test_shards(repeated, empty):
    for limit in (1 << 20, 2000, 10):
        rows = sharding.shard_by_bytes(repeated, limit=limit).collect()
        assert len(rows) == 2 * len(ROWS) + 2
        for shard in {r.shard for r in rows}:
            own = [r for r in rows if r.shard == shard]
            size = sum(r.n_bytes for r in own)
            assert {r.shard_bytes for r in own} == {size} and {r.shard_docs for r in own} == {len(own)}
            assert size <= limit or (len({r.doc_id for r in own}) == 1 and own[0].oversize)
    assert sharding.shard_by_bytes(empty).count() == 0


def test_token_counts(repeated, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for head in (1 << 18, 3):
        rows = token_counts.count_tokens(repeated, path, max_head=head).join(repeated.select("doc_id", "text").distinct(), "doc_id").collect()
        assert len(rows) == 2 * len(ROWS)
        for r in rows:
            text = r.text or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids)), text[:40]
    assert token_counts.count_tokens(empty, path).count() == 0


def test_cuts_never_change_counts():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    gaps = [" ", "  ", "\n", " \n", "\n ", "\t", " ", "\x1c", "　", "​", "'s", "1", "!", "<|endoftext|>"]
    for a in gaps:
        for b in gaps:
            text = f"ab{a}cd{b}ef {a}{b} gh"
            pieces = sum(len(library.encode(token_counts.surface(p), add_special_tokens=False).ids) for p in token_counts.pre_tokens(text))
            assert pieces == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_decontamination_awkward(repeated, benchmark, empty, spark):
    rows = decontamination.find_hits(repeated, benchmark).collect()
    assert len(rows) == 2 * len(ROWS) + 2
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in rows if r.doc_id is not None}
    assert got[0] == (120, 20, ["1"]) and got[2] == (123, 22, ["1", "2"]) and got[5] == (0, 0, [])
    left = decontamination.drop_contaminated(repeated, benchmark)
    assert left.columns == repeated.columns and left.where("doc_id in (0, 1, 2, 3, 13)").count() == 0 and left.where("doc_id = 7").count() == 2
    masked = {r.doc_id: r.kept_words for r in decontamination.mask_spans(repeated, benchmark).collect()}
    assert masked[0] == BASE.split()[:20] + BASE.split()[40:]
    assert decontamination.mask_spans(repeated, benchmark).count() == 2 * len(ROWS) + 2
    assert left.where("doc_id is null and text is null").count() == 1  # another row without an id was hit
    assert decontamination.find_hits(empty, benchmark).count() == 0
    assert decontamination.find_hits(repeated, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_languages(spark, docs, empty):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_languages(frame).join(frame, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.99 * len(rows)
    rows = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    assert len(rows) == len(ROWS) and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (4, 5, 6, 14))
    nothing = language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify_languages(empty).count() == 0
    same = docs.where("text is not null").withColumn("doc_id", F.lit(None).cast("bigint"))
    assert len(language_id.sample_texts(same.select(F.lit("").alias("id"), "lang", "text"), 3, 500)["en"]) <= 500


def test_phrases_against_plain_parse():
    import numpy as np

    samples = [b"the cat sat on the mat", b"le chat est sur la table"]
    classes, n = language_id.letter_classes(samples)
    codes = [language_id.classify(np.frombuffer(s, np.uint8), np.array([0, len(s)]), classes)[0] for s in samples]
    text = b"the chat sat  on zebras \xc3\xa9 le mat"
    coded, offsets = language_id.classify(np.frombuffer(text, np.uint8), np.array([0, len(text)]), classes)
    got = language_id.phrases(coded, offsets, *language_id.parser_table(codes, n))[:, 0]
    for sample, found in zip(codes, got):
        inside, own, at, count = bytes(sample), bytes(coded), 0, 0
        while at < len(own):
            size = 1
            while at + size < len(own) and own[at:at + size + 1] in inside:
                size += 1
            at, count = at + size, count + 1
        assert count == found


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= {r.doc_id for r in before.collect()}
        if name == "near_duplicates":
            groups = brute_groups([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)
            assert kept[name] == {i for i, _, _, first in groups if first}
        if name == "decontamination":
            hits = decontamination.find_hits(before, queries.table(spark, SF, "benchmark")).where("n_hit > 0").collect()
            assert kept[name] == {r.doc_id for r in before.collect()} - {r.doc_id for r in hits}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("shard is null").count() == 0


def test_sorts_of_suffix_dedup():
    from duolex.llm.bytesets import stable_order

    rng = np.random.default_rng(3)
    for keys in (np.zeros(0, np.int64), np.zeros(9, np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(-40, 40, 5000)):
        assert (stable_order(keys) == np.argsort(keys, kind="stable")).all()
    data = rng.integers(0, 256, 500, dtype=np.uint8)
    words = suffix_dedup.eights(data[3:])
    assert words.tolist() == [int.from_bytes(data[i:i + 8].tobytes(), "little") for i in range(3, 493)]
    assert np.shares_memory(words, data)  # a view, nothing is copied


def test_windows_are_asked_for_if_their_surroundings_are_shared(monkeypatch):
    # all texts share words of 30 bytes, hence anchors, and two of them a passage of 60
    rng = np.random.default_rng(5)
    word = [rng.integers(97, 123, 30, dtype=np.uint8) for _ in range(20)]
    own = [np.concatenate([np.append(word[j], rng.integers(48, 58, 40, dtype=np.uint8)) for j in rng.permutation(20)]) for _ in range(40)]
    own[7][500:560] = own[31][900:960]
    offsets = np.append(0, np.cumsum([len(t) for t in own]))
    powers, asked, known = suffix_dedup.Powers(), [], suffix_dedup.LevelFamily.known

    def counted(self, prints, places):
        asked.append(len(prints))
        return known(self, prints, places)

    monkeypatch.setattr(suffix_dedup.LevelFamily, "known", counted)
    blobs = []  # each text as a unit of its own, so that equal runs are not found before they are sent
    for i, text in enumerate(own):
        unit = [(text, np.array([0, len(text)]), np.array([i]), np.array([0]))]
        blobs += [blob for _, bucket, blob in suffix_dedup.unit_rows(unit, 50, 1, powers) if bucket < 0]
    ids, starts, ends, *_ = suffix_dedup.shard_hits(blobs, 50, powers)
    assert set(ids.tolist()) == {31}
    assert (starts.min(), ends.max()) == (900, 960)
    assert 0 < sum(asked) < offsets[-1] / 100


@pytest.mark.parametrize("length", [20, 21, 50, 61, 120])
def test_repeats_of_other_lengths(spark, length):
    rng = np.random.default_rng(length)
    passages = ["".join(rng.choice(list("abcd "), size=int(n))) for n in rng.integers(length - 4, length + 9, 12)]
    rows = [(i, "".join("".join(rng.choice(list("abcdefgh "), size=int(rng.integers(0, 30)))) + passages[j] for j in rng.integers(0, 12, 6))) for i in range(40)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), length=length, shard_bytes=1 << 12)
    assert sorted(map(tuple, got.collect())) == sorted(brute_repeats(rows, length))


def test_steps_of_pipeline_bound_what_workers_are_sent(spark):
    from duolex import session

    kept = {k: spark.conf.get(k, None) for k in (session._BATCH_LIMIT, "spark.sql.execution.arrow.maxRecordsPerBatch")}
    wide = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"), F.repeat(F.lit("ab "), 2000).alias("text"))
    steps = [lambda: toxicity.count_words(wide.select("toxic", "text")), lambda: toxicity.count_grams(wide.select(F.col("text").alias("word"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
             lambda: minhash.sketches(wide.select(F.col("doc_id").alias("node"), "text"), 3)]
    try:
        for step in steps:
            spark.conf.set(session._BATCH_LIMIT, 64 << 20)
            step()
            assert int(spark.conf.get(session._BATCH_LIMIT)) == session.BATCH_BYTES
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
