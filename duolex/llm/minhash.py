"""Near-duplicate groups by circulant MinHash.

One permutation places a document's shingles on a circle of 2^32 positions, a
second one orders the circle; turned by 1, 2, 3 .. steps, that second permutation
gives all signature coordinates.  Bands of the signature name candidates.  Every
link is confirmed on the full shingle sets of the two texts.

Copies with the same words are one node.  Shingles that no other candidate has
bound a node's similarity to all others: ``J(x, y) <= v / (|x| + |y| - v)`` with v
the lesser number of shingles that x or y shares with anyone.  Nodes that cannot
reach the threshold leave before any pair is made.  A bit sketch of the shingles
bounds a pair from the other side: ``x`` and ``y`` differ in as many shingles as
sketch bits at least, or in more.  Pairs beyond either bound are never emitted.
In a bucket the heaviest members are compared first with those that are not in
their group yet; of what is then left in different groups only pairs within the
bounds are read.  No link between different groups is left out.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duolex.llm.bytesets import BASE, LOWER, U, Powers, prefix_sums, span_prints, spread_bits, text_slices, windows, word_spans
from duolex.llm.suffix_dedup import packed, split_by, unpacked
from duolex.session import materialise, small_batches

ROWS = 5  # coordinates to a band
MISS = 1e-8  # chance that a pair right at the threshold shares no band
TURN = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
SLICE = 1 << 20
SKETCH = 16  # 64-bit words to a text
SKETCHED = [f"s{i}" for i in range(SKETCH)]


def bands_for(similarity):
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def shingles(data, offsets, k, powers):
    """Rows and 64-bit prints of all shingles; also the words' prints and rows."""
    data = LOWER[data]
    sums = prefix_sums(data, powers)
    starts, ends, rows = word_spans(data, offsets)
    words = span_prints(sums, starts, ends, powers)
    prints, first = windows(words, rows, k)
    found, found_rows = [prints], [rows[first]]
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    for short in range(1, k):  # too few words: all of them as one
        if (n_words == short).any():
            prints, first = windows(words, rows, short)
            whole = n_words[rows[first]] == short
            found.append(prints[whole])
            found_rows.append(rows[first][whole])
    return np.concatenate(found_rows), np.concatenate(found), words, rows


def distinct(rows, prints, n_rows):
    """Distinct (row, print) in order."""
    shift = U(64 - max(int(n_rows - 1).bit_length(), 1))
    # the row replaces the top bits, which leaves 48 bits of print or more
    keys = (rows.astype(np.uint64) << shift) | (prints & ((U(1) << shift) - U(1)))
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys >> shift).astype(np.int64), keys & ((U(1) << shift) - U(1))


def signatures(rows, prints, n_rows, n_coordinates):
    """uint32[coordinate, row]; rows without shingles hold the maximum."""
    out = np.full((n_coordinates, n_rows), 0xFFFFFFFF, np.uint32)
    if not len(rows):
        return out
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    circle = (spread_bits(prints & U((1 << 48) - 1)) >> U(32)).astype(np.uint32)
    x, y = np.empty_like(circle), np.empty_like(circle)
    for k in range(n_coordinates):
        np.subtract(circle, np.uint32(k), out=x)
        np.multiply(x, TURN[0], out=x)
        np.right_shift(x, 16, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, TURN[1], out=x)
        out[k, rows[begins]] = np.minimum.reduceat(x, begins)
    return out


def sequence_prints(words, rows, n_rows, powers):
    """128 bits for the whole word sequence of each row."""
    out = np.zeros((2, n_rows), np.uint64)
    if len(rows):
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        nth = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
        powers.upto(len(rows) + 1)
        out[0, rows[begins]] = spread_bits(np.add.reduceat(words * powers.up[nth], begins))
        out[1, rows[begins]] = spread_bits(np.add.reduceat(spread_bits(words + U(77)) * powers.down[nth], begins))
    return out


def sign(docs: DataFrame, k: int, n_bands: int) -> DataFrame:
    """(doc_id, th) to their set size, sequence prints and band hashes."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, limit=SLICE):
                n = last - first
                rows, prints, words, word_rows = shingles(data, offsets, k, powers)
                rows, prints = distinct(rows, prints, n)
                sig = signatures(rows, prints, n, n_bands * ROWS)
                bands = np.empty((n, n_bands), np.int64)
                for b in range(n_bands):
                    h = np.full(n, b + 1, np.uint64)
                    for r in range(ROWS):
                        h = h * U(BASE) + sig[b * ROWS + r]
                    bands[:, b] = spread_bits(h).view(np.int64)
                seq = sequence_prints(words, word_rows, n, powers).view(np.int64)
                offs = pa.array(np.arange(n + 1, dtype=np.int32) * n_bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.bincount(rows, minlength=n)),
                     pa.array(seq[0]), pa.array(seq[1]), pa.ListArray.from_arrays(offs, pa.array(bands.reshape(-1)))],
                    names=["doc_id", "th", "n", "k1", "k2", "bands"])

    return small_batches(docs).select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root), root the least node of the component; nodes
    other than roots only.  Alternating large and small stars; each round is a
    written table."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = edges.agg(F.count("*"), F.sum(F.col("a") % 1000003), F.sum(F.col("b") % 1000003)).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialise(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
            "links")
        new = edges.agg(F.count("*"), F.sum(F.col("a") % 1000003), F.sum(F.col("b") % 1000003)).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def private_shingles(texts: DataFrame, k: int, n_shingles: int) -> DataFrame:
    """(node, u): at least so many of a node's shingles stand in no other node.

    Prints of about 32 bits per shard are enough: a collision makes a shingle look
    shared, which only loosens the bound.
    """
    n_shards = max(1, -(-n_shingles // (4 << 20)))

    def send(batches):
        powers, unit, size = Powers(), [], 0

        def flushed():
            prints, nodes = (np.concatenate(x) for x in zip(*unit))
            rows = []
            for shard, i in split_by((prints % U(n_shards)).astype(np.int64)):
                kept = (prints[i] >> U(32)).astype(np.uint32)
                order = np.argsort(kept, kind="stable")
                ids, index = np.unique(nodes[i][order], return_inverse=True)
                rows.append((shard, packed(np.diff(kept[order], prepend=np.uint32(0)), index.astype(np.uint32), ids)))
            shards, blobs = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in text_slices(batch, limit=SLICE):
                rows, prints, *_ = shingles(data, offsets, k, powers)
                unit.append((prints, ids[first:last][rows]))
                size += len(prints)
                if size > 1 << 20:
                    yield flushed()
                    unit, size = [], 0
        if unit:
            yield flushed()

    def count(table):
        parts = [unpacked(b) for b in table.column("blob").to_pylist()]
        prints = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
        nodes = np.concatenate([p[2][p[1]] for p in parts])
        order = np.argsort(prints, kind="stable")
        begins = np.flatnonzero(np.append(True, prints[order][1:] != prints[order][:-1]))[:len(prints)]
        least, most = np.minimum.reduceat(nodes[order], begins), np.maximum.reduceat(nodes[order], begins)
        ids, counts = np.unique(least[least == most], return_counts=True)
        return pa.table({"node": pa.array(ids), "u": pa.array(counts)})

    sent = small_batches(texts).select("node", "text").mapInArrow(send, "shard bigint, blob binary")
    return sent.groupBy("shard").applyInArrow(count, "node bigint, u bigint").groupBy("node").agg(F.sum("u").alias("u"))


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """(node, s0, s1 ..): each shingle of the node sets one of 64 * SKETCH bits.  Where
    the bits of two nodes differ, a shingle stands in one of them alone."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, limit=SLICE):
                rows, prints, *_ = shingles(data, offsets, k, powers)
                bits = np.zeros((last - first, 64 * SKETCH), bool)
                bits[rows, (spread_bits(prints) % U(64 * SKETCH)).astype(np.int64)] = True
                words = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *(pa.array(words[:, i].copy()) for i in range(SKETCH))],
                    names=["node", *SKETCHED])

    return small_batches(texts).select("node", "text").mapInArrow(run, "node bigint, " + ", ".join(f"{c} bigint" for c in SKETCHED))


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(lead, node) pairs whose texts have den * intersection >= num * union.

    Members of a lead meet its text in groups of some hundreds, so a lead with
    very many members is shared out.
    """
    many = pairs.groupBy("lead").agg(F.ceil(F.count("*") / 256).alias("parts"))
    salted = pairs.join(many, "lead").withColumn("salt", F.pmod(F.xxhash64("node"), "parts")).select("lead", "node", "salt")
    members = salted.join(texts, "node").select("lead", "salt", F.lit(1).alias("kind"), "node", "text")
    heads = salted.select("lead", "salt").distinct().withColumn("node", F.col("lead")).join(texts, "node").select(
        "lead", "salt", F.lit(0).alias("kind"), "node", "text")
    rows = heads.unionByName(members).repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind")

    def run(batches):
        powers, held = Powers(), np.zeros(0, np.uint64)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, limit=SLICE):
                n = last - first
                lead, kind, node = (batch.column(c).slice(first, n).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
                group = np.cumsum(kind == 0)
                sh_rows, prints, *_ = shingles(data, offsets, k, powers)
                order = np.lexsort((prints, sh_rows))
                sh_rows, prints = sh_rows[order], prints[order]
                new = np.append(True, (sh_rows[1:] != sh_rows[:-1]) | (prints[1:] != prints[:-1]))[:len(prints)]
                sh_rows, prints = sh_rows[new], prints[new]
                size = np.bincount(sh_rows, minlength=n)
                of_lead = kind[sh_rows] == 0
                # the last lead of the slice before counts as group 0
                lead_groups = np.concatenate([np.zeros(len(held), np.int64), group[sh_rows[of_lead]]])
                lead_prints = np.concatenate([held, prints[of_lead]])
                keyed = np.sort(spread_bits(lead_prints + lead_groups.astype(np.uint64) * U(BASE)))
                lead_size = np.bincount(lead_groups, minlength=int(group[-1]) + 1)
                asked = spread_bits(prints + group[sh_rows].astype(np.uint64) * U(BASE))
                at = np.minimum(np.searchsorted(keyed, asked), max(len(keyed) - 1, 0))
                common = np.bincount(sh_rows[keyed[at] == asked], minlength=n) if len(keyed) else np.zeros(n, np.int64)
                union = lead_size[group] + size - common
                linked = (kind == 1) & (den * common >= num * union)
                yield pa.RecordBatch.from_arrays([pa.array(lead[linked]), pa.array(node[linked])], names=["a", "b"])
                held = lead_prints[lead_groups == group[-1]]

    return small_batches(rows).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, key="doc_id", text="text", words=5, num=4, den=5) -> DataFrame:
    """One row per row of ``docs``: (doc_id, th, n_shingles, component_id, kept, first).

    Links texts whose sets of ``words``-word shingles (A-Z in lower case) have
    ``den * intersection >= num * union``; a text with fewer words is one shingle,
    one without words has an empty set and no links.  ``component_id`` is the
    least id reachable (null ids are passed over unless all are null), ``kept``
    marks its rows, ``first`` exactly one row of each component.  ``th`` is a hash
    of id and text.  Repeated rows are links of each other if they have words;
    an empty table gives an empty result.
    """
    th = F.xxhash64(F.col(key).cast("bigint"), F.col(text))
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), th.alias("th"), F.col(text).alias("text"))
    signed = materialise(sign(narrow, words, bands_for(num / den)), "signed")
    # numbered where they are written, so the numbers stay
    signed = materialise(signed.withColumn("row_", F.monotonically_increasing_id()), "signed")
    full = signed.where("n > 0")
    nodes = materialise(full.groupBy("k1", "k2").agg(F.min("row_").alias("node")), "nodes")
    alone = full.join(nodes.select(F.col("node").alias("row_")), "row_", "left_semi")
    members = alone.select(F.explode("bands").alias("bucket"), F.col("row_").alias("node"), "n")
    shared = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = materialise(members.join(shared, "bucket", "left_semi"), "buckets")
    wanted = members.select("node").distinct().join(signed.select(F.col("row_").alias("node"), F.col("doc_id").alias("d_"), F.col("th").alias("t_")), "node")
    texts = narrow.join(wanted, (F.col("th") == F.col("t_")) & F.col("doc_id").eqNullSafe(F.col("d_"))).select("node", "text").dropDuplicates(["node"])
    texts = materialise(texts, "texts")
    n_all = members.select("node", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    private = materialise(private_shingles(texts, words, n_all), "private")
    near = (
        members.join(private, "node", "left").withColumn("v", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
        .where(den * F.col("v") >= num * F.col("n"))
    )
    near = materialise(near, "buckets")
    shared = near.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    near = near.join(shared, "bucket")
    weight = near.groupBy("node").agg(F.sum("c").alias("w"))
    drawn = sketches(texts.join(weight.select("node"), "node", "left_semi"), words)
    weight = materialise(weight.join(drawn, "node"), "sketches")
    open_ = materialise(near.join(weight, "node").select("bucket", "node", "n", "v", "w", F.col("node").alias("comp"), *SKETCHED), "buckets")
    # what a pair may share at most, and what at least stands in one of the two alone
    most, both = F.least(F.col("v"), F.col("lead_v")), F.col("n") + F.col("lead_n")
    apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead_{c}"))) for c in SKETCHED)
    within = (F.col("comp") != F.col("lead_comp")) & (den * most >= num * (both - most)) & ((den + num) * apart <= (den - num) * both)
    roots = None
    for leads_each in (1, 4, None):
        if open_.isEmpty():
            break
        leads = open_
        if leads_each:
            heavy = Window.partitionBy("bucket").orderBy(F.desc("w"), "node")
            leads = open_.withColumn("k", F.row_number().over(heavy)).where(F.col("k") <= leads_each)
        leads = leads.select("bucket", F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("v").alias("lead_v"), F.col("comp").alias("lead_comp"),
                             *[F.col(c).alias(f"lead_{c}") for c in SKETCHED])
        wanted = within if leads_each else within & (F.col("lead") < F.col("node"))
        pairs = materialise(open_.join(leads, (open_.bucket == leads.bucket) & wanted).select("lead", "node").distinct(), "pairs")
        links = verified(pairs, texts, words, num, den)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = connected_components(links)
        if not leads_each:
            break
        rest = (
            open_.join(leads.select("bucket", F.col("lead").alias("node")), ["bucket", "node"], "left_anti")
            .drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        )
        rest = materialise(rest, "buckets")
        mixed = rest.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
        open_ = materialise(rest.join(mixed, "bucket", "left_semi"), "buckets")

    placed = full.select("row_", "doc_id", "k1", "k2").join(nodes, ["k1", "k2"])
    if roots is not None:
        placed = placed.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    else:
        placed = placed.withColumn("comp", F.col("node"))
    placed = materialise(placed.select("row_", "doc_id", "comp"), "placed")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"),
                                       F.min_by("row_", F.struct(F.col("doc_id").isNull(), "doc_id", "row_")).alias("first_row"))
    grouped = placed.join(least, "comp").select("row_", "component_id", "first_row")
    out = signed.select("row_", "doc_id", "th", "n").join(grouped, "row_", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), ((F.col("n") == 0) | (F.col("row_") == F.col("first_row"))).alias("first"))


def drop_near_duplicates(docs: DataFrame, *, key="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies.  Texts without words stay."""
    found = materialise(near_duplicates(docs, key=key, text=text, **options).select(
        F.col("doc_id").alias("d_"), F.col("th").alias("t_"), "n_shingles", "first"), "first")
    names = docs.columns
    own = F.col(key).cast("bigint")
    rows = docs.select(F.struct(*names).alias("row_"), own.alias("id_"), F.xxhash64(own, F.col(text)).alias("th_"))
    same = (F.col("th_") == F.col("t_")) & F.col("id_").eqNullSafe(F.col("d_"))
    kept = rows.join(found.where("first").select("d_", "t_").distinct(), same, "left_semi")
    unpacked_row = [F.col("row_").getField(n).alias(n) for n in names]
    repeated = found.where("n_shingles > 0").groupBy("d_", "t_").count().where("count > 1").select("d_", "t_")
    if repeated.isEmpty():
        return kept.select(*unpacked_row)
    # an identical row stands several times: one of them stays
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["id_", "th_"])
    return kept.join(repeated, same, "left_anti").unionByName(once).select(*unpacked_row)
