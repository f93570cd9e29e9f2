"""Removal of repeated byte strings with a logarithmic family of hash-sorted window indexes.

A match of 50 bytes holds at least one anchor: the 12 bytes with the least hash
among those inside it.  Runs of suffixes that share their anchor travel together
to the index shard of that anchor, so equal strings always meet.  A shard adds
its suffixes in batches of ascending document id.  A batch is sorted by the
fingerprints of their first 50 bytes (no lexicographic order; matches are
confirmed on the bytes), looked up in every level of the family, and becomes a level itself; levels of equal
rank merge, so a shard of n batches has at most log2(n) + 1 levels.

Within a unit of input equal runs are resolved before anything is sent: only the
least document id travels, so a passage that stands in a third of all documents
reaches its shard once per unit.  Where a text repeats itself every few bytes (a
stretch of blanks), its equal runs travel as one run with a step and a count.
"""

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.llm.bytesets import U, Powers, per_row, prefix_sums, span_prints, spread_bits, stable_order, text_slices

ANCHOR = 12
NO_ID = (1 << 63) - 1  # null ids come after all others
POSITION = 28  # bits
PIECE = 4 << 20  # long texts are cut into overlapping pieces of this size
UNIT = 8 << 20  # bytes of text whose runs are compared before they are sent
BATCH = 1 << 16  # suffixes
CHAIN = 1 << 12  # equal runs that travel as one
PAIRS = 1 << 20  # places of hits looked at together
GATHERED = 1 << 17  # bytes copied together
BLOCK = 10  # neighbouring windows that are asked for together first


def eights(data):
    """The 8 bytes from every position as one number."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), 0, (1,))


def anchor_print(first, second):
    return spread_bits((first * U(0xC2B2AE3D27D4EB4F)) ^ second)


def anchored_runs(data, offsets, length):
    """Runs of window starts that share their anchor: first start, end of the
    last window, anchor position, anchor print, row."""
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    if len(data) < length:
        return empty
    v = eights(data)
    prints = anchor_print(v[:-4], v[4:])
    low = U((1 << POSITION) - 1)
    least = prints & ~low
    least |= np.arange(len(prints), dtype=np.uint64)  # leftmost on ties
    spare = np.empty_like(least)
    width, span = 1, length - ANCHOR + 1
    while 2 * width <= span:  # by turns into one of two arrays
        n = len(least) - width
        least, spare = np.minimum(least[:-width], least[width:], out=spare[:n]), least
        width *= 2
    if span > width:
        least = np.minimum(least[:width - span], least[span - width:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    inside = np.arange(len(least)) + length <= offsets[1:][row]
    at = (least & low).astype(np.int64)
    begins = np.ones(len(at) + 1, bool)
    begins[1:-1] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(begins[:-1] & inside)
    ends = np.flatnonzero(begins[1:] & inside) + length
    return starts, ends, at[starts], prints[at[starts]], row[starts]


def gathered(data, starts, ends):
    sizes = ends - starts
    to = np.append(0, np.cumsum(sizes))
    out = np.empty(to[-1], data.dtype)
    first = 0
    while first < len(sizes):  # a part at a time, whose places stay in the cache
        last = max(first + 1, int(np.searchsorted(to, to[first] + GATHERED, side="right")) - 1)
        part = slice(first, last)
        where = np.repeat(starts[part] - to[part], sizes[part]) + np.arange(to[first], to[last])
        np.take(data, where, out=out[to[first]:to[last]], mode="clip")
        first = last
    return out


def packed(*arrays):
    """Arrays as one compressed blob; integers by byte planes."""
    out = [struct.pack("<I", len(arrays))]
    codec = pa.Codec("zstd", compression_level=3)
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        body = codec.compress(planes.tobytes(), asbytes=True) if len(a) else b""
        out += [struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(a), len(body)), body]
    return b"".join(out)


def unpacked(blob):
    codec, at, out = pa.Codec("zstd"), 4, []
    for _ in range(struct.unpack_from("<I", blob)[0]):
        kind, n, size = struct.unpack_from("<2sQQ", blob, at)
        at += 18
        dtype = np.dtype("<" + kind.decode())
        planes = codec.decompress(blob[at:at + size], n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).reshape(-1).view(dtype))
        at += size
    return out


def split_by(keys):
    """(key, indexes) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    values, first = np.unique(keys[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]))


def text_rows(slices, n_buckets):
    """(bucket, blob) of whole texts: ids, null flags, sizes, bytes."""
    parts = {}
    for data, offsets, ids, nulls in slices:
        for bucket, i in split_by(ids % n_buckets):
            parts.setdefault(bucket, []).append((ids[i], nulls[i], np.diff(offsets)[i], gathered(data, offsets[i], offsets[i + 1])))
    for bucket, pieces in parts.items():
        yield bucket, packed(*(np.concatenate(x) for x in zip(*pieces)))


def chained(starts, same, length):
    """Equal runs at even, short distances: first of each chain, its step, its count.
    ``starts`` ascends; short distances do not reach into another row's run."""
    order = stable_order(same)
    gaps = np.diff(starts[order], prepend=0)
    link = gaps <= length // 2
    link[:1] = False
    link[1:] &= same[order][1:] == same[order][:-1]
    begins = ~link
    begins[1:] |= link[:-1] & (gaps[1:] != gaps[:-1])
    number = np.arange(len(order))
    begins |= (number - np.maximum.accumulate(np.where(begins, number, 0))) % CHAIN == 0
    first = np.flatnonzero(begins)
    counts = np.diff(np.append(first, len(order)))
    steps = np.where(counts > 1, gaps[np.minimum(first + 1, max(len(order) - 1, 0))], 0)
    back = np.argsort(order[first])
    return order[first][back], steps[back], counts[back]


def chains(steps, counts):
    """What is sent of them: nothing if every run stands alone."""
    return (steps.astype(np.int32), counts.astype(np.int32)) if (counts > 1).any() else ()


def with_chains(arrays, n):
    """``n`` unpacked arrays, then steps and counts."""
    rows = len(arrays[0])
    return arrays if len(arrays) > n else [*arrays, np.zeros(rows, np.int32), np.ones(rows, np.int32)]


def hit_rows(ids, starts, ends, prints, steps, counts, n_buckets):
    for bucket, i in split_by(ids % n_buckets):
        yield bucket, packed(ids[i], starts[i], (ends - starts)[i].astype(np.int32), prints[i].astype(np.uint32), *chains(steps[i], counts[i]))


def unit_rows(slices, length, n_shards, powers):
    """What one unit sends: (shard, bucket, blob).  Bucket -1: runs for the
    index; else hits found here, on their way to the documents of that bucket."""
    found = []
    for k, (data, offsets, ids, bases) in enumerate(slices):
        starts, ends, at, prints, row = anchored_runs(data, offsets, length)
        sums = prefix_sums(data, powers)
        text = span_prints(sums, starts, ends, powers)
        del sums
        same = spread_bits(text + (at - starts).astype(np.uint64))
        first, step, count = chained(starts, spread_bits(same + row.astype(np.uint64)), length)
        starts, ends, at, prints, row, same, text = (x[first] for x in (starts, ends, at, prints, row, same, text))
        found.append((np.full(len(starts), k), starts, ends, at - starts, prints, ids[row], bases[row] + starts - offsets[row], same, text, step, count))
    slice_no, starts, ends, at, prints, ids, positions, same, text, step, count = (np.concatenate(x) for x in zip(*found))
    if not len(starts):
        return
    order = stable_order(ids)
    order = order[stable_order(same[order])]
    first = np.ones(len(order), bool)
    first[1:] = same[order][1:] != same[order][:-1]
    least = np.repeat(ids[order][first], np.diff(np.append(np.flatnonzero(first), len(order))))
    hit = np.zeros(len(order), bool)
    hit[order] = ids[order] > least
    h = np.flatnonzero(hit)
    for bucket, blob in hit_rows(ids[h], positions[h], positions[h] + (ends - starts)[h], text[h], step[h], count[h], n_shards):
        yield bucket, bucket, blob
    shard = ((prints >> U(POSITION)) % U(n_shards)).astype(np.int64)
    shard[hit] = -1
    parts = {}
    for k, (data, *_) in enumerate(slices):
        mine = np.flatnonzero((slice_no == k) & (shard >= 0))
        mine = mine[stable_order(shard[mine])]
        texts = gathered(data, starts[mine], ends[mine])
        to = np.append(0, np.cumsum(ends[mine] - starts[mine]))
        values, opens = np.unique(shard[mine], return_index=True)
        for s, a, b in zip(values.tolist(), opens.tolist(), [*opens[1:].tolist(), len(mine)]):
            parts.setdefault(s, []).append((mine[a:b], texts[to[a]:to[b]]))
    for s, pieces in parts.items():
        i = np.concatenate([p[0] for p in pieces])
        steps = np.diff(ids[i], prepend=0)
        yield s, -1, packed(steps, positions[i], (ends - starts)[i].astype(np.uint8), at[i].astype(np.uint8), np.concatenate([p[1] for p in pieces]),
                            *chains(step[i], count[i]))


def equal_bytes(words, tail, a, b, length):
    """Whether the strings of ``length`` bytes at ``a`` and ``b`` agree.  ``words``:
    the 8 bytes from every position."""
    same = words[a + tail] == words[b + tail]
    for k in range(0, length - 7, 8):
        same &= words[a + k] == words[b + k]
    return same


def equal_strings(words, a, b, length):
    """``equal_bytes`` for ascending ``a``: where both places are one beyond those of the
    pair before, only the last byte is new."""
    tail = length - 8
    same = words[a + tail] == words[b + tail]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    same[new] &= equal_bytes(words, tail, a[new], b[new], length)
    return same if same.all() else equal_bytes(words, tail, a, b, length)


def under_two_ids(keys, ids):
    """Which keys stand under more than one id."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        groups = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        shared = np.minimum.reduceat(ids[order], groups) < np.maximum.reduceat(ids[order], groups)
        out[order] = np.repeat(shared, np.diff(np.append(groups, len(order))))
    return out


def shared_blocks(sums, begins, sizes, at, ids, length, powers):
    """(run, first window, number of windows) of what may match another id, in order.

    Equal windows have their anchor at the same distance.  The windows of a run whose
    distance is ``low`` to ``high`` are a block; each of them holds the bytes from ``low``
    before the anchor to the end of the first of them.  Blocks whose bytes no other id has
    match nothing.
    """
    found = []
    for low in range(0, length - ANCHOR + 1, BLOCK):
        high = min(low + BLOCK - 1, length - ANCHOR)
        first = np.maximum(at - high, 0)
        n = np.minimum(at - low, sizes - length) + 1 - first
        run = np.flatnonzero(n > 0)
        anchor = (begins + at)[run]
        held = span_prints(sums, anchor - low, anchor - high + length, powers)
        run = run[under_two_ids(held, ids[run])]
        found.append((run, first[run], n[run]))
    run, first, n = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, run))
    return run[order], first[order], n[order]


class LevelFamily:
    """Sorted levels of (fingerprint, place); ranks descend strictly."""

    def __init__(self, words, length):
        self.levels, self.words, self.length = [], words, length

    def known(self, prints, places):
        """Merge-scan of a sorted batch against all levels."""
        out = np.zeros(len(prints), bool)
        for _, level, level_places in self.levels:
            at = np.minimum(np.searchsorted(level, prints), len(level) - 1)
            same = np.flatnonzero(level[at] == prints)
            same = same[np.argsort(places[same])]
            out[same] |= equal_strings(self.words, places[same], level_places[at[same]], self.length)
        return out

    def add(self, prints, places):
        if not len(prints):
            return
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other, other_places = self.levels.pop()
            prints = np.concatenate([other, prints])
            order = np.argsort(prints, kind="stable")
            prints, places = prints[order], np.concatenate([other_places, places])[order]
            rank += 1
        self.levels.append((rank, prints, places))


def shard_hits(blobs, length, powers):
    """Hits among the runs of one shard: (ids, starts, ends, prints, steps, counts)."""
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] + [np.zeros(0, np.int32)] * 2
    parts = [with_chains(unpacked(b), 5) for b in blobs]
    ids = np.concatenate([np.cumsum(p[0]) for p in parts])
    positions, sizes, at = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2, 3))
    step, count = (np.concatenate([p[k] for p in parts]) for k in (5, 6))
    data = np.concatenate([p[4] for p in parts] + [np.zeros(8, np.uint8)])
    del parts
    begins = np.cumsum(sizes) - sizes
    # anchors of a single document match nothing
    anchor = begins + at
    eight = eights(data)
    kept = np.flatnonzero(under_two_ids(anchor_print(eight[anchor], eight[anchor + 4]), ids))
    if not len(kept):
        return none
    kept = kept[np.argsort(ids[kept], kind="stable")]
    ids, positions, sizes, at, step, count = ids[kept], positions[kept], sizes[kept], at[kept], step[kept], count[kept]
    data = np.append(gathered(data, begins[kept], begins[kept] + sizes), np.zeros(8, np.uint8))
    begins = np.cumsum(sizes) - sizes
    sums = prefix_sums(data, powers)
    # all suffixes that are long enough and may match
    run, first, n = shared_blocks(sums, begins, sizes, at, ids, length, powers)
    place = np.repeat(begins[run] + first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    run = np.repeat(run, n)
    prints = span_prints(sums, place, place + length, powers)
    owner = ids[run]
    hit = np.zeros(len(place), bool)
    family = LevelFamily(eights(data), length)
    low = 0
    while low < len(place):
        high = int(np.searchsorted(owner, owner[min(low + BATCH, len(place)) - 1], side="right"))
        order = low + stable_order(prints[low:high])
        first = np.append(True, prints[order][1:] != prints[order][:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(order)))
        heads = order[first]
        known = family.known(prints[heads], place[heads])
        hit[order] = np.repeat(known, size)
        head_of = np.empty(high - low, np.int64)
        head_of[order - low] = np.repeat(heads, size)
        later = low + np.flatnonzero(owner[low:high] > owner[head_of])
        hit[later] |= equal_strings(family.words, place[later], place[head_of[later - low]], length)
        family.add(prints[heads[~known]], place[heads[~known]])
        low = high
    h = np.flatnonzero(hit)
    if not len(h):
        return none
    opens = np.append(True, (place[h][1:] != place[h][:-1] + 1) | (run[h][1:] != run[h][:-1]))
    a, b = h[opens], h[np.append(opens[1:], True)]
    start = positions[run[a]] + place[a] - begins[run[a]]
    end = positions[run[b]] + place[b] - begins[run[b]] + length
    return owner[a], start, end, span_prints(sums, place[a], place[b] + length, powers), step[run[a]], count[run[a]]


def removed_mask(data, offsets, ids, hits, powers):
    """Which bytes of a slice go.  A hit counts for a row of its id whose text has
    the same bytes at its place, and at each further place of its chain."""
    hit_ids, starts, sizes, prints, steps, counts = hits
    low, high = np.searchsorted(hit_ids, ids, side="left"), np.searchsorted(hit_ids, ids, side="right")
    n = high - low
    row = np.repeat(np.arange(len(ids)), n)
    i = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    sums = prefix_sums(data, powers)
    change = np.zeros(len(data) + 1, np.int32)
    places = np.cumsum(counts[i], dtype=np.int64)
    first = 0
    while first < len(i):
        last = max(first + 1, int(np.searchsorted(places, (places[first - 1] if first else 0) + PAIRS, side="right")))
        j, r, n = i[first:last], row[first:last], counts[i[first:last]].astype(np.int64)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        j, r = np.repeat(j, n), np.repeat(r, n)
        begin = offsets[r] + starts[j] + number * steps[j]
        end = begin + sizes[j]
        fits = end <= offsets[r + 1]
        begin, end, j = begin[fits], end[fits], j[fits]
        same = span_prints(sums, begin, end, powers).astype(np.uint32) == prints[j]
        np.add.at(change, begin[same], 1)
        np.add.at(change, end[same], -1)
        first = last
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, *, key="doc_id", text="text", length=50, shard_bytes=3 << 19, with_kept=False) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]).

    Every byte goes that a string of ``length`` bytes covers which also starts in
    a document with a smaller id, judged on the texts as given.  Null texts are
    empty; null ids count as the greatest id and stay null; rows that share an id
    are one document in that none removes from the other; an empty table gives an
    empty result.  ``kept`` (optional) has the remaining bytes.  ``length`` is
    between 20 and 120.  A task holds about ``shard_bytes`` of text, apart from a
    single longer text, all texts of one id (null is one), and all different
    surroundings of one anchor, which stay in one shard.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "id_", F.coalesce("doc_id", F.lit(NO_ID)))
    total = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // shard_bytes))

    def send(batches):
        powers, unit, size = Powers(), [], 0

        def flushed():
            rows = list(zip(*unit_rows(unit, length, n_shards, powers)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["shard", "bucket", "blob"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, data, offsets in text_slices(batch, limit=PIECE // 2):
                if last - first == 1 and len(data) > PIECE:
                    for at in range(0, len(data) - length + 1, PIECE):
                        piece = data[at:at + PIECE + length - 1]
                        unit.append((piece, np.array([0, len(piece)]), ids[first:last], np.array([at])))
                else:
                    unit.append((data, offsets, ids[first:last], np.zeros(last - first, np.int64)))
                size += len(data)
                if size > UNIT:
                    yield from flushed()
                    unit, size = [], 0
        if unit:
            yield from flushed()

    def index(table):
        powers = Powers()
        buckets, blobs = table.column("bucket").to_pylist(), table.column("blob").to_pylist()
        out = [(b, blob) for b, blob in zip(buckets, blobs) if b >= 0]
        runs = [blob for b, blob in zip(buckets, blobs) if b < 0]
        if runs:
            out += hit_rows(*shard_hits(runs, length, powers), n_shards)
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "blob": pa.array([b for _, b in out], pa.binary())})

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def send_texts(batches):
        unit, size = [], 0

        def flushed():
            rows = list(zip(*text_rows(unit, n_shards)))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], names=["bucket", "text_blob"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            nulls = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for first, last, data, offsets in text_slices(batch):
                unit.append((data, offsets, ids[first:last], nulls[first:last]))
                size += len(data)
                if size > UNIT:
                    yield flushed()
                    unit, size = [], 0
        if unit:
            yield flushed()

    def finish(texts, found):
        powers = Powers()
        none = [np.zeros(0, t) for t in ("<i8", "<i8", "<i4", "<u4")]
        parts = [with_chains(p, 4) for p in [unpacked(b) for b in found.column("blob").to_pylist()] or [none]]
        hits = [np.concatenate(x) for x in zip(*parts)]
        order = stable_order(hits[0])
        hits = [h[order] for h in hits]
        out = []
        for blob in texts.column("text_blob").to_pylist():
            ids, nulls, sizes, data = unpacked(blob)
            offsets = np.append(0, np.cumsum(sizes))
            gone = removed_mask(data, offsets, ids, hits, powers)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            at_row = offsets[:-1][offsets[:-1] < len(data)]
            opens[at_row] = gone[at_row]
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [pa.array(ids, mask=nulls.astype(bool)), pa.array(sizes), pa.array(per_row(gone, offsets)),
                       pa.array(per_row(opens, offsets)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            out.append(pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_kept, names=names))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds))))

    sent = narrow.select("id_", "text").mapInArrow(send, "shard bigint, bucket bigint, blob binary")
    hits = sent.groupBy("shard").applyInArrow(index, "bucket bigint, blob binary")
    texts = narrow.select("id_", "text", F.col("doc_id").isNull()).mapInArrow(send_texts, "bucket bigint, text_blob binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return texts.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(finish, schema)
