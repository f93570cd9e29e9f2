"""Byte-pair merges by the thousand: merges are drafted ahead on frequent words,
then checked on all words in one pass.

A round drafts up to ``AHEAD`` merges, lets every task apply them to its words one
after the other and sums, pair by pair, how the counts change at each step.  That
gives the exact count of every pair at every step, so the first step at which
another pair should have been merged is known, and the steps before it are what
merging one by one gives.  The draft decides only how far a round gets.
"""

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.session import materialise, small_batches

AHEAD = 256
DRAFT_WORDS = 4_000
DRAFT_PAIRS = 4_096
DRAFT_CHARS = 64
DRAFT_CHANGES = 20_000
FOLD = 256
HELD = 1 << 18  # pieces of words that a task merges together

CHANGES = "left string, right string, step int, delta bigint"


def merge_word(pieces, turns):
    """``pieces`` after the merges of ``turns`` (pair to its rising steps), each at its
    turn and from left to right."""
    at = 0
    while len(pieces) > 1:
        best = None
        for pair in zip(pieces, pieces[1:]):
            for step in turns.get(pair, ()):
                if step > at and (best is None or step < best[0]):
                    best = step, pair
        if best is None:
            break
        at, (left, right) = best
        pieces = merge_pair(pieces, left, right)
    return pieces


def merge_pair(pieces, left, right):
    out, i = [], 0
    while i < len(pieces):
        if pieces[i] == left and i + 1 < len(pieces) and pieces[i + 1] == right:
            out.append(left + right)
            i += 2
        else:
            out.append(pieces[i])
            i += 1
    return out


def turns_of(merges):
    turns = defaultdict(list)
    for step, pair in enumerate(merges, 1):
        turns[pair].append(step)
    return dict(turns)


def draft(words, pairs, ahead, heard=None):
    """A guess of the next merges: exact counts of the leading ``pairs`` {pair: n},
    changed as the sample ``words`` [(pieces, weight)] change, scaled to each merge's
    count.  ``heard`` is what the last round told: its pairs, and {merge: {pair: change}}
    of them, which is used in place of the sample's.
    """
    known, told = heard or (set(), {})
    count, seen, where = defaultdict(float, pairs), defaultdict(float), defaultdict(set)
    words = [list(w) for w in words]
    for i, (pieces, n) in enumerate(words):
        for pair in zip(pieces, pieces[1:]):
            seen[pair] += n
            where[pair].add(i)
    queue = [(-n, pair) for pair, n in count.items()]
    heapq.heapify(queue)
    found = []
    while len(found) < ahead and queue:
        n, best = heapq.heappop(queue)
        if best not in count or -n != count[best]:
            continue
        if -n < 0.5:
            break
        found.append(best)
        scale = -n / seen[best] if seen[best] > 0 else 0.0
        changes = dict(told.get(best, {}))
        for i in where.pop(best, ()):
            pieces, weight = words[i]
            after = merge_pair(pieces, *best)
            change = Counter(zip(after, after[1:]))
            change.subtract(Counter(zip(pieces, pieces[1:])))
            for pair, k in change.items():
                seen[pair] += k * weight
                if best not in told or pair not in known:
                    changes[pair] = changes.get(pair, 0) + k * weight * scale
                if k > 0:
                    where[pair].add(i)
            words[i][0] = after
        for pair, change in changes.items():
            count[pair] += change
            heapq.heappush(queue, (-count[pair], pair))
        count.pop(best, None)
    return found


class Pieces:
    """Words as one flat array of numbered pieces with links to their neighbours.  The
    places of the pairs to be merged are looked up, so a merge costs what it changes."""

    def __init__(self, pieces: pa.Array, weights, merges):
        flat = pieces.flatten().dictionary_encode()
        numbers = {p: i for i, p in enumerate(flat.dictionary.to_pylist())}
        for left, right in merges:
            for p in (left, right, left + right):
                numbers.setdefault(p, len(numbers))
        self.names, self.size = pa.array(list(numbers), pa.string()), max(len(numbers), 1)
        self.merges = [(numbers[a], numbers[b], numbers[a + b]) for a, b in merges]
        self.symbol = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lengths = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = np.repeat(weights, self.lengths)
        ends = np.cumsum(self.lengths)
        filled = self.lengths > 0
        self.next, self.before = np.arange(1, len(self.symbol) + 1), np.arange(-1, len(self.symbol) - 1)
        self.next[ends[filled] - 1] = -1
        self.before[(ends - self.lengths)[filled]] = -1

    def keys(self, at):
        """Number of the pair at each of these places."""
        return self.symbol[at] * self.size + self.symbol[self.next[at]]

    def summed(self, keys, steps, deltas):
        """(left, right, step, delta), one row a pair and step."""
        span = int(steps.max(initial=0)) + 1
        both, which = np.unique(keys * span + steps, return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, which, deltas)
        both, total = both[total != 0], total[total != 0]
        left, right = np.divmod(both // span, self.size)
        return [self.names.take(pa.array(left)), self.names.take(pa.array(right)), pa.array(both % span, pa.int32()), pa.array(total)]

    def counts(self):
        at = np.flatnonzero(self.next >= 0)
        return self.summed(self.keys(at), np.zeros(len(at), np.int64), self.weight[at])

    def merge(self, quiet):
        """Applies all merges in order, each from left to right; how the counts of pairs
        change at each of them but the first ``quiet`` ones, numbered from 1."""
        asked, which = np.unique(np.array([a * self.size + b for a, b, _ in self.merges], np.int64), return_inverse=True)
        places, noted = [[] for _ in asked], []

        def file(at, keys):
            found = np.searchsorted(asked, keys)
            known = np.flatnonzero(asked[np.minimum(found, len(asked) - 1)] == keys)
            order = known[np.argsort(found[known], kind="stable")]
            pairs, first = np.unique(found[order], return_index=True)
            for k, i in zip(pairs.tolist(), np.split(order, first[1:])):
                places[k].append(at[i])

        start = np.flatnonzero(self.next >= 0)
        if len(asked):
            file(start, self.keys(start))
        for step, (k, (a, b, product)) in enumerate(zip(which.tolist(), self.merges), 1 - quiet):
            if not places[k]:
                continue
            at, places[k] = np.unique(np.concatenate(places[k])), []
            at = at[(self.symbol[at] == a) & (self.next[at] >= 0)]
            at = at[self.symbol[self.next[at]] == b]
            if a == b and len(at):  # of overlapping places every other one counts
                number = np.arange(len(at))
                apart = np.append(True, self.next[at[:-1]] != at[1:])
                at = at[(number - np.maximum.accumulate(np.where(apart, number, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = self.next[at]
            right, left = self.next[gone], self.before[at]
            inner = right >= 0
            if step > 0:
                lost = np.unique(np.concatenate([left[left >= 0], at, gone[inner]]))
                noted.append((self.keys(lost), np.full(len(lost), step), -self.weight[lost]))
            self.symbol[at], self.symbol[gone], self.next[at] = product, -1, right
            self.before[right[inner]] = at[inner]
            left = self.before[at]
            made = np.unique(np.concatenate([left[left >= 0], at[inner]]))
            keys = self.keys(made)
            if step > 0:
                noted.append((keys, np.full(len(made), step), self.weight[made]))
            file(made, keys)
        noted = noted or [(np.zeros(0, np.int64),) * 3]
        return self.summed(*(np.concatenate(x) for x in zip(*noted)))

    def lists(self):
        """The pieces of each word as they are now."""
        left = self.symbol >= 0
        kept = np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], np.cumsum(self.lengths)])]
        return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), self.names.take(pa.array(self.symbol[left])))


def _held(batches):
    """The columns of some batches in a row, with about ``HELD`` pieces."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("pieces").flatten())
        if size > HELD:
            yield {name: pa.concat_arrays([b.column(name) for b in held]) for name in batch.schema.names}
            held, size = [], 0
    if held:
        yield {name: pa.concat_arrays([b.column(name) for b in held]) for name in held[0].schema.names}


def _pieces_after(words: DataFrame, merges) -> DataFrame:
    """(word, n, pieces) with ``merges`` applied in order."""
    if not merges:
        return words

    def run(batches):
        for unit in _held(batches):
            pieces = Pieces(unit["pieces"], unit["n"].to_numpy(zero_copy_only=False), merges)
            pieces.merge(len(merges))
            yield pa.RecordBatch.from_arrays([unit["word"], unit["n"], pieces.lists()], names=["word", "n", "pieces"])

    return small_batches(words).select("word", "n", "pieces").mapInArrow(run, "word string, n bigint, pieces array<string>")


def _changes(words: DataFrame, done, ahead) -> DataFrame:
    """How the counts of pairs change at each step of ``ahead``, on words that ``done``
    is applied to first.  Step 0 without both: the counts themselves."""

    def run(batches):
        for unit in _held(batches):
            pieces = Pieces(unit["pieces"], unit["n"].to_numpy(zero_copy_only=False), [*done, *ahead])
            rows = pieces.merge(len(done)) if ahead else pieces.counts()
            yield pa.RecordBatch.from_arrays(rows, names=["left", "right", "step", "delta"])

    return small_batches(words).select("n", "pieces").mapInArrow(run, CHANGES)


def _timeline(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """(left, right, n, steps): count of a pair before the round, its changes by step."""
    steps = F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.struct("step", "delta"))))
    before = F.sum(F.when(F.col("step") == 0, F.col("delta")).otherwise(0)).alias("n")
    # changes first come together by pair and step, so a list holds one entry a step
    rows = counts.select("left", "right", F.lit(0).alias("step"), F.col("n").alias("delta")).unionByName(changes)
    summed = rows.groupBy("left", "right", "step").agg(F.sum("delta").alias("delta"))
    return summed.groupBy("left", "right").agg(before, steps.alias("steps"))


def _gained(upto):
    """Sum of the changes up to a step."""
    kept = F.filter("steps", lambda s: s["step"] <= upto)
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, s: a + s["delta"])


def _high(timeline: DataFrame, least) -> DataFrame:
    """The pairs that may count ``least`` or more at some step."""
    rises = F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, s: a + F.greatest(s["delta"], F.lit(0)))
    return timeline.where(F.col("n") + rises >= least)


def _first_miss(timeline: DataFrame, drafted, counts) -> int:
    """The first step at which a pair other than the drafted one comes first.

    ``counts`` are those of the drafted pairs at their own step.
    """
    size = len(drafted)

    def run(batches):
        first = size + 1
        for batch in batches:
            for left, right, n, steps in zip(*(c.to_pylist() for c in batch.columns)):
                since = 0
                for until, change in [(s["step"], s["delta"]) for s in steps] + [(size, 0)]:
                    for i in range(since, min(until, first - 1)):
                        if counts[i] < n or (counts[i] == n and (left, right) < drafted[i]):
                            first = i + 1
                    since, n = until, n + change
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32())], names=["miss"])

    return _high(timeline, min(counts)).mapInArrow(run, "miss int").agg(F.min("miss")).first()[0]


def _sampled(heard: DataFrame, size: int):
    """[(pieces, weight)]: the most frequent words, and of the others an even share
    that stands for all of them."""
    short = heard.where(F.size("pieces") <= DRAFT_CHARS)
    top = short.orderBy(F.desc("n"), "word").select("word", "pieces", "n").limit(size).collect()
    found = [(list(r.pieces), r.n) for r in top]
    if size and len(top) == size:
        rest = short.where((F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("word") > top[-1].word)))
        share = min(1.0, size / max(rest.count(), 1))
        drawn = rest.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
        found += [(list(r.pieces), r.n / share) for r in drawn.select("pieces", "n").limit(2 * size).collect()]
    return found


def learn_merges(counts: DataFrame, n_merges: int, ahead=AHEAD, draft_words=DRAFT_WORDS, draft_pairs=DRAFT_PAIRS, rounds=None):
    """Byte-pair merges over the distinct words of ``counts`` (word, n).

    Returns (merges, words) as ``learn_bpe_merges`` does and with the same rows, in a
    number of rounds that hardly grows with the merges.  The most frequent pair is
    merged first, of equal ones the least (left, right).  The driver holds
    three times ``draft_words`` words, ``draft_pairs`` pairs, the changes of
    ``DRAFT_CHANGES`` pairs and the merges; ``rounds`` gets the
    merges that each round gave.  Null and empty words, and counts below one, have no
    say in the merges; the latter are cut all the same.
    """
    spark = counts.sparkSession
    letters = F.regexp_extract_all("word", F.lit(r"(?s)(.)"))
    state = materialise(
        counts.where("word <> ''").select("word", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), letters.alias("pieces")), "merge-words")
    heard = state.where((F.col("n") > 0) & (F.size("pieces") > 1))
    pairs = materialise(_changes(heard, [], []).groupBy("left", "right").agg(F.sum("delta").alias("n")), "merge-pairs")
    sample, told = _sampled(heard, draft_words), None
    merges, pending = [], []
    while len(merges) < n_merges:
        lead = pairs.where("n > 0").orderBy(F.desc("n"), "left", "right").limit(draft_pairs).collect()
        drafted = draft(sample, {(r.left, r.right): r.n for r in lead}, min(ahead, n_merges - len(merges)), told)
        if not drafted:
            break
        timeline = materialise(_timeline(pairs, _changes(heard, pending, drafted)), "merge-pairs")
        asked = spark.createDataFrame(sorted(set(drafted)), "left string, right string")
        known = {(r.left, r.right): r for r in timeline.join(F.broadcast(asked), ["left", "right"], "left_semi").collect()}
        own = []
        for step, pair in enumerate(drafted, 1):
            row = known.get(pair)
            n = row.n + sum(s.delta for s in row.steps if s.step < step) if row else 0
            if n < 1:
                break
            own.append(n)
        drafted = drafted[:len(own)]
        right = _first_miss(timeline, drafted, own) - 1 if own else 0
        changed = _high(timeline, min(own, default=1)).where(F.size("steps") > 0).limit(DRAFT_CHANGES).collect()
        told = {(r.left, r.right) for r in changed}, {pair: {} for pair in drafted}
        for r in changed:
            for step, delta in r.steps:
                if step <= len(drafted):
                    told[1][drafted[step - 1]][r.left, r.right] = delta
        merges += drafted[:right]
        pending += drafted[:right]
        turns = turns_of(drafted[:right])
        sample = [(p, n) for p, n in ((merge_word(p, turns), n) for p, n in sample) if len(p) > 1]
        pairs = timeline.select("left", "right", (F.col("n") + _gained(F.lit(right))).alias("n")).where("n > 0")
        if rounds is not None:
            rounds.append(right)
        if len(pending) >= FOLD:
            state, pending = materialise(_pieces_after(state, pending), "merge-words"), []
            heard = state.where((F.col("n") > 0) & (F.size("pieces") > 1))
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(merges, 1)], "rank int, left string, right string")
    return table, _pieces_after(state, pending)
