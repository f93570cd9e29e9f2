"""Cheapest repair of a conversation's turns.

A conversation should read ``(s?(ua)+)?`` by its roles' initials.  Its rows, in the order
of their turns, become symbols of role and fault; equal symbols in a row are one
run.  A symbol is a small matrix of costs between the states of the pattern, so a run
is a power of it in min-plus arithmetic, put together from cached squares.  Costs go
from the last run to the first; then the choices are unrolled from the first to the last.

Spark sorts narrow rows by conversation and turn over all tasks, so that a long
conversation is coded by several; what meets in one place is its list of runs.  Texts
travel to their group of equal rows and to the digest of the repaired conversation,
which reads them one by one in order.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolex.session import materialise

KEEP, REROLE, DELETE, INSERT, BLEMISH = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
WANTS = (USER, USER, ASSISTANT, USER)  # what an inserted or a renamed row becomes, by state
ENDS = (START, ASSISTANT)
FAR = 1 << 60
GONE = 0  # a row that has to go; others: 1 + 2 * role + (1 if truncated)
ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}  # any other initial: 0
LEGAL = {"su", "ua", "au"}


def keeps(symbol, state):
    """The state after keeping the row, or None."""
    role = (symbol - 1) // 2
    if symbol == GONE or not role:
        return None
    if role == SYSTEM:
        return SYSTEM if state == START else None
    return role if WANTS[state] == role else None


def product(a, b):
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def inserts():
    """Costs of any number of inserted rows."""
    step = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(step, 0)
    for state, wanted in enumerate(WANTS):
        step[state, wanted] = INSERT
    for _ in range(3):
        step = product(step, step)
    return step


INSERTS = inserts()
CLOSE = INSERTS[:, list(ENDS)].min(axis=1)  # costs to the end when no row is left


def transition(symbol):
    """Costs of one row: inserts before it, then the row."""
    row = np.full((4, 4), FAR, np.int64)
    blemish = BLEMISH if symbol != GONE and symbol % 2 == 0 else 0
    for state in range(4):
        row[state, state] = DELETE
        if symbol != GONE:
            row[state, WANTS[state]] = min(row[state, WANTS[state]], REROLE + blemish)
        after = keeps(symbol, state)
        if after is not None:
            row[state, after] = min(row[state, after], KEEP + blemish)
    return product(INSERTS, row)


class Powers:
    """Cached squares of every symbol's transition."""

    def __init__(self):
        self.squares = {s: [transition(s)] for s in range(9)}

    def before(self, symbol, length, after):
        """Costs to the end before a run, from those after it."""
        squares, k = self.squares[symbol], 0
        while length >> k:
            if k == len(squares):
                squares.append(product(squares[-1], squares[-1]))
            if length >> k & 1:
                after = np.minimum((squares[k] + after).min(axis=1), FAR)
            k += 1
        return after


def unroll(symbol, length, state, after):
    """(edits of a run, state after it): at every step the least letter among the cheapest."""
    m = transition(symbol)
    blemish = BLEMISH if symbol != GONE and symbol % 2 == 0 else 0
    togo = np.empty((length + 1, 4), np.int64)
    togo[length] = after
    at = length
    while at:  # once the costs only rise by the same, they go on so
        togo[at - 1] = np.minimum((m + togo[at]).min(axis=1), FAR)
        at -= 1
        if at + 2 <= length:
            rise = togo[at] - togo[at + 2]
            if (rise == rise[0]).all() and at:
                steps = np.arange(at - 1, -1, -1)
                togo[steps] = togo[at + 1 - (at - 1 - steps) % 2] + ((at - 1 - steps) // 2 + 1)[:, None] * rise[0]
                break
    table = togo.tolist()
    out = []
    for at in range(length):
        while True:
            cost, later = table[at][state], table[at + 1]
            wanted = WANTS[state]
            if DELETE + later[state] == cost:
                out.append("D")
                break
            if INSERT + table[at][wanted] == cost:
                out.append("I")
                state = wanted
                continue
            after_keep = keeps(symbol, state)
            if after_keep is not None and KEEP + blemish + later[after_keep] == cost:
                out.append("K")
                state = after_keep
                break
            out.append("R")
            state = wanted
            break
    return out, state


def repair(runs, powers):
    """(cost, audit) of a list of (symbol, length)."""
    costs = [CLOSE]
    for symbol, length in reversed(runs):
        costs.append(powers.before(symbol, length, costs[-1]))
    costs.reverse()
    state, audit = START, []
    for (symbol, length), after in zip(runs, costs[1:]):
        edits, state = unroll(symbol, length, state, after)
        audit += edits
    left = int(CLOSE[state])
    while left:
        audit.append("I")
        state = WANTS[state]
        left -= INSERT
    return int(costs[0][START]), "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n): rows of (conv, turn, role, text) after the damage that
    crc32 of conversation and turn prescribes; a dropped row has n = 0 and nulls."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space))
    there = F.col("kind") != 0
    return rows.withColumn("kind", kind).select(
        "conv", F.when(there, F.col("turn")).alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(F.when(there, 1).otherwise(0)).cast("bigint").alias("n"))


def intact(rows: DataFrame) -> DataFrame:
    """The same columns, without damage."""
    space = F.lit(" ")
    return rows.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).cast("bigint").alias("n"))


GAP = r"[\x20\x09-\x0D]"
ITEM = ["conv", "turn", "role", "digest"]


def first_texts(rows: DataFrame) -> DataFrame:
    """(conv, role, text, turn, digest): every role and text of a conversation that is not
    blank, where it stands first.  Equal rows meet already summed up."""
    filled = rows.where((F.col("n") > 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    unturned = F.max(F.col("turn").isNull())
    least = filled.groupBy("conv", "role", "text").agg(unturned.alias("none"), F.min("turn").alias("least"))
    return least.select("conv", F.when(~F.col("none"), F.col("least")).alias("turn"), "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")


def items(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, n, first, blank, truncated): equal rows of a turn as one,
    ``n`` in number, of which the first is no duplicate where ``first`` is 1."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    narrow = rows.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "n", blank.alias("blank"),
                         F.lit(0).alias("first"), F.lit(False).alias("truncated"))
    cut = ~F.col("text").rlike(rf"[.!?]{GAP}*\z")
    marks = firsts.select(*ITEM, F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("blank"), F.lit(1).alias("first"), cut.alias("truncated"))
    return narrow.unionByName(marks).groupBy(*ITEM).agg(
        F.sum("n").alias("n"), F.max("first").alias("first"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))


PART = ("conv {conv}, part bigint, runs binary, head string, tail string, low bigint, high bigint, turns bigint, "
        "blank bigint, duplicate bigint, truncated bigint, illegal bigint")


class Segment:
    """What a task knows of one conversation: its runs and sums."""

    def __init__(self):
        self.symbols, self.lengths = [], []
        self.head = self.tail = self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def run(self, symbol, length):
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += length
        elif length:
            self.symbols.append(symbol)
            self.lengths.append(length)

    def add(self, turn, role, n, first, blank, truncated):
        if not n:
            return
        initial = role[:1]
        if self.head is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in LEGAL
        self.illegal += n - 1  # equal initials
        self.tail = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        if blank:
            self.blank += n
            self.run(GONE, n)
            return
        if first:
            self.truncated += truncated
            self.run(1 + 2 * ROLES.get(initial, 0) + truncated, 1)
        self.duplicate += n - first
        self.run(GONE, n - first)

    def row(self, conv, part):
        runs = np.array(self.symbols, np.uint8).tobytes() + np.array(self.lengths, "<i8").tobytes()
        return (conv, part, runs, self.head, self.tail, self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal)


def in_batches(rows, schema, most=4096):
    """Row tuples as record batches of bounded size."""
    kept, weight = [], 0
    for row in rows:
        kept.append(row)
        weight += 1 + sum(len(v) for v in row if isinstance(v, (str, bytes))) // 1000
        if weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept, weight = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)


def python_rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns))


def segments(found: DataFrame) -> DataFrame:
    """Items to one row per conversation and task of the sort; rows in order, no text."""
    kind = found.schema["conv"].dataType.simpleString()
    ordered = found.repartitionByRange(*ITEM).sortWithinPartitions(*ITEM)
    ordered = ordered.select("conv", F.spark_partition_id().cast("bigint").alias("part"), "turn", "role", "n", "first", "blank", "truncated")
    schema = ordered.select("conv").schema

    def run(batches):
        arrow = None

        def rows():
            nonlocal arrow
            here, segment, part = None, None, None
            for conv, part, *item in python_rows(batches):
                if segment is None or conv != here:
                    if segment is not None:
                        yield segment.row(here, part)
                    here, segment = conv, Segment()
                segment.add(*item)
            if segment is not None:
                yield segment.row(here, part)

        arrow = arrow_schema(schema, PART)
        yield from in_batches(rows(), arrow)

    return ordered.mapInArrow(run, PART.format(conv=kind))


def arrow_schema(key, ddl):
    """The Arrow schema of ``ddl`` whose first column is the one column of ``key``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c.split(" ") for c in ddl.split(", ")[1:]]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([to_arrow_schema(key).field(0)] + [pa.field(n, kinds[k]) for n, k in names])


REPORT = "conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, moves string"


def reports(parts: DataFrame) -> DataFrame:
    """Segments to one row per conversation; ``moves`` are the edits of rows that may stay."""
    kind = parts.schema["conv"].dataType.simpleString()
    ordered = parts.repartition("conv").sortWithinPartitions("conv", "part")
    schema = parts.select("conv").schema

    def finish(conv, segments, powers):
        runs, sums, illegal, gaps = [], [0, 0, 0], 0, 0
        tail = low = high = None
        turns = 0
        for _, _, blob, head, last, first_turn, last_turn, n_turns, *counts, inside in segments:
            n = len(blob) // 9
            for symbol, length in zip(blob[:n], np.frombuffer(blob[n:], "<i8").tolist()):
                if runs and runs[-1][0] == symbol:
                    runs[-1] = symbol, runs[-1][1] + length
                else:
                    runs.append((symbol, length))
            sums = [a + b for a, b in zip(sums, counts)]
            if head is not None:
                illegal += inside + (tail is not None and tail + head not in LEGAL)
                tail = last
            if first_turn is not None:
                low = first_turn if low is None else low
                turns += n_turns - (high is not None and high == first_turn)
                high = last_turn
        if low is not None:
            gaps = high - low + 1 - turns
        cost, audit = repair(runs, powers)
        moves, at = [], 0
        for symbol, length in runs:  # leave out the rows that have to go
            while length:
                if audit[at] == "I":
                    moves.append("I")
                else:
                    length -= 1
                    if symbol != GONE:
                        moves.append(audit[at])
                at += 1
        return conv, gaps, *sums, illegal, cost, audit, "".join(moves) + audit[at:]

    def run(batches):
        powers = Powers()

        def rows():
            here, kept = None, []
            for row in python_rows(batches):
                if kept and row[0] != here:
                    yield finish(here, kept, powers)
                    kept = []
                here = row[0]
                kept.append(row)
            if kept:
                yield finish(here, kept, powers)

        yield from in_batches(rows(), arrow_schema(schema, REPORT))

    return ordered.mapInArrow(run, REPORT.format(conv=kind))


class Repaired:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, moves):
        self.moves, self.at, self.state, self.rows = moves, 0, START, 0
        self.hash = hashlib.sha256()

    def put(self, role, text):
        self.hash.update(("\n" if self.rows else "").encode() + f"{role}:{text}".encode())
        self.rows += 1

    def insert(self):
        while self.moves[self.at:self.at + 1] == "I":
            self.state = WANTS[self.state]
            self.put("user" if self.state == USER else "assistant", "")
            self.at += 1

    def add(self, role, text):
        self.insert()
        edit = self.moves[self.at]
        self.at += 1
        if edit == "K":
            self.state = ROLES[role[:1]]
            self.put(role, text)
        elif edit == "R":
            self.state = WANTS[self.state]
            self.put("user" if self.state == USER else "assistant", text)

    def digest(self):
        self.insert()
        return self.hash.hexdigest()


def digests(reported: DataFrame, firsts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): moves and texts of a conversation pass in order; one text is held at a time."""
    kind = reported.schema["conv"].dataType.simpleString()
    leads = reported.select("conv", F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                            F.lit("").alias("digest"), F.col("moves").alias("text"))
    texts = firsts.select("conv", F.lit(1).alias("place"), "turn", "role", "digest", "text")
    ordered = leads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "place", "turn", "role", "digest")
    ordered = ordered.select("conv", "place", "role", "text")
    schema = reported.select("conv").schema

    def run(batches):
        def rows():
            here, repaired = None, None
            for conv, place, role, text in python_rows(batches):
                if place == 0:
                    if repaired is not None:
                        yield here, repaired.digest()
                    here, repaired = conv, Repaired(text)
                else:
                    repaired.add(role, text)
            if repaired is not None:
                yield here, repaired.digest()

        yield from in_batches(rows(), arrow_schema(schema, "conv x, repaired_sha256 string"))

    return ordered.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, *, conv="conv_id", turn="turn", role="role", text="text", damage=False) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``damage`` first damages the rows as ``damaged`` says.  Rows of one turn are ordered by role and
    the digest of the text; null turns come first; null roles and texts are one space.  An
    initial that is none of s, u, a (an empty role too) cannot be kept.  Null conversation ids are one
    conversation.  A conversation without rows has zeros, an empty audit and the digest of nothing;
    an empty table gives an empty result.  Only a conversation's runs, its audit and one text at a
    time are held by a task.
    """
    narrow = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    narrow = damaged(narrow) if damage else intact(narrow)
    firsts = materialise(first_texts(narrow), "repair-texts")
    found = materialise(items(narrow, firsts), "repair-items")
    reported = materialise(reports(segments(found)), "repair-reports")
    hashed = digests(reported, firsts).withColumnRenamed("conv", "conv_")
    joined = reported.drop("moves").join(hashed, F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_")
    return joined.withColumnRenamed("conv", conv)
