"""Noise for denoising examples.

A row is an id array; ``l`` is the index of its first ``</s>`` (else its size),
so positions 1..l-1 are content.  Every draw is seeded by the row and its
position: the same row gets the same noise on any cluster.  All of it is one
projection; nothing is shuffled.
"""

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolex.functions import arrays as A
from duolex.functions.rng import mix_below, mix_each, row_seed
from duolex.operators.encode import mask_pad
from duolex.schemas import EOS, MASK, PAD

POS_BITS = 31  # (31 random bits, any array position) pairs are sorted as one BIGINT
POS_MASK = (1 << POS_BITS) - 1
GUIDE_BITS = 12


@dataclass(frozen=True)
class Ratios:
    """Shares of content positions; Columns or numbers."""

    mask: object = 0.15
    dropout: object = 0.20
    replace: object = 0.0
    insert: object = 0.15
    shuffle: object = 1


def content_length(x: Column) -> Column:
    at = F.array_position(x, F.lit(EOS)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(x))


def _share(l: Column, ratio) -> Column:
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.floor(l * ratio).cast("int")


def _pick(s: Column, start: int, stop: Column, n: Column, salt: int) -> Column:
    """``n`` distinct positions of [start, stop), in random order."""
    keyed = F.transform(
        mix_each(s, stop - start, salt, start), lambda h, i: F.shiftleft(h, POS_BITS) + i + start
    )
    return F.transform(
        A.take(F.sort_array(keyed), n), lambda v: v.bitwiseAND(F.lit(POS_MASK)).cast("int")
    )


def _splice(x: Column, at: Column, values, skip: int) -> Column:
    """``x`` with ``values(j)`` (an array) put in at ``at[j]``, ascending; the element
    there is left out when ``skip`` is 1.  Works on slices, not on elements."""

    def part(p, j):
        before = F.when(j == 0, F.lit(0)).otherwise(F.get(at, j - 1) + skip)
        return F.concat(F.slice(x, before + 1, p - before), values(j))

    last = F.when(F.size(at) == 0, F.lit(0)).otherwise(F.get(at, F.size(at) - 1) + skip)
    return F.concat(F.flatten(F.transform(at, part)), A.drop_first(x, last))


def noise_mask(x: Column, l: Column, ratio, s: Column) -> Column:
    """``int(l * ratio)`` draws with replacement become the mask id."""

    def body(n):
        hits = F.transform(mix_each(s, n, 1), lambda h: F.shiftright(h * (l - 1), 31).cast("int") + 1)
        mask = F.array(F.lit(MASK))
        return A.let(F.sort_array(F.array_distinct(hits)), lambda at: _splice(x, at, lambda j: mask, 1))

    return A.let(_share(l, ratio), lambda n: F.when((n < 1) | (l < 2), x).otherwise(body(n)))


def noise_dropout(x: Column, l: Column, ratio, s: Column, keyword_ids) -> Column:
    """Delete ``int(l * ratio)`` distinct content positions and pad at the end.
    Tokens of the language's keywords weigh 2, others 1.

    Taking the n largest u**(1/weight) has the law of n successive weighted draws.
    """

    def key(h, i):
        if keyword_ids:
            root = F.floor(F.sqrt(h / F.lit(2147483648.0)) * F.lit(2147483648.0))
            h = F.when(F.get(x, i + 1).isin(*keyword_ids), root).otherwise(h)
        return F.shiftleft(h, POS_BITS) + i + 1

    def body(n):
        top = A.take(F.sort_array(F.transform(mix_each(s, l - 1, 2, 1), key), asc=False), n)
        drop = F.sort_array(F.transform(top, lambda v: v.bitwiseAND(F.lit(POS_MASK)).cast("int")))
        none = F.array().cast("array<int>")
        return A.let(
            drop,
            lambda at: A.let(_splice(x, at, lambda j: none, 1), lambda kept: A.pad_to(kept, F.size(x), PAD)),
        )

    return A.let(_share(l, ratio), lambda n: F.when((n < 1) | (l < 2), x).otherwise(body(n)))


class TokenSampler:
    """Draws of distinct tokens by frequency, for one language per row.

    ``tables`` maps a language to its (token_id, freq) list, at most k long.  The
    lists enter the plan as array literals; a draw is a binary search in integer
    running sums, so the same token comes out on any engine.
    """

    def __init__(self, tables: dict[str, list[tuple[int, int]]]):
        self.tables = {}
        for lang, rows in tables.items():
            ids, freqs, upto, total = [], [], [], 0
            for token_id, freq in rows:
                total += freq
                ids.append(token_id)
                freqs.append(freq)
                upto.append(total)
            self.tables[lang] = (ids, freqs, upto, total)

    @classmethod
    def from_table(cls, probs: DataFrame, limit=200_000):
        """From (lang, token_id, freq), cut to top-k before: a table of fixed size."""
        rows = probs.select("lang", "token_id", "freq").orderBy("lang", F.desc("freq"), "token_id").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError("cut the frequency table to its top-k tokens first")
        tables = {}
        for r in rows:
            tables.setdefault(r.lang, []).append((r.token_id, r.freq))
        return cls(tables)

    @staticmethod
    def _longs(values):
        # one literal, folded into an array by the optimizer
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def draw(self, lang: Column, n: Column, s: Column, salt: int) -> Column:
        """``n`` distinct ids (all of them when there are fewer)."""
        out = F.array().cast("array<int>")
        for name, table in self.tables.items():
            out = F.when(lang == name, self._draw_one(table, n, s, salt)).otherwise(out)
        return out

    def _draw_one(self, table, n, s, salt):
        ids, freqs, upto, total = table
        token_ids = self._longs(ids)
        # The upper bits of a draw tell where its binary search may start; the
        # steps cover the widest gap between two such starts.
        starts = [
            bisect_right(upto, int((j << (31 - GUIDE_BITS)) / 2147483648.0 * float(total)))
            for j in range(1 << GUIDE_BITS)
        ]
        gap = max((b - a for a, b in zip(starts, starts[1:] + [len(ids)])), default=0)
        bits = gap.bit_length()
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))]).cast("array<int>")
        cdf, guide = self._longs(upto + [1 << 62] * (1 << bits)), self._longs(starts)

        def token(h):
            # number of running sums that are <= the draw
            at = A.let(
                F.floor(h / F.lit(2147483648.0) * F.lit(float(total))),
                lambda r: F.aggregate(
                    steps, F.get(guide, F.shiftright(h, 31 - GUIDE_BITS).cast("int")).cast("int"),
                    lambda lo, d: F.when(F.get(cdf, lo + d - 1) <= r, lo + d).otherwise(lo),
                ),
            )
            return F.get(token_ids, at).cast("int")

        # Drawing again what was drawn before, and keeping first occurrences, is
        # drawing without replacement.  Where the spare draws do not yield enough
        # distinct tokens, the exact weighted order of the whole list is used.
        drawn = F.array_distinct(F.transform(mix_each(s, 2 * n + 32, salt), token))

        def whole():
            keyed = F.transform(
                mix_each(s, F.lit(len(ids)), salt + 1),
                lambda h, i: F.struct(
                    (-F.ln((h + F.lit(1)) / F.lit(2147483649.0)) / F.get(self._longs(freqs), i)).alias("key"),
                    i.alias("pos"),
                ),
            )
            return F.transform(A.take(F.sort_array(keyed), n), lambda p: F.get(token_ids, p["pos"]).cast("int"))

        return A.let(drawn, lambda d: F.when(F.size(d) >= n, A.take(d, n)).otherwise(whole()))


def _put_tokens(x, at, tokens, skip):
    """The j-th drawn token goes to the j-th drawn position."""
    pairs = F.sort_array(F.transform(A.take(at, F.size(tokens)), lambda p, k: F.struct(p.alias("p"), k.alias("k"))))

    def put(o):
        def value(j):
            return F.array(F.get(tokens, F.get(o, j)["k"]))

        return A.let(F.transform(o, lambda z: z["p"]), lambda ps: _splice(x, ps, value, skip))

    return A.let(pairs, put)


def noise_replace(x: Column, l: Column, ratio, s: Column, sampler: TokenSampler, other: Column) -> Column:
    """``int(l * ratio)`` distinct content positions get distinct tokens drawn by the
    other language's frequencies."""

    def body(n):
        return A.let(
            F.struct(_pick(s, 1, l, n, 4).alias("at"), sampler.draw(other, n, s, 5).alias("tokens")),
            lambda d: _put_tokens(x, d["at"], d["tokens"], 1),
        )

    return A.let(_share(l, ratio), lambda n: F.when(n < 1, x).otherwise(body(n)))


def noise_insert(x: Column, l: Column, ratio, s: Column, sampler: TokenSampler, other: Column) -> Column:
    """Tokens drawn as for replacement go before ``int(l * ratio)`` distinct positions
    of 1..l-2; the result is cut to the old size, ending in ``</s>``, or padded."""

    def body(n):
        return A.let(
            F.struct(_pick(s, 1, l - 1, n, 7).alias("at"), sampler.draw(other, n, s, 8).alias("tokens")),
            lambda d: A.let(
                _put_tokens(x, d["at"], d["tokens"], 0),
                lambda y: A.let(content_length(y) + 1, lambda m: _refit(y, m, F.size(x))),
            ),
        )

    return A.let(_share(l, ratio), lambda n: F.when(n < 1, x).otherwise(body(n)))


def _refit(y: Column, m: Column, size: Column) -> Column:
    """Content plus ``</s>`` takes ``m`` places: cut to ``size`` or pad up to it."""
    cut = F.concat(A.take(y, size - 1), F.array(F.lit(EOS)))
    return F.when(m >= size, cut).otherwise(A.pad_to(A.take(y, m), size, PAD))


def noise_shuffle(x: Column, l: Column, flag, s: Column) -> Column:
    """Permute x[a:b] for random a < b in [1, l); nothing when l < 10 or b - a < 2."""
    flag = flag if isinstance(flag, Column) else F.lit(flag)

    def body(ab):
        a, b = F.array_min(ab), F.array_max(ab)
        order = F.transform(mix_each(s, b - a, 11), lambda h, k: F.shiftleft(h, POS_BITS) + k)
        shuffled = F.transform(
            F.sort_array(order), lambda v: F.get(x, a + v.bitwiseAND(F.lit(POS_MASK)).cast("int"))
        )
        return F.when(b - a < 2, x).otherwise(F.concat(A.take(x, a), shuffled, A.drop_first(x, b)))

    # two distinct positions: the second is drawn from the l-2 others
    first = (mix_below(s, F.lit(0), l - 1, 10) + 1).cast("int")
    second = (mix_below(s, F.lit(1), l - 2, 10) + 1).cast("int")
    both = A.let(first, lambda p: F.array(p, F.when(second >= p, second + 1).otherwise(second)))
    return F.when((flag == 0) | (l < 10), x).otherwise(A.let(both, body))


def _staged(df, col, step):
    """One noise step over the current array and its current content length."""
    return df.withColumn(
        col, A.let(F.col(col), lambda x: A.let(content_length(x), lambda l: step(x, l)))
    )


def denoise_examples(df: DataFrame, ratios: Ratios, sampler: TokenSampler, keyword_ids: dict,
                     langs, key, seed=0) -> DataFrame:
    """Noisy inputs with the clean ids as labels.

    Order: dropout, replacement, insertion, shuffle, mask.  ``lang`` becomes the
    other language, as the trainer translates back into the row's own one; the
    attention mask is computed again.  ``key`` names the columns that identify
    the row.
    """
    first, second = langs
    s = F.col("_s")
    df = (
        df.where(F.col("lang").isin(first, second))
        .withColumn("_s", row_seed(seed, *key))
        .withColumn("_other", F.when(F.col("lang") == first, F.lit(second)).otherwise(F.lit(first)))
        .withColumn("labels", mask_pad(F.col("input_ids")))
    )
    other = F.col("_other")

    def dropout(x, l):
        return F.when(
            F.col("lang") == first, noise_dropout(x, l, ratios.dropout, s, keyword_ids.get(first, []))
        ).otherwise(noise_dropout(x, l, ratios.dropout, s, keyword_ids.get(second, [])))

    df = _staged(df, "input_ids", dropout)

    # replacement keeps the content length, so insertion sees the same one
    def replace_insert(x, l):
        return A.let(
            noise_replace(x, l, ratios.replace, s, sampler, other),
            lambda y: noise_insert(y, l, ratios.insert, s, sampler, other),
        )

    df = _staged(df, "input_ids", replace_insert)

    def shuffle_mask(x, l):
        return A.let(noise_shuffle(x, l, ratios.shuffle, s), lambda y: noise_mask(y, l, ratios.mask, s))

    df = _staged(df, "input_ids", shuffle_mask)
    return (
        df.withColumn("lang", other)
        .withColumn("attention_mask", A.not_equal_mask(F.col("input_ids"), PAD))
        .drop("_s", "_other")
    )
