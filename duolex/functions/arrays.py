"""Array idioms shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain column would be inlined into the lambdas that use it and be
    evaluated again for every array element.
    """
    return F.transform(F.array(value), body)[0]


def positions(n: Column, start: int = 0) -> Column:
    """[start, start+1, .., n-1]; empty when there is none."""
    return F.when(n > start, F.sequence(F.lit(start), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def take(a: Column, n: Column) -> Column:
    """First ``n`` elements (``n`` may be 0 or exceed the size)."""
    return F.slice(a, F.lit(1), F.greatest(n.cast("int"), F.lit(0)))


def drop_first(a: Column, n: Column) -> Column:
    """All but the first ``n`` elements."""
    return F.slice(a, n.cast("int") + 1, F.greatest(F.size(a) - n.cast("int"), F.lit(0)))


def pad_to(a: Column, n: Column, value: int) -> Column:
    """Append ``value`` up to size ``n``; never cuts."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n.cast("int") - F.size(a), F.lit(0))))


def not_equal_mask(a: Column, value: int) -> Column:
    """1 where the element differs from ``value``, else 0."""
    return F.transform(a, lambda x: F.when(x == value, F.lit(0)).otherwise(F.lit(1)))


def joined(a: Column, null="") -> Column:
    """Array as comma separated text."""
    return F.array_join(a.cast("array<string>"), ",", null)


def joined_padded(a: Column, n: Column, value: int, null="") -> Column:
    """``joined(pad_to(a, n, value))``, the padding repeated as text and not held as elements."""
    gap = F.greatest(n.cast("int") - F.size(a), F.lit(0))
    padding = F.repeat(F.lit(f",{value}"), gap)
    return F.concat(joined(a, null), F.when(F.size(a) > 0, padding).otherwise(F.substr(padding, F.lit(2))))


def div(a: Column, n: int) -> Column:
    """Integer quotient of a BIGINT that is not negative."""
    return F.call_function("div", a, F.lit(n))
