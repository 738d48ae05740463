"""Vector helpers over array columns, which Spark orders lexicographically.

Spark counts a strict prefix as smaller; vectors that are compared should have one length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lexi_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; unequal lengths are compared on the common prefix."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def lexi_max(a: Column, b: Column) -> Column:
    """The larger vector, the first on a tie."""
    return F.when(lexi_compare(a, b) >= 0, a).otherwise(b)


def lexi_min(a: Column, b: Column) -> Column:
    return F.when(lexi_compare(a, b) <= 0, a).otherwise(b)


def blend(vector: Column, beta: int, scale: int = 100) -> Column:
    """Each component plus ``beta / scale`` of the next, times ``scale``: exact integers."""
    return F.transform(vector, lambda x, i: x * scale + F.coalesce(F.try_element_at(vector, (i + 2).cast("int")), F.lit(0)) * beta)


def blend_doubles(vector: Column, beta: float) -> Column:
    return F.transform(vector, lambda x, i: x + F.coalesce(F.try_element_at(vector, (i + 2).cast("int")), F.lit(0.0)) * F.lit(float(beta)))


def render(vector: Column) -> Column:
    """Components joined by ``_``, as the method table's text column holds them."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), "_")


def parse(text: Column) -> Column:
    """The vector in a rendered text."""
    return F.transform(F.split(text, "_"), lambda x: x.cast("double"))


def ranking_key(groups: Sequence[int]) -> str:
    return "_".join(map(str, groups))


def position(group: Column, groups: Sequence[int]) -> Column:
    """0-based place of a group in a ranking, null outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(int(g)) for g in groups]), group), F.lit(0)) - 1


def median_vector(vectors: Column) -> Column:
    """Middle of the vectors sorted falling, or the mean of the two middle ones."""
    ordered = F.sort_array(vectors, asc=False)
    n = F.size(vectors)
    lo = F.element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1)
    hi = F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return F.zip_with(lo, hi, lambda x, y: (x + y) / 2)
