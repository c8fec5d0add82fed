"""Column builders over numeric array columns (one row = one position or one trace).

Every function is narrow: no shuffle, no Python worker. ``let`` matters: a computed column that is
read inside a lambda would be evaluated once per element after projections are merged, so it is bound
to a lambda variable first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def asum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def amean(values: Column) -> Column:
    """Mean of an array; null when empty."""
    return let(values, lambda v: F.when(F.size(v) > 0, asum(v) / F.size(v)))


def argmax(values: Column) -> Column:
    """0-based index of the first largest element."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("bigint"))


def at(values: Column, index: Column) -> Column:
    """Element at a 0-based index; null outside the array."""
    return F.get(values, index.cast("int"))


def log_softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    temp = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return let(
        z,
        lambda v: let(
            F.array_max(v),
            lambda m: let(
                F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp((x - m) / temp))),
                lambda lse: F.transform(v, lambda x: (x - m) / temp - lse),
            ),
        ),
    )


def softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    return F.transform(log_softmax(z, temperature), lambda x: F.exp(x))


def entropy(p: Column, eps: float) -> Column:
    """-sum p ln(p + eps)."""
    return -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * F.log(x + F.lit(eps)))


def dot(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: x * y))


def resize(values: Column, like: Column, fill: float = NEG_INF) -> Column:
    """Cut or pad ``values`` to the length of ``like``."""
    return let(
        values,
        lambda v: F.transform(like, lambda _, i: F.coalesce(F.get(v, i), F.lit(fill))),
    )


def top_entries(score: Column, k: int | None, *payload: Column) -> Column:
    """The ``k`` entries with the largest score (all for None), ties by smaller index.

    Returns an array of structs ``(score, neg_index, p0, p1, ...)``; payload arrays are read at the
    same index.
    """

    def entry(values: Column, arrays: list[Column]) -> Column:
        return F.transform(
            values,
            lambda x, i: F.struct(
                x.alias("score"),
                (-i).alias("neg_index"),
                *[F.get(a, i).alias(f"p{n}") for n, a in enumerate(arrays)],
            ),
        )

    def bind(values: Column, rest: list[Column], bound: list[Column]) -> Column:
        if not rest:
            return entry(values, bound)
        return let(rest[0], lambda a: bind(values, rest[1:], [*bound, a]))

    ranked = F.sort_array(let(score, lambda s: bind(s, list(payload), [])), asc=False)
    return ranked if k is None else F.slice(ranked, 1, k)


def trailing_sums(values: Column, w: int) -> Column:
    """Sum over the last ``w`` elements up to each index; shorter windows at the head."""
    if w == 1:
        return values
    return let(
        values,
        lambda v: F.transform(
            v,
            lambda _, i: asum(F.slice(v, F.greatest(i - (w - 2), F.lit(1)), F.least(i + 1, F.lit(w)))),
        ),
    )
