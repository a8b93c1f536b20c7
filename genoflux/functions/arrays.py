"""Vectors as array values of a row.  Indices are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .math import _c


def _n(x) -> Column:
    return _c(x).cast("int")


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), _n(n))


def falses(n) -> Column:
    return F.array_repeat(F.lit(False), _n(n))


def empties(n) -> Column:
    return F.array_repeat(F.lit(""), _n(n))


def integers(n, fill1: int = 0, fill2: int = 1, fill2_indices: list[int] | None = None) -> Column:
    marked = F.array(*[F.lit(int(i)).cast("bigint") for i in fill2_indices or ()]).cast("array<bigint>")
    return F.transform(seq_len(n), lambda i: F.when(F.array_contains(marked, i), fill2).otherwise(fill1).cast("bigint"))


def seq_len(n) -> Column:
    """0 to n - 1."""
    k = _c(n).cast("bigint")
    return F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(k, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))


def seq_along(x) -> Column:
    return seq_len(F.size(_c(x)))


def seq(start, stop, by: float | None = None, length: int | None = None) -> Column:
    """Ascending or descending; by step, or in that many values."""
    a, z = _c(start), _c(stop)
    if length is not None:
        step = (z.cast("double") - a.cast("double")) / max(1, length - 1)
        return F.transform(seq_len(length), lambda i: a.cast("double") + i.cast("double") * step)
    if by is None or isinstance(by, int):
        return F.sequence(a.cast("bigint"), z.cast("bigint"), F.lit(by).cast("bigint")) if by is not None else F.sequence(a.cast("bigint"), z.cast("bigint"))
    n = F.floor((z.cast("double") - a.cast("double")) / by + 1e-10) + 1
    return F.transform(seq_len(n), lambda i: a.cast("double") + i.cast("double") * by)


def rep(x, n) -> Column:
    return F.flatten(F.array_repeat(_c(x), _n(n)))


def rep_each(x, n) -> Column:
    return F.flatten(F.transform(_c(x), lambda v: F.array_repeat(v, _n(n))))


def concatenate(*xs) -> Column:
    return F.concat(*map(_c, xs))


def which(x) -> Column:
    return F.transform(F.filter(F.transform(_c(x), lambda v, i: F.struct(v.alias("v"), i.cast("bigint").alias("i"))), lambda r: r["v"]), lambda r: r["i"])


def subset(x, indices) -> Column:
    return F.transform(_c(indices), lambda i: F.element_at(_c(x), (i + 1).cast("int")))


def mask(x, keep) -> Column:
    return F.transform(F.filter(F.arrays_zip(_c(x).alias("v"), _c(keep).alias("k")), lambda r: r["k"]), lambda r: r["v"])


def order(x, ascending: bool = True) -> Column:
    """Sorting permutation; ties by index."""
    rows = F.transform(_c(x), lambda v, i: F.struct(v.alias("v"), (i if ascending else -i).alias("i")))
    return F.transform(F.sort_array(rows, ascending), lambda r: F.abs(r["i"]).cast("bigint"))


def reverse(x) -> Column:
    return F.reverse(_c(x))


def sort(x, ascending: bool = True) -> Column:
    return F.sort_array(_c(x), ascending)


def unique(x) -> Column:
    """Distinct values in order of their first occurrence."""
    return F.array_distinct(_c(x))


def match(x, table) -> Column:
    """Index of each value's first place in the table, else -1."""
    return F.transform(_c(x), lambda v: F.coalesce(F.array_position(_c(table), v), F.lit(0)) - 1)


def cum_sum(x) -> Column:
    acc = F.aggregate(_c(x), F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum")), lambda a, v: F.struct(F.array_append(a["out"], a["sum"] + v).alias("out"), (a["sum"] + v).alias("sum")))
    return acc["out"]


def cum_product(x) -> Column:
    acc = F.aggregate(_c(x), F.struct(F.array().cast("array<double>").alias("out"), F.lit(1.0).alias("p")), lambda a, v: F.struct(F.array_append(a["out"], a["p"] * v).alias("out"), (a["p"] * v).alias("p")))
    return acc["out"]


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v.cast("double"))


def sapply(x, f) -> Column:
    """f, a function of a Column, over every element."""
    return F.transform(_c(x), f)


def any_true(x) -> Column:
    return F.exists(_c(x), lambda v: v)


def all_true(x) -> Column:
    return F.forall(_c(x), lambda v: v)


def set_union(x, y) -> Column:
    return F.array_union(_c(x), _c(y))


def set_intersection(x, y) -> Column:
    return F.array_intersect(_c(x), _c(y))


def set_difference(x, y) -> Column:
    return F.array_except(_c(x), _c(y))


def set_symmetric_difference(x, y) -> Column:
    return F.array_union(F.array_except(_c(x), _c(y)), F.array_except(_c(y), _c(x)))
