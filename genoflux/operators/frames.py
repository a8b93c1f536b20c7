"""Dictionaries as map columns and data frames as tables with an index column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import _c
from .vectors import before


def dictionary(**values) -> Column:
    """A map of keys to values of one type."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), _c(v) if isinstance(v, Column) else F.lit(v))])


def from_json(text, value_type: str = "string") -> Column:
    return F.from_json(_c(text), f"map<string,{value_type}>")


def get_value(d, key: str) -> Column:
    """Null if the key isn't there."""
    return F.try_element_at(_c(d), F.lit(key))


def set_value(d, key: str, value) -> Column:
    """Put, or remove with None."""
    rest = F.map_filter(_c(d), lambda k, _: k != key)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), value if isinstance(value, Column) else F.lit(value)))


def add_keys(d, other) -> Column:
    """All keys of both; the other's values win."""
    return F.map_concat(F.map_filter(_c(d), lambda k, _: ~F.map_contains_key(_c(other), k)), _c(other))


def append_keys(d, other) -> Column:
    """All keys of both; arrays of a key that both have are concatenated."""
    return F.map_zip_with(_c(d), _c(other), lambda _, a, b: F.concat(F.coalesce(a, F.array_except(b, b)), F.coalesce(b, F.array_except(a, a))))


def all_keys(d) -> Column:
    """In ascending order."""
    return F.array_sort(F.map_keys(_c(d)))


def row_values(d, i) -> Column:
    """The values at one index of every key's array."""
    return F.transform_values(_c(d), lambda _, v: F.get(v, _c(i)))


def compact_indices(d) -> Column:
    """Integer keys numbered anew from 0, in order, without empty arrays."""
    kept = F.array_sort(F.map_entries(F.map_filter(_c(d), lambda _, v: F.size(v) > 0)))
    return F.map_from_entries(F.transform(kept, lambda e, i: F.struct(i.cast("bigint"), e["value"])))


def same_contents(a, b) -> Column:
    return F.array_sort(F.map_entries(_c(a))) == F.array_sort(F.map_entries(_c(b)))


def serialize(d, kind: str = "json") -> Column:
    """json, or key and value lines in csv and tsv."""
    if kind == "json":
        return F.to_json(_c(d))
    sep = {"csv": ",", "tsv": "\t"}[kind]
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(d))), lambda e: F.concat_ws(sep, e["key"], e["value"].cast("string"))), "\n")


def with_index(df: DataFrame, *order: str | Column, idx: str = "idx") -> DataFrame:
    """Adds a 0-based index in the order of columns, by ranges."""
    return before(df, [], list(order), F.lit(1).cast("bigint"), idx)


def cbind(*frames: DataFrame, idx: str = "idx") -> DataFrame:
    """Columns side by side, by the index; names must differ."""
    names = [c for f in frames for c in f.columns if c != idx]
    if len(names) != len(set(names)):
        raise ValueError("cbind() needs different column names")
    return reduce(lambda a, b: a.join(b, idx, "full"), frames)


def rbind(*frames: DataFrame) -> DataFrame:
    """Rows of frames with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def subset_rows(df: DataFrame, asked: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows (place, idx) asked for, repeats included, in the order of place."""
    return asked.join(df, idx)


def as_matrix(df: DataFrame, columns: list[str], idx: str = "idx") -> DataFrame:
    """Coordinates (row, col, value) of columns of one type."""
    return df.select(F.col(idx).alias("row"), F.posexplode(F.array(*columns)).alias("col", "value")).withColumn("col", F.col("col").cast("bigint"))


def sort_by(df: DataFrame, column: str, ascending: bool = True, idx: str = "idx") -> DataFrame:
    return df.orderBy(F.asc(column) if ascending else F.desc(column), idx)
