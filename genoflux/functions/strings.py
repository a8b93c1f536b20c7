"""Strings, casts and type tests.  Positions are 0-based."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .math import _c


def _plain(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def nchar(x) -> Column:
    """Length in bytes."""
    return F.octet_length(_c(x)).cast("bigint")


def strcontains(x, s: str, pos: int = 0) -> Column:
    return F.locate(s, _c(x), pos + 1) > 0 if s else F.length(_c(x)) >= pos


def strfind(x, s: str, pos: int = 0) -> Column:
    return (F.locate(s, _c(x), pos + 1) - 1).cast("bigint")


def strprefix(x, s: str) -> Column:
    return F.startswith(_c(x), F.lit(s))


def strsuffix(x, s: str) -> Column:
    return F.endswith(_c(x), F.lit(s))


def strsplit(x, sep: str = " ") -> Column:
    """Split at a literal separator; an empty one splits into characters."""
    return F.split(_c(x), _plain(sep), -1) if sep else F.split(_c(x), "", -1)


def substr(x, first, last=None) -> Column:
    """Characters from first to last, both included, as far as they exist."""
    v, a = _c(x), F.greatest(_c(first), F.lit(0))
    z = F.length(v) - 1 if last is None else F.least(_c(last), F.length(v) - 1)
    return F.when(z < a, "").otherwise(F.substr(v, (a + 1).cast("int"), (z - a + 1).cast("int")))


def grep(x, pattern: str, ignore_case: bool = False, fixed: bool = False, invert: bool = False) -> Column:
    """Whether a pattern is found; filter by it for elements or, with an index column, for indices."""
    p = _plain(pattern) if fixed else pattern
    found = _c(x).rlike(f"(?i){p}" if ignore_case else p)
    return ~found if invert else found


def grep_match(x, pattern: str, ignore_case: bool = False) -> Column:
    """The matched part, or null."""
    p = f"(?i){pattern}" if ignore_case else pattern
    return F.when(_c(x).rlike(p), F.regexp_extract(_c(x), p, 0))


def paste(*xs, sep: str = " ") -> Column:
    return F.concat_ws(sep, *(_c(x).cast("string") for x in xs))


def paste0(*xs) -> Column:
    return paste(*xs, sep="")


def format_number(fmt: str, x) -> Column:
    """printf-style, for one number."""
    if len(re.findall(r"%(?!%)", fmt)) != 1:
        raise ValueError("format() needs exactly one conversion")
    return F.format_string(re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)i", r"%\1d", fmt), _c(x))


def as_float(x) -> Column:
    return _c(x).cast("double")


def as_integer(x) -> Column:
    """Truncates floats; text that isn't a number raises."""
    return _c(x).cast("bigint")


def as_logical(x) -> Column:
    return _c(x).cast("boolean")


def as_string(x) -> Column:
    return _c(x).cast("string")


#: What a Spark type is called in the array language.
KINDS = {"boolean": "logical", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "float", "string": "string"}


def element_type(df: DataFrame, column: str) -> str:
    """logical, integer, float, string, NULL, or object for a nested column."""
    kind = dict(df.dtypes)[column]
    return "NULL" if kind == "void" else KINDS.get(kind, "object")


def is_type(df: DataFrame, column: str, kind: str) -> bool:
    return element_type(df, column) == kind
