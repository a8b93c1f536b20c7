"""Colours, for presentation: fixed ramps on the driver, conversions as column expressions."""

from __future__ import annotations

import colorsys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .math import _c


def _hex(rgb: tuple[float, ...]) -> str:
    return "#" + "".join(f"{round(255 * min(1.0, max(0.0, x))):02X}" for x in rgb)


def rainbow(n: int, s: float = 1.0, v: float = 1.0, start: float = 0.0, end: float | None = None) -> list[str]:
    end = max(1, n - 1) / n if end is None and n else end or 0.0
    return [_hex(colorsys.hsv_to_rgb((start + (end - start) * i / max(1, n - 1)) % 1.0, s, v)) for i in range(n)]


def heat(n: int) -> list[str]:
    """From red over yellow to near white."""
    return [_hex((1.0, min(1.0, 1.5 * t), max(0.0, 2 * t - 1))) for t in (i / max(1, n - 1) for i in range(n))]


def terrain(n: int) -> list[str]:
    """From green over sand to near white."""
    return [_hex(colorsys.hsv_to_rgb(0.33 * (1 - t), 1 - 0.9 * t, 0.65 + 0.3 * t)) for t in (i / max(1, n - 1) for i in range(n))]


def cyan_magenta(n: int) -> list[str]:
    return [_hex((min(1.0, 2 * t), min(1.0, 2 - 2 * t), 1.0)) for t in (i / max(1, n - 1) for i in range(n))]


def gray(x) -> Column:
    """A number from 0 to 1 as a grey."""
    v = F.lpad(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x))) * 255).cast("int")), 2, "0")
    return F.concat(F.lit("#"), v, v, v)


def rgb_to_color(r, g, b) -> Column:
    part = lambda x: F.lpad(F.hex(F.round(_c(x) * 255).cast("int")), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def color_to_rgb(color) -> Column:
    """#RRGGBB as an array of three numbers from 0 to 1."""
    return F.array(*[F.conv(F.substring(_c(color), k, 2), 16, 10).cast("double") / 255 for k in (2, 4, 6)])


def _converted(f):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([list(f(*x)) for x in zip(a, b, c)])

    return lambda a, b, c: udf(_c(a), _c(b), _c(c))


hsv_to_rgb, rgb_to_hsv = _converted(colorsys.hsv_to_rgb), _converted(colorsys.rgb_to_hsv)
