"""Matrices as coordinate tables (row, col, value), 0-based."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "row bigint, col bigint, value double"


def from_vector(df: DataFrame, value: str, idx: str, nrow: int, ncol: int, by_row: bool = False) -> DataFrame:
    i = F.col(idx).cast("bigint")
    row, col = (F.expr(f"{idx} div {ncol}"), i % ncol) if by_row else (i % nrow, F.expr(f"{idx} div {nrow}"))
    return df.select(row.cast("bigint").alias("row"), col.cast("bigint").alias("col"), F.col(value).alias("value"))


def to_vector(m: DataFrame, nrow: int) -> DataFrame:
    """Rows (idx, value), by column."""
    return m.select((F.col("col") * nrow + F.col("row")).alias("idx"), "value")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def dim(m: DataFrame) -> DataFrame:
    """One row (nrow, ncol)."""
    return m.agg(F.coalesce(F.max("row") + 1, F.lit(0)).alias("nrow"), F.coalesce(F.max("col") + 1, F.lit(0)).alias("ncol"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product, by a join on the inner dimension and a sum over it; absent entries are zero."""
    x = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    y = b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return x.join(y, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def power(m: DataFrame, n: int, size: int) -> DataFrame:
    """Whole powers by squaring; of the inverse for negative ones."""
    if n < 0:
        return power(inverse(m), -n, size)
    out = None
    while n:
        if n & 1:
            out = m if out is None else multiply(out, m)
        n >>= 1
        m = multiply(m, m) if n else m
    return out if out is not None else identity(m.sparkSession, size)


def identity(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(value).alias("value"))


def outer_product(x: DataFrame, y: DataFrame) -> DataFrame:
    """Of vectors (idx, value): as the result is every pair, both sides are what the caller asks for."""
    return x.select(F.col("idx").alias("row"), F.col("value").alias("x")).join(y.select(F.col("idx").alias("col"), F.col("value").alias("y")), F.lit(True)).select("row", "col", (F.col("x") * F.col("y")).alias("value"))


def cbind(*ms: tuple[DataFrame, int]) -> DataFrame:
    """Matrices (table, number of columns) side by side."""
    return _bind(ms, "col")


def rbind(*ms: tuple[DataFrame, int]) -> DataFrame:
    """Matrices (table, number of rows) on top of each other."""
    return _bind(ms, "row")


def _bind(ms, axis: str) -> DataFrame:
    out, at = None, 0
    for m, n in ms:
        m = m.withColumn(axis, F.col(axis) + at)
        out, at = m if out is None else out.unionByName(m), at + n
    return out


def diagonal(m: DataFrame) -> DataFrame:
    return m.where(F.col("row") == F.col("col")).select(F.col("row").alias("idx"), "value")


def upper_triangle(diag: bool = False) -> Column:
    return F.col("row") <= F.col("col") if diag else F.col("row") < F.col("col")


def lower_triangle(diag: bool = False) -> Column:
    return F.col("row") >= F.col("col") if diag else F.col("row") > F.col("col")


def trace(m: DataFrame) -> DataFrame:
    return m.agg(F.coalesce(F.sum(F.when(F.col("row") == F.col("col"), F.col("value"))), F.lit(0.0)).alias("trace"))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("row").agg(F.sum("value").alias("value"))


def col_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("col").agg(F.sum("value").alias("value"))


def margin_apply(m: DataFrame, axis: str, agg: Column) -> DataFrame:
    """An aggregate over each row or column."""
    return m.groupBy(axis).agg(agg.alias("value"))


def _dense(pdf: pd.DataFrame) -> np.ndarray:
    n = int(max(pdf["row"].max(), pdf["col"].max())) + 1
    out = np.zeros((n, n))
    out[pdf["row"].astype(int), pdf["col"].astype(int)] = pdf["value"]
    return out


def determinant(m: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Of small square matrices, one for each group: a matrix has to fit in a task, as its factors are dense."""
    keys = ", ".join(f"{k} {dict(m.dtypes)[k]}" for k in by)
    return m.groupBy(*by).applyInPandas(lambda key, p: pd.DataFrame([[*key, float(np.linalg.det(_dense(p)))]]), f"{keys}{', ' * bool(by)}determinant double")


def inverse(m: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Of small square matrices, one for each group; a singular one raises."""
    keys = ", ".join(f"{k} {dict(m.dtypes)[k]}" for k in by)

    def invert(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        inv = np.linalg.inv(_dense(p))
        row, col = np.indices(inv.shape)
        return pd.DataFrame({**{k: [v] * inv.size for k, v in zip(by, key)}, "row": row.ravel(), "col": col.ravel(), "value": inv.ravel()})

    return m.groupBy(*by).applyInPandas(invert, f"{keys}{', ' * bool(by)}{ENTRIES}")


def column_covariance(rows: DataFrame, columns: list[str], correlation: bool = False) -> DataFrame:
    """Covariances or correlations of all pairs of columns, from one pass."""
    f = F.corr if correlation else F.covar_samp
    cells = [F.struct(F.lit(i).cast("bigint").alias("row"), F.lit(j).cast("bigint").alias("col"), f(F.col(a).cast("double"), F.col(b).cast("double")).alias("value")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
