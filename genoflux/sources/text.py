"""Lines, CSV and rate maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column type codes.
TYPE_CODES = {"l": "boolean", "i": "bigint", "f": "double", "s": "string"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_lines(lines: DataFrame, path: str, append: bool = False, compress: bool = False) -> None:
    """A table of one string column, as text files below path."""
    lines.write.mode("append" if append else "errorifexists").option("compression", "gzip" if compress else "none").text(path)


def read_csv(spark: SparkSession, path: str, header: bool = True, types: str | None = None, sep: str = ",", quote: str = '"', decimal: str = ".", comment: str = "") -> DataFrame:
    """A table of a text file with separators; sep "" is any white space.

    types: a code for each column (l, i, f, s, ? to guess, _ to leave out); without it all are guessed, in the order logical, integer, float, string."""
    if sep == "":
        # as a file of one column, so that Spark takes each file's first line for its header
        lines = spark.read.csv(path, header=header, sep="\x01", quote="", escape="", comment=comment or None)
        names = lines.columns[0].split() if header else None
        value = F.split(lines[lines.columns[0]], "\\Q" + comment + "\\E", 2)[0] if comment else lines[lines.columns[0]]
        fields = lines.select(F.trim(value).alias("value")).where(F.col("value") != "").select(F.split("value", "\\s+").alias("f"))
        if names is None:
            first = fields.first()
            names = [f"X{i + 1}" for i in range(len(first["f"]) if first else 0)]
        df = fields.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    else:
        df = spark.read.csv(path, header=header, sep=sep, quote=quote, comment=comment or None)
        if not header:
            df = df.toDF(*[f"X{i + 1}" for i in range(len(df.columns))])
    if decimal != ".":
        df = df.select(*[F.when(F.col(c).rlike(rf"^[-+]?[0-9]*\{decimal}[0-9]+([eE][-+]?[0-9]+)?$"), F.translate(c, decimal, ".")).otherwise(F.col(c)).alias(c) for c in df.columns])
    codes = types or "?" * len(df.columns)
    unknown = [c for c, t in zip(df.columns, codes) if t == "?"]
    guessed = _guess(df, unknown) if unknown else {}
    return df.select(*[F.col(c).cast(guessed.get(c) or TYPE_CODES[t]).alias(c) for c, t in zip(df.columns, codes) if t != "_"])


def _guess(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Types from one pass over all rows."""
    patterns = {"boolean": r"^(T|F|true|false|TRUE|FALSE)$", "bigint": r"^[-+]?[0-9]{1,18}$", "double": r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$|^([-+]?INF|NAN|NaN|-?Infinity)$"}
    seen = df.agg(*[F.coalesce(F.bool_and(F.col(c).rlike(p)), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, p in patterns.items()]).first()
    return {c: next((k for k in patterns if seen[f"{i}_{k}"]), "string") for i, c in enumerate(columns)}


def read_rate_map(spark: SparkSession, path: str, last_position: int, scale: float = 1e-8, sep: str = "\t", one_based: bool = True) -> DataFrame:
    """Intervals (start, end, rate) of a file of (start, rate) rows."""
    from ..operators.genome import from_starts

    return from_starts(spark.read.csv(path, sep=sep, schema="start bigint, rate double", comment="#"), last_position, scale, one_based)
