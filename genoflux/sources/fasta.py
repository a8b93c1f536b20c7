"""FASTA sequences as tables (name, position, base)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A row for each position, from 0; records are split by Spark's reader at their ">", lines are joined within a record."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    named = records.select(F.regexp_extract("value", r"^\s*(\S*)", 1).alias("name"), F.upper(body).alias("sequence"))
    return named.select("name", F.posexplode(F.filter(F.split("sequence", ""), lambda b: b != "")).alias("position", "base"))


def fasta_lines(sequences: DataFrame, width: int = 70) -> DataFrame:
    """Text of sequences (name, sequence), a row for each record."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("value"))
