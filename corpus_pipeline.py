"""The corpus pipeline: stages applied to ``documents`` one after the other, each written as Parquet and read again.

Language ID drops documents whose language is uncertain; near-deduplication by SimHash, and by minima for pairs beyond its radius, counts
every link and keeps one document of each group;
decontamination drops documents that hold a benchmark item; secret scans mask what they find; packing returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from genoflux.llm import decontaminate, language_id, packing, secret_scan, simhash
from genoflux.llm.common import stash, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; a missing lang becomes the predicted one."""
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    names = tuple(unused(docs, x) for x in ("lang_pred", "lang_score", "lang_rejected"))
    told = language_id.classify(docs, model, names).where(~F.col(names[2]))
    return told.withColumn("lang", F.coalesce("lang", names[0])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash by covering masks, then minima for what differs in more bits, then counted shingles."""
    return simhash.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, whatever its parameters."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secret_scan.redact(docs, secret_scan.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of up to 2048."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near-dedup", near_dedup),
    ("decontamination", leaks),
    ("secrets", secrets),
    ("packing", packed),
]

#: Tokenizing can't be expressed in SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
