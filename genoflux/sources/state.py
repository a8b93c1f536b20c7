"""Saved state: every table of a model as Parquet below one path, and the native text of haplosomes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_state(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def mutation_lines(counts: DataFrame, mutations: DataFrame) -> DataFrame:
    """Rows (mut_id, value): id, type, position, s, dominance and prevalence, as text."""
    j = mutations.join(counts, "mut_id")
    return j.select("mut_id", F.concat_ws(" ", F.col("mut_id").cast("string"), F.concat(F.lit("m"), F.col("mut_type").cast("string")), F.col("position").cast("string"), F.col("s").cast("string"), F.col("dominance").cast("string"), F.col("c").cast("string")).alias("value"))


def haplosome_lines(carries: DataFrame, haplosomes: DataFrame) -> DataFrame:
    """Rows (hap_id, value): a haplosome and the ids of its mutations in ascending order."""
    own = carries.groupBy("hap_id").agg(F.array_sort(F.collect_list("mut_id")).alias("held"))
    ids = F.transform(F.coalesce("held", F.array().cast("array<bigint>")), lambda m: m.cast("string"))
    return haplosomes.select("hap_id").join(own, "hap_id", "left").select("hap_id", F.concat_ws(" ", F.concat(F.lit("h"), F.col("hap_id").cast("string")), F.concat_ws(" ", ids)).alias("value"))


def fixed_lines(substitutions: DataFrame) -> DataFrame:
    return substitutions.select("mut_id", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("mut_id", "position", "s", "fixation_tick")]).alias("value"))


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which every executor sees; a local folder only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder in spark.checkpoint.dir and read again."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
