"""The ms format: segregating sites, their positions in [0, 1), and a 0/1 string for each haplosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import with_index


def read_ms(spark: SparkSession, path: str, length: int) -> tuple[DataFrame, DataFrame]:
    """mutation (replicate, site, position) and carries (replicate, haplosome, site).

    A replicate, which starts with "//", is one record of Spark's reader; files of many replicates are read in splits."""
    blocks = spark.read.option("lineSep", "//").text(path).where(F.col("value").contains("segsites:"))
    r = blocks.select(F.monotonically_increasing_id().alias("replicate"), F.split("value", "\n").alias("lines"))
    at = F.split(F.trim(F.regexp_replace(F.filter("lines", lambda x: F.startswith(x, F.lit("positions:")))[0], "positions:", "")), r"\s+")
    mutations = r.where(F.exists("lines", lambda x: F.startswith(x, F.lit("positions:")))).select("replicate", F.posexplode(at).alias("site", "p")).select("replicate", "site", F.least(F.round(F.col("p").cast("double") * (length - 1)), F.lit(length - 1)).cast("bigint").alias("position"))
    haps = r.select("replicate", F.posexplode(F.filter("lines", lambda x: x.rlike("^[01]+\\s*$"))).alias("haplosome", "bits"))
    carries = haps.select("replicate", "haplosome", F.posexplode(F.split(F.trim("bits"), "")).alias("site", "bit")).where(F.col("bit") == "1").drop("bit")
    return mutations, carries


def ms_lines(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, length: int) -> DataFrame:
    """Rows (place, value): a line with the positions, then one for each haplosome; sites are those that a sample carries."""
    held = carries.join(haplosomes.select("hap_id"), "hap_id", "left_semi")
    sites = held.select("mut_id").distinct().join(mutations.select("mut_id", "position"), "mut_id").agg(F.array_sort(F.collect_list(F.struct("position", "mut_id"))).alias("sites"))
    own = haplosomes.select("hap_id").join(held.groupBy("hap_id").agg(F.collect_set("mut_id").alias("held")), "hap_id", "left")
    bits = F.array_join(F.transform("sites", lambda s: F.when(F.coalesce(F.array_contains("held", s["mut_id"]), F.lit(False)), "1").otherwise("0")), "")
    body = own.join(F.broadcast(sites), F.lit(True)).select("hap_id", bits.alias("value"))  # one row, as long as any line of the file
    body = with_index(body, "hap_id", idx="place").select((F.col("place") + 3).cast("int").alias("place"), "value")
    head = sites.select(F.inline(F.array(F.struct(F.lit(0).alias("place"), F.lit("//").alias("value")), F.struct(F.lit(1).alias("place"), F.concat(F.lit("segsites: "), F.size("sites").cast("string")).alias("value")), F.struct(F.lit(2).alias("place"), F.concat(F.lit("positions: "), F.array_join(F.transform("sites", lambda s: F.format_number(s["position"] / F.lit(float(length - 1)), 7)), " ")).alias("value")))))
    return head.unionByName(body)

