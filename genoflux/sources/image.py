"""Images as tables of pixels, read by Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (origin, row, col, r, g, b), channels from 0 to 255; grey images have equal ones.  The source keeps blue first."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    rows = i.select("origin", "width", F.col("nChannels").alias("n"), "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    line = rows.select("origin", "width", "n", "row", F.hex(F.substring("data", F.col("row") * F.col("width") * F.col("n") + 1, F.col("width") * F.col("n"))).alias("hex"))
    pixels = line.select("origin", "row", "n", "hex", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    channel = lambda k: F.conv(F.substring("hex", (F.col("col") * F.col("n") + F.least(F.lit(k), F.col("n") - 1)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return pixels.select("origin", "row", "col", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))
