"""Operator 8: exact length histogram of a corpus in tokens, with suffix sums.

Documents are encoded once and aggregated by their number of tokens, so that everything after the scan works
on one row for each distinct length.  Suffix sums over the lengths give, for every context limit, the documents
that are at least as long, their tokens, and the tokens left after truncation to the limit.

Defined cases: a null or empty text has length 0; repeated rows count as often as they occur; an empty table gives
an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stash, table
from .tokens import encoder

#: Lengths that one window works on; sums of whole ranges are added afterwards.
RANGE = 512


def lengths(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """n_tokens of every row."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in enc.encode(b.column(0).to_pylist())], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(task, "n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length n_tokens: n_docs, total_tokens, and with the sums from the ends
    docs_at_most, docs_at_least, tokens_at_least, and truncated_tokens, the corpus's size at the context limit n_tokens."""
    # written out, as it is read twice below and must not be encoded twice
    h = stash(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn("total_tokens", F.col("n_tokens") * F.col("n_docs"))
    h = h.withColumn("part", F.floor(F.col("n_tokens") / RANGE))
    up, down = Window.orderBy("part"), Window.orderBy(F.desc("part"))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("total_tokens").alias("t"))
    parts = parts.select("part", (F.sum("d").over(up) - F.col("d")).alias("d_below"), (F.sum("t").over(up) - F.col("t")).alias("t_below"), (F.sum("d").over(down) - F.col("d")).alias("d_above"), (F.sum("t").over(down) - F.col("t")).alias("t_above"))
    up, down = Window.partitionBy("part").orderBy("n_tokens"), Window.partitionBy("part").orderBy(F.desc("n_tokens"))
    h = h.join(parts, "part")
    at_least, tokens = F.sum("n_docs").over(down) + F.col("d_above"), F.sum("total_tokens").over(down) + F.col("t_above")
    below = F.sum("total_tokens").over(up) + F.col("t_below") - F.col("total_tokens")
    return h.select("n_tokens", "n_docs", "total_tokens", (F.sum("n_docs").over(up) + F.col("d_below")).alias("docs_at_most"), at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"), (below + F.col("n_tokens") * at_least).alias("truncated_tokens"))


def totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For every context limit: documents, longer documents, tokens, and tokens after truncation to the limit."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("bigint"))
    row = lambda c: F.struct(F.lit(int(c)).cast("bigint").alias("context"), total(docs).alias("n_docs"), total(F.when(n > c, docs)).alias("n_longer"), total(n * docs).alias("tokens"), total(F.least(n, F.lit(c)) * docs).alias("truncated_tokens"))
    return hist.agg(F.array(*[row(c) for c in limits]).alias("rows")).select(F.inline("rows"))


def quantiles(hist: DataFrame, probabilities: list[float]) -> DataFrame:
    """The smallest length that at least that share of documents doesn't exceed, for each probability."""
    total = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    reached = lambda p: F.struct(F.lit(float(p)).alias("p"), F.min(F.when(F.col("docs_at_most") >= p * total, F.col("n_tokens"))).alias("n_tokens"))
    return hist.agg(F.array(*[reached(p) for p in probabilities]).alias("rows")).select(F.inline("rows"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(table(spark, sf_dir, "documents")))
