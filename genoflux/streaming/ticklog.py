"""Per-tick logs: named aggregates of each tick's rows, in batch or as a stream.

A log is a list of named column expressions.  ``rows`` gives a row for each tick that is due; ``start`` does the same for a
stream of rows with a tick, by a watermark-free count of complete ticks within each micro-batch, appended by foreachBatch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MISSING = "NA"


@dataclass
class TickLog:
    """Columns of a log, an interval in ticks, and the file format of its rows."""

    interval: int = 1
    precision: int = 6
    columns: list[tuple[str, Column]] = field(default_factory=list)

    def custom(self, name: str, aggregate: Column) -> "TickLog":
        self.columns.append((name, aggregate))
        return self

    def population_size(self, name: str = "num_individuals") -> "TickLog":
        return self.custom(name, F.count("*"))

    def sex_ratio(self, name: str = "sex_ratio") -> "TickLog":
        """Share of males."""
        return self.custom(name, F.avg((F.col("sex") == "M").cast("double")))

    def subpopulation_size(self, subpop: int) -> "TickLog":
        return self.custom(f"p{subpop}_num_individuals", F.count(F.when(F.col("subpop") == subpop, 1)))

    def subpopulation_sex_ratio(self, subpop: int) -> "TickLog":
        return self.custom(f"p{subpop}_sex_ratio", F.avg(F.when(F.col("subpop") == subpop, (F.col("sex") == "M").cast("double"))))

    def mean_sd(self, name: str, value: Column) -> "TickLog":
        return self.custom(f"{name}_mean", F.avg(value)).custom(f"{name}_sd", F.stddev_samp(value))

    def supplied(self, name: str, value=None) -> "TickLog":
        return self.custom(name, F.lit(value))

    def is_due(self, tick: Column) -> Column:
        return tick % self.interval == 0

    def rows(self, df: DataFrame, tick: str = "tick") -> DataFrame:
        """A row for each due tick of a table."""
        aggregates = [a.alias(n) for n, a in self.columns] or [F.count("*").alias("n")]
        return df.where(self.is_due(F.col(tick))).groupBy(tick).agg(*aggregates)

    def lines(self, rows: DataFrame, sep: str = ",") -> DataFrame:
        """Text of log rows; missing values are NA."""
        text = lambda c, kind: F.coalesce(F.format_string(f"%.{self.precision}g", F.col(c)) if kind == "double" else F.col(c).cast("string"), F.lit(MISSING))
        return rows.select(F.concat_ws(sep, *[text(c, k) for c, k in rows.dtypes]).alias("value"))

    def start(self, stream: DataFrame, path: str, checkpoint: str, tick: str = "tick") -> StreamingQuery:
        """Appends log rows of each micro-batch below path; the batch id makes a repeated batch overwrite itself."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.rows(batch, tick).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts by event time in tumbling or sliding windows; on a stream, late rows are waited for."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
