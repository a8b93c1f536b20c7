"""Chromosomes: interval maps (start, end, rate), genomic elements, effects of new mutations, and breakpoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as draw
from ..sources.state import fresh
from .vectors import before

#: Chromosome types by their fixed codes: autosomes, sex chromosomes and haploid ones.
CHROMOSOME_TYPES = ("A", "H", "X", "Y", "Z", "W", "HF", "FL", "HM", "ML", "H-", "-Y")
#: Positions in one bin of an interval join.
BIN = 1 << 16
#: Intervals of a map that one task takes; a map of no more is summed in one place, and broadcast.
TASK_INTERVALS = 1 << 16
#: Parts of (0, 1) that an interval is dealt to in one array.
DEALT = 1 << 12
#: What lies before a row; a window of ranges has few rows, as each stands for many intervals.
_BEFORE = (Window.unboundedPreceding, -1)


def from_starts(rows: DataFrame, last_position: int, scale: float = 1.0, one_based: bool = False) -> DataFrame:
    """Intervals (start, end, rate) of rows (start, rate): each ends where the next begins."""
    at = (F.col("start") - int(one_based)).cast("bigint")
    d = rows.select(at.alias("start"), (F.col("rate").cast("double") * scale).alias("rate"))
    return d.select("start", (F.lead("start", 1, last_position + 1).over(Window.orderBy("start")) - 1).alias("end"), "rate")


def _ranges(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows, of which there are n, with __range, which ascends with order: one range, or some for as many tasks."""
    if n <= TASK_INTERVALS:
        return rows.withColumn("__range", F.lit(0))
    # ranges are sampled, so they are written out before they are used twice
    return fresh(rows.repartitionByRange(-(-n // TASK_INTERVALS), order).withColumn("__range", F.spark_partition_id()), "intervals")


def from_ends(rows: DataFrame) -> DataFrame:
    """Intervals of rows (end, rate): each starts after the one before, which for the first of a range ends the ranges before it."""
    d = _ranges(rows.select(F.col("end").cast("bigint").alias("end"), F.col("rate").cast("double").alias("rate")), "end", rows.count())
    tops = d.groupBy("__range").agg(F.max("end").alias("__top"))
    tops = tops.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(*_BEFORE)).alias("__ahead"))
    own = d.withColumn("__own", F.lag("end").over(Window.partitionBy("__range").orderBy("end")))
    return own.join(F.broadcast(tops), "__range").select((F.coalesce("__own", "__ahead", F.lit(-1)) + 1).cast("bigint").alias("start"), "end", "rate")


def at_positions(points: DataFrame, intervals: DataFrame, position: str = "position", how: str = "left", width: int = BIN) -> DataFrame:
    """points with the interval that holds them, by bins: an interval is in every bin that it touches, a point in one."""
    span = intervals.withColumn("__bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))
    p = points.withColumn("__bin", F.expr(f"{position} div {width}"))
    on = [p["__bin"] == span["__bin"], p[position] >= span["start"], p[position] <= span["end"]]
    return p.join(span, on, how).drop("__bin")


def overall_rate(intervals: DataFrame) -> DataFrame:
    """Expected events on the whole map."""
    return intervals.agg(F.sum((F.col("end") - F.col("start") + 1) * F.col("rate")).alias("rate"))


def multiply_maps(rates: DataFrame, factors: DataFrame) -> DataFrame:
    """Rates times the multipliers of a second map (start, end, multiplier): overlapping parts of both."""
    m = factors.select(F.col("start").alias("ms"), F.col("end").alias("me"), "multiplier")
    bins = lambda df, a, z: df.withColumn("__bin", F.explode(F.sequence(F.expr(f"{a} div {BIN}"), F.expr(f"{z} div {BIN}"))))
    j = bins(rates, "start", "end").join(bins(m, "ms", "me"), "__bin").where((F.col("start") <= F.col("me")) & (F.col("ms") <= F.col("end")))
    return j.select(F.greatest("start", "ms").alias("start"), F.least("end", "me").alias("end"), (F.col("rate") * F.col("multiplier")).alias("rate")).distinct()


def cumulative(intervals: DataFrame) -> DataFrame:
    """Adds lo and hi, the shares of the map's total rate before and up to each interval; an interval's lo is the hi of the one before, to the bit."""
    return _shares(intervals, _positive(intervals))


def _positive(intervals: DataFrame) -> int:
    return intervals.where(F.col("rate") > 0).count()


def _shares(intervals: DataFrame, n: int) -> DataFrame:
    """The cumulative map of intervals, n of which have a rate."""
    d = intervals.where(F.col("rate") > 0).withColumn("__w", (F.col("end") - F.col("start") + 1) * F.col("rate")).where(F.col("__w") > 0)
    # sums of floats depend on where they are cut, so ranges here are places of the map, and not samples
    d = d.withColumn("__range", F.lit(0)) if n <= TASK_INTERVALS else before(d, [], [F.col("start")], F.lit(1), "__at").withColumn("__range", F.expr(f"__at div {TASK_INTERVALS}")).drop("__at")
    w = Window.partitionBy("__range").orderBy("start")
    less, upto = (F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, x)) for x in (-1, 0))
    d = d.withColumns({"__before": F.coalesce(less, F.lit(0.0)), "__upto": upto})
    # the last running sum, and not another sum of the range, so that the next range begins where this one ends
    sums = d.groupBy("__range").agg(F.max("__upto").alias("__sum"))
    ahead = F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(*_BEFORE)), F.lit(0.0))
    sums = sums.select("__range", ahead.alias("__ahead"), (ahead + F.col("__sum")).alias("__end"))
    sums = sums.select("__range", "__ahead", F.max("__end").over(Window.partitionBy()).alias("__all"))
    share = lambda x: (F.col("__ahead") + F.col(x)) / F.col("__all")
    return d.join(F.broadcast(sums), "__range").withColumns({"lo": share("__before"), "hi": share("__upto")}).drop("__range", "__w", "__before", "__upto", "__ahead", "__all")


def _part(share: Column, parts: int) -> Column:
    return F.least(F.floor(share * parts), F.lit(parts - 1)).cast("bigint")


def _dealt(shares: DataFrame, parts: int) -> DataFrame:
    """A cumulative map's intervals, in each __part of (0, 1) that they touch: as many rows as intervals and parts together, at most.

    An interval with most of the rates is in most of the parts, so it is dealt to them by arrays of a bounded length."""
    c = shares.select("start", "end", "lo", "hi", _part(F.col("lo"), parts).alias("__from"), _part(F.col("hi"), parts).alias("__to"))
    c = c.withColumn("__first", F.explode(F.sequence(F.col("__from") - F.col("__from") % DEALT, F.col("__to"), F.lit(DEALT).cast("bigint"))))
    own = F.sequence(F.greatest("__from", "__first"), F.least("__to", F.col("__first") + (DEALT - 1)))
    return c.withColumn("__part", F.explode(own)).drop("__from", "__to", "__first")


def draw_positions(events: DataFrame, intervals: DataFrame, seed: int, key: list[str], parts: int | None = None) -> DataFrame:
    """events with a position each, by the rates: the drawn share is looked up in the cumulative map, by equal parts of (0, 1).

    There are as many parts as intervals, so that an event meets two intervals on average, wherever the rates are large."""
    n = _positive(intervals)
    parts = parts or max(n, 1)
    c = _dealt(_shares(intervals, n), parts)
    u = F.least(draw.uniform(seed, *key, stream=3), F.lit(1 - 2.0**-53))  # the largest of these floats is rounded to 1
    e = events.withColumn("__u", u).withColumn("__part", _part(F.col("__u"), parts))
    if n + parts <= 2 * TASK_INTERVALS:
        j = e.join(F.broadcast(c), "__part")
    else:
        tasks = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_INTERVALS))
        j = e.repartition(tasks, "__part").join(c.repartition(tasks, "__part").hint("merge"), "__part")
    j = j.where((F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi")))
    within = (F.col("__u") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    at = F.least(F.col("start") + F.floor(within * (F.col("end") - F.col("start") + 1)), F.col("end"))
    return j.withColumn("position", at.cast("bigint")).select(*events.columns, "position")


def breakpoints(gametes: DataFrame, intervals: DataFrame, expected: float, seed: int, key: str) -> DataFrame:
    """Rows (key, position) of sorted, distinct crossovers: a Poisson number for each gamete, placed by the recombination map."""
    n = draw.rpois(seed, key, lam=F.lit(float(expected)))
    # a table of few files is few tasks, and a gamete's draws are far more work than moving its key
    drawn = gametes.select(key).repartition(key).select(key, n.alias("n"))
    # a gamete without crossovers has a null here; a condition of its own would be moved to before the spread, and draw twice
    events = drawn.select(key, F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("n")))).alias("k"))
    return draw_positions(events, intervals, seed, [key, "k"]).select(key, "position").distinct()


def effect(kind: str, seed: int, *key, parameters: tuple[float, ...] = ()) -> Column:
    """A new mutation's selection coefficient: f(ixed), g(amma: mean, shape), e(xponential), n(ormal), w(eibull), p (Laplace)."""
    p = [float(x) for x in parameters]
    return {
        "f": lambda: F.lit(p[0]),
        "g": lambda: draw.rgamma(seed, *key, mean=F.lit(p[0]), shape=F.lit(p[1])),
        "e": lambda: draw.rexp(seed, *key, mu=p[0]),
        "n": lambda: draw.rnorm(seed, *key, mean=p[0], sd=p[1]),
        "w": lambda: draw.rweibull(seed, *key, scale=p[0], shape=p[1]),
        "p": lambda: p[0] + draw.rlaplace(seed, *key, b=p[1]),
    }[kind]()


def draw_types(mutations: DataFrame, mix: list[tuple[int, float]], seed: int, key: list[str]) -> DataFrame:
    """Adds mut_type, by the fractions of a genomic element type."""
    total = math.fsum(f for _, f in mix)
    u, upto, out = draw.uniform(seed, *key, stream=5), 0.0, None
    for kind, f in mix:
        upto += f / total
        out = F.when(u < upto, kind) if out is None else out.when(u < upto, kind)
    return mutations.withColumn("mut_type", out.otherwise(mix[-1][0]))


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of asked ids; one that isn't there raises when it is read."""
    j = ids.join(table.withColumn("__there", F.lit(True)), key, "left")
    return j.where(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit(f"no row with {key} "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__there")
