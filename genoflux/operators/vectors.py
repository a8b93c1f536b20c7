"""Vectors as tables: a value for each row and an explicit index column; order comes from the index only.

Ranks, orders, running sums and filters of a whole table work by ranges of its order: each range is settled for itself, and only
one row for each range (and group) meets in one place, to tell what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import INF, NAN, _c

#: Index values in one range of a running aggregate over a whole table.
RANGE = 1 << 16
#: Ranges of (0, 1) that weighted draws are settled in.
DRAW_RANGES = 1024


def _over(by: list[str], *order: Column | str):
    return Window.partitionBy(*by).orderBy(*order)


def before(df: DataFrame, by: list[str], order: list[Column | str], n: Column, name: str) -> DataFrame:
    """Adds the sum of n over the rows before each, of its group; neither a group nor the table has to fit in a task."""
    from ..sources.state import fresh

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are sampled, so they are written out before they are used twice
    d = fresh(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = d.groupBy("__part", *by).agg(F.sum(n).alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    sizes = sizes.select(F.col("__part").alias("__p"), *[F.col(x).alias(f"__by{i}") for i, x in enumerate(by)], ahead.alias("__ahead"))
    same = F.col("__part") == F.col("__p")
    for i, x in enumerate(by):
        same &= F.col(x).eqNullSafe(F.col(f"__by{i}"))
    within = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = d.withColumn("__own", F.sum(n).over(within) - n)
    return own.join(sizes, same).withColumn(name, F.col("__own") + F.col("__ahead")).select(*df.columns, name)


def rank(df: DataFrame, value: str, idx: str, ties: str = "average", by: list[str] = [], name: str = "rank") -> DataFrame:  # noqa: B006
    """Ranks from 1; ties: average, first, last, min or max."""
    if ties in ("first", "last"):
        return before(df, by, [F.col(value), F.col(idx) if ties == "first" else F.desc(idx)], F.lit(1), name).withColumn(name, F.col(name) + 1)
    peers = df.groupBy(*by, value).agg(F.count("*").alias("__peers"))
    low, n = F.col("__low") + 1, F.col("__peers")
    out = {"min": low, "max": low + n - 1, "average": low + (n - 1) / 2.0}[ties]
    keys = [*by, value]
    ranked = before(peers, by, [F.col(value)], F.col("__peers"), "__low").select(*[F.col(x).alias(f"__key{i}") for i, x in enumerate(keys)], out.alias(name))
    same = F.lit(True)
    for i, x in enumerate(keys):
        same &= F.col(x).eqNullSafe(F.col(f"__key{i}"))
    return df.join(ranked, same).select(*df.columns, name)


def order(df: DataFrame, value: str, idx: str, ascending: bool = True, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (place, idx): the index of the value at each place of the sorted vector, ties by index."""
    v = F.asc(value) if ascending else F.desc(value)
    rows = df.select(*dict.fromkeys([*by, idx, value]))
    return before(rows, by, [v, F.col(idx)], F.lit(1), "place").select(*by, idx, F.col("place").cast("bigint"))


def cum_sum(df: DataFrame, value: str, idx: str, by: list[str] = [], name: str = "cum_sum") -> DataFrame:  # noqa: B006
    if by:
        return df.withColumn(name, F.sum(value).over(_over(by, idx).rowsBetween(Window.unboundedPreceding, 0)))
    part = F.floor(F.col(idx) / RANGE)
    ahead = df.groupBy(part.alias("__part")).agg(F.sum(value).alias("__sum"))
    ahead = ahead.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__part", part).join(ahead, "__part").withColumn(name, own + F.col("__ahead")).drop("__part", "__ahead")


def cum_product(df: DataFrame, value: str, idx: str, by: list[str], name: str = "cum_product") -> DataFrame:
    """Running product within groups, with sign and zeros kept apart from the logarithm of the size."""
    w = _over(by, idx).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value).cast("double")
    zero = F.max((v == 0).cast("int")).over(w) == 1
    negative = F.sum((v < 0).cast("int")).over(w) % 2 == 1
    size = F.exp(F.sum(F.ln(F.when(v != 0, F.abs(v)))).over(w))
    return df.withColumn(name, F.when(zero, 0.0).when(negative, -size).otherwise(size))


def centered_filter(df: DataFrame, value: str, idx: str, weights: list[float], outside: bool | float = False, by: list[str] = [], name: str = "filtered") -> DataFrame:  # noqa: B006
    """Linear filter of odd length, centred.  outside: False gives NaN at the ends, True rescales, a number stands for missing values."""
    if len(weights) % 2 == 0:
        raise ValueError("a centred filter has an odd length")
    half, columns = len(weights) // 2, [*df.columns, name]
    if by:
        w = _over(by, idx)
    else:  # ranges of places, each with the half-width of rows on either side
        df = before(df, [], [F.col(idx)], F.lit(1), "__at")
        own = F.floor(F.col("__at") / RANGE)
        near = F.array_distinct(F.array(F.floor((F.col("__at") - half) / RANGE), own, F.floor((F.col("__at") + half) / RANGE)))
        df, w = df.withColumn("__own", own).withColumn("__cell", F.explode(near)), _over(["__cell"], "__at")
    at = lambda k: F.lag(F.col(value).cast("double"), half - k).over(w) if k <= half else F.lead(F.col(value).cast("double"), k - half).over(w)
    there = [(float(x), at(k)) for k, x in enumerate(weights)]
    fill = float(outside) if not isinstance(outside, bool) else 0.0
    total = sum((x * F.coalesce(v, F.lit(fill)) for x, v in there), F.lit(0.0))
    if outside is False:
        total = F.when(there[0][1].isNull() | there[-1][1].isNull(), NAN).otherwise(total)
    elif outside is True:
        seen = sum((F.when(v.isNotNull(), abs(x)).otherwise(0.0) for x, v in there), F.lit(0.0))
        total = total * sum(map(abs, weights)) / seen
    out = df.withColumn(name, total)
    return out if by else out.where(F.col("__cell") == F.col("__own")).select(*columns)


def tabulate(df: DataFrame, bin_column: str, max_bin: int | None = None) -> DataFrame:
    """Rows (bin, n) for every bin from 0 to max_bin, or the largest; values outside are left out."""
    spark = df.sparkSession
    counts = df.where(F.col(bin_column) >= 0).groupBy(F.col(bin_column).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    if max_bin is None:
        bins = counts.agg(F.max("bin").alias("top")).where(F.col("top").isNotNull()).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("bin"))
    else:
        bins = spark.range(max_bin + 1).select(F.col("id").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def unique(df: DataFrame, value: str, idx: str | None = None) -> DataFrame:
    """Distinct values; with an index also the first place of each."""
    return df.select(value).distinct() if idx is None else df.groupBy(value).agg(F.min(idx).alias(idx))


def match(x: DataFrame, table: DataFrame, value: str, idx: str, name: str = "place") -> DataFrame:
    """x with the first place of each value in the table, -1 if it isn't there; NaN matches NaN."""
    first = table.groupBy(value).agg(F.min(idx).alias(name))
    return x.join(first, value, "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("bigint"))


def which(df: DataFrame, test: Column, idx: str) -> DataFrame:
    return df.where(test).select(idx)


def reverse(df: DataFrame, idx: str) -> DataFrame:
    """The index counted from the end."""
    top = df.agg(F.max(idx).alias("__top"))
    return df.join(F.broadcast(top), F.lit(True)).withColumn(idx, F.col("__top") - F.col(idx)).drop("__top")  # one row


def rep(df: DataFrame, n: int, idx: str) -> DataFrame:
    """The whole vector n times, with a new index."""
    size = df.agg(F.count("*").alias("__size"))
    times = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.limit(0).withColumn("__k", F.lit(0))
    return times.join(F.broadcast(size), F.lit(True)).withColumn(idx, F.col("__k") * F.col("__size") + F.col(idx)).drop("__k", "__size")  # one row


def rep_each(df: DataFrame, n: Column | int, idx: str) -> DataFrame:
    """Each row n times; rows keep their index and get ``copy``."""
    return df.withColumn("copy", F.explode(F.transform(F.array_repeat(F.lit(0), _c(n).cast("int")), lambda _, i: i))).orderBy(idx, "copy")


def find_interval(x: DataFrame, value: str, breaks: DataFrame, bound: str, name: str = "interval") -> DataFrame:
    """x with the 0-based interval among any number of distinct breaks; -1 below the first.

    An as-of join: breaks and values are merged in ranges, whose bounds are approximate quantiles of the breaks, and only one
    row for each range meets in one place."""
    spark = x.sparkSession
    numbered = x.select("*", F.col(value).cast("double").alias("__v"))
    marks = breaks.select(F.col(bound).cast("double").alias("__v")).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = marks.approxQuantile("__v", [i / parts for i in range(1, parts)], 0.01)
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c <= F.col("__v")))
    row = F.struct(*numbered.columns).alias("__row")
    both = numbered.select("__v", F.lit(1).alias("__kind"), row).unionByName(marks.select("__v", F.lit(0).alias("__kind"), F.lit(None).cast(numbered.select(row).schema[0].dataType).alias("__row")))
    both = both.withColumn("__part", part)
    ahead = marks.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    every = spark.range(parts + 1).select(F.col("id").cast("int").alias("__part")).join(ahead, "__part", "left")
    every = every.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    own = F.sum(1 - F.col("__kind")).over(Window.partitionBy("__part").orderBy("__v", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.join(every, "__part").withColumn(name, (own + F.col("__ahead") - 1).cast("bigint"))
    return found.where(F.col("__kind") == 1).select("__row.*", name).drop("__v")


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has: one aggregate over both instead of two differences."""
    both = a.distinct().withColumn("__side", F.lit(1)).union(b.distinct().withColumn("__side", F.lit(2)))
    return both.groupBy(*a.columns).agg(F.sum("__side").alias("__sides")).where(F.col("__sides") < 3).drop("__sides")


def identical(a: DataFrame, b: DataFrame) -> bool:
    """Same columns, types and rows, repeats included."""
    if a.dtypes != b.dtypes:
        return False
    one = a.groupBy(*a.columns).agg(F.count("*").alias("__n")).withColumn("__side", F.lit(1))
    two = b.groupBy(*b.columns).agg(F.count("*").alias("__n")).withColumn("__side", F.lit(-1))
    return one.union(two).groupBy(*a.columns).agg(F.sum(F.col("__n") * F.col("__side")).alias("d")).where(F.col("d") != 0).isEmpty()


def sample(df: DataFrame, size: int, seed: int, key: list[str], replace: bool = False, weight: str | None = None) -> DataFrame:
    """size rows at random, by hash of (seed, key): weighted without replacement by exponential keys, with replacement by
    drawing from the cumulative weights."""
    from ..functions.distributions import uniform

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if not replace:
        keyed = df.withColumn("__key", F.when(w > 0, -F.ln(uniform(seed, *key)) / w).otherwise(INF))
        return keyed.where(F.col("__key") < INF).orderBy("__key", *key).limit(size).drop("__key")
    parts = df.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(4096))).withColumn("__w", w)
    sums = parts.groupBy("__part").agg(F.sum("__w").alias("__s"))
    sums = sums.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__lo"), F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))  # 4096 rows
    ends = parts.join(sums, "__part")
    upto = F.sum("__w").over(Window.partitionBy("__part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__lo")
    ends = ends.withColumn("__hi", upto / F.col("__all")).drop("__part", "__lo", "__all")
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), uniform(seed, "id").alias("__at"))
    row = F.struct(*df.columns)
    ends = ends.where(F.col("__w") > 0).select(F.col("__hi").alias("__at"), F.lit(None).cast("bigint").alias("draw"), row.alias("__row"))
    both = ends.unionByName(draws.withColumn("__row", F.lit(None).cast(ends.schema["__row"].dataType)))
    # a draw takes the first end above it: in its range of (0, 1), or else the first of the next range that has one
    both = both.withColumn("__cell", F.least(F.floor(F.col("__at") * DRAW_RANGES), F.lit(DRAW_RANGES - 1)).cast("int"))
    cells = df.sparkSession.range(DRAW_RANGES).select(F.col("id").cast("int").alias("__cell"))
    firsts = both.where(F.col("draw").isNull()).groupBy("__cell").agg(F.min(F.struct("__at", "__row")).alias("__first"))
    following = Window.orderBy("__cell").rowsBetween(1, Window.unboundedFollowing)
    later = cells.join(firsts, "__cell", "left").select("__cell", F.first("__first.__row", ignorenulls=True).over(following).alias("__later"))
    here = Window.partitionBy("__cell").orderBy("__at", F.col("draw").isNull()).rowsBetween(0, Window.unboundedFollowing)
    taken = both.withColumn("__row", F.first("__row", ignorenulls=True).over(here)).where(F.col("draw").isNotNull()).join(later, "__cell")
    return taken.select("draw", F.coalesce("__row", "__later").alias("__row")).select("draw", "__row.*")
