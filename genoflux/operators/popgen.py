"""Population-genetic statistics over incidence: ``carries`` (hap_id, mut_id), one row for each mutation that a haplosome carries.

Every statistic begins with one aggregate of carries to a count for each mutation (and group), which Spark combines before the
shuffle; what follows works on one row for each mutation.  The number of haplosomes n is counted from the haplosome table,
not from carries, as a haplosome may carry nothing.  Mutations come from ``mutation`` (mut_id, position, mut_type, s, dominance).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import NAN, divide


def mutation_counts(carries: DataFrame, haplosomes: DataFrame | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (by, mut_id, c) of mutations that occur; haplosomes (hap_id, by) restrict and group."""
    if haplosomes is not None:
        carries = carries.join(haplosomes.select("hap_id", *by), "hap_id")
    return carries.groupBy(*by, "mut_id").agg(F.count("*").alias("c"))


def requested_counts(counts: DataFrame, mutations: DataFrame) -> DataFrame:
    """Counts of the mutations asked for, 0 where one doesn't occur."""
    return mutations.select("mut_id").join(counts, "mut_id", "left").select("mut_id", F.coalesce("c", F.lit(0)).cast("bigint").alias("c"))


def frequencies(counts: DataFrame, haplosomes: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds n, the haplosomes of the group, and p = c / n."""
    n = haplosomes.groupBy(*by).agg(F.count("*").alias("n"))
    return (counts.join(n, by) if by else counts.join(F.broadcast(n), F.lit(True))).withColumn("p", F.col("c") / F.col("n"))  # one row


def _harmonic(n: Column, power: int = 1) -> Column:
    """Sum of 1 / i, or 1 / i ** 2, for i below n: term by term up to a thousand, then by the asymptotic series, which is exact in doubles there."""
    few = F.sequence(F.lit(1).cast("bigint"), F.greatest(F.least(n, F.lit(1000)), F.lit(2)).cast("bigint") - 1)
    terms = F.aggregate(few, F.lit(0.0), lambda a, i: a + 1.0 / (i.cast("double") if power == 1 else i.cast("double") * i.cast("double")))
    x = F.greatest(n, F.lit(1)).cast("double")
    if power == 1:
        series = F.ln(x) + 0.5772156649015329 - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    else:
        series = math.pi**2 / 6 - 1 / x - 1 / (2 * x * x) - 1 / (6 * x * x * x)
    return F.when(n <= 1000, terms).otherwise(series)


def _segregating() -> Column:
    return (F.col("c") > 0) & (F.col("c") < F.col("n"))


def heterozygosity(freq: DataFrame, length: Column | float, by: list[str] = []) -> DataFrame:  # noqa: B006
    return freq.groupBy(*by).agg((F.coalesce(F.sum(2 * F.col("p") * (1 - F.col("p"))), F.lit(0.0)) / length).alias("heterozygosity"))


def diversity(freq: DataFrame, length: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """pi: mean pairwise differences for each site."""
    n = F.col("n").cast("double")
    few = F.raise_error(F.lit("diversity() needs two haplosomes or more")).cast("double")
    apart = F.when(F.col("n") < 2, few).when(_segregating(), F.col("c") * (F.col("n") - F.col("c")) / (n * (n - 1) / 2))
    return freq.groupBy(*by).agg((F.coalesce(F.sum(apart), F.lit(0.0)) / length).alias("pi"))


def _constants(freq: DataFrame, by: list[str]) -> DataFrame:
    """k segregating mutations, n, pi over all sites, and harmonic numbers of n - 1."""
    n = F.col("n").cast("double")
    agg = freq.groupBy(*by).agg(F.count(F.when(_segregating(), 1)).alias("k"), F.max("n").alias("n"), F.coalesce(F.sum(F.when(_segregating(), F.col("c") * (F.col("n") - F.col("c")) / (n * (n - 1) / 2))), F.lit(0.0)).alias("pairwise"))
    return agg.withColumn("a1", _harmonic(F.col("n"))).withColumn("a2", _harmonic(F.col("n"), 2))


def wattersons_theta(freq: DataFrame, length: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    return _constants(freq, by).select(*by, (F.col("k") / F.col("a1") / length).alias("theta"))


def tajimas_d(freq: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    d, n = _constants(freq, by), F.col("n").cast("double")
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    a1, a2, k = F.col("a1"), F.col("a2"), F.col("k").cast("double")
    e1 = (b1 - 1 / a1) / a1
    e2 = (b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    return d.select(*by, divide(F.col("pairwise") - k / a1, F.sqrt(e1 * k + e2 * k * (k - 1))).alias("tajimas_d"))


def site_frequency_spectrum(freq: DataFrame, bins: int | None = None, density: bool = False, fold: bool = False) -> DataFrame:
    """Rows (bin, n_mutations or density), every bin included.

    With bins, by frequency (absent mutations are left out, fixed ones are in the last); without, by count from 1 to n - 1.
    Folding adds the mirrored bin, and a central one to itself."""
    spark = freq.sparkSession
    if bins is not None:
        b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint")
        tally = freq.where(F.col("c") > 0).groupBy(b.alias("bin")).agg(F.count("*").alias("tally"))
        every, top = spark.range(bins).select(F.col("id").alias("bin")), F.lit(bins - 1).cast("bigint")
        every = every.withColumn("top", top)
    else:
        tally = freq.where(_segregating()).groupBy((F.col("c") - 1).alias("bin")).agg(F.count("*").alias("tally"))
        n = freq.agg(F.max("n").alias("n"))
        every = n.where(F.col("n") > 1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 2)).alias("bin"), (F.col("n") - 2).alias("top"))
    full = every.join(tally, "bin", "left").select("bin", "top", F.coalesce("tally", F.lit(0)).cast("bigint").alias("tally"))
    if fold:
        low = F.least("bin", F.col("top") - F.col("bin"))
        weight = F.when(F.col("bin") * 2 == F.col("top"), 2).otherwise(1)
        full = full.groupBy(low.alias("bin")).agg((F.sum(F.col("tally") * weight)).alias("tally"))
    if density:
        return full.join(F.broadcast(full.agg(F.sum("tally").alias("all"))), F.lit(True)).select("bin", divide(F.col("tally"), F.col("all")).alias("density"))  # one row
    return full.select("bin", F.col("tally").cast("bigint").alias("n_mutations"))


def two_groups(carries: DataFrame, haplosomes: DataFrame, group: str, first, second) -> DataFrame:
    """Rows (mut_id, c1, c2, n1, n2) of mutations in either of two groups of haplosomes, from one aggregate."""
    both = haplosomes.where(F.col(group).isin(first, second)).select("hap_id", (F.col(group) == first).alias("__one"))
    n = both.agg(F.count(F.when(F.col("__one"), 1)).alias("n1"), F.count(F.when(~F.col("__one"), 1)).alias("n2"))
    c = carries.join(both, "hap_id").groupBy("mut_id").agg(F.count(F.when(F.col("__one"), 1)).alias("c1"), F.count(F.when(~F.col("__one"), 1)).alias("c2"))
    return c.join(F.broadcast(n), F.lit(True))  # one row


def fst(two: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """1 - mean(Hs) / mean(Ht) over mutations; NaN if there is none."""
    p1, p2 = F.col("c1") / F.col("n1"), F.col("c2") / F.col("n2")
    mean = (p1 + p2) / 2
    return two.groupBy(*by).agg((1 - divide(F.avg(p1 * (1 - p1) + p2 * (1 - p2)), F.avg(2 * mean * (1 - mean)))).alias("x")).select(*by, F.coalesce("x", F.lit(NAN)).alias("fst"))


def dxy(two: DataFrame, length: float | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean differences between haplosomes of two groups, of mutations that segregate in both together."""
    c1, c2, n1, n2 = (F.col(x).cast("double") for x in ("c1", "c2", "n1", "n2"))
    apart = F.when((c1 + c2 > 0) & (c1 + c2 < n1 + n2), (c1 * (n2 - c2) + (n1 - c1) * c2) / (n1 * n2))
    return two.groupBy(*by).agg((F.coalesce(F.sum(apart), F.lit(0.0)) / (length or 1.0)).alias("dxy"))


def linkage(carries: DataFrame, n: int, mut_id: int) -> DataFrame:
    """Rows (mut_id, d, r_squared) of every mutation against one: d = p12 - p1 p2."""
    holders = carries.where(F.col("mut_id") == mut_id).select("hap_id", F.lit(1).alias("__with"))
    c = carries.join(holders, "hap_id", "left").groupBy("mut_id").agg(F.count("*").alias("c2"), F.count("__with").alias("c12"))
    c1 = holders.agg(F.count("*").alias("c1"))
    j = c.join(F.broadcast(c1), F.lit(True))  # one row
    p1, p2, p12 = (F.col(x) / n for x in ("c1", "c2", "c12"))
    d = p12 - p1 * p2
    return j.select("mut_id", F.when(F.col("c1") == 0, 0.0).otherwise(d).alias("d"), divide(d * d, p1 * (1 - p1) * p2 * (1 - p2)).alias("r_squared"))


def additive_variance(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, mut_type: int) -> DataFrame:
    """Sample variance over individuals of their summed effects of one mutation type."""
    m = mutations.where(F.col("mut_type") == mut_type).select("mut_id", "s")
    sums = carries.join(m, "mut_id").join(haplosomes.select("hap_id", "ind_id"), "hap_id").groupBy("ind_id").agg(F.sum("s").alias("s"))
    every = haplosomes.select("ind_id").distinct().join(sums, "ind_id", "left").select(F.coalesce("s", F.lit(0.0)).alias("s"))
    few = F.raise_error(F.lit("additive_variance() needs two individuals or more")).cast("double")
    return every.agg(F.when(F.count("*") < 2, few).otherwise(F.var_samp("s")).alias("va"))


def inbreeding_load(freq: DataFrame, mutations: DataFrame) -> DataFrame:
    """sum(q s) - sum(q^2 s) - 2 sum(q (1 - q) s h) over deleterious mutations, s up to 1."""
    q, s, h = F.col("p"), F.least(-F.col("s"), F.lit(1.0)), F.col("dominance")
    j = freq.join(mutations.where(F.col("s") < 0).select("mut_id", "s", "dominance"), "mut_id")
    return j.agg(F.coalesce(F.sum(q * s) - F.sum(q * q * s) - 2 * F.sum(q * (1 - q) * s * h), F.lit(0.0)).alias("inbreeding_load"))


def pair_heterozygosity(carries: DataFrame, pairs: DataFrame, length: float, mutations: DataFrame | None = None, infinite_sites: bool = True, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows (hap_a, hap_b, heterozygosity) of pairs: mutations that only one of both carries, over the length.

    Without infinite sites their different positions count.  With start and end only what lies there, over its own length; either
    needs mutations (mut_id, position)."""
    if start is not None and end is not None:
        mutations, length = within(mutations, start, end), float(end - start + 1)
        carries = carries.join(mutations.select("mut_id"), "mut_id", "left_semi")
    sides = pairs.select("hap_a", "hap_b", F.explode(F.array("hap_a", "hap_b")).alias("hap_id"))
    own = sides.join(carries, "hap_id").groupBy("hap_a", "hap_b", "mut_id").agg(F.count("*").alias("k")).where(F.col("k") == 1)
    if not infinite_sites:
        own = own.join(mutations.select("mut_id", "position"), "mut_id").select("hap_a", "hap_b", "position").distinct()
    apart = own.groupBy("hap_a", "hap_b").agg(F.count("*").alias("apart"))
    return pairs.join(apart, ["hap_a", "hap_b"], "left").select("hap_a", "hap_b", (F.coalesce("apart", F.lit(0)) / length).alias("heterozygosity"))


def zygosity(carries: DataFrame, haplosomes: DataFrame) -> DataFrame:
    """Rows (ind_id, mut_id, copies) of mutations that individuals carry."""
    return carries.join(haplosomes.select("hap_id", "ind_id"), "hap_id").groupBy("ind_id", "mut_id").agg(F.count("*").alias("copies"))


def zygosity_code(copies: Column, ploidy: Column, homozygous=2, heterozygous=1, hemizygous=1, haploid=1) -> Column:
    """What an individual is called for a mutation, 0 without it."""
    return F.when(copies == 0, 0).when(copies == 2, homozygous).when(ploidy == 2, heterozygous).when(ploidy == 1, hemizygous).otherwise(haploid)


def runs_of_homozygosity(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, last_position: int | DataFrame, minimum: int = 1_000_000) -> DataFrame:
    """Rows (ind_id, f_roh) of individuals with two haplosomes: the share of their chromosomes in long runs between heterozygous positions.

    last_position is that of the only chromosome, or a table (chrom, last_position); then haplosomes and mutations have chrom, and
    only chromosomes of which an individual has two haplosomes count."""
    if isinstance(last_position, DataFrame):
        ends = last_position.select("chrom", F.col("last_position").cast("bigint").alias("last_position"))
    else:
        ends = haplosomes.sparkSession.range(1).select(F.lit("").alias("chrom"), F.lit(int(last_position)).cast("bigint").alias("last_position"))
        haplosomes, mutations = haplosomes.withColumn("chrom", F.lit("")), mutations.withColumn("chrom", F.lit(""))
    key = ["ind_id", "chrom"]
    het = zygosity(carries, haplosomes).where(F.col("copies") == 1).join(mutations.select("mut_id", "chrom", "position"), "mut_id").select(*key, "position").distinct()
    whole = haplosomes.groupBy(*key).agg(F.count("*").alias("k")).where(F.col("k") == 2).select(*key).join(ends, "chrom")
    marks = het.join(whole, key, "left_semi").unionByName(whole.select(*key, (F.col("last_position") + 1).alias("position")))
    before = F.lag("position", 1, -1).over(Window.partitionBy(*key).orderBy("position"))
    runs = marks.select("ind_id", (F.col("position") - before - 1).alias("run")).groupBy("ind_id").agg(F.coalesce(F.sum(F.when(F.col("run") >= minimum, F.col("run"))), F.lit(0)).alias("long"))
    total = whole.groupBy("ind_id").agg(F.sum(F.col("last_position") + 1).cast("double").alias("total"))
    return runs.join(total, "ind_id").select("ind_id", (F.col("long") / F.col("total")).alias("f_roh"))


def mean_f_roh(roh: DataFrame) -> DataFrame:
    return roh.agg(F.coalesce(F.avg("f_roh"), F.lit(NAN)).alias("mean_f_roh"))


def windows(freq: DataFrame, mutations: DataFrame, width: int) -> DataFrame:
    """Adds window, so that any statistic takes by=["window"] and gives all windows at once."""
    return freq.join(mutations.select("mut_id", F.expr(f"position div {int(width)}").alias("window")), "mut_id")


def within(mutations: DataFrame, start: int, end: int) -> DataFrame:
    return mutations.where(F.col("position").between(start, end))


def fitness(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame) -> DataFrame:
    """Rows (ind_id, fitness): the product over an individual's mutations of 1 + s, or 1 + h s for one copy of two, none below 0."""
    ploidy = haplosomes.groupBy("ind_id").agg(F.count("*").alias("ploidy"))
    own = zygosity(carries, haplosomes).join(mutations.select("mut_id", "s", "dominance"), "mut_id").join(ploidy, "ind_id")
    effect = F.greatest(F.lit(0.0), 1 + F.when((F.col("copies") == 1) & (F.col("ploidy") == 2), F.col("dominance") * F.col("s")).otherwise(F.col("s")))
    product = own.groupBy("ind_id").agg(F.product(effect).alias("fitness"))
    return ploidy.select("ind_id").join(product, "ind_id", "left").select("ind_id", F.coalesce("fitness", F.lit(1.0)).alias("fitness"))
