"""Reading and changing what haplosomes carry; changes return new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_mutations(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame) -> DataFrame:
    """Rows (hap_id, mut_id, present) of asked haplosomes and mutations, which the caller bounds."""
    asked = haplosomes.select("hap_id").join(mutations.select("mut_id"), F.lit(True))
    return asked.join(carries.select("hap_id", "mut_id", F.lit(True).alias("present")), ["hap_id", "mut_id"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def contains_marker(carries: DataFrame, mutations: DataFrame, mut_type: int, position: int) -> DataFrame:
    """Haplosomes with a mutation of a type at a position."""
    m = mutations.where((F.col("mut_type") == mut_type) & (F.col("position") == position))
    return carries.join(m, "mut_id", "left_semi").select("hap_id").distinct()


def mutations_of_type(carries: DataFrame, mutations: DataFrame, mut_type: int) -> DataFrame:
    return carries.join(mutations.where(F.col("mut_type") == mut_type), "mut_id")


def count_of_type(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, mut_type: int, key: str = "hap_id") -> DataFrame:
    """Rows (key, n) for every haplosome, or individual with key ind_id."""
    return _per(carries, haplosomes, mutations, mut_type, key, F.count("*"), 0, "n")


def sum_of_type(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, mut_type: int, key: str = "hap_id") -> DataFrame:
    """Rows (key, total): summed effects of a type."""
    return _per(carries, haplosomes, mutations, mut_type, key, F.sum("s"), 0.0, "total")


def _per(carries, haplosomes, mutations, mut_type, key, agg, empty, name) -> DataFrame:
    held = mutations_of_type(carries, mutations, mut_type)
    if key != "hap_id":
        held = held.join(haplosomes.select("hap_id", key), "hap_id")
    found = held.groupBy(key).agg(agg.alias(name))
    return haplosomes.select(key).distinct().join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(empty)))


def positions_of_type(carries: DataFrame, mutations: DataFrame, mut_type: int) -> DataFrame:
    """Rows (hap_id, positions) in ascending order."""
    return mutations_of_type(carries, mutations, mut_type).groupBy("hap_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def unique_of_type(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, mut_type: int) -> DataFrame:
    """Distinct (ind_id, mut_id) of a type."""
    return mutations_of_type(carries, mutations, mut_type).join(haplosomes.select("hap_id", "ind_id"), "hap_id").select("ind_id", "mut_id").distinct()


def from_haplosomes(zygosity: DataFrame, ploidy: DataFrame, category: str) -> DataFrame:
    """Rows of zygosity in a category: unique, homozygous, heterozygous, hemizygous or all (repeated for each copy)."""
    j = zygosity.join(ploidy, "ind_id")
    if category == "all":
        return j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    test = {"unique": F.lit(True), "homozygous": F.col("copies") == 2, "heterozygous": (F.col("copies") == 1) & (F.col("ploidy") == 2), "hemizygous": (F.col("copies") == 1) & (F.col("ploidy") == 1)}[category]
    return j.where(test)


def stack(rows: DataFrame, policy: str = "s") -> DataFrame:
    """Which mutations of one stacking group stay at one position of a haplosome: all (s), the first (f) or the last (l) by age."""
    if policy == "s":
        return rows
    when = F.col("origin_tick").asc() if policy == "f" else F.col("origin_tick").desc()
    by = Window.partitionBy("hap_id", "position", "stack_group").orderBy(when, F.col("mut_id").asc() if policy == "f" else F.col("mut_id").desc())
    return rows.withColumn("__place", F.row_number().over(by)).where(F.col("__place") == 1).drop("__place")


def add_mutations(carries: DataFrame, added: DataFrame) -> DataFrame:
    """carries with more pairs (hap_id, mut_id); one that is there already stays single."""
    return carries.select("hap_id", "mut_id").unionByName(added.select("hap_id", "mut_id")).distinct()


def remove_mutations(carries: DataFrame, removed: DataFrame) -> DataFrame:
    """carries without pairs, or without mutations if removed has no hap_id."""
    return carries.join(removed, ["hap_id", "mut_id"] if "hap_id" in removed.columns else ["mut_id"], "left_anti")


def split_fixed(freq: DataFrame, mutations: DataFrame, tick: int) -> tuple[DataFrame, DataFrame]:
    """Mutations that still segregate, and substitutions: those that every haplosome carries."""
    fixed = freq.where(F.col("c") == F.col("n")).select("mut_id")
    return mutations.join(fixed, "mut_id", "left_anti"), mutations.join(fixed, "mut_id", "left_semi").withColumn("fixation_tick", F.lit(tick))


def derived_sequence(ancestral: DataFrame, carries: DataFrame, mutations: DataFrame, start: int, end: int) -> DataFrame:
    """Rows (hap_id, sequence) of A, C, G and T: the ancestral (position, base) with the nucleotides of mutations (mut_id, position, nucleotide).

    Only haplosomes with a mutation in the range have rows; the range is bounded by the caller, as a sequence is one string."""
    ref = ancestral.where(F.col("position").between(start, end)).agg(F.array_sort(F.collect_list(F.struct("position", "base"))).alias("ref"))
    alt = carries.join(mutations.where(F.col("position").between(start, end) & F.col("nucleotide").isNotNull()).select("mut_id", "position", "nucleotide"), "mut_id")
    base = F.element_at(F.array(*map(F.lit, "ACGT")), F.col("nucleotide").cast("int") + 1)
    own = alt.groupBy("hap_id").agg(F.map_from_entries(F.collect_list(F.struct("position", base.alias("base")))).alias("alt"))
    return own.join(F.broadcast(ref), F.lit(True)).select("hap_id", F.array_join(F.transform("ref", lambda r: F.coalesce(F.try_element_at(F.col("alt"), r["position"]), r["base"])), "").alias("sequence"))


def subset_individuals(individuals: DataFrame, exclude: list[int] | None = None, sex: str | None = None, tag: int | None = None, min_age: int | None = None, max_age: int | None = None, migrant: bool | None = None, **tags: bool) -> DataFrame:
    """Individuals that meet all conditions given; tags are tagL0 to tagL4."""
    tests: list[Column] = []
    if exclude:
        tests.append(~F.col("ind_id").isin(exclude))
    for name, value in (("sex", sex), ("tag", tag), ("migrant", migrant), *tags.items()):
        if value is not None:
            tests.append(F.col(name) == value)
    if min_age is not None:
        tests.append(F.col("age") >= min_age)
    if max_age is not None:
        tests.append(F.col("age") <= max_age)
    for t in tests:
        individuals = individuals.where(t)
    return individuals


def subset_mutations(mutations: DataFrame, exclude: int | None = None, **equal) -> DataFrame:
    """Mutations with given mut_type, position, nucleotide, tag, mut_id or chrom, without one."""
    for name, value in equal.items():
        mutations = mutations.where(F.col(name) == value)
    return mutations if exclude is None else mutations.where(F.col("mut_id") != exclude)
