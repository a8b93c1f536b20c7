"""Declarations of a model as tables: chromosomes, genomic elements, mutation types, interactions and rate maps.

Each function checks what it is given and returns a small DataFrame of the logical schema; simulations and interval joins take them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.genome import CHROMOSOME_TYPES

#: Effects of new mutations by code, with their number of parameters.
EFFECTS = {"f": 1, "g": 2, "e": 1, "n": 2, "w": 2, "p": 2}
#: Kernels by code, with their number of parameters after the maximum distance.
KERNELS = {"f": 1, "l": 1, "e": 2, "n": 2, "c": 2, "t": 3}
STACK_POLICIES = ("s", "f", "l")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def chromosomes(spark: SparkSession, rows: list[tuple[int, str, int, str]]) -> DataFrame:
    """(chrom, type, length, symbol)."""
    for _, kind, length, _ in rows:
        _check(kind in CHROMOSOME_TYPES, f"no chromosome type {kind}")
        _check(length > 0, "a chromosome has a length")
    _check(len({r[0] for r in rows}) == len(rows) == len({r[3] for r in rows}), "chromosome ids and symbols differ")
    return spark.createDataFrame(rows, "chrom int, type string, length bigint, symbol string")


def mutation_types(spark: SparkSession, rows: list[tuple[int, float, str, list[float]]], policy: str = "s", convert: bool = True) -> DataFrame:
    """(mut_type, dominance, effect, parameters)."""
    _check(policy in STACK_POLICIES, f"no stacking policy {policy}")
    for _, _, effect, parameters in rows:
        _check(len(parameters) == EFFECTS.get(effect, -1), f"effect {effect} doesn't take {len(parameters)} parameters")
    d = spark.createDataFrame(rows, "mut_type int, dominance double, effect string, parameters array<double>")
    return d.withColumns({"stack_policy": F.lit(policy), "stack_group": F.col("mut_type"), "convert": F.lit(convert)})


def genomic_elements(spark: SparkSession, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    """(chrom, start, end, element_type); elements of a chromosome don't overlap."""
    last: dict[int, int] = {}
    for chrom, start, end, _ in sorted(rows):
        _check(0 <= start <= end, "an element starts before it ends")
        _check(start > last.get(chrom, -1), "elements don't overlap")
        last[chrom] = end
    return spark.createDataFrame(rows, "chrom int, start bigint, end bigint, element_type int")


def element_mix(spark: SparkSession, rows: list[tuple[int, int, float]]) -> DataFrame:
    """(element_type, mut_type, fraction), fractions made to sum to 1 in each type."""
    total: dict[int, float] = {}
    for kind, _, fraction in rows:
        _check(fraction >= 0, "fractions aren't negative")
        total[kind] = total.get(kind, 0.0) + fraction
    return spark.createDataFrame([(k, m, f / total[k] if total[k] else 0.0) for k, m, f in rows], "element_type int, mut_type int, fraction double")


def rate_map(spark: SparkSession, ends: list[int], rates: list[float], recombination: bool = False) -> DataFrame:
    """Intervals (start, end, rate) from ascending ends; recombination rates lie between 0 and a half."""
    _check(len(ends) == len(rates) > 0 and all(a < b for a, b in zip(ends, ends[1:])), "ends ascend, with a rate each")
    _check(all(0 <= r and (r <= 0.5 or not recombination) for r in rates), "a rate is out of range")
    return spark.createDataFrame(list(zip([0, *[e + 1 for e in ends[:-1]]], ends, map(float, rates))), "start bigint, end bigint, rate double")


def interactions(spark: SparkSession, rows: list[tuple[int, str, float, str, list[float]]]) -> DataFrame:
    """(interaction, dimensions, max_distance, kernel, parameters)."""
    for _, dims, _, kind, parameters in rows:
        _check(dims in ("", "x", "y", "z", "xy", "xz", "yz", "xyz"), f"no dimensions {dims}")
        _check(len(parameters) == KERNELS.get(kind, -1), f"kernel {kind} doesn't take {len(parameters)} parameters")
    return spark.createDataFrame(rows, "interaction int, dimensions string, max_distance double, kernel string, parameters array<double>")


def ancestral_sequence(spark: SparkSession, sequence: str) -> DataFrame:
    """(position, base) of a short sequence; long ones come from FASTA files."""
    _check(set(sequence) <= set("ACGT"), "a sequence has A, C, G and T")
    return spark.createDataFrame([(sequence,)], "s string").select(F.posexplode(F.filter(F.split("s", ""), lambda b: b != "")).alias("position", "base"))
