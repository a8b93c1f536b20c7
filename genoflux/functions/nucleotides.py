"""Nucleotides (0 to 3 for A, C, G, T), codons (0 to 63) and mutation matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .math import _c

BASES = "ACGT"
#: Amino acids of the standard genetic code, for codons in the order AAA, AAC, AAG, AAT, ACA, ... TTT.
AMINO_ACIDS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVVXYXYSSSSXCWCLFLF"
#: Three-letter names by one-letter code.
LONG_NAMES = {"A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr", "X": "Ter"}


def to_codes(sequence) -> Column:
    """A string of bases as an array of 0 to 3; anything else raises."""
    place = F.create_map(*[F.lit(x) for k, b in enumerate(BASES) for x in (b, k)])
    wrong = F.raise_error(F.lit("not a nucleotide")).cast("int")
    return F.transform(F.filter(F.split(_c(sequence), ""), lambda b: b != ""), lambda b: F.coalesce(F.try_element_at(place, b), wrong))


def counts(sequence) -> Column:
    """Struct of the numbers of A, C, G and T in a string."""
    s = _c(sequence)
    return F.struct(*[(F.length(s) - F.length(F.translate(s, b, ""))).cast("bigint").alias(b) for b in BASES])


def frequencies(sequence) -> Column:
    s = _c(sequence)
    n = [F.length(s) - F.length(F.translate(s, b, "")) for b in BASES]
    total = n[0] + n[1] + n[2] + n[3]
    return F.struct(*[F.when(total > 0, x / F.when(total > 0, total)).otherwise(float("nan")).alias(b) for x, b in zip(n, BASES)])


def to_codons(codes) -> Column:
    """Triplets of an array of 0 to 3 as codons; a length that isn't a multiple of three raises."""
    x = _c(codes)
    at = lambda k: F.element_at(x, k.cast("int"))
    triplets = F.transform(F.sequence(F.lit(0), F.greatest((F.size(x) / 3).cast("int"), F.lit(1)) - 1), lambda i: at(3 * i + 1) * 16 + at(3 * i + 2) * 4 + at(3 * i + 3))
    bad = F.raise_error(F.lit("codons need a multiple of three nucleotides")).cast("array<int>")
    return F.when(F.size(x) % 3 != 0, bad).when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(triplets)


def codon_bases(codon) -> Column:
    """The three nucleotides of a codon."""
    c = _c(codon).cast("int")
    return F.array(F.floor(c / 16).cast("int"), F.floor(c / 4).cast("int") % 4, c % 4)


def base(code) -> Column:
    return F.element_at(F.array(*map(F.lit, BASES)), _c(code).cast("int") + 1)


def amino_acid(codon, long: bool = False) -> Column:
    """One-letter name of a codon's amino acid (X for stop), or three letters."""
    names = [LONG_NAMES[a] if long else a for a in AMINO_ACIDS]
    return F.element_at(F.array(*map(F.lit, names)), _c(codon).cast("int") + 1)


def amino_acids(codons, long: bool = False) -> Column:
    """An array of codons as one string, or of three letters each, joined by hyphens."""
    return F.array_join(F.transform(_c(codons), lambda c: amino_acid(c, long)), "-" if long else "")


def random_bases(seed: int, *key, basis: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)) -> Column:
    """A random nucleotide for each key, by weights."""
    from .distributions import uniform

    u, total = uniform(seed, *key), float(sum(basis))
    return F.when(u < basis[0] / total, 0).when(u < sum(basis[:2]) / total, 1).when(u < sum(basis[:3]) / total, 2).otherwise(3)


def jukes_cantor(spark: SparkSession, alpha: float) -> DataFrame:
    """Mutation matrix (row, col, value) with one rate for every change."""
    return kimura(spark, alpha, alpha)


def kimura(spark: SparkSession, alpha: float, beta: float) -> DataFrame:
    """Mutation matrix with rate alpha for transitions (A-G, C-T) and beta for transversions."""
    r = spark.range(16).select(F.expr("id div 4").alias("row"), (F.col("id") % 4).alias("col"))
    apart = F.abs(F.col("row") - F.col("col"))
    return r.withColumn("value", F.when(apart == 0, 0.0).when(apart == 2, float(alpha)).otherwise(float(beta)))


def expand_context(matrix: DataFrame) -> DataFrame:
    """A 4 x 4 matrix as 64 x 4, for trinucleotides whose middle base mutates."""
    context = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("around")
    return matrix.select("row", "col", "value", context).select((F.expr("around div 4") * 16 + F.col("row") * 4 + F.col("around") % 4).alias("row"), "col", "value")
