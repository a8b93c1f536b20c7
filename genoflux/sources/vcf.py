"""Variant call files: reading to sites and incidence, and writing from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of the format.
COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
#: Lines of the header, which readers compare whole.
HEADER = (
    "##fileformat=VCFv4.2",
    '##INFO=<ID=S,Number=.,Type=Float,Description="Selection Coefficient">',
    '##INFO=<ID=DOM,Number=.,Type=Float,Description="Dominance">',
    '##INFO=<ID=PO,Number=.,Type=Integer,Description="Population of Origin">',
    '##INFO=<ID=TO,Number=.,Type=Integer,Description="Tick of Origin">',
    '##INFO=<ID=MT,Number=.,Type=Integer,Description="Mutation Type">',
    '##INFO=<ID=AC,Number=.,Type=Integer,Description="Allele Count">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">',
    '##INFO=<ID=MULTIALLELIC,Number=0,Type=Flag,Description="Multiallelic">',
    '##INFO=<ID=AA,Number=1,Type=String,Description="Ancestral Allele">',
    '##INFO=<ID=NONNUC,Number=0,Type=Flag,Description="Non-nucleotide-based">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
)
#: Fields of INFO with a value for each alternative allele: their column and type.
PER_ALLELE = {"MID": ("mut_id", "bigint"), "S": ("s", "double"), "DOM": ("dominance", "double"), "PO": ("origin", "bigint"), "TO": ("origin_tick", "bigint"), "MT": ("mut_type", "int")}


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """mutation (chrom, position from 0, alt_index, ref, alt, ancestral, nucleotide_based, and the columns of PER_ALLELE, null where a
    file has none) and calls (chrom, position, sample, copy, alt_index > 0).

    Samples are named by their place, from 0; haploid calls have copy 0 only, and a missing allele is no call.  Lines are independent,
    so files are read in splits."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    site = [F.col("f")[0].alias("chrom"), (F.col("f")[1].cast("bigint") - 1).alias("position")]
    info = F.col("f")[7]
    values = [F.split(F.regexp_extract(info, rf"(?:^|;){k}=([^;]*)", 1), ",").alias(k) for k in PER_ALLELE]
    ancestral = F.nullif(F.regexp_extract(info, r"(?:^|;)AA=([^;]*)", 1), F.lit(""))
    alts = rows.select(*site, F.col("f")[3].alias("ref"), ancestral.alias("ancestral"), (~info.rlike("(?:^|;)NONNUC(?:;|$)")).alias("nucleotide_based"), *values, F.posexplode(F.split(F.col("f")[4], ",")).alias("k", "alt"))
    own = [F.expr(f"try_cast(get({k}, k) as {kind})").alias(name) for k, (name, kind) in PER_ALLELE.items()]
    mutations = alts.select("chrom", "position", (F.col("k") + 1).alias("alt_index"), "ref", "alt", "ancestral", "nucleotide_based", *own)
    calls = rows.select(*site, F.posexplode(F.slice("f", 10, 1 << 30)).alias("sample", "call")).select("chrom", "position", "sample", F.posexplode(F.split(F.split("call", ":")[0], "[|/]")).alias("copy", "allele"))
    return mutations, calls.select("chrom", "position", "sample", "copy", F.expr("try_cast(allele as int)").alias("alt_index")).where(F.col("alt_index") > 0)


def vcf_lines(carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, chrom: str = "1") -> DataFrame:
    """Rows (position, mut_id, value) of data lines, phased, for haplosomes (hap_id, sample, copy) of at most as many samples as a line can hold.

    INFO has what columns of PER_ALLELE mutations have, but for mut_id; ref and alt are A and T unless mutations have them."""
    # as long as any line of the file
    slots = haplosomes.groupBy("sample").agg(F.array_sort(F.collect_list("copy")).alias("copies")).agg(F.array_sort(F.collect_list(F.struct("sample", "copies"))).alias("slots"))
    by_sample = carries.join(haplosomes, "hap_id").groupBy("mut_id", "sample").agg(F.collect_list("copy").alias("copies"))
    own = by_sample.groupBy("mut_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "copies"))).alias("held"), F.sum(F.size("copies")).alias("ac"))
    j = own.join(mutations, "mut_id").join(F.broadcast(slots), F.lit(True))  # one row
    call = lambda s: F.array_join(F.transform(s["copies"], lambda c: F.when(F.coalesce(F.array_contains(F.try_element_at("held", s["sample"]), c), F.lit(False)), "1").otherwise("0")), "|")
    fields = [F.concat(F.lit(f"{k}="), F.col(name).cast("string")) for k, (name, _) in PER_ALLELE.items() if name in mutations.columns and name != "mut_id"]
    info = F.concat_ws(";", *fields, F.concat(F.lit("AC="), F.col("ac").cast("string")), F.lit("DP=1000"))
    base = lambda c, usual: F.col(c) if c in mutations.columns else F.lit(usual)
    line = [F.lit(chrom), (F.col("position") + 1).cast("string"), F.lit("."), base("ref", "A"), base("alt", "T"), F.lit("1000"), F.lit("PASS"), info, F.lit("GT")]
    return j.select("position", "mut_id", F.concat_ws("\t", *line, F.concat_ws("\t", F.transform("slots", call))).alias("value"))


def header_lines(spark: SparkSession, samples: list[str]) -> DataFrame:
    """Rows (place, value) of the header."""
    lines = [*HEADER, "#" + "\t".join([*COLUMNS, *samples])]
    return spark.createDataFrame(list(enumerate(lines)), "place int, value string")
