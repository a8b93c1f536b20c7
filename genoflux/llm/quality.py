"""Operator 10: quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document.  The ledger keeps the measurements and one integer of failure bits, so a
policy (a named, versioned choice of rules) is a bitwise AND, and its ablations are sums over the few distinct bit
patterns; no text is read again.  Repeated word windows are found within a row, by sorting the hashes of its windows,
so there is no shuffle at all.

Defined cases: null and empty texts have no word and fail ``few_words``; repeated rows are judged each for itself; an
empty table gives an empty ledger.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WINDOW = 8


def rules() -> list[tuple[str, Column]]:
    """(name, whether a document fails it), by bit."""
    n = F.col("n_words")
    return [
        ("few_words", n < 20),
        ("repeated_windows", 100 * F.col("n_repeat_words") > 30 * n),
        ("short_words", 2 * n > F.col("word_chars")),
        ("long_words", F.col("word_chars") > 40 * n),
        ("symbols", F.col("n_symbols") > n),
        ("repeated_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        ("few_letters", 100 * F.col("n_letters") < 40 * F.col("word_chars")),
    ]


#: Rules that a document has to pass, by policy and version.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("default", 1): ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "few_letters"),
}


def mask(policy: tuple[str, int]) -> int:
    """The bits of a policy's rules."""
    return sum(1 << i for i, (name, _) in enumerate(rules()) if name in POLICIES[policy])


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with words."""
    whole = f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))"
    df = df.withColumn("hashes", F.expr(f"if(size(words) > {WINDOW}, {whole}, cast(array() as array<bigint>))"))
    # most texts repeat no window; only the others are sorted
    df = df.withColumn("sorted", F.expr("if(size(array_distinct(hashes)) < size(hashes), array_sort(transform(hashes, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))"))
    df = df.withColumn("places", F.expr("array_sort(transform(filter(sorted, (x, j) -> coalesce(get(sorted, j - 1).h = x.h, false) or coalesce(get(sorted, j + 1).h = x.h, false)), x -> x.i))"))
    covered = f"aggregate(places, struct(0L as n, -{WINDOW} as at), (a, i) -> struct(a.n + least({WINDOW}, i - a.at) as n, i as at), a -> a.n)"
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("hashes", "sorted", "places")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements (n_words, word_chars, n_symbols, n_letters, n_lines, n_dup_lines, n_repeat_words) and failed_bits."""
    long = lambda x: F.expr(x).cast("bigint")
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"))
    d = d.withColumn("lines", F.expr("filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    d = d.withColumn("solid", F.translate("text", SPACES, ""))
    d = d.select(
        "doc_id",
        "words",
        long("size(words)").alias("n_words"),
        long("length(solid)").alias("word_chars"),
        (F.length("solid") - F.length(F.translate("solid", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("solid", "[^\\p{L}]+", "")).cast("bigint").alias("n_letters"),
        long("size(lines)").alias("n_lines"),
        long("size(lines) - size(array_distinct(lines))").alias("n_dup_lines"),
    )
    d = _repeat_words(d).drop("words")
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (_, fails) in enumerate(rules())), F.lit(0).cast("bigint"))
    return d.withColumn("failed_bits", bits)


def apply_policy(ledger: DataFrame, policy: tuple[str, int] = ("default", 1), name: str = "kept") -> DataFrame:
    """Adds whether each document passes a policy."""
    return ledger.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablations(ledger: DataFrame, policy: tuple[str, int] = ("default", 1)) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (kept if it went), and kept now."""
    m = mask(policy)
    patterns = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("bigint"))
    bit = lambda i: F.lit(1 << i).cast("bigint")
    rows = [F.struct(F.lit(name).alias("rule"), total(F.col("bits").bitwiseAND(bit(i)) != 0).alias("n_failed"), total(F.col("bits") == bit(i)).alias("n_only"), total(F.col("bits") == 0).alias("n_kept")) for i, (name, _) in enumerate(rules()) if m >> i & 1]
    return patterns.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(("base", 1))).cast("bigint")) != 0
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits", "n_letters", "n_lines")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT rid, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS solid
  FROM d
), w AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) > 8)
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i, unnest(range(0, 8)) AS k FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM w) WHERE c > 1)
  GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars,
    CAST(length(solid) - length(regexp_replace(solid, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(length(regexp_replace(solid, '\P{L}+', '', 'g')) AS BIGINT) AS n_letters, CAST(len(lines) AS BIGINT) AS n_lines
  FROM t LEFT JOIN r USING (rid)
), f AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (2 * n_words > word_chars)::INT
    + 8 * (word_chars > 40 * n_words)::INT + 16 * (n_symbols > n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT
    + 64 * (100 * n_letters < 40 * word_chars)::INT AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept,
  failed_bits, n_letters, n_lines
FROM f
"""
