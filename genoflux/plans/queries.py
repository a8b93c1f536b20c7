"""Registered queries: every operator over the provided tables, with SQL for DuckDB where SQL can express it.

Roles of the tables: lineitem is incidence, orders are haplosomes (two for each individual, five subpopulations), part is mutations,
embeddings are points, customers with nations and regions are an ancestry, events are a log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, math, nucleotides, stats, strings
from ..functions import distributions as draw
from ..operators import ancestry, frames, genome, genotypes, maps, matrix, pedigree, popgen, spatial, vectors
from ..sources import state
from ..streaming.ticklog import TickLog, windowed_counts
from . import simulation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(x: Column | str, digits: int = 9) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


class Tables:
    """The provided tables in their roles."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def carries(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("hap_id"), F.col("l_partkey").alias("mut_id")).distinct()

    @property
    def haplosome(self) -> DataFrame:
        ind = F.expr("o_orderkey div 2")
        return self.orders.select(F.col("o_orderkey").alias("hap_id"), ind.alias("ind_id"), (F.col("o_orderkey") % 2).cast("int").alias("copy"), (ind % 5).cast("int").alias("subpop"))

    @property
    def mutation(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.part.select(k.alias("mut_id"), (k * 1000).alias("position"), (F.col("p_size") % 3).alias("mut_type"), ((F.col("p_retailprice") - 950) / 1000).alias("s"), F.lit(0.5).alias("dominance"))

    @property
    def length(self) -> float:
        return 1000.0 * self.part.count()

    @property
    def points(self) -> DataFrame:
        at = lambda i: F.element_at("embedding", i).cast("double")
        return self.embeddings.select(F.col("vec_id").alias("ind_id"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), (F.col("label") % 2).alias("sex"))

    @property
    def freq(self) -> DataFrame:
        return popgen.frequencies(popgen.mutation_counts(self.carries), self.haplosome)

    @property
    def values(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("idx"), "user_id", "event_type", F.col("value").alias("v"), "props", "ts")


V = """WITH carries AS (SELECT DISTINCT l_orderkey AS hap_id, l_partkey AS mut_id FROM lineitem),
haplosome AS (SELECT o_orderkey AS hap_id, o_orderkey // 2 AS ind_id, CAST(o_orderkey % 2 AS INT) AS copy, CAST((o_orderkey // 2) % 5 AS INT) AS subpop FROM orders),
mutation AS (SELECT p_partkey AS mut_id, p_partkey * 1000 AS position, p_size % 3 AS mut_type, (p_retailprice - 950) / 1000 AS s, 0.5::DOUBLE AS dominance FROM part),
total AS (SELECT count(*) AS n FROM haplosome), len AS (SELECT 1000.0::DOUBLE * count(*) AS l FROM part),
freq AS (SELECT mut_id, count(*) AS c, any_value(n) AS n, count(*)::DOUBLE / any_value(n) AS p FROM carries, total GROUP BY mut_id),
points AS (SELECT vec_id AS ind_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label % 2 AS sex FROM embeddings),
vals AS (SELECT event_id AS idx, user_id, event_type, value AS v, props, ts FROM events),
harm AS (SELECT n, (SELECT sum(1.0::DOUBLE / i) FROM range(1, n) t(i)) AS a1, (SELECT sum(1.0::DOUBLE / (i::DOUBLE * i)) FROM range(1, n) t(i)) AS a2 FROM total)
"""


# ---- functions


@query(V + "SELECT idx, round(abs(v - 50), 9) AS a, round(sqrt(abs(v)), 9) AS b, round(exp(v / 100), 9) AS c, round(ln(abs(v) + 1), 9) AS d, round(log10(abs(v) + 1), 9) AS e, round(log2(abs(v) + 1), 9) AS f, round(pow(v / 100, 2), 9) AS g, sign(v - 50)::DOUBLE AS h FROM vals")
def math_elementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return Tables(spark, sf_dir).values.select("idx", r(math.absolute(v - 50)).alias("a"), r(math.sqrt(F.abs(v))).alias("b"), r(math.exp(v / 100)).alias("c"), r(math.log(F.abs(v) + 1)).alias("d"), r(math.log10(F.abs(v) + 1)).alias("e"), r(math.log2(F.abs(v) + 1)).alias("f"), r(math.power(v / 100, 2)).alias("g"), math.sign(v - 50).alias("h"))


@query(V + "SELECT idx, ceil(v - 50) + 0.0 AS c, floor(v - 50) + 0.0 AS f, round(v - 50) + 0.0 AS r, trunc(v - 50) + 0.0 AS t FROM vals")
def math_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("v") - 50
    return Tables(spark, sf_dir).values.select("idx", (math.ceil(x) + 0.0).alias("c"), (math.floor(x) + 0.0).alias("f"), (math.round_half_away(x) + 0.0).alias("r"), (math.trunc(x) + 0.0).alias("t"))


@query(V + "SELECT idx, round(sin(v), 9) AS s, round(cos(v), 9) AS c, round(tan(v / 1000), 9) AS t, round(atan(v), 9) AS a, round(atan2(v, 2), 9) AS a2, round(asin(v / (abs(v) + 1)), 9) AS i, round(acos(v / (abs(v) + 1)), 9) AS o FROM vals")
def math_trigonometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("v"), F.col("v") / (F.abs("v") + 1)
    return Tables(spark, sf_dir).values.select("idx", r(math.sin(v)).alias("s"), r(math.cos(v)).alias("c"), r(math.tan(v / 1000)).alias("t"), r(math.atan(v)).alias("a"), r(math.atan2(v, 2.0)).alias("a2"), r(math.asin(u)).alias("i"), r(math.acos(u)).alias("o"))


@query(V + "SELECT idx, (idx - 500) // 7 AS q, (idx - 500) % 7 AS m, round(fmod(v, 3.5), 9) AS fm, round(v / (idx % 5 + 1), 9) AS d FROM vals")
def math_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("idx"), F.col("v")
    return Tables(spark, sf_dir).values.select("idx", math.integer_div(i - 500, 7).alias("q"), math.integer_mod(i - 500, 7).alias("m"), r(math.modulo(v, 3.5)).alias("fm"), r(math.divide(v, i % 5 + 1)).alias("d"))


@query(V + "SELECT CASE idx % 3 WHEN 0 THEN 'inf' WHEN 1 THEN 'nan' ELSE 'finite' END AS kind, count(*) AS n, count(*) AS same FROM vals GROUP BY 1")
def math_ieee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division by zero and zero by zero, sorted by the tests for them."""
    x = math.divide(F.when(F.col("idx") % 3 == 1, 0.0).otherwise(1.0), F.when(F.col("idx") % 3 == 2, 2.0).otherwise(0.0))
    kind = F.when(math.is_infinite(x), "inf").when(math.is_nan(x), "nan").when(math.is_finite(x), "finite")
    return Tables(spark, sf_dir).values.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(math.is_close(x, x, equal_nan=True), 1)).alias("same"))


@query(V + "SELECT event_type, round(sum(v), 5) AS total, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(var_samp(v), 7) AS var, min(v) AS low, max(v) AS high, round(covar_samp(v, idx), 4) AS cov, round(corr(v, idx), 9) AS cor FROM vals GROUP BY event_type")
def stats_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.groupBy("event_type").agg(r(stats.total("v"), 5).alias("total"), r(stats.mean("v")).alias("mean"), r(stats.sd("v")).alias("sd"), r(stats.variance("v"), 7).alias("var"), stats.minimum("v").alias("low"), stats.maximum("v").alias("high"), r(stats.covariance("v", "idx"), 4).alias("cov"), r(stats.correlation("v", "idx")).alias("cor"))


@query(V + "SELECT event_type, list_transform([quantile_cont(v, 0.0), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 1.0)], lambda x: round(x, 9)) AS q FROM vals GROUP BY event_type")
def quantile_type7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.groupBy("event_type").agg(F.transform(stats.quantile("v"), lambda x: F.round(x, 9)).alias("q"))


@query(V + """SELECT event_type, round(fsum(v), 4) AS exact, arg_max(idx, (v, -idx)) AS which_max, arg_min(idx, (v, idx)) AS which_min, bool_and(v > -1e9) AS all_true, bool_or(v > 1e9) AS any_true FROM vals GROUP BY event_type""")
def stats_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.groupBy("event_type").agg(F.round(F.sum("v"), 4).alias("exact"), stats.which_max("v", "idx").alias("which_max"), stats.which_min("v", "idx").alias("which_min"), stats.all_true(F.col("v") > -1e9).alias("all_true"), stats.any_true(F.col("v") > 1e9).alias("any_true"))


@query(V + "SELECT event_type, round(fsum(v), 6) AS total FROM vals GROUP BY event_type")
def sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.groupBy("event_type").agg(F.round(stats.total_exact("v"), 6).alias("total"))


@query()
def ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Tables(spark, sf_dir).values
    first = F.col("idx") % 2 == 0
    side = lambda t, n: [F.count(F.when(t, F.col("v"))).alias(f"n{n}"), F.avg(F.when(t, F.col("v"))).alias(f"m{n}"), F.var_samp(F.when(t, F.col("v"))).alias(f"v{n}")]
    a = v.groupBy("event_type").agg(*side(first, 1), *side(~first, 2))
    return a.select("event_type", stats.ttest_two("n1", "m1", "v1", "n2", "m2", "v2").alias("p_two"), stats.ttest_one("n1", "m1", "v1", 50.0).alias("p_one"))


@query(V + "SELECT idx, round(exp(-pow((v - 50) / 10, 2) / 2) / (10 * sqrt(2 * pi())), 9) AS normal, round(CASE WHEN v < 0 THEN 0 ELSE exp(-v / 20) / 20 END, 9) AS exponential FROM vals")
def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.select("idx", r(draw.dnorm("v", 50.0, 10.0)).alias("normal"), r(draw.dexp("v", 20.0)).alias("exponential"))


@query()
def densities_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.abs(F.col("v")) / (F.abs(F.col("v")) + 1)
    return Tables(spark, sf_dir).values.select("idx", draw.dgamma(F.abs("v"), 2.0, 3.0).alias("gamma"), draw.dbeta(u, 2.0, 3.0).alias("beta"), draw.pnorm("v", 50.0, 10.0).alias("p"), draw.qnorm(u).alias("q"), draw.dmvnorm(F.array(u, u), [0.0, 0.0], [[1.0, 0.3], [0.3, 1.0]]).alias("mv"))


@query()
def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1.0)
    # a table of few files is few tasks, and a row of draws is far more work than moving its id
    rows = Tables(spark, sf_dir).values.select("idx").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx")
    return rows.select("idx", draw.runif(1, "idx").alias("runif"), draw.rdunif(1, "idx", low=1, high=6).alias("rdunif"), draw.rdunif64(1, "idx").alias("rdunif64"), draw.rnorm(1, "idx").alias("rnorm"), draw.rlnorm(1, "idx").alias("rlnorm"), draw.rexp(1, "idx").alias("rexp"), draw.rcauchy(1, "idx").alias("rcauchy"), draw.rlaplace(1, "idx").alias("rlaplace"), draw.rweibull(1, "idx").alias("rweibull"), draw.rgeom(1, "idx").alias("rgeom"), draw.rgamma(1, "idx", mean=one, shape=one * 2).alias("rgamma"), draw.rbeta(1, "idx", alpha=one, beta=one * 2).alias("rbeta"), draw.rf(1, "idx", d1=one * 3, d2=one * 9).alias("rf"), draw.rbinom(1, "idx", size=F.lit(10), prob=one / 2).alias("rbinom"), draw.rpois(1, "idx", lam=one * 3).alias("rpois"), draw.rnbinom(1, "idx", size=one * 3, prob=one / 2).alias("rnbinom"), draw.rztpois(1, "idx", lam=one / 2).alias("rztpois"), draw.rdirichlet(1, "idx", alpha=F.array(one, one)).alias("rdirichlet"), draw.rmultinom(1, "idx", size=F.lit(5), prob=F.array(one, one * 3)).alias("rmultinom"), draw.rmvnorm(1, "idx", mu=F.array(one, one), sigma=F.array(one, one * 0, one * 0, one)).alias("rmvnorm"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, contains(text, 'the') AS has_the, CAST(instr(text, 'an') - 1 AS BIGINT) AS at_an, starts_with(text, 'T') AS starts, ends_with(text, '.') AS ends, CAST(len(string_split(text, ' ')) AS BIGINT) AS parts, substr(text, 3, 5) AS part, regexp_matches(text, '[0-9]+') AS has_digit FROM documents")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return Tables(spark, sf_dir).documents.select("doc_id", strings.nchar(t).alias("bytes"), strings.strcontains(t, "the").alias("has_the"), strings.strfind(t, "an").alias("at_an"), strings.strprefix(t, "T").alias("starts"), strings.strsuffix(t, ".").alias("ends"), F.size(strings.strsplit(t, " ")).cast("bigint").alias("parts"), strings.substr(t, F.lit(2), F.lit(6)).alias("part"), strings.grep(t, "[0-9]+").alias("has_digit"))


@query(V + "SELECT user_id, string_agg(CAST(idx AS VARCHAR), '-' ORDER BY idx) AS joined FROM vals GROUP BY user_id")
def paste_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.groupBy("user_id").agg(stats.paste("idx", "idx", "-").alias("joined"))


@query("SELECT vec_id, list_transform(list_distinct(list_transform(embedding[1:6], lambda x: sign(x)::INT)), lambda x: x) IS NOT NULL AS ok, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, list_reverse(list_sort(embedding))[1] AS top FROM embeddings")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return Tables(spark, sf_dir).embeddings.select("vec_id", (F.size(arrays.unique(F.transform(F.slice(e, 1, 6), lambda x: F.signum(x)))) > 0).alias("ok"), F.round(arrays.total(e), 6).alias("total"), F.size(arrays.which(arrays.sapply(e, lambda x: x > 0))).cast("bigint").alias("positive"), F.element_at(arrays.sort(e, False), 1).alias("top"))


@query("SELECT o_orderkey AS k, list_transform(range(0, o_orderkey % 5), lambda i: i) AS seq, list_concat(range(0, o_orderkey % 3), range(0, o_orderkey % 3)) AS rep, list_transform(range(0, o_orderkey % 4), lambda i: i * (i + 1) / 2) AS cum FROM orders")
def array_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return Tables(spark, sf_dir).orders.select(k.alias("k"), arrays.seq_len(k % 5).alias("seq"), arrays.rep(arrays.seq_len(k % 3), 2).alias("rep"), arrays.cum_sum(arrays.seq_len(k % 4)).alias("cum"))


_SEQ = "array_to_string(list_transform(range(0, 12), lambda k: substr('ACGT', CAST((p_partkey * 7 // pow(4, k % 7)::BIGINT + k) % 4 + 1 AS INT), 1)), '')"


def _sequences(t: Tables) -> DataFrame:
    code = lambda k: ((F.expr(f"(p_partkey * 7) div {4 ** (k % 7)}") + k) % 4).cast("int")
    return t.part.select("p_partkey", F.concat(*[nucleotides.base(code(k)) for k in range(12)]).alias("seq"))


@query(f"WITH s AS (SELECT p_partkey, {_SEQ} AS seq FROM part) SELECT p_partkey, seq, len(seq) - len(replace(seq, 'A', '')) AS a, len(seq) - len(replace(seq, 'C', '')) AS c, len(seq) - len(replace(seq, 'G', '')) AS g, len(seq) - len(replace(seq, 'T', '')) AS t, round((len(seq) - len(replace(seq, 'G', ''))) / 12.0, 9) AS freq_g FROM s")
def nucleotide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sequences(Tables(spark, sf_dir)).withColumn("n", nucleotides.counts("seq")).withColumn("f", nucleotides.frequencies("seq"))
    return s.select("p_partkey", "seq", F.col("n.A").alias("a"), F.col("n.C").alias("c"), F.col("n.G").alias("g"), F.col("n.T").alias("t"), r(F.col("f")["G"]).alias("freq_g"))


@query(f"""WITH s AS (SELECT p_partkey, {_SEQ} AS seq FROM part), c AS (SELECT p_partkey, list_transform(range(0, 4), lambda i: (instr('ACGT', substr(seq, CAST(3 * i + 1 AS INT), 1)) - 1) * 16 + (instr('ACGT', substr(seq, CAST(3 * i + 2 AS INT), 1)) - 1) * 4 + instr('ACGT', substr(seq, CAST(3 * i + 3 AS INT), 1)) - 1) AS codons FROM s)
SELECT p_partkey, list_transform(codons, lambda x: CAST(x AS INT)) AS codons, array_to_string(list_transform(codons, lambda x: substr('{nucleotides.AMINO_ACIDS}', CAST(x + 1 AS INT), 1)), '') AS amino FROM c""")
def codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _sequences(Tables(spark, sf_dir)).select("p_partkey", nucleotides.to_codons(nucleotides.to_codes("seq")).alias("codons"))
    return c.select("p_partkey", "codons", nucleotides.amino_acids("codons").alias("amino"))


@query("SELECT CAST(a * 16 + i * 4 + b AS BIGINT) AS row, j AS col, CASE WHEN i = j THEN 0.0 WHEN abs(i - j) = 2 THEN 0.2 ELSE 0.1 END::DOUBLE AS value FROM range(4) t(i), range(4) u(j), range(4) v(a), range(4) w(b)")
def mutation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleotides.expand_context(nucleotides.kimura(spark, 0.2, 0.1)).select(F.col("row").cast("bigint").alias("row"), "col", "value")


# ---- vectors

for _ties, _sql in {"average": "rank() OVER (PARTITION BY event_type ORDER BY w) + (count(*) OVER (PARTITION BY event_type, w) - 1) / 2.0::DOUBLE", "min": "rank() OVER (PARTITION BY event_type ORDER BY w)", "max": "rank() OVER (PARTITION BY event_type ORDER BY w) + count(*) OVER (PARTITION BY event_type, w) - 1", "first": "row_number() OVER (PARTITION BY event_type ORDER BY w, idx)", "last": "row_number() OVER (PARTITION BY event_type ORDER BY w, idx DESC)"}.items():

    def _rank(spark: SparkSession, sf_dir: str, ties: str = _ties) -> DataFrame:
        d = Tables(spark, sf_dir).values.select("idx", "event_type", F.floor("v").alias("w"))
        out = vectors.rank(d, "w", "idx", ties, ["event_type"])
        return out.select("idx", F.col("rank").cast("double" if ties == "average" else "bigint").alias("rank"))

    QUERIES[f"rank_{_ties}"] = _rank
    ORACLE[f"rank_{_ties}"] = V + f"SELECT idx, {_sql} AS rank FROM (SELECT *, floor(v) AS w FROM vals)"


@query(V + "SELECT event_type, idx, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, idx) - 1 AS place FROM vals")
def order_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.order(Tables(spark, sf_dir).values, "v", "idx", False, ["event_type"])


@query(V + "SELECT idx, round(sum(v) OVER (ORDER BY idx), 4) AS cum_sum FROM vals")
def cum_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cum_sum(Tables(spark, sf_dir).values, "v", "idx").select("idx", F.round("cum_sum", 4).alias("cum_sum"))


@query(V + "SELECT user_id, idx, round(product(1 + v / 1000) OVER (PARTITION BY user_id ORDER BY idx), 6) AS cum_product FROM vals")
def cum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).values.withColumn("f", 1 + F.col("v") / 1000)
    return vectors.cum_product(d, "f", "idx", ["user_id"]).select("user_id", "idx", F.round("cum_product", 6).alias("cum_product"))


@query(V + "SELECT user_id, idx, round((0.25 * coalesce(lag(v) OVER w, 0) + 0.5 * v + 0.25 * coalesce(lead(v) OVER w, 0)) / (0.5 + CASE WHEN lag(v) OVER w IS NULL THEN 0 ELSE 0.25 END + CASE WHEN lead(v) OVER w IS NULL THEN 0 ELSE 0.25 END), 6) AS filtered FROM vals WINDOW w AS (PARTITION BY user_id ORDER BY idx)")
def centered_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vectors.centered_filter(Tables(spark, sf_dir).values, "v", "idx", [0.25, 0.5, 0.25], True, ["user_id"])
    return d.select("user_id", "idx", F.round("filtered", 6).alias("filtered"))


@query("SELECT bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(p_size) + 1 FROM part))) AS bin) LEFT JOIN (SELECT p_size AS bin, count(*) AS n FROM part GROUP BY 1) USING (bin)")
def tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.tabulate(Tables(spark, sf_dir).part, "p_size")


@query("SELECT c_custkey, c_nationkey, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey), -1) AS place FROM customer")
def match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return vectors.match(t.customer.select("c_custkey", "c_nationkey"), t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey"), "c_nationkey", "s_suppkey")


@query("SELECT l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_suppkey")
def unique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.unique(Tables(spark, sf_dir).lineitem, "l_suppkey", "l_orderkey")


@query(V + "SELECT idx, CASE WHEN v < 10 THEN -1 WHEN v < 20 THEN 0 WHEN v < 50 THEN 1 WHEN v < 80 THEN 2 ELSE 3 END::BIGINT AS interval FROM vals")
def find_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.select("idx", draw.find_interval("v", [10.0, 20.0, 50.0, 80.0]).alias("interval"))


@query("SELECT o_orderkey, (SELECT count(*) FROM (SELECT DISTINCT p_retailprice * 100 AS b FROM part) WHERE b <= o_totalprice) - 1 AS interval FROM orders")
def find_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals among as many breaks as there are prices."""
    t = Tables(spark, sf_dir)
    x = t.orders.select("o_orderkey", "o_totalprice")
    return vectors.find_interval(x, "o_totalprice", t.part.select((F.col("p_retailprice") * 100).alias("b")), "b").select("o_orderkey", "interval")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = Tables(spark, sf_dir)
    return t.customer.select(F.col("c_custkey").alias("k")), t.orders.select((F.col("o_custkey") * 2).alias("k"))


for _name, _f, _sql in (("union", vectors.set_union, "UNION"), ("intersection", vectors.set_intersection, "INTERSECT"), ("difference", vectors.set_difference, "EXCEPT")):
    QUERIES[f"set_{_name}"] = lambda spark, sf_dir, f=_f: f(*_sides(spark, sf_dir))
    ORACLE[f"set_{_name}"] = f"SELECT c_custkey AS k FROM customer {_sql} SELECT o_custkey * 2 AS k FROM orders"
QUERIES["set_symmetric_difference"] = lambda spark, sf_dir: vectors.set_symmetric_difference(*_sides(spark, sf_dir))
ORACLE["set_symmetric_difference"] = "(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey * 2 FROM orders) UNION (SELECT o_custkey * 2 AS k FROM orders EXCEPT SELECT c_custkey FROM customer)"


@query("SELECT n_nationkey + k * (SELECT count(*) FROM nation) AS idx, n_name FROM nation, range(0, 3) t(k)")
def rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.rep(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").cast("bigint").alias("idx"), "n_name"), 3, "idx")


@query("SELECT n_nationkey AS idx, CAST(k AS INT) AS copy FROM nation, range(0, 3) t(k) WHERE k < n_nationkey % 4")
def rep_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.rep_each(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("idx")), F.col("idx") % 4, "idx")


@query("SELECT (SELECT max(n_nationkey) FROM nation) - n_nationkey AS idx, n_name FROM nation")
def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.reverse(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("idx"), "n_name"), "idx")


@query()
def sample_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sample(Tables(spark, sf_dir).part.select("p_partkey", "p_size"), 50, 7, ["p_partkey"], weight="p_size")


@query()
def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sample(Tables(spark, sf_dir).part.select("p_partkey", "p_size"), 500, 7, ["p_partkey"], replace=True, weight="p_size")


# ---- matrices

_A = "WITH a AS (SELECT l_suppkey % 20 AS row, CAST(l_linenumber - 1 AS BIGINT) AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) "


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy((F.col("l_suppkey") % 20).alias("row"), (F.col("l_linenumber") - 1).cast("bigint").alias("col")).agg(F.sum("l_quantity").alias("value"))


@query(_A + "SELECT x.col AS row, y.col AS col, sum(x.value * y.value) AS value FROM a x JOIN a y ON x.row = y.row GROUP BY 1, 2")
def matrix_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.multiply(matrix.transpose(_a(spark, sf_dir)), _a(spark, sf_dir))


@query(_A + "SELECT row, sum(value) AS value FROM a GROUP BY row")
def matrix_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.row_sums(_a(spark, sf_dir))


@query(_A + "SELECT col, sum(value) AS value FROM a GROUP BY col")
def matrix_col_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.col_sums(_a(spark, sf_dir))


@query(_A + "SELECT coalesce(sum(value) FILTER (WHERE row = col), 0) AS trace FROM a")
def matrix_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.trace(_a(spark, sf_dir))


@query(_A + "SELECT row, col, value FROM a WHERE row < col")
def matrix_upper_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _a(spark, sf_dir).where(matrix.upper_triangle())


@query(_A + "SELECT row, col, value FROM a UNION ALL SELECT row + 20, col, value FROM a")
def matrix_rbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.rbind((_a(spark, sf_dir), 20), (_a(spark, sf_dir), 20))


@query("WITH m AS (SELECT i AS row, j AS col, (i + 2 * j + 1)::DOUBLE AS value FROM range(3) t(i), range(3) u(j)) SELECT a.row, c.col, sum(a.value * b.value * c.value) AS value FROM m a JOIN m b ON a.col = b.row JOIN m c ON b.col = c.row GROUP BY 1, 2")
def matrix_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix.from_vector(spark.range(9).select(F.col("id").alias("idx"), (F.col("id") % 3 + 2 * F.expr("id div 3") + 1).cast("double").alias("value")), "value", "idx", 3, 3)
    return matrix.power(m, 3, 3)


@query("SELECT n_regionkey AS g, 2.0 * (n_regionkey + 2) * (n_regionkey + 3)::DOUBLE AS determinant FROM nation GROUP BY 1")
def matrix_determinant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a diagonal matrix for each region."""
    g = Tables(spark, sf_dir).region.select(F.col("r_regionkey").alias("g"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("row"), F.lit(i).cast("bigint").alias("col"), v.cast("double").alias("value")) for i, v in enumerate((F.lit(2.0), F.col("g") + 2, F.col("g") + 3))]))
    d = matrix.determinant(g.select("g", cells.alias("c")).select("g", "c.*"), ["g"])
    return d.select("g", F.round("determinant", 9).alias("determinant"))


@query("SELECT i AS row, j AS col, round(CASE i * 3 + j WHEN 0 THEN var_samp(l_quantity) WHEN 1 THEN covar_samp(l_quantity, l_discount) WHEN 2 THEN covar_samp(l_quantity, l_tax) WHEN 3 THEN covar_samp(l_discount, l_quantity) WHEN 4 THEN var_samp(l_discount) WHEN 5 THEN covar_samp(l_discount, l_tax) WHEN 6 THEN covar_samp(l_tax, l_quantity) WHEN 7 THEN covar_samp(l_tax, l_discount) ELSE var_samp(l_tax) END, 6) AS value FROM lineitem, range(3) t(i), range(3) u(j) GROUP BY i, j")
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.column_covariance(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_discount", "l_tax"]).select("row", "col", F.round("value", 6).alias("value"))


# ---- population genetics


@query(V + "SELECT mut_id, c, n, round(p, 9) AS p FROM freq")
def mutation_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).freq.select("mut_id", "c", "n", r("p").alias("p"))


@query(V + "SELECT subpop, mut_id, count(*) AS c FROM carries JOIN haplosome USING (hap_id) GROUP BY 1, 2")
def mutation_counts_by_subpopulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.mutation_counts(t.carries, t.haplosome, ["subpop"])


@query(V + "SELECT round(sum(2 * p * (1 - p)) / any_value(l), 15) AS heterozygosity FROM freq, len")
def heterozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.heterozygosity(t.freq, t.length).select(r("heterozygosity", 15).alias("heterozygosity"))


@query(V + "SELECT round(sum(c * (n - c) / (n * (n - 1.0::DOUBLE) / 2)) / any_value(l), 15) AS pi FROM freq, len WHERE c < n")
def nucleotide_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.diversity(t.freq, t.length).select(r("pi", 15).alias("pi"))


@query(V + "SELECT round(count(*) / any_value(a1) / any_value(l), 15) AS theta FROM freq JOIN harm USING (n), len WHERE c < n")
def wattersons_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.wattersons_theta(t.freq, t.length).select(r("theta", 15).alias("theta"))


@query(V + """, k AS (SELECT count(*)::DOUBLE AS k, sum(c * (n - c) / (n * (n - 1.0::DOUBLE) / 2)) AS d, any_value(n)::DOUBLE AS n, any_value(a1) AS a1, any_value(a2) AS a2 FROM freq JOIN harm USING (n) WHERE c < n),
e AS (SELECT *, ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 AS e1, (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM k)
SELECT round((d - k / a1) / sqrt(e1 * k + e2 * k * (k - 1)), 6) AS tajimas_d FROM e""")
def tajimas_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.tajimas_d(Tables(spark, sf_dir).freq).select(r("tajimas_d", 6).alias("tajimas_d"))


@query(V + "SELECT bin, coalesce(m, 0) AS n_mutations FROM (SELECT unnest(range(0, (SELECT n - 1 FROM total))) AS bin) LEFT JOIN (SELECT c - 1 AS bin, count(*) AS m FROM freq WHERE c < n GROUP BY 1) USING (bin)")
def sfs_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.site_frequency_spectrum(Tables(spark, sf_dir).freq)


@query(V + "SELECT bin, round(coalesce(m, 0) / sum(coalesce(m, 0)) OVER (), 9) AS density FROM (SELECT unnest(range(0, 10)) AS bin) LEFT JOIN (SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS m FROM freq GROUP BY 1) USING (bin)")
def sfs_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.site_frequency_spectrum(Tables(spark, sf_dir).freq, 10, density=True).select("bin", r("density").alias("density"))


@query(V + ", b AS (SELECT bin, coalesce(m, 0) AS m FROM (SELECT unnest(range(0, 11)) AS bin) LEFT JOIN (SELECT least(floor(p * 11), 10)::BIGINT AS bin, count(*) AS m FROM freq GROUP BY 1) USING (bin)) SELECT x.bin, CAST(x.m + y.m AS BIGINT) AS n_mutations FROM b x JOIN b y ON y.bin = 10 - x.bin WHERE x.bin <= 5")
def sfs_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.site_frequency_spectrum(Tables(spark, sf_dir).freq, 11, fold=True)


_TWO = V + ", g AS (SELECT mut_id, count(*) FILTER (WHERE subpop = 0) AS c1, count(*) FILTER (WHERE subpop = 1) AS c2 FROM carries JOIN haplosome USING (hap_id) WHERE subpop IN (0, 1) GROUP BY 1), nn AS (SELECT count(*) FILTER (WHERE subpop = 0)::DOUBLE AS n1, count(*) FILTER (WHERE subpop = 1)::DOUBLE AS n2 FROM haplosome), q AS (SELECT mut_id, c1, c2, n1, n2, c1 / n1 AS p1, c2 / n2 AS p2 FROM g, nn) "


def _two(t: Tables) -> DataFrame:
    return popgen.two_groups(t.carries, t.haplosome, "subpop", 0, 1)


@query(_TWO + "SELECT round(1 - avg(p1 * (1 - p1) + p2 * (1 - p2)) / avg((p1 + p2) * (1 - (p1 + p2) / 2)), 9) AS fst FROM q")
def fixation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.fst(_two(Tables(spark, sf_dir))).select(r("fst").alias("fst"))


@query(_TWO + "SELECT round(sum((c1 * (n2 - c2) + (n1 - c1) * c2) / (n1 * n2)), 6) AS dxy FROM q WHERE c1 + c2 < n1 + n2")
def divergence_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.dxy(_two(Tables(spark, sf_dir))).select(r("dxy", 6).alias("dxy"))


@query(_TWO + "SELECT (mut_id * 1000) // 100000 AS window, round(1 - avg(p1 * (1 - p1) + p2 * (1 - p2)) / avg((p1 + p2) * (1 - (p1 + p2) / 2)), 9) AS fst FROM q GROUP BY 1")
def windowed_fixation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.fst(popgen.windows(_two(t), t.mutation, 100_000), ["window"]).select("window", r("fst").alias("fst"))


@query(V + "SELECT (mut_id * 1000) // 100000 AS window, round(sum(c * (n - c) / (n * (n - 1.0::DOUBLE) / 2)) / 100000, 15) AS pi FROM freq WHERE c < n GROUP BY 1")
def windowed_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.diversity(popgen.windows(t.freq, t.mutation, 100_000), 100_000.0, ["window"]).select("window", r("pi", 15).alias("pi"))


@query(V + ", h AS (SELECT hap_id FROM carries WHERE mut_id = 1), c AS (SELECT mut_id, count(*) AS c2, count(h.hap_id) AS c12 FROM carries LEFT JOIN h USING (hap_id) GROUP BY 1), q AS (SELECT mut_id, (SELECT count(*) FROM h)::DOUBLE / n AS p1, c2::DOUBLE / n AS p2, c12::DOUBLE / n AS p12 FROM c, total) SELECT mut_id, round(p12 - p1 * p2, 12) AS d, round(pow(p12 - p1 * p2, 2) / (p1 * (1 - p1) * p2 * (1 - p2)), 9) AS r_squared FROM q")
def linkage_disequilibrium(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.linkage(t.carries, t.haplosome.count(), 1).select("mut_id", r("d", 12).alias("d"), r("r_squared").alias("r_squared"))


@query(V + "SELECT round(var_samp(s), 12) AS va FROM (SELECT ind_id, coalesce(sum(m.s), 0) AS s FROM haplosome h LEFT JOIN carries c USING (hap_id) LEFT JOIN (SELECT * FROM mutation WHERE mut_type = 1) m USING (mut_id) GROUP BY 1)")
def additive_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.additive_variance(t.carries, t.haplosome, t.mutation, 1).select(r("va", 12).alias("va"))


@query(V + "SELECT round(sum(p * d) - sum(p * p * d) - 2 * sum(p * (1 - p) * d * dominance), 9) AS inbreeding_load FROM (SELECT p, least(-s, 1.0) AS d, dominance FROM freq JOIN mutation USING (mut_id) WHERE s < 0)")
def inbreeding_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.inbreeding_load(t.freq, t.mutation).select(r("inbreeding_load").alias("inbreeding_load"))


@query(V + ", held AS (SELECT hap_id, count(*) AS k FROM carries GROUP BY 1), shared AS (SELECT x.hap_id, count(*) AS k FROM carries x JOIN carries y ON y.hap_id = x.hap_id + 1 AND y.mut_id = x.mut_id GROUP BY 1) SELECT a.hap_id AS hap_a, b.hap_id AS hap_b, round((coalesce(ha.k, 0) + coalesce(hb.k, 0) - 2 * coalesce(s.k, 0)) / l, 15) AS heterozygosity FROM haplosome a JOIN haplosome b ON b.hap_id = a.hap_id + 1 LEFT JOIN held ha ON ha.hap_id = a.hap_id LEFT JOIN held hb ON hb.hap_id = b.hap_id LEFT JOIN shared s ON s.hap_id = a.hap_id, len WHERE a.copy = 0")
def pair_heterozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both haplosomes of every individual."""
    t = Tables(spark, sf_dir)
    h = t.haplosome
    pairs = h.where("copy = 0").select(F.col("hap_id").alias("hap_a"), (F.col("hap_id") + 1).alias("hap_b")).join(h.select(F.col("hap_id").alias("hap_b")), "hap_b", "left_semi")
    return popgen.pair_heterozygosity(t.carries, pairs, t.length).select("hap_a", "hap_b", r("heterozygosity", 15).alias("heterozygosity"))


@query(V + "SELECT ind_id, mut_id, count(*) AS copies FROM carries JOIN haplosome USING (hap_id) GROUP BY 1, 2")
def zygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.zygosity(t.carries, t.haplosome)


@query(V + """, z AS (SELECT ind_id, mut_id, count(*) AS copies FROM carries JOIN haplosome USING (hap_id) GROUP BY 1, 2),
w AS (SELECT ind_id FROM haplosome GROUP BY 1 HAVING count(*) = 2),
m AS (SELECT DISTINCT ind_id, mut_id * 1000 AS position FROM z JOIN w USING (ind_id) WHERE copies = 1 UNION ALL SELECT ind_id, l::BIGINT + 1 FROM w, len),
g AS (SELECT ind_id, position - lag(position, 1, -1) OVER (PARTITION BY ind_id ORDER BY position) - 1 AS run FROM m)
SELECT ind_id, round(coalesce(sum(run) FILTER (WHERE run >= 50000), 0) / (any_value(l) + 1), 9) AS f_roh FROM g, len GROUP BY 1""")
def runs_of_homozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.runs_of_homozygosity(t.carries, t.haplosome, t.mutation, int(t.length), 50_000).select("ind_id", r("f_roh").alias("f_roh"))


@query(V + """, z AS (SELECT ind_id, mut_id, count(*) AS copies FROM carries JOIN haplosome USING (hap_id) GROUP BY 1, 2), pl AS (SELECT ind_id, count(*) AS ploidy FROM haplosome GROUP BY 1),
e AS (SELECT ind_id, greatest(0.0, 1 + CASE WHEN copies = 1 AND ploidy = 2 THEN dominance * s ELSE s END) AS f FROM z JOIN mutation USING (mut_id) JOIN pl USING (ind_id))
SELECT pl.ind_id, round(coalesce(product(f), 1.0), 9) AS fitness FROM pl LEFT JOIN e ON e.ind_id = pl.ind_id GROUP BY 1""")
def individual_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.fitness(t.carries, t.haplosome, t.mutation).select("ind_id", r("fitness").alias("fitness"))


# ---- genotypes


@query(V + "SELECT ind_id, count(m.mut_id) AS n FROM haplosome h LEFT JOIN carries c USING (hap_id) LEFT JOIN (SELECT mut_id FROM mutation WHERE mut_type = 2) m USING (mut_id) GROUP BY 1")
def mutations_of_type_by_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return genotypes.count_of_type(t.carries, t.haplosome, t.mutation, 2, "ind_id")


@query(V + "SELECT hap_id, round(coalesce(sum(m.s), 0), 9) AS total FROM haplosome h LEFT JOIN carries c USING (hap_id) LEFT JOIN (SELECT * FROM mutation WHERE mut_type = 2) m USING (mut_id) GROUP BY 1")
def effects_by_haplosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return genotypes.sum_of_type(t.carries, t.haplosome, t.mutation, 2).select("hap_id", r("total").alias("total"))


@query(V + "SELECT hap_id, list(position ORDER BY position) AS positions FROM carries JOIN mutation USING (mut_id) WHERE mut_type = 0 GROUP BY 1")
def positions_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return genotypes.positions_of_type(t.carries, t.mutation, 0)


@query(V + "SELECT DISTINCT hap_id FROM carries JOIN mutation USING (mut_id) WHERE position = 5000 AND mut_type = (SELECT mut_type FROM mutation WHERE position = 5000)")
def marker_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return genotypes.contains_marker(t.carries, t.mutation, t.mutation.where("position = 5000").first()["mut_type"], 5000)


@query(V + "SELECT * FROM carries WHERE mut_id NOT IN (SELECT mut_id FROM mutation WHERE mut_type = 1)")
def remove_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return genotypes.remove_mutations(t.carries, t.mutation.where("mut_type = 1").select("mut_id"))


@query(V + "SELECT * FROM carries UNION SELECT hap_id, 1 AS mut_id FROM haplosome WHERE subpop = 0")
def add_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return genotypes.add_mutations(t.carries, t.haplosome.where("subpop = 0").select("hap_id", F.lit(1).cast("bigint").alias("mut_id")))


@query(V + ", z AS (SELECT ind_id, mut_id, count(*) AS copies FROM carries JOIN haplosome USING (hap_id) GROUP BY 1, 2) SELECT ind_id, mut_id FROM z WHERE copies = 2")
def homozygous_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ploidy = t.haplosome.groupBy("ind_id").agg(F.count("*").alias("ploidy"))
    return genotypes.from_haplosomes(popgen.zygosity(t.carries, t.haplosome), ploidy, "homozygous").select("ind_id", "mut_id")


@query(V + ", k AS (SELECT *, row_number() OVER (PARTITION BY hap_id, mut_id // 10 ORDER BY mut_id DESC) AS place FROM carries) SELECT hap_id, mut_id FROM k WHERE place = 1")
def stacking_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last mutation of each haplosome in every ten positions."""
    t = Tables(spark, sf_dir)
    rows = t.carries.withColumn("position", F.expr("mut_id div 10")).withColumn("stack_group", F.lit(0)).withColumn("origin_tick", F.col("mut_id"))
    return genotypes.stack(rows, "l").select("hap_id", "mut_id")


@query(V + "SELECT mut_id, position FROM mutation WHERE mut_type = 1 AND position BETWEEN 10000 AND 900000 AND mut_id <> 12")
def subset_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = popgen.within(Tables(spark, sf_dir).mutation, 10_000, 900_000)
    return genotypes.subset_mutations(m, exclude=12, mut_type=1).select("mut_id", "position")


@query(V + "SELECT h.hap_id, concat_ws(' ', 'h' || h.hap_id, array_to_string(list_transform(list_sort(list(c.mut_id) FILTER (WHERE c.mut_id IS NOT NULL)), lambda x: CAST(x AS VARCHAR)), ' ')) AS value FROM haplosome h LEFT JOIN carries c USING (hap_id) WHERE EXISTS (SELECT 1 FROM carries d WHERE d.hap_id = h.hap_id) GROUP BY 1")
def native_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return state.haplosome_lines(t.carries, t.haplosome.join(t.carries, "hap_id", "left_semi"))


# ---- space

_NEAR = V + ", near AS (SELECT a.ind_id, b.ind_id AS e_ind_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM points a JOIN points b ON a.ind_id <> b.ind_id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.05 * 0.05) "


def _near(t: Tables, **more) -> DataFrame:
    return spatial.neighbors(t.points.select("ind_id", "x", "y"), t.points.select("ind_id", "x", "y"), 0.05, **more)


@query(_NEAR + "SELECT p.ind_id, count(n.d) AS n_neighbors FROM points p LEFT JOIN near n USING (ind_id) GROUP BY 1")
def neighbor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return spatial.count(t.points, _near(t))


@query(_NEAR + "SELECT ind_id, e_ind_id, place FROM (SELECT ind_id, e_ind_id, row_number() OVER (PARTITION BY ind_id ORDER BY d, e_ind_id) AS place FROM near) WHERE place <= 3")
def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).points
    return spatial.nearest_within(p, p, 3, 0.05).select("ind_id", "e_ind_id", "place")


for _kind, _args, _sql in (("f", (2.0,), "2.0 + 0 * d"), ("l", (2.0,), "2.0 * (1 - d / 0.05)"), ("e", (2.0, 40.0), "2.0 * exp(-40 * d)"), ("n", (2.0, 0.02), "2.0 * exp(-d * d / (2 * 0.02 * 0.02))"), ("c", (2.0, 0.02), "2.0 / (1 + pow(d / 0.02, 2))"), ("t", (2.0, 3.0, 0.02), "2.0 * pow(1 + pow(d / 0.02, 2) / 3, -2)")):

    def _strength(spark: SparkSession, sf_dir: str, kind: str = _kind, args: tuple = _args) -> DataFrame:
        t = Tables(spark, sf_dir)
        return spatial.total_strength(t.points, _near(t), spatial.kernel(kind, 0.05, *args)).select("ind_id", r("total", 6).alias("total"))

    QUERIES[f"kernel_total_{_kind}"] = _strength
    ORACLE[f"kernel_total_{_kind}"] = _NEAR + f"SELECT p.ind_id, round(coalesce(sum({_sql}), 0)::DOUBLE, 6) AS total FROM points p LEFT JOIN near n USING (ind_id) GROUP BY 1"


@query(V + ", w AS (SELECT ind_id, x - floor(x) AS x, y - floor(y) AS y FROM points), near AS (SELECT a.ind_id FROM w a JOIN w b ON a.ind_id <> b.ind_id WHERE pow(least(abs(a.x - b.x), 1 - abs(a.x - b.x)), 2) + pow(least(abs(a.y - b.y), 1 - abs(a.y - b.y)), 2) <= 0.05 * 0.05) SELECT w.ind_id, (SELECT count(*) FROM near n WHERE n.ind_id = w.ind_id) AS n_neighbors FROM w")
def neighbor_count_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = {"x": (0.0, 1.0), "y": (0.0, 1.0)}
    p = spatial.periodic(Tables(spark, sf_dir).points.select("ind_id", "x", "y"), unit)
    return spatial.count(p, spatial.neighbors(p, p, 0.05, periods={"x": 1.0, "y": 1.0}))


@query(V + "SELECT p.ind_id, count(b.ind_id) AS n_neighbors FROM points p LEFT JOIN points b ON b.sex = 1 AND p.ind_id <> b.ind_id AND pow(p.x - b.x, 2) + pow(p.y - b.y, 2) + pow(p.z - b.z, 2) <= 0.08 * 0.08 GROUP BY 1")
def interacting_count_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).points
    return spatial.count(p, spatial.neighbors(p, p.where("sex = 1"), 0.08, "xyz"))


@query(V + "SELECT ind_id, round(sqrt(pow(x, 2) + pow(y, 2)), 9) AS d FROM points ORDER BY sqrt(pow(x, 2) + pow(y, 2)), ind_id LIMIT 10")
def nearest_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_of_point(Tables(spark, sf_dir).points, (0.0, 0.0), 10, 10.0).select("ind_id", r("d").alias("d"))


@query(V + "SELECT ind_id, greatest(-0.1, least(0.1, x)) AS x, greatest(-0.1, least(0.1, y)) AS y, x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AS inside FROM points")
def points_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = {"x": (-0.1, 0.1), "y": (-0.1, 0.1)}
    p = Tables(spark, sf_dir).points.withColumn("inside", spatial.in_bounds(b))
    return spatial.stopped(p, b).select("ind_id", "x", "y", "inside")


_B = (-0.5, -0.5, 0.5, 0.5)


def _grid(spark: SparkSession, n: int = 11) -> maps.Grid:
    v = spark.range(n * n).select((F.col("id") % n).alias("i"), F.expr(f"id div {n}").alias("j"))
    return maps.Grid(v.withColumn("value", (F.col("i") * 3 + F.col("j") * F.col("j")).cast("double")), n, n, _B)


_G = V + ", grid AS (SELECT i, j, (i * 3 + j * j)::DOUBLE AS value FROM range(11) t(i), range(11) u(j)) "


@query(_G + ", c AS (SELECT floor((x + 0.5) * 10 + 0.5)::BIGINT AS i, floor((y + 0.5) * 10 + 0.5)::BIGINT AS j, count(*) AS n FROM points WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5 GROUP BY 1, 2) SELECT i, j, round(coalesce(n, 0) / (0.01 * CASE WHEN i IN (0, 10) THEN 0.5 ELSE 1 END * CASE WHEN j IN (0, 10) THEN 0.5 ELSE 1 END)::DOUBLE, 6) AS value FROM grid LEFT JOIN c USING (i, j)")
def summarize_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.summarize(Tables(spark, sf_dir).points, _grid(spark), F.count("*"), per_unit_area=True).select("i", "j", r("value", 6).alias("value"))


@query(_G + "SELECT ind_id, value AS map_value FROM points p LEFT JOIN grid ON i = floor((x + 0.5) * 10 + 0.5) AND j = floor((y + 0.5) * 10 + 0.5)")
def map_value_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark).nearest_values(Tables(spark, sf_dir).points).select("ind_id", "map_value")


@query(_G + ", f AS (SELECT ind_id, (x + 0.5) * 10 AS fx, (y + 0.5) * 10 AS fy, least(floor((x + 0.5) * 10), 9)::BIGINT AS i0, least(floor((y + 0.5) * 10), 9)::BIGINT AS j0 FROM points WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5) SELECT ind_id, round(sum((CASE WHEN i = i0 THEN 1 - (fx - i0) ELSE fx - i0 END) * (CASE WHEN j = j0 THEN 1 - (fy - j0) ELSE fy - j0 END) * value), 6) AS map_value FROM f JOIN grid ON i BETWEEN i0 AND i0 + 1 AND j BETWEEN j0 AND j0 + 1 GROUP BY 1")
def map_value_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).points.where("x between -0.5 and 0.5 and y between -0.5 and 0.5")
    return _grid(spark).linear_values(p, "ind_id").select("ind_id", F.round("map_value", 6).alias("map_value"))


@query(_G + ", e AS (SELECT *, (CASE WHEN i IN (0, 10) THEN 0.5 ELSE 1 END * CASE WHEN j IN (0, 10) THEN 0.5 ELSE 1 END)::DOUBLE AS c FROM grid) SELECT a.i, a.j, round(sum(exp(-50 * (pow((a.i - b.i) * 0.1, 2) + pow((a.j - b.j) * 0.1, 2))) * c * b.value) / sum(exp(-50 * (pow((a.i - b.i) * 0.1, 2) + pow((a.j - b.j) * 0.1, 2))) * c), 6) AS value FROM grid a JOIN e b ON sqrt(pow((a.i - b.i) * 0.1, 2) + pow((a.j - b.j) * 0.1, 2)) <= 0.25 GROUP BY 1, 2")
def map_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math as m

    return _grid(spark).smooth(0.25, lambda d: m.exp(-50 * d * d)).values.select("i", "j", r("value", 6).alias("value"))


@query(_G + "SELECT i, j, round(0.25 * (value * 2) + 0.75 * ((value - 0) / 130 * 5), 9) AS value FROM grid")
def map_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark)
    return g.rescale(0.0, 5.0).blend(g.multiply(2.0), 0.25).values.select("i", "j", r("value").alias("value"))


@query(_G + ", f AS (SELECT i, j, i / 2.0::DOUBLE AS x, j / 2.0::DOUBLE AS y FROM range(21) t(i), range(21) u(j)) SELECT f.i, f.j, round(sum((1 - abs(x - grid.i)) * (1 - abs(y - grid.j)) * value), 9) AS value FROM f JOIN grid ON abs(x - grid.i) < 1 AND abs(y - grid.j) < 1 GROUP BY 1, 2")
def map_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark).interpolate(2).values.select("i", "j", r("value").alias("value"))


# ---- pedigree, genome, ancestry

_PED = "ped AS (SELECT c_custkey AS ind_id, c_custkey // 2 AS p1, c_custkey // 3 AS p2, c_custkey // 4 AS g1, c_custkey // 6 AS g2, c_custkey // 6 AS g3, c_custkey // 9 AS g4 FROM customer) "


@query("WITH " + _PED + "SELECT a.ind_id AS a, b.ind_id AS b, CASE WHEN (a.p1 = b.p1 AND a.p2 = b.p2) OR (a.p1 = b.p2 AND a.p2 = b.p1) THEN 2 WHEN a.p1 = b.p1 OR a.p1 = b.p2 OR a.p2 = b.p1 OR a.p2 = b.p2 THEN 1 ELSE 0 END AS shared FROM ped a JOIN ped b ON b.ind_id = a.ind_id + 1")
def shared_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related_pairs(spark, sf_dir).select("a", "b", pedigree.shared_parent_count().alias("shared"))


def _related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ped = Tables(spark, sf_dir).customer.select(k.alias("ind_id"), *[F.expr(f"c_custkey div {d}").alias(n) for n, d in zip(pedigree.IDS[1:], (2, 3, 4, 6, 6, 9))])
    asked = ped.select(F.col("ind_id").alias("a"), (F.col("ind_id") + 1).alias("b"))
    return pedigree.pairs(asked, ped)


@query()
def relatedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related_pairs(spark, sf_dir).select("a", "b", pedigree.relatedness().alias("relatedness"))


@query("WITH m AS (SELECT p_partkey * 5000 AS start, coalesce(lead(p_partkey * 5000) OVER (ORDER BY p_partkey), 200000000) - 1 AS stop, p_size * 1e-8 AS rate FROM part), o AS (SELECT o_orderkey, o_orderkey * 700 AS position FROM orders) SELECT o_orderkey, start, round(rate, 15) AS rate FROM o LEFT JOIN m ON position BETWEEN start AND stop")
def rate_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a map from starts, at positions."""
    t = Tables(spark, sf_dir)
    m = genome.from_starts(t.part.select((F.col("p_partkey") * 5000).alias("start"), F.col("p_size").alias("rate")), 199_999_999, 1e-8)
    p = t.orders.select("o_orderkey", (F.col("o_orderkey") * 700).alias("position"))
    return genome.at_positions(p, m).select("o_orderkey", "start", r("rate", 15).alias("rate"))


@query()
def recombination_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    m = genome.from_ends(t.part.select((F.col("p_partkey") * 1000).alias("end"), (F.col("p_size") * 1e-8).alias("rate")))
    return genome.breakpoints(t.haplosome, m, 2.0, 5, "hap_id")


_SETS = V + ", gt AS (SELECT hap_id AS sample, mut_id AS site FROM carries), sets AS (SELECT subpop AS sample_set, hap_id AS sample FROM haplosome), ns AS (SELECT sample_set, count(*) AS n FROM sets GROUP BY 1), c AS (SELECT site, sample_set, coalesce(k, 0) AS c, n FROM (SELECT DISTINCT site FROM gt), ns LEFT JOIN (SELECT site AS s2, sample_set AS ss, count(*) AS k FROM gt JOIN sets USING (sample) GROUP BY 1, 2) ON s2 = site AND ss = sample_set) "


def _counts(t: Tables) -> tuple[DataFrame, DataFrame]:
    gt = t.carries.select(F.col("hap_id").alias("sample"), F.col("mut_id").alias("site"))
    return gt, ancestry.counts(gt, t.haplosome.select(F.col("subpop").alias("sample_set"), F.col("hap_id").alias("sample")))


@query(_SETS + "SELECT floor(site * 1000 / 200000.0)::BIGINT AS window, sample_set, round(sum(2.0::DOUBLE * c * (n - c) / (n * (n - 1))) / 200000, 15) AS stat FROM c GROUP BY 1, 2")
def ancestry_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    sites = t.mutation.select(F.col("mut_id").alias("id"), "position")
    return ancestry.general_stat(_counts(t)[1], sites, ancestry.diversity_value(), 200_000.0).select("window", "sample_set", r("stat", 15).alias("stat"))


@query(_SETS + "SELECT sample_set, sum((c > 0 AND c < n)::INT)::DOUBLE AS stat FROM c GROUP BY 1")
def ancestry_segregating(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return ancestry.general_stat(_counts(t)[1], t.mutation, ancestry.segregating_value())


@query(_SETS + "SELECT x.sample_set AS a, y.sample_set AS b, round(sum(CASE WHEN x.sample_set = y.sample_set THEN 2.0::DOUBLE * x.c * (x.n - x.c) / (x.n * (x.n - 1)) ELSE (x.c * (y.n - y.c) + (x.n - x.c) * y.c)::DOUBLE / (x.n * y.n) END), 6) AS stat FROM c x JOIN c y ON x.site = y.site AND x.sample_set <= y.sample_set GROUP BY 1, 2")
def ancestry_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.divergence(_counts(Tables(spark, sf_dir))[1]).select("a", "b", r("stat", 6).alias("stat"))


@query(_SETS + ", m AS (SELECT site, avg(c::DOUBLE / n) AS mean FROM c GROUP BY 1) SELECT x.sample_set AS a, y.sample_set AS b, round(sum((x.c::DOUBLE / x.n - mean) * (y.c::DOUBLE / y.n - mean)), 9) AS stat FROM c x JOIN c y ON x.site = y.site AND x.sample_set <= y.sample_set JOIN m ON m.site = x.site GROUP BY 1, 2")
def ancestry_relatedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.genetic_relatedness(_counts(Tables(spark, sf_dir))[1]).select("a", "b", r("stat").alias("stat"))


@query(_SETS + "SELECT counts, count(*) AS n_sites FROM (SELECT site, list(c ORDER BY sample_set) AS counts FROM c GROUP BY 1) GROUP BY 1")
def ancestry_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.frequency_spectrum(_counts(Tables(spark, sf_dir))[1])


@query(V + ", y AS (SELECT o_orderkey AS sample, o_totalprice / 1000 AS trait FROM orders), a AS (SELECT count(*)::DOUBLE AS n, sum(trait) AS sy, sum(trait * trait) AS syy FROM y), o AS (SELECT mut_id AS site, count(*)::DOUBLE AS c, sum(trait) AS sxy FROM carries JOIN y ON sample = hap_id GROUP BY 1), s AS (SELECT site, n, sxy - c * sy / n AS sxy, c - c * c / n AS sxx, syy - sy * sy / n AS syy FROM o, a) SELECT site, round(sxy * sxy / (sxx * syy), 9) AS correlation_sq, round(sxy / sxx, 6) AS slope FROM s")
def trait_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    traits = t.orders.select(F.col("o_orderkey").alias("sample"), (F.col("o_totalprice") / 1000).alias("trait"))
    return ancestry.trait_stats(_counts(t)[0], traits).select("site", r("correlation_sq").alias("correlation_sq"), r("slope", 6).alias("slope"))


@query(V + ", w AS (SELECT hap_id, (hap_id % 7)::DOUBLE AS w FROM haplosome), ld AS (SELECT mut_id, sum(w) AS load FROM carries JOIN w USING (hap_id) GROUP BY 1), t AS (SELECT f.mut_id, f.p, load - f.p * (SELECT sum(w) FROM w) AS t FROM freq f JOIN ld USING (mut_id)), b AS (SELECT sum(p * t) AS base FROM t), o AS (SELECT hap_id, sum(t) AS own FROM carries JOIN t USING (mut_id) GROUP BY 1) SELECT h.hap_id AS sample, round(coalesce(own, 0) - base, 4) AS value FROM haplosome h LEFT JOIN o USING (hap_id), b")
def relatedness_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    s = t.haplosome.select(F.col("hap_id").alias("sample"))
    return ancestry.relatedness_vector(_counts(t)[0], s, s.withColumn("w", (F.col("sample") % 7).cast("double"))).select("sample", F.round("value", 4).alias("value"))


@query(V + ", pr AS (SELECT mut_id AS a, mut_id + 1 AS b FROM mutation), both_ AS (SELECT x.mut_id AS a, count(*) AS k FROM carries x JOIN carries y ON x.hap_id = y.hap_id AND y.mut_id = x.mut_id + 1 GROUP BY 1), q AS (SELECT pr.a, pr.b, fa.p, fb.p AS q, coalesce(k, 0)::DOUBLE / fa.n AS pq FROM pr JOIN freq fa ON fa.mut_id = pr.a JOIN freq fb ON fb.mut_id = pr.b LEFT JOIN both_ ON both_.a = pr.a) SELECT a, b, round(pq - p * q, 12) AS d, round((pq - p * q) / sqrt(p * (1 - p) * q * (1 - q)), 9) AS r FROM q")
def two_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    pairs = t.mutation.select(F.col("mut_id").alias("a"), (F.col("mut_id") + 1).alias("b"))
    return ancestry.two_locus(_counts(t)[0], pairs, t.haplosome.count()).select("a", "b", r("d", 12).alias("d"), r("r").alias("r"))


def _tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers below nations below regions below one root; the second half of the genome has another root's regions."""
    nation, region = F.col("c_nationkey") + 1_000_000, F.col("n_regionkey") + 2_000_000
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("time")).union(t.nation.select((F.col("n_nationkey") + 1_000_000).cast("bigint"), F.lit(1.0))).union(t.region.select((F.col("r_regionkey") + 2_000_000).cast("bigint"), F.lit(2.0))).union(t.spark.createDataFrame([(3_000_000, 3.0)], "id bigint, time double"))
    edge = lambda df, l, r_, parent, child: df.select(F.lit(l).alias("left"), F.lit(r_).alias("right"), parent.cast("bigint").alias("parent"), child.cast("bigint").alias("child"))
    n = t.nation
    edges = edge(t.customer, 0.0, 10.0, nation, F.col("c_custkey")).union(edge(n, 0.0, 10.0, region, F.col("n_nationkey") + 1_000_000)).union(edge(t.region, 0.0, 10.0, F.lit(3_000_000), F.col("r_regionkey") + 2_000_000))
    return nodes, edges


_MRCA = "SELECT a.c_custkey AS a, b.c_custkey AS b, 0.0::DOUBLE AS \"left\", 10.0::DOUBLE AS \"right\", CASE WHEN a.c_nationkey = b.c_nationkey THEN a.c_nationkey + 1000000 WHEN x.n_regionkey = y.n_regionkey THEN x.n_regionkey + 2000000 ELSE 3000000 END::BIGINT AS mrca, CASE WHEN a.c_nationkey = b.c_nationkey THEN 1.0 WHEN x.n_regionkey = y.n_regionkey THEN 2.0 ELSE 3.0 END::DOUBLE AS time FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN nation x ON x.n_nationkey = a.c_nationkey JOIN nation y ON y.n_nationkey = b.c_nationkey"


def _mrcas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    nodes, edges = _tree(t)
    above = ancestry.ancestors(t.customer.select(F.col("c_custkey").alias("start")), edges)
    pairs = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return ancestry.common_ancestors(pairs, above, nodes)


@query(_MRCA)
def common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mrcas(spark, sf_dir)


@query(f"SELECT time::BIGINT AS bin, sum(\"right\" - \"left\") AS weight FROM ({_MRCA}) GROUP BY 1")
def coalescence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.coalescence_counts(_mrcas(spark, sf_dir), [0.0, 1.0, 2.0, 3.0]).select(F.col("bin").cast("bigint").alias("bin"), "weight")


@query(f"SELECT a, b, mrca, \"left\", \"right\" FROM ({_MRCA}) WHERE time <= 2")
def identity_by_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.identity_by_descent(_mrcas(spark, sf_dir), 1.0, 2.0)


@query("""WITH node AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0), edge AS (SELECT c_custkey AS child, c_nationkey + 1000000 AS parent, c_custkey % 11 = 0 AS hollow, c_custkey % 13 = 0 AS young FROM customer),
mut AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS site, l_suppkey AS node FROM lineitem), site AS (SELECT p_partkey AS id, p_partkey // 2 AS position FROM part WHERE p_partkey % 5 <> 0)
SELECT * FROM (SELECT 'edge without a child node' AS problem, count(*) AS n FROM edge WHERE child NOT IN (SELECT id FROM node) UNION ALL SELECT 'edge with an empty interval', count(*) FROM edge WHERE hollow
UNION ALL SELECT 'parent not older than its child', count(*) FROM edge WHERE young AND child IN (SELECT id FROM node) UNION ALL SELECT 'mutation without a site', count(*) FROM mut WHERE site NOT IN (SELECT id FROM site)
UNION ALL SELECT 'mutation without a node', count(*) FROM mut WHERE node NOT IN (SELECT id FROM node) UNION ALL SELECT 'two sites at one position', count(*) FROM (SELECT position FROM site GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""")
def ancestry_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of customers below nations with planted faults: missing nodes and sites, hollow edges, children as old as their parents."""
    t = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    nodes = t.customer.where(k % 7 != 0).select(k.alias("id"), F.when(k % 13 == 0, 1.0).otherwise(0.0).alias("time")).union(t.nation.select((F.col("n_nationkey") + 1_000_000).cast("bigint"), F.lit(1.0)))
    edges = t.customer.select(F.lit(0.0).alias("left"), F.when(k % 11 == 0, 0.0).otherwise(100.0).alias("right"), (F.col("c_nationkey") + 1_000_000).cast("bigint").alias("parent"), k.alias("child"))
    sites = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("position"))
    mutations = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("node"))
    return ancestry.integrity_errors(nodes, edges, sites, mutations)


# ---- dictionaries, logs, simulation


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def dictionary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.select("event_id", frames.get_value(frames.from_json("props"), "k").alias("k"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS idx FROM customer")
def data_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.with_index(Tables(spark, sf_dir).customer, "c_acctbal", "c_custkey").select("c_custkey", "idx")


_TICK = "datediff('hour', TIMESTAMP '2024-01-01', ts)"


@query(f"SELECT CAST({_TICK} AS BIGINT) AS tick, count(*) AS num_individuals, round(avg(value), 6) AS v_mean, round(stddev_samp(value), 6) AS v_sd FROM events WHERE {_TICK} % 10 = 0 GROUP BY 1")
def tick_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.withColumn("tick", F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600))
    log = TickLog(interval=10).population_size().mean_sd("v", F.col("value"))
    return log.rows(e).select("tick", "num_individuals", r("v_mean", 6).alias("v_mean"), r("v_sd", 6).alias("v_sd"))


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(Tables(spark, sf_dir).events, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query()
def wright_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of two subpopulations; mutation frequencies afterwards."""
    from ..sources.state import fresh

    model = simulation.Model({1: 60, 2: 60}, [(1, 2, 0.05), (2, 1, 0.05)], 99_999, 1e-5, 1e-5, ((1, 1.0, "n", (0.0, 0.01), 0.5),))
    end = simulation.run(simulation.start(spark, model), model, 2, fresh)
    return popgen.frequencies(popgen.mutation_counts(end.carries), end.haplosome).join(end.mutation.select("mut_id", "position", "s"), "mut_id")
