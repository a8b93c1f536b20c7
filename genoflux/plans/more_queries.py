"""More registered queries: logic, vectors in cells, strings, matrices, frames, file formats, maps, logs and ancestry tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, colors, math, nucleotides, stats, strings
from ..functions import distributions as draw
from ..operators import ancestry, frames, genotypes, maps, matrix, popgen, spatial, vectors
from ..sources import fasta, ms, state, text, vcf
from ..streaming.ticklog import TickLog
from .queries import _B, _G, _MRCA, _NEAR, _SEQ, Tables, V, _grid, _mrcas, _sequences, _tree, query, r

# ---- functions


@query(
    V
    + """SELECT idx, CASE WHEN v > 50 THEN idx ELSE -idx END AS chosen, greatest(v, 50) AS high, least(v, 50) AS low, v > 10 AND v < 60 AND user_id % 2 = 0 AS every, v < 10 OR v > 60 AS some,
event_type || CAST(user_id AS VARCHAR) AS joined, event_type || ' / ' || CAST(idx AS VARCHAR) AS pasted, event_type || CAST(idx AS VARCHAR) AS pasted0, printf('%05.2f', v) AS formatted FROM vals"""
)
def logic_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice, extremes of two, conjunction and disjunction, concatenation, pasting and formatting."""
    v, even = F.col("v"), F.col("user_id") % 2 == 0
    return Tables(spark, sf_dir).values.select(
        "idx",
        math.if_else(v > 50, F.col("idx"), -F.col("idx")).alias("chosen"),
        math.pmax(v, F.lit(50.0)).alias("high"),
        math.pmin(v, F.lit(50.0)).alias("low"),
        math.all_of(v > 10, v < 60, even).alias("every"),
        math.any_of(v < 10, v > 60).alias("some"),
        math.plus_text("event_type", "user_id").alias("joined"),
        strings.paste("event_type", "idx", sep=" / ").alias("pasted"),
        strings.paste0("event_type", "idx").alias("pasted0"),
        strings.format_number("%05.2f", v).alias("formatted"),
    )


@query(V + "SELECT user_id, round(product(1 + v / 1000), 6) AS product, [min(v), max(v)] AS span FROM vals GROUP BY user_id")
def product_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).values.groupBy("user_id").agg(F.round(stats.product(1 + F.col("v") / 1000), 6).alias("product"), stats.value_range("v").alias("span"))


@query(
    V
    + """, s AS (SELECT idx, CAST(idx AS VARCHAR) AS t, v, CASE WHEN idx % 2 = 0 THEN 'true' ELSE 'false' END AS b FROM vals)
SELECT idx, CAST(t AS DOUBLE) AS f, CAST(t AS BIGINT) AS i, trunc(v)::BIGINT AS whole, CAST(b AS BOOLEAN) AS l, t AS s FROM s"""
)
def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).values.withColumn("t", strings.as_string("idx")).withColumn("b", F.when(F.col("idx") % 2 == 0, "true").otherwise("false"))
    return t.select("idx", strings.as_float("t").alias("f"), strings.as_integer("t").alias("i"), strings.as_integer("v").alias("whole"), strings.as_logical("b").alias("l"), strings.as_string("t").alias("s"))


_KINDS = {"event_id": "integer", "ts": "object", "user_id": "integer", "event_type": "string", "value": "float", "props": "string"}


@query("SELECT column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'BOOLEAN' THEN 'logical' ELSE 'object' END AS kind, true AS tested FROM information_schema.columns WHERE table_name = 'events'")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of a table are in the array language, by name and by test."""
    e = Tables(spark, sf_dir).events
    kinds = {c: strings.element_type(e, c) for c in e.columns}
    return spark.createDataFrame([(c, k, strings.is_type(e, c, k)) for c, k in kinds.items()], "name string, kind string, tested boolean")


@query(
    """SELECT o_orderkey AS k, list_concat(list_transform(range(0, o_orderkey % 4), lambda i: 0.0::DOUBLE), [o_totalprice]) AS c, list_transform(range(0, o_orderkey % 3), lambda i: false) AS f, list_transform(range(0, o_orderkey % 3), lambda i: '') AS e,
[0, 0, 1, 0]::BIGINT[] AS marked, range(2, 9, 3) AS s, [1.0, 1.5, 2.0, 2.5]::DOUBLE[] AS h, range(0, 4) AS along, [x[1], x[4]] AS picked, list_filter(x, lambda i: i > 40) AS masked, list_reverse(x) AS back, list_sort(x) AS up,
list_transform([1, 2], lambda i: list_position(x, 50) - 1)::BIGINT[] AS at, list_filter(range(0, 4), lambda i: x[i + 1] > 40) AS here, list_concat([x[1], x[1]], [x[2], x[2]]) AS twice
FROM (SELECT *, [o_orderkey % 97, 50, o_custkey % 89, 7]::BIGINT[] AS x FROM orders)"""
)
def array_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Construction, concatenation, indexing, masking, sorting, matching and repetition of vectors in cells."""
    k = F.col("o_orderkey")
    d = Tables(spark, sf_dir).orders.withColumn("x", F.array(k % 97, F.lit(50).cast("bigint"), F.col("o_custkey") % 89, F.lit(7).cast("bigint")).cast("array<bigint>"))
    longs = lambda *v: F.array(*map(F.lit, v)).cast("array<bigint>")
    return d.select(
        k.alias("k"),
        arrays.concatenate(arrays.zeros(k % 4), F.array("o_totalprice")).alias("c"),
        arrays.falses(k % 3).alias("f"),
        arrays.empties(k % 3).alias("e"),
        arrays.integers(4, 0, 1, [2]).alias("marked"),
        arrays.seq(2, 8, 3).alias("s"),
        arrays.seq(1.0, 2.5, 0.5).alias("h"),
        arrays.seq_along("x").alias("along"),
        arrays.subset("x", longs(0, 3)).alias("picked"),
        arrays.mask("x", F.transform("x", lambda i: i > 40)).alias("masked"),
        arrays.reverse("x").alias("back"),
        arrays.sort("x").alias("up"),
        arrays.match(longs(50, 50), "x").cast("array<bigint>").alias("at"),
        arrays.which(F.transform("x", lambda i: i > 40)).alias("here"),
        arrays.rep_each(F.slice("x", 1, 2), 2).alias("twice"),
    )


@query(
    """WITH x AS (SELECT p_partkey AS k, (p_partkey * 37 % 256) / 255.0::DOUBLE AS r, (p_partkey * 91 % 256) / 255.0::DOUBLE AS g, (p_partkey * 53 % 256) / 255.0::DOUBLE AS b FROM part)
SELECT k, printf('#%02X%02X%02X', k * 37 % 256, k * 91 % 256, k * 53 % 256) AS color, printf('#%02X%02X%02X', k * 37 % 256, k * 37 % 256, k * 37 % 256) AS gray, [round(r, 6), round(g, 6), round(b, 6)] AS rgb, [round(r, 6), round(g, 6), round(b, 6)] AS back,
round(greatest(r, g, b), 6) AS bright FROM x"""
)
def color_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers to colours and back, through the other colour space too."""
    k = F.col("p_partkey")
    x = Tables(spark, sf_dir).part.select(k.alias("k"), *[((k * m % 256) / 255.0).alias(c) for c, m in (("r", 37), ("g", 91), ("b", 53))])
    x = x.withColumn("color", colors.rgb_to_color("r", "g", "b")).withColumn("hsv", colors.rgb_to_hsv("r", "g", "b"))
    short = lambda c: F.transform(c, lambda v: F.round(v, 6))
    back = colors.hsv_to_rgb(F.col("hsv")[0], F.col("hsv")[1], F.col("hsv")[2])
    return x.select("k", "color", colors.gray("r").alias("gray"), short(colors.color_to_rgb("color")).alias("rgb"), short(back).alias("back"), F.round(F.col("hsv")[2], 6).alias("bright"))


@query("SELECT * FROM (VALUES ('rainbow', ['#FF0000', '#FFFF00', '#00FF00', '#00FFFF', '#0000FF', '#FF00FF']), ('heat', ['#FF0000', '#FF8000', '#FFFF55', '#FFFFFF']), ('cyan_magenta', ['#00FFFF', '#FFFFFF', '#FF00FF'])) t(name, ramp)")
def color_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ramps' known colours: six hues, red over yellow to white, cyan over white to magenta."""
    heat = colors.heat(7)
    return spark.createDataFrame([("rainbow", colors.rainbow(6)), ("heat", [heat[0], heat[2], heat[4], heat[6]]), ("cyan_magenta", colors.cyan_magenta(3))], "name string, ramp array<string>")


@query(V + "SELECT idx, round(v * v * exp(-v / 2) / (2 * 8), 12) AS gamma, round(12 * u * (1 - u) * (1 - u), 12) AS beta FROM (SELECT idx, abs(v) + 0.5 AS v, abs(v) / (abs(v) + 1) AS u FROM vals)")
def gamma_and_beta_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma density with mean 6 and shape 3, beta density with parameters 2 and 3."""
    v = F.abs("v")
    return Tables(spark, sf_dir).values.select("idx", F.round(draw.dgamma(v + 0.5, 6.0, 3.0), 12).alias("gamma"), F.round(draw.dbeta(v / (v + 1), 2.0, 3.0), 12).alias("beta"))


@query(
    """SELECT name, true AS mean_ok, true AS sd_ok FROM (VALUES ('runif'), ('rdunif'), ('rnorm'), ('rlnorm'), ('rexp'), ('rlaplace'), ('rweibull'), ('rgeom'), ('rgamma'), ('rbeta'), ('rpois'), ('rbinom'), ('rnbinom'), ('rf'), ('rztpois')) t(name)"""
)
def draw_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws for every event: whether mean and deviation lie within six standard errors of the distribution's."""
    one = F.lit(1.0)
    e = 2.718281828459045
    known = {  # draws, mean, deviation, kurtosis
        "runif": (draw.runif(1, "idx"), 0.5, (1 / 12) ** 0.5, 1.8),
        "rdunif": (draw.rdunif(2, "idx", low=1, high=6), 3.5, (35 / 12) ** 0.5, 1.8),
        "rnorm": (draw.rnorm(3, "idx", mean=2.0, sd=3.0), 2.0, 3.0, 3.0),
        "rlnorm": (draw.rlnorm(4, "idx", meanlog=0.0, sdlog=0.25), e**0.03125, (e**0.0625 * (e**0.0625 - 1)) ** 0.5, 5.0),
        "rexp": (draw.rexp(5, "idx", mu=2.0), 2.0, 2.0, 9.0),
        "rlaplace": (draw.rlaplace(6, "idx", b=1.5), 0.0, 1.5 * 2**0.5, 6.0),
        "rweibull": (draw.rweibull(7, "idx", scale=2.0, shape=1.0), 2.0, 2.0, 9.0),
        "rgeom": (draw.rgeom(8, "idx", p=0.25), 3.0, 12**0.5, 9.1),
        "rgamma": (draw.rgamma(9, "idx", mean=one * 6.0, shape=one * 3.0), 6.0, 12**0.5, 5.0),
        "rbeta": (draw.rbeta(10, "idx", alpha=one * 2.0, beta=one * 3.0), 0.4, 0.2, 2.4),
        "rpois": (draw.rpois(11, "idx", lam=one * 4.0), 4.0, 2.0, 3.3),
        "rbinom": (draw.rbinom(12, "idx", size=F.lit(10), p=one * 0.3), 3.0, 2.1**0.5, 2.9),
        "rnbinom": (draw.rnbinom(13, "idx", size=one * 5.0, p=one * 0.5), 5.0, 10**0.5, 4.4),
        "rf": (draw.rf(14, "idx", d1=one * 10.0, d2=one * 40.0), 40 / 38, (2 * 1600 * 48 / (10 * 38 * 38 * 36)) ** 0.5, 7.0),
        "rztpois": (draw.rztpois(15, "idx", lam=one * 2.0), 2 / (1 - e**-2), (6 / (1 - e**-2) - (2 / (1 - e**-2)) ** 2) ** 0.5, 4.0),
    }
    v = Tables(spark, sf_dir).values
    drawn = v.select(*[x.cast("double").alias(k) for k, (x, *_) in known.items()])
    a = drawn.agg(F.count("*").alias("n"), *[f(k).alias(f"{k}_{n}") for k in known for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    root = F.sqrt("n")
    ok = lambda k, m, s, q: F.struct(F.lit(k).alias("name"), (F.abs(F.col(f"{k}_mean") - m) <= 6 * s / root).alias("mean_ok"), (F.abs(F.col(f"{k}_sd") - s) <= 6 * s * ((q - 1) ** 0.5) / 2 / root).alias("sd_ok"))
    return a.select(F.inline(F.array(*[ok(k, m, s, q) for k, (_, m, s, q) in known.items()])))


@query(f"SELECT p_partkey, list_transform(range(0, 12), lambda i: instr('ACGT', substr({_SEQ}, CAST(i + 1 AS INT), 1)) - 1)::BIGINT[] AS codes FROM part")
def codon_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nucleotides to codons and back."""
    c = _sequences(Tables(spark, sf_dir)).select("p_partkey", nucleotides.to_codons(nucleotides.to_codes("seq")).alias("codons"))
    return c.select("p_partkey", F.flatten(F.transform("codons", nucleotides.codon_bases)).cast("array<bigint>").alias("codes"))


@query("SELECT i AS row, j AS col, CASE WHEN i = j THEN 0.0 ELSE 0.25 END::DOUBLE AS value FROM range(4) t(i), range(4) u(j)")
def jukes_cantor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleotides.jukes_cantor(spark, 0.25).select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value")


# ---- vectors, matrices and frames


@query(V + "SELECT idx, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0::DOUBLE AS rank, row_number() OVER (ORDER BY w, idx) AS first, row_number() OVER (ORDER BY v DESC, idx) - 1 AS place, round(0.25 * lag(v, 1, 0) OVER (ORDER BY idx) + 0.5 * v + 0.25 * lead(v, 1, 0) OVER (ORDER BY idx), 6) AS filtered FROM (SELECT *, floor(v) AS w FROM vals)")
def whole_table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, order and a centred filter over a whole table, by ranges."""
    v = Tables(spark, sf_dir).values.select("idx", "v", F.floor("v").alias("w"))
    out = vectors.rank(vectors.rank(v, "w", "idx"), "w", "idx", "first", name="first")
    out = out.join(vectors.order(v, "v", "idx", False), "idx").join(vectors.centered_filter(v.select("idx", "v"), "v", "idx", [0.25, 0.5, 0.25], 0.0).select("idx", F.round("filtered", 6).alias("filtered")), "idx")
    return out.select("idx", F.col("rank").cast("double").alias("rank"), F.col("first").cast("bigint").alias("first"), "place", "filtered")


@query("SELECT kind, n FROM (SELECT 'which' AS kind, count(*) AS n FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'same', 1 UNION ALL SELECT 'different', 0)")
def which_and_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that meet a test; a table with itself in another order, and with a row twice."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    same, more = vectors.identical(o, o.orderBy("o_totalprice")), vectors.identical(o, o.unionByName(o.limit(1)))
    told = spark.createDataFrame([("same", int(same)), ("different", int(more))], "kind string, n bigint")
    return vectors.which(o, F.col("o_totalprice") > 1000, "o_orderkey").agg(F.lit("which").alias("kind"), F.count("*").alias("n")).union(told)


_M = "WITH a AS (SELECT l_suppkey % 20 AS row, CAST(l_linenumber - 1 AS BIGINT) AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) "


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).lineitem.groupBy((F.col("l_suppkey") % 20).alias("row"), (F.col("l_linenumber") - 1).cast("bigint").alias("col")).agg(F.sum("l_quantity").alias("value"))


@query(_M + "SELECT 'lower' AS kind, row, col, value FROM a WHERE row >= col UNION ALL SELECT 'diagonal', row, row, value FROM a WHERE row = col UNION ALL SELECT 'cbind', row, col, value FROM a UNION ALL SELECT 'cbind', row, col + 7, value FROM a UNION ALL SELECT 'dim', max(row) + 1, max(col) + 1, 0 FROM a UNION ALL SELECT 'largest', row, 0, max(value) FROM a GROUP BY row UNION ALL SELECT 'vector', col * 20 + row, 0, value FROM a UNION ALL SELECT 'identity', i, i, 2.0 FROM range(3) t(i)")
def matrix_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangle, diagonal, columns bound, dimensions, an aggregate by row, a matrix as a vector, and a diagonal one."""
    a = _a(spark, sf_dir)
    zero = F.lit(0).cast("bigint")
    part = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value"))
    d = matrix.diagonal(a)
    parts = [
        part("lower", a.where(matrix.lower_triangle(True))),
        part("diagonal", d.select(F.col("idx").alias("row"), F.col("idx").alias("col"), "value")),
        part("cbind", matrix.cbind((a, 7), (a, 7))),
        part("dim", matrix.dim(a).select(F.col("nrow").alias("row"), F.col("ncol").alias("col"), F.lit(0.0).alias("value"))),
        part("largest", matrix.margin_apply(a, "row", F.max("value")).withColumn("col", zero)),
        part("vector", matrix.to_vector(a, 20).select(F.col("idx").alias("row"), zero.alias("col"), "value")),
        part("identity", matrix.identity(spark, 3, 2.0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT a.n_nationkey AS row, b.r_regionkey AS col, (a.n_nationkey + 1) * (b.r_regionkey + 2)::DOUBLE AS value FROM nation a, region b")
def outer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    x = t.nation.select(F.col("n_nationkey").cast("bigint").alias("idx"), (F.col("n_nationkey") + 1).cast("double").alias("value"))
    y = t.region.select(F.col("r_regionkey").cast("bigint").alias("idx"), (F.col("r_regionkey") + 2).cast("double").alias("value"))
    return matrix.outer_product(x, y)


@query("SELECT c_custkey AS idx, c_acctbal AS b, c_nationkey AS n, c_acctbal * 2 AS d, 2 AS copies FROM customer")
def frames_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns side by side, rows on top of each other, in order."""
    c = Tables(spark, sf_dir).customer
    wide = frames.cbind(c.select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("b")), c.select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("n"), (F.col("c_acctbal") * 2).alias("d")))
    long = frames.rbind(wide, wide)
    return frames.sort_by(long.groupBy("idx", "b", "n", "d").agg(F.count("*").cast("int").alias("copies")), "b", False)


@query("SELECT n_nationkey AS row, 0 AS col, n_nationkey::DOUBLE AS value FROM nation UNION ALL SELECT n_nationkey, 1, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 2, n_regionkey FROM nation, range(2) WHERE n_nationkey % 2 = 0")
def frames_as_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as a matrix; rows asked for twice."""
    n = Tables(spark, sf_dir).nation.select(F.col("n_nationkey").cast("bigint").alias("idx"), F.col("n_nationkey").cast("double").alias("k"), F.col("n_regionkey").cast("double").alias("r"))
    asked = n.where("idx % 2 = 0").select("idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    picked = frames.subset_rows(n, asked).select((F.col("idx") + 100).alias("row"), F.lit(2).cast("bigint").alias("col"), F.col("r").alias("value"))
    return frames.as_matrix(n, ["k", "r"]).unionByName(picked)


@query(
    """SELECT o_orderkey AS k, ['a', 'b', 'c'] AS added, o_custkey AS b, ['b'] AS left_over, [o_orderkey, o_custkey, o_custkey] AS appended, [o_orderkey, o_custkey] AS second, false AS same, true AS own,
'{"a":' || o_orderkey || ',"b":' || o_custkey || '}' AS json, 'a,' || o_orderkey || chr(10) || 'b,' || o_custkey AS csv, [0, 1] AS compact FROM orders"""
)
def dictionary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys put, removed, added and appended; contents compared and written out; indices made compact."""
    a, b = F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint")
    o = Tables(spark, sf_dir).orders.select(a.alias("a"), b.alias("b"))
    d, c = frames.dictionary(a=F.col("a"), b=F.lit(-1).cast("bigint")), frames.dictionary(b=F.col("b"))
    lists = frames.dictionary(x=F.array("a", "b"), y=F.array("b", "b"))
    more = frames.dictionary(x=F.array("b"))
    both = frames.add_keys(d, c)
    holes = F.create_map(F.lit(3), F.array("a"), F.lit(5), F.array().cast("array<bigint>"), F.lit(9), F.array("b"))
    return o.select(
        F.col("a").alias("k"),
        frames.all_keys(frames.set_value(both, "c", F.col("a"))).alias("added"),
        frames.get_value(both, "b").alias("b"),
        frames.all_keys(frames.set_value(both, "a", None)).alias("left_over"),
        frames.get_value(frames.append_keys(lists, more), "x").alias("appended"),
        F.array(frames.get_value(frames.row_values(lists, 0), "x"), frames.get_value(frames.row_values(lists, 1), "y")).alias("second"),
        frames.same_contents(d, both).alias("same"),
        frames.same_contents(both, frames.add_keys(c, frames.dictionary(a=F.col("a")))).alias("own"),
        frames.serialize(both).alias("json"),
        frames.serialize(both, "csv").alias("csv"),
        F.array_sort(F.map_keys(frames.compact_indices(holes))).alias("compact"),
    )


# ---- files: written to the shared folder and read again


def _written(lines: DataFrame, place: str | None = None) -> str:
    """A folder with these lines, in one file if they have an order, as formats with a header need."""
    path = f"{state.shared_root(lines.sparkSession)}/text-{uuid.uuid4().hex}"
    text.write_lines((lines.coalesce(1).sortWithinPartitions(place) if place else lines).select("value"), path, compress=place is None)
    return path


@query("SELECT p_partkey AS k, p_name || ' / ' || p_size AS value FROM part")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written with compression and read again."""
    p = Tables(spark, sf_dir).part
    lines = p.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat_ws(" / ", "p_name", F.col("p_size").cast("string"))).alias("value"))
    f = F.split("value", "\t")
    return text.read_lines(spark, _written(lines)).select(f[0].cast("bigint").alias("k"), f[1].alias("value"))


@query("SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status, o_orderkey % 2 = 0 AS even FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as CSV with a header, its types guessed when it is read."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    path = f"{state.shared_root(spark)}/csv-{uuid.uuid4().hex}"
    o.write.option("header", True).csv(path)
    return text.read_csv(spark, path)


@query(V + ", h AS (SELECT DISTINCT l_partkey AS mut_id, s_nationkey AS sample, l_linenumber % 2 AS copy FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) SELECT position, mut_id, s, dominance, m.mut_type::INT AS mut_type, calls, copies FROM (SELECT mut_id, count(*) AS calls, sum(copy)::BIGINT AS copies FROM h GROUP BY 1) JOIN mutation m USING (mut_id)")
def vcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of nations with two haplosomes each, with effects, dominance and types, read again; calls counted."""
    t = Tables(spark, sf_dir)
    nation, copy = F.col("s_nationkey").cast("bigint"), (F.col("l_linenumber") % 2).cast("int")
    held = t.lineitem.join(t.supplier.withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").select((2 * nation + copy).alias("hap_id"), F.col("l_partkey").alias("mut_id")).distinct()
    hap = t.nation.select(F.col("n_nationkey").cast("bigint").alias("sample"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).withColumn("hap_id", 2 * F.col("sample") + F.col("copy"))
    lines = vcf.vcf_lines(held, hap, t.mutation.withColumn("origin", F.lit(1).cast("bigint")))
    sites, calls = vcf.read_vcf(spark, _written(lines))
    n = calls.groupBy("position").agg(F.count("*").alias("calls"), F.sum("copy").alias("copies"))
    return sites.join(n, "position").select("position", (F.col("position") / 1000).cast("bigint").alias("mut_id"), "s", "dominance", "mut_type", "calls", "copies")


@query("WITH h AS (SELECT DISTINCT s_suppkey AS hap, k FROM supplier, range(0, 9) t(k) WHERE (s_suppkey * 7 + k * 3) % 5 < 2) SELECT k * 10 AS position, count(*) AS n FROM h GROUP BY 1")
def ms_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplosomes of a sample as ms text and back; carriers counted at each position."""
    s = Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("hap_id"))
    held = s.withColumn("mut_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint")))).where((F.col("hap_id") * 7 + F.col("mut_id") * 3) % 5 < 2)
    sites, carries = ms.read_ms(spark, _written(ms.ms_lines(held, s, spark.range(9).select(F.col("id").alias("mut_id"), (F.col("id") * 10).alias("position")), 101), "place"), 101)
    return carries.join(sites, ["replicate", "site"]).groupBy("position").agg(F.count("*").alias("n"))


@query(f"SELECT 'p' || p_partkey AS name, i::INT AS position, substr({_SEQ}, CAST(i + 1 AS INT), 1) AS base FROM part, range(0, 12) t(i)")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sequences(Tables(spark, sf_dir)).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("seq").alias("sequence"))
    return fasta.read_fasta(spark, _written(fasta.fasta_lines(s, 5))).select("name", F.col("position").cast("int").alias("position"), "base")


# ---- genotypes, space and maps


@query(V + "SELECT h.hap_id, m.mut_id, c.mut_id IS NOT NULL AS present FROM haplosome h JOIN (SELECT min(mut_id) AS mut_id FROM carries UNION SELECT max(mut_id) FROM carries) m ON true LEFT JOIN carries c ON c.hap_id = h.hap_id AND c.mut_id = m.mut_id")
def contains_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether haplosomes carry the mutations of the smallest and the largest id."""
    t = Tables(spark, sf_dir)
    ends = t.carries.agg(F.array(F.min("mut_id"), F.max("mut_id")).alias("m")).select(F.explode("m").alias("mut_id"))
    return genotypes.contains_mutations(t.carries, t.haplosome, ends).select("hap_id", "mut_id", "present")


@query(V + "SELECT DISTINCT ind_id, mut_id FROM carries JOIN haplosome USING (hap_id) JOIN mutation USING (mut_id) WHERE mut_type = 1")
def unique_mutations_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return genotypes.unique_of_type(t.carries, t.haplosome, t.mutation, 1).select("ind_id", "mut_id")


@query(V + "SELECT mut_id, coalesce(c, 0) AS c FROM mutation LEFT JOIN (SELECT mut_id, count(*) AS c FROM carries GROUP BY 1) USING (mut_id)")
def counts_of_asked_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return popgen.requested_counts(popgen.mutation_counts(t.carries), t.mutation.select("mut_id")).select("mut_id", F.col("c").cast("bigint").alias("c"))


@query(_NEAR + "SELECT p.ind_id, p.ind_id + 1 AS e_ind_id, CASE WHEN n.d IS NULL THEN 'Infinity'::DOUBLE ELSE round(n.d, 9) END AS d FROM points p JOIN points q ON q.ind_id = p.ind_id + 1 LEFT JOIN near n ON n.ind_id = p.ind_id AND n.e_ind_id = p.ind_id + 1")
def distances_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of individuals to the next one by id, infinite beyond the radius."""
    t = Tables(spark, sf_dir)
    p = t.points.select("ind_id", "x", "y")
    asked = p.select("ind_id", (F.col("ind_id") + 1).alias("e_ind_id")).join(p.select(F.col("ind_id").alias("e_ind_id")), "e_ind_id", "left_semi")
    return spatial.interaction_distance(asked, p, p, 0.05).select("ind_id", "e_ind_id", F.when(F.col("d") < math.INF, F.round("d", 9)).otherwise(math.INF).alias("d"))


@query(V + "SELECT count(*) AS n_neighbors FROM points WHERE sqrt(x * x + y * y) <= 0.2")
def neighbors_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.count_of_point(Tables(spark, sf_dir).points, (0.0, 0.0), 0.2)


@query(V + "SELECT ind_id, round(CASE WHEN x > 0.1 THEN 0.2 - x WHEN x < -0.1 THEN -0.2 - x ELSE x END, 9) AS x FROM points WHERE abs(x) <= 0.3")
def points_reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions within three half-widths, folded back once."""
    p = Tables(spark, sf_dir).points.where(F.abs("x") <= 0.3).select("ind_id", "x")
    return spatial.reflected(p, {"x": (-0.1, 0.1)}).select("ind_id", r("x").alias("x"))


@query("SELECT c_custkey AS k, true AS x_in, true AS y_in FROM customer")
def points_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform positions in bounds, by a map of probabilities that is zero in its left half."""
    c = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("k"))
    half = spark.range(121).select((F.col("id") % 11).alias("i"), F.expr("id div 11").alias("j"))
    grid = maps.Grid(half.withColumn("value", F.when(F.col("i") >= 6, 0.5).otherwise(0.0)), 11, 11, _B)
    p = maps.uniform_points_on(c, grid, 3, "k")
    return p.select("k", F.col("x").between(0.05, 0.5).alias("x_in"), F.col("y").between(-0.5, 0.5).alias("y_in"))


@query(_G + "SELECT i, j, round(value - 5, 9) AS less, round(value / 4, 9) AS part, round(pow(value, 2), 6) AS squared, round(exp(value / 50), 9) AS raised, (SELECT min(value) FROM grid) AS low, (SELECT max(value) FROM grid) AS high FROM grid")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark)
    named = lambda m, name, digits=9: m.values.select("i", "j", F.round("value", digits).alias(name))
    out = named(g.subtract(5.0), "less")
    for m in (named(g.divide(4.0), "part"), named(g.power(2.0), "squared", 6), named(g.divide(50.0).exp(), "raised")):
        out = out.join(m, ["i", "j"])
    return out.join(F.broadcast(g.value_range()), F.lit(True))  # one row


@query(V + ", site AS (SELECT mut_id, mut_id // 40 AS position FROM mutation), one AS (SELECT hap_id // 2 AS ind_id, mut_id FROM carries GROUP BY 1, 2 HAVING count(*) = 1), apart AS (SELECT ind_id, count(DISTINCT position) AS k FROM one JOIN site USING (mut_id) WHERE position BETWEEN 1 AND 30 GROUP BY 1) SELECT a.hap_id AS hap_a, a.hap_id + 1 AS hap_b, round(coalesce(k, 0) / 30.0::DOUBLE, 12) AS heterozygosity FROM haplosome a JOIN haplosome b ON b.hap_id = a.hap_id + 1 LEFT JOIN apart ON apart.ind_id = a.hap_id // 2 WHERE a.copy = 0")
def pair_heterozygosity_of_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different positions within bounds, where many mutations share one."""
    t = Tables(spark, sf_dir)
    h, site = t.haplosome, t.mutation.select("mut_id", F.expr("mut_id div 40").alias("position"))
    pairs = h.where("copy = 0").select(F.col("hap_id").alias("hap_a"), (F.col("hap_id") + 1).alias("hap_b")).join(h.select(F.col("hap_id").alias("hap_b")), "hap_b", "left_semi")
    return popgen.pair_heterozygosity(t.carries, pairs, t.length, site, False, 1, 30).select("hap_a", "hap_b", F.round("heterozygosity", 12).alias("heterozygosity"))


_ROH = V + """, h AS (SELECT hap_id, ind_id, CAST(ind_id % 3 AS VARCHAR) AS chrom FROM haplosome UNION ALL SELECT hap_id + 100000000, ind_id, CAST(3 + ind_id % 2 AS VARCHAR) FROM haplosome),
k AS (SELECT hap_id + CASE WHEN mut_id % 2 = 0 THEN 100000000 ELSE 0 END AS hap_id, mut_id FROM carries), z AS (SELECT ind_id, chrom, mut_id FROM k JOIN h USING (hap_id) GROUP BY 1, 2, 3 HAVING count(*) = 1),
site AS (SELECT mut_id, CASE WHEN mut_id % 2 = 0 THEN '3' ELSE '0' END AS chrom, mut_id * 10 AS position FROM mutation), ends AS (SELECT CAST(i AS VARCHAR) AS chrom, 1000000 * (i + 1) - 1 AS last FROM range(5) t(i)),
w AS (SELECT ind_id, chrom, last FROM (SELECT ind_id, chrom FROM h GROUP BY 1, 2 HAVING count(*) = 2) JOIN ends USING (chrom)),
m AS (SELECT DISTINCT z.ind_id, z.chrom, position FROM z JOIN site ON site.mut_id = z.mut_id AND site.chrom = z.chrom JOIN w ON w.ind_id = z.ind_id AND w.chrom = z.chrom UNION ALL SELECT ind_id, chrom, last + 1 FROM w),
g AS (SELECT ind_id, position - lag(position, 1, -1) OVER (PARTITION BY ind_id, chrom ORDER BY position) - 1 AS run FROM m), sums AS (SELECT ind_id, sum(last + 1) AS t FROM w GROUP BY 1),
roh AS (SELECT ind_id, coalesce(sum(run) FILTER (WHERE run >= 5000), 0) / any_value(t)::DOUBLE AS f_roh FROM g JOIN sums USING (ind_id) GROUP BY 1) """


@query(_ROH + "SELECT ind_id, round(f_roh, 9) AS f_roh FROM roh")
def homozygosity_by_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs on two of five chromosomes of each individual, over the length of both."""
    return _roh(spark, sf_dir).select("ind_id", r("f_roh").alias("f_roh"))


@query(_ROH + "SELECT round(avg(f_roh), 9) AS mean_f_roh FROM roh")
def mean_homozygosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popgen.mean_f_roh(_roh(spark, sf_dir)).select(r("mean_f_roh").alias("mean_f_roh"))


def _roh(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    h, second, even = t.haplosome, F.lit(100_000_000).cast("bigint"), F.col("mut_id") % 2 == 0
    both = h.select("hap_id", "ind_id", (F.col("ind_id") % 3).cast("string").alias("chrom")).union(h.select(F.col("hap_id") + second, "ind_id", (3 + F.col("ind_id") % 2).cast("string")))
    held = t.carries.select((F.col("hap_id") + F.when(even, second).otherwise(0)).alias("hap_id"), "mut_id")
    site = t.mutation.select("mut_id", F.when(even, "3").otherwise("0").alias("chrom"), (F.col("mut_id") * 10).alias("position"))
    ends = spark.range(5).select(F.col("id").cast("string").alias("chrom"), (1_000_000 * (F.col("id") + 1) - 1).alias("last_position"))
    # a mutation counts on its own chromosome only
    own = held.join(both, "hap_id").join(site.select("mut_id", F.col("chrom").alias("at")), "mut_id").where(F.col("chrom") == F.col("at")).select("hap_id", "mut_id")
    return popgen.runs_of_homozygosity(own, both, site, ends, 5_000)


# ---- logs and ancestry


@query("SELECT user_id % 50 AS tick, count(*) AS num_individuals, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS sex_ratio, count(*) FILTER (event_id % 2 = 1) AS p1_num_individuals, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 2 = 1)::DOUBLE, 9) AS p1_sex_ratio, max(value) AS top, 'run' AS label FROM events WHERE user_id % 50 % 5 = 0 GROUP BY 1")
def log_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log every fifth tick: sizes, sex ratios, a custom aggregate and a supplied value."""
    e = Tables(spark, sf_dir).events
    d = e.select((F.col("user_id") % 50).alias("tick"), F.when(F.col("event_id") % 3 == 0, "M").otherwise("F").alias("sex"), (F.col("event_id") % 2).alias("subpop"), "value")
    log = TickLog(interval=5).population_size().sex_ratio().subpopulation_size(1).subpopulation_sex_ratio(1).custom("top", F.max("value")).supplied("label", "run")
    return log.rows(d).select("tick", "num_individuals", r("sex_ratio").alias("sex_ratio"), "p1_num_individuals", r("p1_sex_ratio").alias("p1_sex_ratio"), "top", "label")


def _below(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    t = Tables(spark, sf_dir)
    nodes, edges = _tree(t)
    samples = t.customer.select(F.col("c_custkey").alias("start"))
    return samples, nodes, edges, ancestry.ancestors(samples, edges)


@query("SELECT c_nationkey + 1000000 AS node, c_custkey % 2 AS sample_set, count(*)::DOUBLE AS mean FROM customer GROUP BY 1, 2 UNION ALL SELECT n_regionkey + 2000000, c_custkey % 2, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 UNION ALL SELECT 3000000, c_custkey % 2, count(*) FROM customer GROUP BY 1, 2 UNION ALL SELECT c_custkey, c_custkey % 2, 1 FROM customer")
def mean_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two sets below nations, regions, the root and themselves."""
    samples, _, _, above = _below(spark, sf_dir)
    sets = samples.select(F.col("start").alias("sample"), (F.col("start") % 2).alias("sample_set"))
    return ancestry.mean_descendants(above, sets, 10.0)


_NODES = "node AS (SELECT c_custkey AS id, 0.0::DOUBLE AS time FROM customer UNION ALL SELECT n_nationkey + 1000000, 1.0 FROM nation UNION ALL SELECT r_regionkey + 2000000, 2.0 FROM region UNION ALL SELECT 3000000, 3.0), edge AS (SELECT c_nationkey + 1000000 AS parent, c_custkey AS child FROM customer UNION ALL SELECT n_regionkey + 2000000, n_nationkey + 1000000 FROM nation UNION ALL SELECT 3000000, r_regionkey + 2000000 FROM region)"


@query(f"WITH {_NODES} SELECT kind, parent, child FROM (SELECT 'simplified' AS kind, parent, child FROM edge WHERE child < 1000000 OR (child < 2000000 AND child IN (SELECT c_nationkey + 1000000 FROM customer)) OR (child >= 2000000 AND child IN (SELECT n_regionkey + 2000000 FROM nation JOIN customer ON c_nationkey = n_nationkey)) UNION ALL SELECT 'subset', parent, child FROM edge WHERE child >= 1000000 UNION ALL SELECT 'young', parent, child FROM edge WHERE parent < 2000000)")
def ancestry_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges above the samples, edges among kept nodes, and edges whose parent is young."""
    samples, nodes, edges, above = _below(spark, sf_dir)
    part = lambda kind, e: e.select(F.lit(kind).alias("kind"), "parent", "child")
    kept = nodes.where("id >= 1000000").select("id")
    young = ancestry.delete_older(nodes, edges, nodes.select("id", "time"), 1.5)[0]
    return part("simplified", ancestry.simplify(edges, nodes, above)[1]).unionByName(part("subset", ancestry.subset(nodes, edges, kept)[1])).unionByName(part("young", young))


@query(f"WITH {_NODES}, crossing AS (SELECT *, row_number() OVER (ORDER BY parent, child) + 3999999 AS id FROM edge WHERE child BETWEEN 1000000 AND 1999999) SELECT parent, child FROM edge WHERE child NOT BETWEEN 1000000 AND 1999999 UNION ALL SELECT parent, id FROM crossing UNION ALL SELECT id, child FROM crossing")
def ancestry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from nations to regions pass through new nodes at time 1.5."""
    nodes, edges = _tree(Tables(spark, sf_dir))
    return ancestry.split_edges(edges, nodes, 1.5, 4_000_000)[1].select("parent", "child")


@query(f"WITH {_NODES} SELECT row_number() OVER (ORDER BY time, id) - 1 AS id, time FROM node")
def ancestry_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tree(Tables(spark, sf_dir))
    return ancestry.canonical(nodes, edges)[0].select("id", "time")


@query("WITH first AS (SELECT p_partkey // 2 AS position, min(p_partkey) AS first FROM part GROUP BY 1) SELECT l_orderkey * 10 + l_linenumber AS id, first AS site FROM lineitem JOIN part ON p_partkey = l_partkey JOIN first ON position = p_partkey // 2")
def ancestry_sites_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring parts share a position: mutations move to the first of both."""
    t = Tables(spark, sf_dir)
    sites = t.part.select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("position"))
    mutations = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("site"))
    return ancestry.deduplicate_sites(sites, mutations)[1].select("id", "site")


@query(
    f"""WITH {_NODES}, mut AS (SELECT c_custkey AS id, c_custkey % 10 AS site, c_custkey AS node, 0.0::DOUBLE AS time FROM customer UNION ALL SELECT n_nationkey + 1000000, n_nationkey % 10, n_nationkey + 1000000, 1.0 FROM nation UNION ALL SELECT r_regionkey + 2000000, r_regionkey, r_regionkey + 2000000, 2.0 FROM region),
up AS (SELECT c_custkey AS node, c_nationkey + 1000000 AS above FROM customer UNION ALL SELECT c_custkey, n_regionkey + 2000000 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_nationkey + 1000000, n_regionkey + 2000000 FROM nation)
SELECT m.id, arg_min(o.id, o.time) AS parent FROM mut m LEFT JOIN up ON up.node = m.node LEFT JOIN mut o ON o.node = up.above AND o.site = m.site GROUP BY m.id"""
)
def mutation_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The youngest mutation of the same site on a node above, for mutations on customers, nations and regions."""
    t = Tables(spark, sf_dir)
    nodes, edges = _tree(t)
    n, g = F.col("n_nationkey"), F.col("r_regionkey")
    m = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("site"), F.col("c_custkey").alias("node"), F.lit(0.0).alias("time"))
    m = m.union(t.nation.select((n + 1_000_000).cast("bigint"), (n % 10).cast("bigint"), (n + 1_000_000).cast("bigint"), F.lit(1.0))).union(t.region.select((g + 2_000_000).cast("bigint"), g.cast("bigint"), (g + 2_000_000).cast("bigint"), F.lit(2.0)))
    above = ancestry.ancestors(m.select(F.col("node").alias("start")), edges)
    sites = spark.range(10).select("id", F.col("id").cast("double").alias("position"))
    return ancestry.mutation_parents(m, above, sites).select("id", "parent")


@query(f"WITH {_NODES}, mut AS (SELECT o_orderkey AS id, o_custkey AS node, o_orderkey % 3 AS site FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) SELECT id, round(row_number() OVER (PARTITION BY site, node ORDER BY id DESC) / (count(*) OVER (PARTITION BY site, node) + 1)::DOUBLE, 9) AS time FROM mut")
def mutation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations spaced evenly between customers, at time 0, and nations, at time 1."""
    t = Tables(spark, sf_dir)
    nodes, edges = _tree(t)
    m = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 3).alias("site"))
    sites = spark.range(3).select("id", F.col("id").cast("double").alias("position"))
    return ancestry.mutation_times(m, edges, nodes, sites).select("id", r("time").alias("time"))


@query(f"WITH {_NODES} SELECT parent, child FROM edge UNION ALL SELECT n_regionkey + 2000000, row_number() OVER (ORDER BY n_nationkey) + 8999999 FROM nation")
def ancestry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second table set with the same regions and new nations below them."""
    t = Tables(spark, sf_dir)
    nodes, edges = _tree(t)
    region = t.region.select((F.col("r_regionkey") + 5_000_000).cast("bigint").alias("id"), F.lit(2.0).alias("time"))
    nation = t.nation.select((F.col("n_nationkey") + 6_000_000).cast("bigint").alias("id"), F.lit(1.0).alias("time"))
    other = t.nation.select(F.lit(0.0).alias("left"), F.lit(10.0).alias("right"), (F.col("n_regionkey") + 5_000_000).cast("bigint").alias("parent"), (F.col("n_nationkey") + 6_000_000).cast("bigint").alias("child"))
    same = t.region.select((F.col("r_regionkey") + 2_000_000).cast("bigint").alias("id"), (F.col("r_regionkey") + 5_000_000).cast("bigint").alias("other_id"))
    return ancestry.union(nodes, edges, region.union(nation), other, same, 9_000_000)[1].select("parent", "child")


@query(f"SELECT a, b, 2 * time AS stat FROM ({_MRCA})")
def ancestry_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the time to the common ancestor, of neighbours by id."""
    return ancestry.divergence_matrix(_mrcas(spark, sf_dir), 10.0)


@query(f"WITH m AS ({_MRCA}), t AS (SELECT time, count(*) AS k FROM m GROUP BY 1) SELECT (time - 1)::BIGINT AS bin, round(CASE WHEN time = 3 THEN 'NaN'::DOUBLE ELSE -ln(1 - k / (SELECT sum(k) FROM t u WHERE u.time >= t.time)::DOUBLE) END, 9) AS rate FROM t")
def coalescence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that coalesce among nations, regions and the root, over those that haven't before."""
    rates = ancestry.coalescence_rates(_mrcas(spark, sf_dir), [0.5, 1.5, 2.5])
    return rates.select(F.col("bin").cast("bigint").alias("bin"), r("rate").alias("rate"))


@query(f"WITH m AS ({_MRCA}) SELECT min(time) AS time FROM (SELECT time, count(*) OVER (ORDER BY time) / count(*) OVER () AS share FROM m) WHERE share >= 0.5")
def coalescence_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.coalescence_quantile(_mrcas(spark, sf_dir), 0.5).toDF("time")
