"""Edge rows that the tables lack, round trips of formats, and what SQL can't express."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from genoflux.functions import arrays, colors, nucleotides, stats, strings
from genoflux.functions import distributions as draw
from genoflux.functions import math as m
from genoflux.operators import ancestry, frames, genome, genotypes, matrix, pedigree, popgen, spatial, vectors
from genoflux.plans import simulation
from genoflux.plans.schedule import Schedule
from genoflux.sources import fasta, ms, state, text, vcf
from genoflux.streaming.ticklog import TickLog

NAN, INF = math.nan, math.inf


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def same(a, b):
    return len(a) == len(b) and all((math.isnan(x) and math.isnan(y)) if isinstance(y, float) and math.isnan(y) else x == y for x, y in zip(a, b))


def test_ieee_division_and_logarithms(spark):
    got = one(spark, *[m.divide(a, b) for a, b in ((1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (INF, 2.0), (7.0, 2.0))], m.modulo(5.5, 2.0), m.modulo(-5.5, 2.0), m.modulo(1.0, 0.0), m.modulo(3.0, INF))
    assert same(got, [INF, -INF, NAN, -INF, INF, 3.5, 1.5, -1.5, NAN, 3.0])
    assert same(one(spark, m.log(0.0), m.log(-1.0), m.log10(100.0), m.log2(8.0), m.log(INF)), [-INF, NAN, 2.0, 3.0, INF])


def test_rounding_of_edges(spark):
    values = [2.5, -2.5, 0.49999999999999994, -0.2, 1e300, INF]
    assert same(one(spark, *[m.round_half_away(v) for v in values]), [3.0, -3.0, 0.0, 0.0, 1e300, INF])
    assert same(one(spark, m.ceil(NAN), m.floor(-INF), m.trunc(-2.7), m.ceil(1e20)), [NAN, -INF, -2.0, 1e20])
    assert same(one(spark, m.pmax(1.0, NAN), m.pmin(NAN, 1.0), m.pmin(2.0, 1.0), m.sign(NAN), m.sign(-3.0)), [NAN, NAN, 1.0, NAN, -1.0])


def test_tests_of_floats(spark):
    assert one(spark, m.is_close(1.0, 1.000001), m.is_close(INF, INF), m.is_close(INF, 1.0), m.is_close(NAN, NAN), m.is_close(NAN, NAN, equal_nan=True), m.is_finite(NAN), m.is_infinite(-INF))[:] == (True, True, False, False, True, False, True)
    with pytest.raises(PySparkException):
        spark.range(1).select(m.integer_div(1, F.col("id"))).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(F.lit(2**63 - 1) + F.col("id") + 1).collect()


def test_aggregates_of_few_values(spark):
    d = spark.createDataFrame([], "v double, i bigint")
    r = d.agg(stats.mean("v"), stats.sd("v"), stats.total("v"), stats.product("v"), stats.minimum("v"), stats.all_true(F.col("v") > 0), stats.total_integer("i")).first()
    assert same(r, [NAN, NAN, 0.0, 1.0, None, True, 0])
    one_row = spark.createDataFrame([(3.0, 2**62), (1.0, 2**62)], "v double, i bigint")
    assert one_row.agg(stats.total("i")).first()[0] == 2.0**63
    assert one_row.limit(1).agg(stats.variance("v").alias("x")).first()[0] != one_row.agg(stats.variance("v").alias("x")).first()[0]
    tricky = spark.createDataFrame([(1e100,), (1.0,), (-1e100,)], "v double")
    assert tricky.agg(stats.total_exact("v")).first()[0] == 1.0
    for bad in (d, spark.createDataFrame([(NAN,), (1.0,)], "v double")):
        with pytest.raises(PySparkException):
            bad.agg(stats.quantile("v")).collect()


def test_t_test_against_known_values(spark):
    p = one(spark, stats.ttest_two(F.lit(5), F.lit(10.0), F.lit(4.0), F.lit(5), F.lit(10.0), F.lit(4.0)), stats.ttest_one(F.lit(10), F.lit(2.262157), F.lit(10.0), F.lit(0.0)))
    assert p[0] == pytest.approx(1.0) and p[1] == pytest.approx(0.05, abs=2e-3)
    assert float(stats.incomplete_beta(2.0, 3.0, 0.4)) == pytest.approx(0.5248)


def test_draws_have_their_moments(spark):
    n = 20_000
    d = spark.range(n).repartition(7)
    k = F.lit(1.0)
    cases = {
        "u": (draw.runif(1, "id"), 0.5, 1 / 12), "n": (draw.rnorm(1, "id", mean=2.0, sd=3.0), 2.0, 9.0), "e": (draw.rexp(1, "id", mu=2.0), 2.0, 4.0), "l": (draw.rlaplace(1, "id"), 0.0, 2.0),
        "g": (draw.rgamma(1, "id", mean=k * 3, shape=k * 2), 3.0, 4.5), "p": (draw.rpois(1, "id", lam=k * 4), 4.0, 4.0), "b": (draw.rbinom(1, "id", size=F.lit(10), prob=k * 0.3), 3.0, 2.1), "geom": (draw.rgeom(1, "id", p=0.25), 3.0, 12.0),
        "w": (draw.rweibull(1, "id", scale=1.0, shape=2.0), 0.8862, 0.2146), "z": (draw.rztpois(1, "id", lam=k), 1.58198, 0.66125), "beta": (draw.rbeta(1, "id", alpha=k * 2, beta=k * 2), 0.5, 0.05), "d": (draw.rdunif(1, "id", low=1, high=6), 3.5, 35 / 12),
    }
    r = d.select(*[c.alias(x) for x, (c, _, _) in cases.items()]).agg(*[f(x).alias(f"{x}_{i}") for x in cases for i, f in enumerate((F.avg, F.var_samp))]).first()
    for x, (_, mean, var) in cases.items():
        assert r[f"{x}_0"] == pytest.approx(mean, abs=5 * math.sqrt(var / n)), x
        assert r[f"{x}_1"] == pytest.approx(var, rel=0.15), x
    again = spark.range(n).repartition(3).select("id", draw.rnorm(1, "id").alias("x"))
    assert again.join(d.select("id", draw.rnorm(1, "id").alias("y")), "id").where("x <> y").count() == 0


def test_densities(spark):
    r = one(spark, draw.dgamma(F.lit(2.0), 2.0, 1.0), draw.dbeta(F.lit(0.5), 2.0, 2.0), draw.pnorm(F.lit(1.96)), draw.qnorm(F.lit(0.975)), draw.dmvnorm(F.array(F.lit(0.0), F.lit(0.0)), [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]))
    assert list(r) == pytest.approx([math.exp(-1) / 2, 1.5, 0.9750021, 1.9599640, 1 / (2 * math.pi)], rel=1e-6)
    assert one(spark, *[draw.find_interval(F.lit(x), [1.0, 2.0, 3.0], *flags) for x, flags in ((0.5, ()), (1.0, ()), (3.0, ()), (3.0, (True,)), (9.0, (False, True)), (0.0, (False, True)))])[:] == (-1, 0, 2, 1, 1, 0)


def test_strings(spark):
    assert one(spark, strings.nchar(F.lit("é")), strings.strfind(F.lit("banana"), "an", 2), strings.strfind(F.lit("abc"), "x"), strings.substr(F.lit("hello"), F.lit(-3), F.lit(1)), strings.substr(F.lit("hello"), F.lit(3)), strings.substr(F.lit("hi"), F.lit(5)))[:] == (2, 3, -1, "he", "lo", "")
    assert one(spark, strings.strsplit(F.lit("a.b..c"), "."), strings.strsplit(F.lit("abc"), ""), strings.format_number("%.2f", F.lit(3.14159)), strings.grep(F.lit("a.c"), "a.c", fixed=True), strings.grep(F.lit("abc"), "a.c", fixed=True), strings.grep_match(F.lit("ab12cd"), "[0-9]+"))[:] == (["a", "b", "", "c"], ["a", "b", "c"], "3.14", True, False, "12")
    d = spark.createDataFrame([(1, 2.0, "x", True, [1])], "a int, b double, c string, d boolean, e array<int>")
    assert [strings.element_type(d, c) for c in "abcde"] == ["integer", "float", "string", "logical", "object"]


def test_arrays(spark):
    x = F.array(*map(F.lit, (3, 1, 2, 1)))
    assert one(spark, arrays.order(x), arrays.order(x, False), arrays.which(F.transform(x, lambda v: v == 1)), arrays.match(x, F.array(F.lit(1), F.lit(3))), arrays.rep_each(F.array(F.lit(1), F.lit(2)), 2), arrays.seq_len(0), arrays.unique(x), arrays.subset(x, F.array(F.lit(2), F.lit(0))), arrays.cum_product(x))[:] == ([1, 3, 2, 0], [0, 2, 1, 3], [1, 3], [1, 0, -1, 0], [1, 1, 2, 2], [], [3, 1, 2], [2, 3], [3.0, 3.0, 6.0, 6.0])
    assert one(spark, arrays.seq(F.lit(5), F.lit(1)), arrays.seq(F.lit(0.0), F.lit(1.0), by=0.25), arrays.seq(F.lit(0), F.lit(1), length=3), arrays.integers(4, fill2_indices=[1, 3]))[:] == ([5, 4, 3, 2, 1], [0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 0.5, 1.0], [0, 1, 0, 1])
    assert one(spark, arrays.set_symmetric_difference(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))))[0] == [1, 3]


def test_vectors(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate((2, 1, 2, 5))], "i bigint, v double")
    for ties, want in {"average": [2.5, 1, 2.5, 4], "first": [2, 1, 3, 4], "last": [3, 1, 2, 4], "min": [2, 1, 2, 4], "max": [3, 1, 3, 4]}.items():
        assert [r["rank"] for r in vectors.rank(d, "v", "i", ties).orderBy("i").collect()] == want
    f = lambda outside: [r["filtered"] for r in vectors.centered_filter(d, "v", "i", [0.25, 0.5, 0.25], outside).orderBy("i").collect()]
    assert same(f(False), [NAN, 1.5, 2.5, NAN]) and f(True) == pytest.approx([5 / 3, 1.5, 2.5, 4.0]) and f(0.0) == [1.25, 1.5, 2.5, 3.0]
    bins = spark.createDataFrame([(0,), (2,), (2,), (-1,), (9,)], "b bigint")
    assert [r["n"] for r in vectors.tabulate(bins, "b", 3).orderBy("bin").collect()] == [1, 0, 2, 0]
    nan = spark.createDataFrame([(0, NAN), (1, 1.0)], "i bigint, v double")
    assert vectors.identical(d, d) and not vectors.identical(d, d.union(d.limit(1)))
    w = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "k bigint, w double")
    drawn = vectors.sample(w, 3000, 1, ["k"], True, "w")
    shares = {r["w"]: r["count"] for r in drawn.groupBy("w").count().collect()}
    assert drawn.count() == 3000 and 0.0 not in shares and shares[2.0] == pytest.approx(2000, abs=150)
    assert vectors.sample(w, 10, 1, ["k"]).distinct().count() == 10 and vectors.sample(w, 50, 1, ["k"], weight="w").count() == 20
    many = spark.createDataFrame([(float(x),) for x in range(-2, 12)], "v double")
    got = {r["v"]: r["interval"] for r in vectors.find_interval(many, "v", spark.createDataFrame([(float(b),) for b in (0, 3, 3, 7)], "b double"), "b").collect()}
    assert got == {x: -1 if x < 0 else 0 if x < 3 else 1 if x < 7 else 2 for x in map(float, range(-2, 12))}


def test_matrices(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)], matrix.ENTRIES)
    inv = {(r["row"], r["col"]): r["value"] for r in matrix.inverse(a).collect()}
    assert inv == pytest.approx({(0, 0): 1.0, (0, 1): -1.0, (1, 0): -1.0, (1, 1): 2.0})
    back = {(r["row"], r["col"]): r["value"] for r in matrix.multiply(matrix.power(a, 2, 2), matrix.power(a, -2, 2)).collect()}
    assert back == pytest.approx({(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 1.0}, abs=1e-9)
    assert matrix.power(a, 0, 2).count() == 2 and matrix.dim(a).first()[:] == (2, 2)
    with pytest.raises(PySparkException):
        matrix.inverse(a.withColumn("value", F.lit(1.0))).collect()


def test_popgen_edges(spark):
    hap = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "hap_id bigint, ind_id bigint")
    fixed = spark.createDataFrame([(h, 1) for h in range(4)] + [(0, 2)], "hap_id bigint, mut_id bigint")
    freq = popgen.frequencies(popgen.mutation_counts(fixed), hap)
    assert popgen.diversity(freq, 1.0).first()[0] == pytest.approx(0.5)
    assert [r["n_mutations"] for r in popgen.site_frequency_spectrum(freq).orderBy("bin").collect()] == [1, 0, 0]
    assert [r["n_mutations"] for r in popgen.site_frequency_spectrum(freq, 4).orderBy("bin").collect()] == [0, 1, 0, 1]
    none = popgen.frequencies(popgen.mutation_counts(fixed.limit(0)), hap)
    assert popgen.diversity(none, 1.0).first()[0] == 0.0 and popgen.heterozygosity(none, 1.0).first()[0] == 0.0
    with pytest.raises(PySparkException):
        popgen.diversity(popgen.frequencies(popgen.mutation_counts(fixed), hap.limit(1)), 1.0).collect()
    two = popgen.two_groups(fixed.limit(0), hap.withColumn("g", F.col("ind_id")), "g", 0, 1)
    assert math.isnan(popgen.fst(two).first()[0]) and popgen.dxy(two).first()[0] == 0.0
    absent = popgen.linkage(fixed, 4, 99)
    assert all(r["d"] == 0 and math.isnan(r["r_squared"]) for r in absent.collect())
    mut = spark.createDataFrame([(1, 10, 0, -2.0, 0.5), (2, 20, 0, 0.5, 0.5)], "mut_id bigint, position bigint, mut_type int, s double, dominance double")
    fit = {r["ind_id"]: r["fitness"] for r in popgen.fitness(fixed, hap, mut).collect()}
    assert fit == {0: 0.0, 1: 0.0}
    left, gone = genotypes.split_fixed(freq, mut, 5)
    assert [r["mut_id"] for r in left.collect()] == [2] and gone.first()["fixation_tick"] == 5
    ref = spark.createDataFrame(list(enumerate("ACGTACGT")), "position bigint, base string")
    alt = spark.createDataFrame([(1, 2, 3), (2, 5, 0)], "mut_id bigint, position bigint, nucleotide int")
    assert {r["hap_id"]: r["sequence"] for r in genotypes.derived_sequence(ref, fixed, alt, 0, 5).collect()} == {0: "ACTTAA", 1: "ACTTAC", 2: "ACTTAC", 3: "ACTTAC"}


def test_neighbors_against_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.random(), rng.choice((0.0, 0.25, 1.0, rng.random()))) for i in range(120)]
    d = spark.createDataFrame(pts, "ind_id bigint, x double, y double")
    for periods in ({}, {"x": 1.0}):
        for salt in (1, 3):
            got = {(r["ind_id"], r["e_ind_id"]) for r in spatial.neighbors(d, d, 0.25, periods=periods, salt=salt).collect()}
            gap = lambda a, b: min(abs(a - b), 1 - abs(a - b)) if periods else abs(a - b)
            assert got == {(i, j) for i, x, y in pts for j, u, v in pts if i != j and math.sqrt(gap(x, u) ** 2 + (y - v) ** 2) <= 0.25}
    near = spatial.neighbors(d, d, 0.25)
    drawn = spatial.draw_by_strength(near, spatial.kernel("l", 0.25, 1.0), 5, 3)
    assert drawn.groupBy("ind_id").count().where("count <> 5").count() == 0
    full = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.5), (3, 0.0, 0.0)], "ind_id bigint, x double, y double")
    area = math.pi * 0.2**2
    c = spatial.clipped_integral("f", 0.2, (1.0,), {"x": (0.0, 1.0), "y": (0.0, 1.0)})
    assert [r[0] for r in full.orderBy("ind_id").select(c).collect()] == pytest.approx([area, area / 2, area / 4], rel=0.02)
    moved = spatial.deviated(full, 1, "ind_id", {"x": (0.0, 1.0), "y": (0.0, 1.0)}, 0.3)
    assert moved.where(~spatial.in_bounds({"x": (0.0, 1.0), "y": (0.0, 1.0)})).count() == 0
    assert spatial.reflected(full.withColumn("x", F.lit(1.2)), {"x": (0.0, 1.0)}).first()["x"] == pytest.approx(0.8)


def test_interaction_distances_of_asked_pairs(spark):
    """As many rows as are asked for, also where everything lies within the radius of everything."""
    rng = random.Random(2)
    pts = [(i, rng.random(), rng.random()) for i in range(60)] + [(60, None, 0.5), (61, float("nan"), 0.5)]
    d = spark.createDataFrame(pts, "ind_id bigint, x double, y double")
    asked = [(i, j) for i in range(0, 64, 3) for j in range(0, 64, 2)]
    q = spark.createDataFrame(asked, "ind_id bigint, e_ind_id bigint")
    for periods in ({}, {"x": 1.0}):
        gap = lambda a, b: min(abs(a - b), 1 - abs(a - b)) if periods else abs(a - b)
        far = lambda a, b: math.sqrt(gap(a[1], b[1]) ** 2 + (a[2] - b[2]) ** 2)
        want = {(i, j): far(pts[i], pts[j]) if i != j and max(i, j) < 60 and far(pts[i], pts[j]) <= 0.4 else math.inf for i, j in asked}
        got = spatial.interaction_distance(q, d, d, 0.4, periods=periods).collect()
        assert {(r["ind_id"], r["e_ind_id"]): r["d"] for r in got} == pytest.approx(want) and len(got) == len(asked)
    one_place = spark.range(50_000).select(F.col("id").alias("ind_id"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    pairs = one_place.select("ind_id", ((F.col("ind_id") + 1) % 50_000).alias("e_ind_id"))
    assert spatial.interaction_distance(pairs, one_place, one_place, 0.1).where("d = 0").count() == 50_000


def test_nearest_within_against_brute_force(spark):
    """Clusters, copies, ties, points on cells' edges and missing coordinates; and many points at one place, which no pairs could be made of."""
    rng = random.Random(5)
    near = lambda c, w: (c[0] + rng.gauss(0, w), c[1] + rng.gauss(0, w))
    pts = [near((0.3, -0.2), 10.0**-k) for k in range(1, 9) for _ in range(25)] + [(rng.random(), rng.random()) for _ in range(60)] + [(0.25 * i, 0.125 * j) for i in range(5) for j in range(5)] + [(0.5, 0.5)] * 9
    rng.shuffle(pts)
    rows = [(i, *p) for i, p in enumerate(pts)] + [(900, None, 0.1), (901, float("nan"), 0.1), (902, 40.0, 40.0), (903, -0.0, 0.0)]
    schema = "ind_id bigint, x double, y double"
    d, few = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::3], schema)
    for exerters, given, k, radius, halvings in ((d, rows, 3, 0.25, 16), (few, rows[::3], 1, 0.3, 16), (few, rows[::3], 6, 5.0, 3)):
        want = set()
        for i, x, y in rows:
            if x is not None:
                found = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in given if u is not None and j != i)
                found = sorted((a, j) for a, j in found if a <= radius)
                want |= {(i, j, n) for n, (_, j) in enumerate(found[:k], 1)}
        got = [tuple(r) for r in spatial.nearest_within(d, exerters, k, radius, halvings=halvings).select("ind_id", "e_ind_id", "place").collect()]
        assert set(got) == want and len(got) == len(want)
    one_place = spark.range(30_000).select(F.col("id").alias("ind_id"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    got = spatial.nearest_within(one_place, one_place, 3, 0.1)
    assert got.groupBy().agg(F.count("*"), F.max("e_ind_id")).first()[:] == (90_000, 3)


def test_points_on_a_map_spread_their_rows(spark):
    """The first accepted try of each row, and no task makes the tries of a whole table that lies in one file."""
    from genoflux.operators import maps

    cells = spark.range(36).select((F.col("id") % 6).alias("i"), F.expr("id div 6").alias("j"))
    grid = maps.Grid(cells.withColumn("value", F.when(F.col("i") >= 3, 0.05 + 0.9 * F.col("j") / 5).otherwise(0.0)), 6, 6, (0.0, -1.0, 1.0, 1.0))
    d = spark.range(0, 300, 1, 1).select((F.col("id") * 7).alias("k"), F.lit("own").alias("x"), F.lit(True).alias("more"))
    got = {r["k"]: (r["x"], r["y"]) for r in maps.uniform_points_on(d, grid, 3, "k").collect()}
    tries = d.select("k", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("t"))
    tries = tries.select("k", "t", *[draw.uniform(3, "k", stream=3 * F.col("t") + s).alias(n) for s, n in enumerate("xyu")])
    want = {}
    for r in tries.orderBy("k", "t").collect():
        i, j = math.floor(r["x"] * 5 + 0.5), math.floor(r["y"] * 2 * 2.5 + 0.5)
        if r["k"] not in want and i >= 3 and r["u"] < 0.05 + 0.9 * j / 5:
            want[r["k"]] = (r["x"], -1 + 2 * r["y"])
    assert len(want) == 300 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert maps.uniform_points_on(d.limit(0), grid, 3, "k").columns == ["k", "more", "x", "y"]
    with pytest.raises(ValueError):
        maps.uniform_points_on(d, grid, 3, "k", 3, 1)
    seen = []
    real = maps.Grid.nearest_values
    try:
        maps.Grid.nearest_values = lambda self, rows, *a: seen.append(max(rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())) or real(self, rows, *a)
        maps.uniform_points_on(d, grid, 3, "k")
    finally:
        maps.Grid.nearest_values = real
    assert seen[0] <= 300 * 4 / 2


def test_seeds_of_a_batch_are_numpys(spark):
    """Every row's state is that of a generator of its own, and so is what it draws."""
    import numpy as np

    seeds = np.array([0, 1, 5, 2**32 - 1, 2**32, 2**63 - 1, *np.random.default_rng(1).integers(0, 2**63 - 1, 500)], np.uint64)
    assert list(draw._states(seeds)) == [np.random.PCG64(int(x)).state for x in seeds]
    assert list(draw._states(seeds[:0])) == []
    one, sigma = F.lit(1.0), [[2.0, 0.5], [0.5, 1.0]]
    d = spark.range(300).select(
        F.xxhash64(F.lit(4).cast("bigint"), F.lit(7), "id").alias("h"),
        draw.rgamma(4, "id", mean=one, shape=one * 2).alias("g"),
        draw.rbinom(4, "id", size=F.lit(10), prob=one / 2).alias("b"),
        draw.rmultinom(4, "id", size=F.lit(5), prob=F.array(one, one * 3)).alias("m"),
        draw.rmvnorm(4, "id", mu=F.array(one, one * 2), sigma=F.array(*[F.lit(x) for r in sigma for x in r])).alias("v"),
    )
    for r in d.collect():
        own = lambda: np.random.default_rng(r["h"] & (1 << 63) - 1)  # noqa: B023, E731
        assert r["g"] == own().gamma(2.0, 0.5) and r["b"] == own().binomial(10, 0.5) and r["m"] == own().multinomial(5, [0.25, 0.75]).tolist()
        assert r["v"] == pytest.approx(own().multivariate_normal([1.0, 2.0], sigma, method="cholesky").tolist(), rel=1e-12)


def brute_relatedness(a, b, ped):
    def rel(x, y):
        if x[0] < 0 or y[0] < 0:
            return 0.0
        if x[0] == y[0]:
            return 1.0
        parents = lambda t: [(t[1], t[3], t[4]), (t[2], t[5], t[6])] if len(t) == 7 else [(t[1],), (t[2],)] if len(t) == 3 else []
        return sum(rel(x, p) for p in parents(y)) / 2 if x[0] in y[1:] else sum(rel(p, y) for p in parents(x)) / 2

    return rel(ped[a], ped[b])


def test_relatedness(spark):
    ped = {1: (1, -1, -1, -1, -1, -1, -1), 2: (2, -1, -1, -1, -1, -1, -1), 3: (3, 1, 2, -1, -1, -1, -1), 4: (4, 1, 2, -1, -1, -1, -1), 5: (5, 3, 4, 1, 2, 1, 2), 6: (6, 3, 9, 1, 2, -1, -1), 9: (9, -1, -1, -1, -1, -1, -1)}
    d = spark.createDataFrame(list(ped.values()), ", ".join(f"{c} bigint" for c in pedigree.IDS))
    asked = spark.createDataFrame([(a, b) for a in ped for b in ped], "a bigint, b bigint")
    rows = pedigree.pairs(asked, d).select("a", "b", pedigree.relatedness().alias("r"), pedigree.shared_parent_count().alias("s")).collect()
    assert len(rows) == len(ped) ** 2
    for r in rows:
        assert r["r"] == brute_relatedness(r["a"], r["b"], ped), r
    got = {(r["a"], r["b"]): (r["r"], r["s"]) for r in rows}
    assert got[3, 4] == (0.5, 2) and got[1, 3][0] == 0.5 and got[1, 2] == (0.0, 0) and got[5, 6][1] == 1


def test_genome(spark):
    rates = genome.from_starts(spark.createDataFrame([(1, 1.0), (51, 3.0)], "start bigint, rate double"), 99, 1e-2, True)
    assert [tuple(r) for r in rates.orderBy("start").collect()] == [(0, 49, 0.01), (50, 99, 0.03)]
    assert genome.overall_rate(rates).first()[0] == pytest.approx(2.0)
    drawn = genome.draw_positions(spark.range(4000), rates, 3, ["id"])
    low = drawn.where("position < 50").count()
    assert drawn.count() == 4000 and low == pytest.approx(1000, abs=150)
    assert genome.from_ends(spark.createDataFrame([(49, 1.0), (99, 2.0)], "end bigint, rate double")).orderBy("start").first()[:] == (0, 49, 1.0)
    with pytest.raises(PySparkException):
        genome.lookup(rates, spark.createDataFrame([(7,)], "start bigint"), "start").collect()
    hot = genome.multiply_maps(rates, spark.createDataFrame([(0, 24, 1.0), (25, 99, 2.0)], "start bigint, end bigint, multiplier double"))
    assert [tuple(r) for r in hot.orderBy("start").collect()] == [(0, 24, 0.01), (25, 49, 0.02), (50, 99, 0.06)]


def test_positions_on_a_map_of_many_intervals(spark, monkeypatch):
    """Whatever the rates: several tasks sum the map, it has no gaps, an event meets few of its intervals, and draws are made once."""
    import numpy as np

    monkeypatch.setattr(genome, "TASK_INTERVALS", 150, raising=False)
    monkeypatch.setattr(genome, "DEALT", 8, raising=False)
    ends, n = [10 * i + 9 for i in range(600)], 5_000
    rates = [(1e-4 if i < 200 else 1e-9) * (i % 7) for i in range(600)]
    rates[300] = 0.5
    u = np.array([r["u"] for r in spark.range(n).select("id", draw.uniform(3, "id", stream=3).alias("u")).orderBy("id").collect()])
    rows = spark.createDataFrame(list(zip(ends, rates)), "end bigint, rate double").repartition(3)
    made = genome.from_ends(rows)
    assert sorted(tuple(r) for r in made.collect()) == [(e - 9, e, x) for e, x in zip(ends, rates)]
    c = genome.cumulative(made)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({r["task"] for r in c.select("hi", F.spark_partition_id().alias("task")).collect()}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    start, end, lo, hi = (np.array(x) for x in zip(*c.orderBy("start").select("start", "end", "lo", "hi").collect()))
    weights = np.array([10 * x for x in rates if x > 0])
    assert lo[0] == 0 and hi[-1] == 1 and (lo[1:] == hi[:-1]).all() and hi == pytest.approx(np.cumsum(weights) / math.fsum(weights))
    i = np.searchsorted(hi, u, side="right")
    want = np.minimum(start[i] + np.floor((u - lo[i]) / (hi[i] - lo[i]) * (end[i] - start[i] + 1)).astype(int), end[i])
    drawn = genome.draw_positions(spark.range(n), made, 3, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in drawn] == list(enumerate(want.tolist()))
    assert genome._dealt(c, len(weights)).count() <= 2 * len(weights)
    cuts = genome.breakpoints(spark.range(2000), made, 2.0, 5, "id")
    assert cuts._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    number = {r["id"]: r["n"] for r in spark.range(2000).select("id", draw.rpois(5, "id", lam=F.lit(2.0)).alias("n")).collect()}
    events = spark.createDataFrame([(i, k) for i, c in number.items() for k in range(1, c + 1)], "id bigint, k bigint")
    assert sorted(cuts.collect()) == sorted(genome.draw_positions(events, made, 5, ["id", "k"]).select("id", "position").distinct().collect())


def test_positions_on_odd_maps(spark):
    rows = lambda *r: genome.from_ends(spark.createDataFrame(r, "end bigint, rate double"))
    place = lambda made: genome.draw_positions(spark.range(50), made, 3, ["id"]).select("position")
    assert place(rows()).count() == 0 and place(rows((5, 0.0), (9, 0.0))).count() == 0
    assert {r[0] for r in place(rows((4, 0.0), (5, 0.1), (5, 0.3), (9, 0.0))).collect()} == {5}
    assert place(rows((999, 0.1))).where("position between 0 and 999").count() == 50


def test_poisson_draws_of_a_batch_are_numpys(spark):
    import numpy as np

    means = [0.0, 1e-12, 0.5, 2.0, 9.999, 10.0, 40.0]
    for lam in means:
        d = spark.range(300).select(F.xxhash64(F.lit(4).cast("bigint"), F.lit(7), "id").alias("h"), draw.rpois(4, "id", lam=F.lit(lam)).alias("n"))
        assert all(r["n"] == np.random.default_rng(r["h"] & (1 << 63) - 1).poisson(lam) for r in d.collect()), lam
    seeds, lam = np.random.default_rng(1).integers(0, 2**63 - 1, 500).astype(np.uint64), np.linspace(0, 9.9, 500)
    assert draw._poisson(seeds, lam).tolist() == [np.random.default_rng(int(s)).poisson(x) for s, x in zip(seeds, lam)]


def test_ancestry_tables(spark):
    nodes = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 0.0), (3, 1.0), (4, 2.0), (5, 3.0)], "id bigint, time double")
    edges = spark.createDataFrame([(0.0, 10.0, 3, 0), (0.0, 5.0, 3, 1), (5.0, 10.0, 4, 1), (0.0, 10.0, 4, 3), (0.0, 10.0, 5, 2), (0.0, 10.0, 5, 4)], "left double, right double, parent bigint, child bigint")
    above = ancestry.ancestors(spark.createDataFrame([(0,), (1,), (2,)], "start bigint"), edges)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a bigint, b bigint")
    rows = ancestry.common_ancestors(pairs, above, nodes)
    got = {(r["a"], r["b"], r["left"], r["right"], r["mrca"]) for r in ancestry.identity_by_descent(rows).select("a", "b", "left", "right", "mrca").collect()}
    assert got == {(0, 1, 0.0, 5.0, 3), (0, 1, 5.0, 10.0, 4), (0, 2, 0.0, 10.0, 5)}
    stat = {(r["a"], r["b"]): r["stat"] for r in ancestry.divergence_matrix(rows, 10.0).collect()}
    assert stat == {(0, 1): 3.0, (0, 2): 6.0}
    kept_nodes, kept_edges = ancestry.simplify(edges, nodes, ancestry.ancestors(spark.createDataFrame([(0,), (1,)], "start bigint"), edges))
    assert {r["id"] for r in kept_nodes.collect()} == {0, 1, 3, 4, 5} and kept_edges.where("child = 2").count() == 0
    more, cut = ancestry.split_edges(edges, nodes, 0.5, 100)
    assert more.count() == 10 and cut.count() == 10
    assert cut.join(more.withColumnsRenamed({"id": "child", "time": "t"}), "child").where("t <= 0.5").count() == cut.where("child < 3 or child >= 100").count()
    bad = ancestry.integrity_errors(nodes, edges.union(spark.createDataFrame([(1.0, 1.0, 0, 5)], edges.schema)), spark.createDataFrame([(0, 1.0), (1, 1.0)], "id bigint, position double"), spark.createDataFrame([(0, 9, 0)], "id bigint, site bigint, node bigint"))
    assert {r["problem"] for r in bad.collect()} == {"edge with an empty interval", "parent not older than its child", "mutation without a site", "two sites at one position"}


def test_frames(spark):
    d = frames.dictionary(a=1, b=2)
    assert one(spark, frames.get_value(d, "a"), frames.get_value(d, "z"), frames.set_value(d, "a", None), frames.set_value(d, "c", 3), frames.add_keys(d, frames.dictionary(b=9)), frames.all_keys(d), frames.same_contents(d, frames.dictionary(b=2, a=1)), frames.serialize(d, "csv"))[:] == (1, None, {"b": 2}, {"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 9}, ["a", "b"], True, "a,1\nb,2")
    left = frames.with_index(spark.createDataFrame([(x,) for x in "cab"], "v string"), "v")
    assert {r["v"]: r["idx"] for r in left.collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        frames.cbind(left, left)
    again = frames.subset_rows(left, spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "place bigint, idx bigint"))
    assert [r["v"] for r in again.orderBy("place").collect()] == ["c", "a", "c"]


def test_nucleotides_and_colours(spark):
    assert one(spark, nucleotides.to_codes(F.lit("ACGT")), nucleotides.to_codons(nucleotides.to_codes(F.lit("ATGTAA"))), nucleotides.amino_acids(nucleotides.to_codons(nucleotides.to_codes(F.lit("ATGTAA"))), True), nucleotides.codon_bases(F.lit(14)))[:] == ([0, 1, 2, 3], [14, 48], "Met-Ter", [0, 3, 2])
    for bad in ("ACGU", "ACGTA"):
        with pytest.raises(PySparkException):
            one(spark, nucleotides.to_codons(nucleotides.to_codes(F.lit(bad))))
    assert colors.rainbow(3)[0] == "#FF0000" and len(colors.terrain(5)) == 5
    assert one(spark, colors.rgb_to_color(1.0, 0.0, 0.5), colors.color_to_rgb(F.lit("#FF0000")), colors.hsv_to_rgb(0.0, 1.0, 1.0))[:] == ("#FF0080", [1.0, 0.0, 0.0], [1.0, 0.0, 0.0])


def test_formats_round_trip(spark, tmp_path):
    hap = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)], "hap_id bigint, sample bigint, copy bigint")
    mut = spark.createDataFrame([(1, 10, 0.5), (2, 99, -0.25)], "mut_id bigint, position bigint, s double")
    carries = spark.createDataFrame([(0, 1), (1, 1), (3, 2)], "hap_id bigint, mut_id bigint")
    lines = [r["value"] for r in vcf.header_lines(spark, ["i0", "i1"]).orderBy("place").collect()] + [r["value"] for r in vcf.vcf_lines(carries, hap, mut).orderBy("position").collect()]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    sites, calls = vcf.read_vcf(spark, f"file://{tmp_path}/a.vcf")
    assert {(r["position"], r["s"]) for r in sites.collect()} == {(10, 0.5), (99, -0.25)}
    assert {(r["position"], r["sample"], r["copy"]) for r in calls.collect()} == {(10, 0, 0), (10, 0, 1), (99, 1, 1)}
    (tmp_path / "a.ms").write_text("".join(r["value"] + "\n" for r in ms.ms_lines(carries, hap, mut, 101).orderBy("place").collect()))
    sites, held = ms.read_ms(spark, f"file://{tmp_path}/a.ms", 101)
    assert [r["position"] for r in sites.orderBy("site").collect()] == [10, 99]
    assert {(r["haplosome"], r["site"]) for r in held.collect()} == {(0, 0), (1, 0), (3, 1)}
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    seq = fasta.read_fasta(spark, f"file://{tmp_path}/a.fa")
    assert {(r["name"], r["position"], r["base"]) for r in seq.collect()} == {("one", i, b) for i, b in enumerate("ACGTAC")} | {("two", 0, "G"), ("two", 1, "G")}
    (tmp_path / "a.txt").write_text("a b   c d\n1 2.5  T x # note\n2 3.0 F 7y\n")
    d = text.read_csv(spark, f"file://{tmp_path}/a.txt", sep="", comment="#")
    assert d.dtypes == [("a", "bigint"), ("b", "double"), ("c", "boolean"), ("d", "string")] and d.count() == 2
    (tmp_path / "b.csv").write_text("x;y\n1,5;a\n2,25;b\n")
    assert [r["x"] for r in text.read_csv(spark, f"file://{tmp_path}/b.csv", sep=";", decimal=",").orderBy("x").collect()] == [1.5, 2.25]
    (tmp_path / "r.tsv").write_text("1\t1.0\n51\t2.0\n")
    assert text.read_rate_map(spark, f"file://{tmp_path}/r.tsv", 99).orderBy("start").first()[:] == (0, 49, 1e-8)
    state.write_state({"hap": hap}, f"file://{tmp_path}/state")
    assert vectors.identical(state.read_state(spark, f"file://{tmp_path}/state", ["hap"])["hap"], hap)
    text.write_lines(hap.select(F.col("hap_id").cast("string").alias("value")), f"file://{tmp_path}/out", compress=True)
    assert text.read_lines(spark, f"file://{tmp_path}/out").count() == 4


def test_schedule():
    s, seen = Schedule(), []
    s.register("b", "late", lambda x: seen.append("late") or x, 1, 3)
    s.register("a", "first", lambda x: seen.append("first") or x + 1, 2)
    assert s.last_tick() == 3
    total = 0
    for t in range(1, 5):
        total = s.run(total, t)
    assert seen == ["late", "first", "late", "late"] and total == 1
    with pytest.raises(ValueError):
        s.register("a", "first", print)
    s.reschedule("a", 9, 9)
    s.deregister("b")
    assert s.last_tick() == 9


def test_log_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(t, i % 2, "M" if i % 3 == 0 else "F", float(i)) for t in range(6) for i in range(t)], "tick bigint, subpop int, sex string, v double")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    log = TickLog(interval=2).population_size().sex_ratio().subpopulation_size(1).mean_sd("v", F.col("v")).supplied("note")
    log.start(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("tick").collect()
    assert [(r["tick"], r["num_individuals"]) for r in got] == [(2, 2), (4, 4)]
    assert log.lines(log.rows(rows).orderBy("tick")).first()[0].endswith(",NA")


def test_wright_fisher_keeps_the_rules(spark):
    model = simulation.Model({1: 20, 2: 10}, [(1, 2, 0.5)], 999, 1e-4, 1e-3, ((1, 0.5, "f", (0.1,), 0.5), (2, 0.5, "e", (0.1,), 0.5)), seed=3)
    end = simulation.run(simulation.start(spark, model), model, 1, state.fresh)
    assert {r["subpop"]: r["count"] for r in end.individual.groupBy("subpop").count().collect()} == {1: 20, 2: 10}
    assert end.haplosome.count() == 60 and end.carries.join(end.haplosome, "hap_id", "left_anti").count() == 0
    assert end.carries.join(end.mutation, "mut_id", "left_anti").count() == 0 and end.mutation.where("position not between 0 and 999").count() == 0
    again = simulation.run(simulation.start(spark, model), model, 1, state.fresh)
    assert vectors.identical(end.carries, again.carries)
    gone = simulation.kill(end, end.individual.where("subpop = 2"))
    assert gone.haplosome.count() == 40


def test_recombination_reads_both_strands(spark):
    hap = spark.createDataFrame([(10, 1, 0), (11, 1, 1)], "hap_id bigint, ind_id bigint, copy int")
    mut = spark.createDataFrame([(i, 100 * i) for i in range(10)], "mut_id bigint, position bigint")
    carries = spark.createDataFrame([(10, i) for i in range(10)], "hap_id bigint, mut_id bigint")
    gametes = spark.createDataFrame([(k, 1) for k in range(40)], "hap_id bigint, parent bigint")
    cuts = spark.createDataFrame([(k, 450) for k in range(40)], "hap_id bigint, position bigint")
    got = {}
    for r in simulation.recombine(gametes, carries, hap, mut, cuts, 1, 1).collect():
        got.setdefault(r["hap_id"], set()).add(r["mut_id"])
    assert set(map(frozenset, got.values())) == {frozenset(range(5)), frozenset(range(5, 10))} and len(got) == 40


def test_more_ancestry(spark):
    nodes = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 0.0), (3, 1.0), (4, 3.0)], "id bigint, time double")
    edges = spark.createDataFrame([(0.0, 10.0, 3, 0), (0.0, 10.0, 3, 1), (0.0, 10.0, 4, 3), (0.0, 10.0, 4, 2)], "left double, right double, parent bigint, child bigint")
    above = ancestry.ancestors(spark.createDataFrame([(0,), (1,), (2,)], "start bigint"), edges)
    sets = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "sample_set int, sample bigint")
    got = {(r["start"], r["sample_set"]): r["share"] for r in ancestry.nearest_neighbours(above, sets.select(F.col("sample").alias("start")), sets, nodes, 10.0).collect()}
    assert got == {(0, 1): 1.0, (1, 0): 1.0, (2, 0): 0.5, (2, 1): 0.5}
    sites = spark.createDataFrame([(0, 4.0)], "id bigint, position double")
    muts = spark.createDataFrame([(0, 0, 3, 0.0), (1, 0, 3, 0.0), (2, 0, 4, 0.0)], "id bigint, site bigint, node bigint, time double")
    times = {r["id"]: r["time"] for r in ancestry.mutation_times(muts, edges, nodes, sites).collect()}
    assert times == pytest.approx({0: 1 + 4 / 3, 1: 1 + 2 / 3, 2: 3.0})
    renamed = spark.createDataFrame([(10, 3.0), (11, 0.0), (12, 1.0)], "id bigint, time double")
    n, e = ancestry.canonical(renamed, spark.createDataFrame([(0.0, 1.0, 10, 12), (0.0, 1.0, 12, 11)], edges.schema))
    assert {(r["id"], r["time"]) for r in n.collect()} == {(0, 0.0), (1, 1.0), (2, 3.0)} and {(r["parent"], r["child"]) for r in e.collect()} == {(2, 1), (1, 0)}
    x = spark.createDataFrame([(0, 1, 0.0, 10.0, 1.0, 1.0, 3.0), (0, 2, 0.0, 10.0, 3.0, 0.0, 3.0), (1, 2, 0.0, 10.0, 3.0, 0.0, 3.0)], "a bigint, b bigint, left double, right double, time double, depth double, root_time double")
    y = spark.createDataFrame([(0, 1, 0.0, 10.0, 3.0, 0.0, 3.0), (0, 2, 0.0, 10.0, 3.0, 0.0, 3.0), (1, 2, 0.0, 10.0, 1.0, 1.0, 3.0)], x.schema)
    none = spark.createDataFrame([], "difference double")
    assert ancestry.tree_distance(x, y, none, 0.0, 10.0).first()[0] == pytest.approx(math.sqrt(2))
    assert ancestry.tree_distance(x, y, none, 1.0, 10.0).first()[0] == pytest.approx(math.sqrt(8))
    assert ancestry.tree_distance(x, x, none, 0.5, 10.0).first()[0] == 0.0


def test_model_tables(spark):
    from genoflux.plans import model_tables as t

    assert [r["fraction"] for r in t.element_mix(spark, [(1, 1, 3.0), (1, 2, 1.0)]).collect()] == [0.75, 0.25]
    assert [tuple(r) for r in t.rate_map(spark, [49, 99], [0.0, 0.5], True).collect()] == [(0, 49, 0.0), (50, 99, 0.5)]
    assert t.ancestral_sequence(spark, "ACG").count() == 3
    for bad in (lambda: t.rate_map(spark, [9], [0.6], True), lambda: t.rate_map(spark, [9, 5], [0.1, 0.1]), lambda: t.chromosomes(spark, [(1, "Q", 5, "c")]), lambda: t.mutation_types(spark, [(1, 0.5, "g", [1.0])]), lambda: t.genomic_elements(spark, [(1, 0, 9, 1), (1, 5, 12, 1)]), lambda: t.interactions(spark, [(1, "xy", 1.0, "t", [1.0])])):
        with pytest.raises(ValueError):
            bad()


def test_explicit_recombinants(spark):
    mut = spark.createDataFrame([(i, 10 * i) for i in range(10)], "mut_id bigint, position bigint")
    carries = spark.createDataFrame([(1, i) for i in range(0, 10, 2)] + [(2, i) for i in range(1, 10, 2)], "hap_id bigint, mut_id bigint")
    g = spark.createDataFrame([(7, 1, 2), (8, 1, None)], "hap_id bigint, first bigint, second bigint")
    cuts = spark.createDataFrame([(7, 30), (7, 60), (8, 40)], "hap_id bigint, position bigint")
    got = {}
    for r in simulation.recombinant(g.select("hap_id"), g, carries, mut, cuts).collect():
        got.setdefault(r["hap_id"], set()).add(r["mut_id"])
    assert got == {7: {0, 2, 3, 5, 6, 8}, 8: {0, 2}}
    tracts = simulation.gene_conversion(cuts, 1, 1, 1.0, 5.0)
    assert tracts.count() == 6


def test_images(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + bytes(row) for row in ([255, 0, 0, 0, 255, 0], [0, 0, 255, 9, 8, 7]))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    from genoflux.sources.image import read_pixels

    assert {tuple(r)[1:] for r in read_pixels(spark, f"file://{tmp_path}/a.png").collect()} == {(0, 0, 255, 0, 0), (0, 1, 0, 255, 0), (1, 0, 0, 0, 255), (1, 1, 9, 8, 7)}


def test_counts_keep_every_sample_set(spark):
    sets = spark.range(5000).select(F.col("id").alias("sample_set"), F.col("id").alias("sample"))
    carried = spark.createDataFrame([(0, 0), (4999, 0), (4321, 1)], "sample bigint, site bigint")
    c = ancestry.counts(carried, sets)
    assert c.count() == 10000 and c.where("c = 1").count() == 3
