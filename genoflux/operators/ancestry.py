"""Ancestry tables: node (id, time, population, individual), edge (left, right, parent, child), site (id, position), mutation
(id, site, node, time).  A genotype table (sample, site) has a row where a sample carries a derived allele.

Statistics over samples start with one count for each site and set.  Walks up the trees take one join for each level,
over interval rows (node, left, right) that only shrink, and stop when no row moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import NAN, divide
from .frames import with_index


def counts(genotypes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (site, sample_set, c, n) of samples in sets (sample_set, sample), 0 included for every set of a site that varies."""
    n = sets.groupBy("sample_set").agg(F.count("*").alias("n"))
    found = genotypes.join(sets, "sample").groupBy("site", "sample_set").agg(F.count("*").alias("c"))
    every = genotypes.select("site").distinct().crossJoin(n)  # a row for each set
    return every.join(found, ["site", "sample_set"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def _windowed(c: DataFrame, sites: DataFrame, width: float | None) -> tuple[DataFrame, list[str]]:
    if width is None:
        return c, []
    return c.join(sites.select(F.col("id").alias("site"), F.floor(F.col("position") / width).alias("window")), "site"), ["window"]


def general_stat(c: DataFrame, sites: DataFrame, value: Column, width: float | None = None, span: float = 1.0) -> DataFrame:
    """Any sum over sites of a function of c and n, for each set (and window), per unit of length."""
    c, w = _windowed(c, sites, width)
    return c.groupBy(*w, "sample_set").agg((F.sum(value) / (width or span)).alias("stat"))


def diversity_value() -> Column:
    return divide(2 * F.col("c") * (F.col("n") - F.col("c")), F.col("n") * (F.col("n") - 1))


def segregating_value() -> Column:
    return ((F.col("c") > 0) & (F.col("c") < F.col("n"))).cast("double")


def pairs_of_sets(c: DataFrame) -> DataFrame:
    """Rows (site, a, b, ca, na, cb, nb) of two sets each; sets are few."""
    side = lambda x: c.select("site", F.col("sample_set").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"))
    return side("a").join(side("b"), "site").where(F.col("a") <= F.col("b"))


def divergence(c: DataFrame, span: float = 1.0) -> DataFrame:
    """Rows (a, b, stat): mean differences between samples of two sets, or within one."""
    x, y, n, m = F.col("ca"), F.col("cb"), F.col("na"), F.col("nb")
    apart = F.when(F.col("a") == F.col("b"), divide(2 * x * (n - x), n * (n - 1))).otherwise(divide(x * (m - y) + (n - x) * y, n * m))
    return pairs_of_sets(c).groupBy("a", "b").agg((F.sum(apart) / span).alias("stat"))


def genetic_relatedness(c: DataFrame, span: float = 1.0) -> DataFrame:
    """Rows (a, b, stat): products of the sets' frequencies less the mean frequency over all sets."""
    mean = c.groupBy("site").agg((F.sum(F.col("c") / F.col("n")) / F.count("*")).alias("mean"))
    j = pairs_of_sets(c).join(mean, "site")
    return j.groupBy("a", "b").agg((F.sum((F.col("ca") / F.col("na") - F.col("mean")) * (F.col("cb") / F.col("nb") - F.col("mean"))) / span).alias("stat"))


def relatedness_vector(genotypes: DataFrame, samples: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows (sample, value): the centred genotype relatedness matrix times weights (sample, w), without forming the matrix."""
    n = samples.count()
    total = weights.agg(F.sum("w").alias("all"))
    p = genotypes.groupBy("site").agg((F.count("*") / n).alias("p"))
    load = genotypes.join(weights, "sample").groupBy("site").agg(F.sum("w").alias("load"))
    t = p.join(load, "site", "left").join(F.broadcast(total), F.lit(True)).select("site", "p", (F.coalesce("load", F.lit(0.0)) - F.col("p") * F.col("all")).alias("t"))  # one row
    base = t.agg(F.sum(F.col("p") * F.col("t")).alias("base"))
    own = genotypes.join(t, "site").groupBy("sample").agg(F.sum("t").alias("own"))
    return samples.join(own, "sample", "left").join(F.broadcast(base), F.lit(True)).select("sample", (F.coalesce("own", F.lit(0.0)) - F.col("base")).alias("value"))  # one row


def frequency_spectrum(c: DataFrame, folded: bool = False) -> DataFrame:
    """Rows (counts, n_sites): the joint spectrum over all sets, as arrays of counts in the order of the sets."""
    joint = c.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("sample_set", "c", "n"))).alias("s"))
    up, down = F.transform("s", lambda x: x["c"]), F.transform("s", lambda x: x["n"] - x["c"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + x)
    key = F.when((total(up) < total(down)) | ((total(up) == total(down)) & (up <= down)), up).otherwise(down) if folded else up
    return joint.groupBy(key.alias("counts")).agg(F.count("*").alias("n_sites"))


def trait_stats(genotypes: DataFrame, traits: DataFrame) -> DataFrame:
    """Rows (site, covariance_sq, correlation_sq, slope) of a trait (sample, trait) on the derived allele, by sums over carriers only."""
    all_ = traits.agg(F.count("*").alias("n"), F.sum("trait").alias("sy"), F.sum(F.col("trait") * F.col("trait")).alias("syy"))
    own = genotypes.join(traits, "sample").groupBy("site").agg(F.count("*").alias("c"), F.sum("trait").alias("sxy"))
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    sxy, sxx, syy = F.col("sxy") - c * F.col("sy") / n, c - c * c / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    j = own.join(F.broadcast(all_), F.lit(True))  # one row
    return j.select("site", F.pow(sxy / (n - 1), F.lit(2.0)).alias("covariance_sq"), divide(sxy * sxy, sxx * syy).alias("correlation_sq"), divide(sxy, sxx).alias("slope"))


def two_locus(genotypes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Rows (a, b, d, r, r_squared) of asked pairs of sites."""
    size = genotypes.groupBy("site").agg(F.count("*").alias("c"))
    ga, gb = (genotypes.select(F.col("site").alias(x), "sample") for x in "ab")
    both = pairs.join(ga, "a").join(gb, ["b", "sample"]).groupBy("a", "b").agg(F.count("*").alias("cab"))
    j = pairs.join(both, ["a", "b"], "left").join(size.select(F.col("site").alias("a"), F.col("c").alias("ca")), "a").join(size.select(F.col("site").alias("b"), F.col("c").alias("cb")), "b")
    p, q, pq = F.col("ca") / n, F.col("cb") / n, F.coalesce("cab", F.lit(0)) / n
    d, v = pq - p * q, p * (1 - p) * q * (1 - q)
    return j.select("a", "b", d.alias("d"), divide(d, F.sqrt(v)).alias("r"), divide(d * d, v).alias("r_squared"))


def ancestors(nodes: DataFrame, edges: DataFrame, save=lambda df: df, most: int = 10_000) -> DataFrame:
    """Rows (start, node, left, right): every ancestor of starting nodes (start), with the interval where it is one.

    One join and one row for each level; save() should write a level out, as lineage grows with the depth otherwise."""
    e = edges.select("parent", F.col("child").alias("node"), F.col("left").alias("el"), F.col("right").alias("er"))
    span = edges.agg(F.min("left").alias("left"), F.max("right").alias("right"))
    now = save(nodes.select("start").join(F.broadcast(span), F.lit(True)).select("start", F.col("start").alias("node"), "left", "right"))  # one row
    levels = [now]
    for _ in range(most):
        up = now.join(e, "node").where((F.col("left") < F.col("er")) & (F.col("el") < F.col("right")))
        now = save(up.select("start", F.col("parent").alias("node"), F.greatest("left", "el").alias("left"), F.least("right", "er").alias("right")))
        if now.isEmpty():
            break
        levels.append(now)
    else:
        raise RuntimeError(f"there are ancestors beyond {most} levels")
    return reduce(lambda a, b: a.unionByName(b), levels)


def common_ancestors(pairs: DataFrame, above: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (a, b, left, right, mrca, time) of asked pairs: over every stretch the youngest node above both."""
    x = above.select(F.col("start").alias("a"), "node", F.col("left").alias("al"), F.col("right").alias("ar"))
    y = above.select(F.col("start").alias("b"), "node", F.col("left").alias("bl"), F.col("right").alias("br"))
    met = pairs.join(x, "a").join(y, ["b", "node"]).where((F.col("al") < F.col("br")) & (F.col("bl") < F.col("ar")))
    met = met.join(nodes.select(F.col("id").alias("node"), "time"), "node").select("a", "b", "node", "time", F.greatest("al", "bl").alias("left"), F.least("ar", "br").alias("right"))
    # cut at every end, then take the youngest over each stretch
    ends = met.select("a", "b", F.explode(F.array("left", "right")).alias("left")).distinct()
    cut = ends.withColumn("right", F.lead("left").over(Window.partitionBy("a", "b").orderBy("left"))).where(F.col("right").isNotNull())
    inside = cut.withColumnsRenamed({"left": "l", "right": "r"}).join(met, ["a", "b"]).where((F.col("left") <= F.col("l")) & (F.col("right") >= F.col("r")))
    return inside.groupBy("a", "b", F.col("l").alias("left"), F.col("r").alias("right")).agg(F.min_by(F.struct("node", "time"), "time").alias("m")).select("a", "b", "left", "right", F.col("m.node").alias("mrca"), "m.time")


def divergence_matrix(mrcas: DataFrame, span: float) -> DataFrame:
    """Rows (a, b, stat): twice the mean time to the common ancestor."""
    return mrcas.groupBy("a", "b").agg((F.sum(2 * F.col("time") * (F.col("right") - F.col("left"))) / span).alias("stat"))


def coalescence_counts(mrcas: DataFrame, breaks: list[float] | None = None) -> DataFrame:
    """Rows (bin, weight): the length over which pairs have their common ancestor at a node, or in a stretch of time."""
    key = F.col("mrca") if breaks is None else F.size(F.filter(F.array(*[F.lit(float(b)) for b in breaks]), lambda b: b <= F.col("time"))) - 1
    return mrcas.groupBy(key.alias("bin")).agg(F.sum(F.col("right") - F.col("left")).alias("weight"))


def coalescence_quantile(mrcas: DataFrame, p: float) -> DataFrame:
    """Time by which a share of the pairs' length has coalesced."""
    t = mrcas.groupBy("time").agg(F.sum(F.col("right") - F.col("left")).alias("w"))
    total, upto = F.sum("w").over(Window.partitionBy()), F.sum("w").over(Window.orderBy("time"))
    return t.select("time", (upto / total).alias("share")).where(F.col("share") >= p).agg(F.min("time").alias("time"))


def coalescence_rates(mrcas: DataFrame, breaks: list[float]) -> DataFrame:
    """Rows (bin, rate): pairs that coalesce in a stretch of time, over those that haven't before, per unit of time."""
    b = coalescence_counts(mrcas, breaks).where(F.col("bin") >= 0)
    left = F.sum("weight").over(Window.orderBy(F.desc("bin")))
    width = F.element_at(F.array(*[F.lit(float(z - a)) for a, z in zip(breaks, [*breaks[1:], float("inf")])]), (F.col("bin") + 1).cast("int"))
    share = F.least(F.col("weight") / left, F.lit(1 - 1e-12))
    return b.select("bin", (F.when(F.col("weight") >= left, NAN).otherwise(-F.ln(1 - share)) / width).alias("rate"))


def identity_by_descent(mrcas: DataFrame, least_span: float = 0.0, most_time: float = float("inf")) -> DataFrame:
    """Rows (a, b, mrca, left, right): neighbouring stretches with one common ancestor, joined."""
    w = Window.partitionBy("a", "b").orderBy("left")
    new = (F.coalesce((F.lag("mrca").over(w) != F.col("mrca")) | (F.lag("right").over(w) != F.col("left")), F.lit(True))).cast("int")
    runs = mrcas.where(F.col("time") <= most_time).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("a", "b", "mrca", "run").agg(F.min("left").alias("left"), F.max("right").alias("right")).where(F.col("right") - F.col("left") >= least_span).drop("run")


def mean_descendants(above: DataFrame, sets: DataFrame, span: float) -> DataFrame:
    """Rows (node, sample_set, mean): samples of a set below a node, averaged over the length."""
    j = above.join(sets.select(F.col("sample").alias("start"), "sample_set"), "start")
    return j.groupBy("node", "sample_set").agg((F.sum(F.col("right") - F.col("left")) / span).alias("mean"))


def simplify(edges: DataFrame, nodes: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that lie above samples: edges are cut to the stretches that are passed on, unary nodes stay."""
    kept = above.select("node", "left", "right").distinct()
    e = edges.join(kept.select(F.col("node").alias("child"), F.col("left").alias("l"), F.col("right").alias("r")), "child").where((F.col("left") < F.col("r")) & (F.col("l") < F.col("right")))
    e = e.select(F.greatest("left", "l").alias("left"), F.least("right", "r").alias("right"), "parent", "child")
    used = kept.select(F.col("node").alias("id")).distinct()
    return nodes.join(used, "id", "left_semi"), squash(e)


def squash(edges: DataFrame) -> DataFrame:
    """Overlapping and adjacent edges of a parent and a child as one."""
    w = Window.partitionBy("parent", "child").orderBy("left")
    new = (F.col("left") > F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    runs = edges.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("parent", "child", "run").agg(F.min("left").alias("left"), F.max("right").alias("right")).select("left", "right", "parent", "child")


def split_edges(edges: DataFrame, nodes: DataFrame, time: float, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges where every edge that crosses a time passes through a new node."""
    t = lambda x: nodes.select(F.col("id").alias(x), F.col("time").alias(f"{x}_time"))
    j = edges.join(t("parent"), "parent").join(t("child"), "child")
    crossing = (F.col("child_time") < time) & (F.col("parent_time") > time)
    key = ["parent", "child", "left"]
    new = with_index(j.where(crossing).select(*key, "right"), *key, idx="id").withColumn("id", (F.col("id") + first_id).cast("bigint"))
    halves = new.select("left", "right", "parent", F.col("id").alias("child")).unionByName(new.select("left", "right", F.col("id").alias("parent"), "child"))
    more = new.select("id", F.lit(float(time)).alias("time"))
    return nodes.unionByName(more, allowMissingColumns=True), j.where(~crossing).select("left", "right", "parent", "child").unionByName(halves)


def deduplicate_sites(sites: DataFrame, mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One site for each position; mutations move to it."""
    first = sites.groupBy("position").agg(F.min("id").alias("first"))
    moved = sites.join(first, "position").select(F.col("id").alias("site"), "first")
    return sites.join(first, (sites["id"] == first["first"]), "left_semi"), mutations.join(moved, "site").withColumn("site", F.col("first")).drop("first")


def mutation_parents(mutations: DataFrame, above: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds parent: the youngest other mutation of the site on a node above, or an older one on the same node."""
    m = mutations.join(sites.select(F.col("id").alias("site"), "position"), "site")
    up = m.join(above.select(F.col("start").alias("node"), F.col("node").alias("above"), "left", "right"), "node").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right")))
    o = mutations.select("site", F.col("node").alias("above"), F.col("id").alias("pid"), F.col("time").alias("ptime"))
    best = up.join(o, ["site", "above"]).where((F.col("pid") != F.col("id")) & (F.col("ptime") > F.col("time"))).groupBy("id").agg(F.min_by("pid", "ptime").alias("parent"))
    return mutations.join(best, "id", "left")


def subset(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) to keep and the edges among them."""
    e = edges.join(keep.select(F.col("id").alias("parent")), "parent", "left_semi").join(keep.select(F.col("id").alias("child")), "child", "left_semi")
    return nodes.join(keep, "id", "left_semi"), e.select("left", "right", "parent", "child")


def union(nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame, other_edges: DataFrame, same: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Two table sets as one: same (id, other_id) are shared nodes, the other's remaining ones get new ids."""
    rest = other_nodes.join(same.select(F.col("other_id").alias("id")), "id", "left_anti")
    named = with_index(rest.select(F.col("id").alias("other_id")), "other_id", idx="id").withColumn("id", (F.col("id") + first_id).cast("bigint"))
    to = same.select("other_id", "id").unionByName(named)
    added = rest.withColumnRenamed("id", "other_id").join(named, "other_id").drop("other_id")
    side = lambda x: to.select(F.col("other_id").alias(x), F.col("id").alias(f"new_{x}"))
    e = other_edges.join(side("parent"), "parent").join(side("child"), "child").select("left", "right", F.col("new_parent").alias("parent"), F.col("new_child").alias("child"))
    return nodes.unionByName(added), edges.unionByName(e).distinct()


def delete_older(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, time: float) -> tuple[DataFrame, DataFrame]:
    """Edges whose parent, and mutations that, are no older than a time."""
    young = nodes.where(F.col("time") <= time).select(F.col("id").alias("parent"))
    return edges.join(young, "parent", "left_semi"), mutations.where(F.col("time") <= time)


def integrity_errors(nodes: DataFrame, edges: DataFrame, sites: DataFrame, mutations: DataFrame) -> DataFrame:
    """Rows (problem, n) of what breaks the rules; none if all is well."""
    t = lambda x: nodes.select(F.col("id").alias(x), F.col("time").alias(f"{x}_time"))
    missing = lambda df, c, other: df.join(other.select(F.col("id").alias(c)), c, "left_anti")
    checks = {
        "edge without a parent node": missing(edges, "parent", nodes),
        "edge without a child node": missing(edges, "child", nodes),
        "edge with an empty interval": edges.where(F.col("left") >= F.col("right")),
        "parent not older than its child": edges.join(t("parent"), "parent").join(t("child"), "child").where(F.col("parent_time") <= F.col("child_time")),
        "mutation without a site": missing(mutations, "site", sites),
        "mutation without a node": missing(mutations, "node", nodes),
        "two sites at one position": sites.groupBy("position").count().where(F.col("count") > 1),
    }
    rows = [df.agg(F.lit(k).alias("problem"), F.count("*").alias("n")) for k, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).where(F.col("n") > 0)


def nearest_neighbours(above: DataFrame, focal: DataFrame, sets: DataFrame, nodes: DataFrame, span: float) -> DataFrame:
    """Rows (start, sample_set, share): for focal samples (start), the sets' shares among the samples that join it first, averaged over
    the length.

    Over each stretch that is the youngest ancestor with another sample below; its samples other than the focal one count."""
    t = above.join(nodes.select(F.col("id").alias("node"), "time"), "node")
    f = focal.select("start").join(t, "start").select("start", "node", "time", F.col("left").alias("fl"), F.col("right").alias("fr"))
    o = t.join(sets.select(F.col("sample").alias("start"), "sample_set"), "start").select(F.col("start").alias("other"), "sample_set", "node", F.col("left").alias("ol"), F.col("right").alias("or_"))
    met = f.join(o, "node").where((F.col("start") != F.col("other")) & (F.col("fl") < F.col("or_")) & (F.col("ol") < F.col("fr")))
    met = met.select("start", "other", "sample_set", "node", "time", F.greatest("fl", "ol").alias("left"), F.least("fr", "or_").alias("right"))
    ends = met.select("start", F.explode(F.array("left", "right")).alias("l")).distinct()
    cut = ends.withColumn("r", F.lead("l").over(Window.partitionBy("start").orderBy("l"))).where(F.col("r").isNotNull())
    inside = cut.join(met, "start").where((F.col("left") <= F.col("l")) & (F.col("right") >= F.col("r")))
    first = inside.groupBy("start", "l", "r").agg(F.min("time").alias("time"))
    near = inside.join(first, ["start", "l", "r", "time"]).groupBy("start", "l", "r", "sample_set").agg(F.countDistinct("other").alias("k"))
    all_ = near.groupBy("start", "l", "r").agg(F.sum("k").alias("all"))
    share = F.sum(F.col("k") / F.col("all") * (F.col("r") - F.col("l"))) / span
    return near.join(all_, ["start", "l", "r"]).groupBy("start", "sample_set").agg(share.alias("share"))


def tree_distance(first: DataFrame, second: DataFrame, depths: DataFrame, weight: float, span: float) -> DataFrame:
    """One row (distance): Kendall-Colijn distance of two ancestries over the same samples, averaged over the length.

    first and second are common ancestors of all pairs asked, with root_time and depth, the branches from the root to the
    ancestor; depths has the pendant branches' differences, (difference).  weight is the share of times against branches."""
    value = lambda x: F.col(x + "depth") * (1 - weight) + (F.col(x + "root_time") - F.col(x + "time")) * weight
    named = lambda df, x: df.select("a", "b", *[F.col(c).alias(x + c) for c in ("left", "right", "time", "depth", "root_time")])
    j = named(first, "x_").join(named(second, "y_"), ["a", "b"]).where((F.col("x_left") < F.col("y_right")) & (F.col("y_left") < F.col("x_right")))
    j = j.select("a", "b", F.greatest("x_left", "y_left").alias("left"), F.least("x_right", "y_right").alias("right"), F.pow(value("x_") - value("y_"), F.lit(2.0)).alias("d"))
    pendant = depths.agg(F.coalesce(F.sum(F.pow(F.col("difference") * weight, F.lit(2.0))), F.lit(0.0)).alias("pendant"))
    cuts = j.select(F.explode(F.array("left", "right")).alias("l")).distinct()
    at = with_index(cuts, "l", idx="k")
    cut = at.join(at.select((F.col("k") - 1).alias("k"), F.col("l").alias("r")), "k").drop("k")
    sums = j.join(cut, (F.col("left") <= F.col("l")) & (F.col("right") >= F.col("r"))).groupBy("l", "r").agg(F.sum("d").alias("d"))
    return sums.join(F.broadcast(pendant), F.lit(True)).agg((F.sum(F.sqrt(F.col("d") + F.col("pendant")) * (F.col("r") - F.col("l"))) / span).alias("distance"))  # one row


def mutation_times(mutations: DataFrame, edges: DataFrame, nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """mutations with times: those above one node at one site are spaced evenly between the node's time and its parent's there, the
    one with the smallest id oldest; above a root they have the node's time."""
    t = lambda x: nodes.select(F.col("id").alias(x), F.col("time").alias(f"{x}_time"))
    m = mutations.drop("time").join(sites.select(F.col("id").alias("site"), "position"), "site")
    e = edges.select(F.col("child").alias("node"), "parent", "left", "right").join(t("parent"), "parent")
    over = m.join(e, "node").where((F.col("left") <= F.col("position")) & (F.col("position") < F.col("right"))).select("id", "parent_time")
    j = m.join(over, "id", "left").join(t("node"), "node")
    by = Window.partitionBy("site", "node")
    step = F.row_number().over(by.orderBy(F.desc("id"))) / (F.count("*").over(by) + 1)
    return j.withColumn("time", F.col("node_time") + F.coalesce((F.col("parent_time") - F.col("node_time")) * step, F.lit(0.0))).drop("position", "parent_time", "node_time")


def canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids numbered anew, youngest first, by ranges; edges are moved along."""
    named = with_index(nodes, "time", "id", idx="new")
    side = lambda x: named.select(F.col("id").alias(x), F.col("new").alias(f"new_{x}"))
    e = edges.join(side("parent"), "parent").join(side("child"), "child").select("left", "right", F.col("new_parent").alias("parent"), F.col("new_child").alias("child"))
    return named.withColumn("id", F.col("new")).drop("new"), e.orderBy("parent", "child", "left")
