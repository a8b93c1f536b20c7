"""One tick of a population model, as joins over state tables; a driver loop strings ticks together.

State: individual (ind_id, subpop, p1, p2), haplosome (hap_id, ind_id, copy), carries (hap_id, mut_id), mutation (mut_id, position,
mut_type, s, dominance, origin_tick).  Every draw hashes (seed, tick, id), so a lost task is redone with the same result.  A tick
returns new tables, which ``run`` writes out: lineage never spans more than one tick.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import rnorm, rpois, uniform
from ..operators import genome, popgen

PARTS = 64


@dataclass
class State:
    individual: DataFrame
    haplosome: DataFrame
    carries: DataFrame
    mutation: DataFrame
    substitution: DataFrame
    tick: int = 0


@dataclass
class Model:
    """Rates and sizes.  Column hooks stand for callbacks: fitness_effect is multiplied to an individual's fitness."""

    sizes: dict[int, int]
    migration: list[tuple[int, int, float]]
    last_position: int
    mutation_rate: float = 1e-7
    recombination_rate: float = 1e-8
    mutation_types: tuple[tuple[int, float, str, tuple[float, ...], float], ...] = ((1, 1.0, "f", (0.0,), 0.5),)
    selfing_rate: float = 0.0
    cloning_rate: float = 0.0
    seed: int = 1
    fitness_effect: Callable[[DataFrame], DataFrame] | None = None


def start(spark: SparkSession, model: Model) -> State:
    """Subpopulations of individuals that carry nothing."""
    rows = [(p, n) for p, n in sorted(model.sizes.items())]
    sizes = spark.createDataFrame(rows, "subpop int, n bigint")
    ind = sizes.select("subpop", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")).select(F.xxhash64(F.lit(0), "subpop", "k").alias("ind_id"), "subpop", F.lit(-1).cast("bigint").alias("p1"), F.lit(-1).cast("bigint").alias("p2"))
    mutation = spark.createDataFrame([], "mut_id bigint, position bigint, mut_type int, s double, dominance double, origin_tick int")
    return State(ind, _haplosomes(ind), spark.createDataFrame([], "hap_id bigint, mut_id bigint"), mutation, mutation.withColumn("fixation_tick", F.lit(0)))


def _haplosomes(ind: DataFrame) -> DataFrame:
    return ind.select("ind_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).select(F.xxhash64("ind_id", "copy").alias("hap_id"), "ind_id", "copy")


def draw_parents(children: DataFrame, candidates: DataFrame, seed: int, tick: int, which: int) -> DataFrame:
    """Adds a parent to children (ind_id, source) from candidates (subpop, ind_id, fitness), by fitness: a share drawn for each child is
    looked up in the subpopulation's cumulative fitness, by equal parts of (0, 1)."""
    w = Window.partitionBy("subpop").orderBy("ind_id")
    part = lambda x: F.least(F.floor(x * PARTS), F.lit(PARTS - 1)).cast("int")
    c = candidates.where(F.col("fitness") > 0).withColumn("to", F.sum("fitness").over(w)).withColumn("all", F.sum("fitness").over(Window.partitionBy("subpop")))
    c = c.select(F.col("subpop").alias("source"), F.col("ind_id").alias("parent"), ((F.col("to") - F.col("fitness")) / F.col("all")).alias("lo"), (F.col("to") / F.col("all")).alias("hi"))
    c = c.withColumn("part", F.explode(F.sequence(part(F.col("lo")), part(F.col("hi")))))
    u = children.withColumn("u", uniform(seed, F.lit(tick), "ind_id", stream=10 + which)).withColumn("part", part(F.col("u")))
    return u.join(c, ["source", "part"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("ind_id", F.col("parent").alias(f"p{which}"))


def recombine(gametes: DataFrame, carries: DataFrame, haplosomes: DataFrame, mutations: DataFrame, crossovers: DataFrame, seed: int, tick: int) -> DataFrame:
    """Pairs (hap_id, mut_id) of children's haplosomes from gametes (hap_id, parent): a mutation is passed on if it lies on the strand that
    is read at its position, which an even or odd number of crossovers at or below it tells."""
    strands = haplosomes.select(F.col("ind_id").alias("parent"), "copy", F.col("hap_id").alias("strand"))
    held = gametes.withColumn("first", (uniform(seed, F.lit(tick), "hap_id", stream=30) < 0.5).cast("int")).join(strands, "parent").join(carries.withColumnRenamed("hap_id", "strand"), "strand").join(mutations.select("mut_id", "position"), "mut_id")
    cuts = crossovers.groupBy("hap_id").agg(F.collect_list("position").alias("cuts"))  # a few for each gamete
    j = held.join(cuts, "hap_id", "left")
    crossed = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("position"))), F.lit(0))
    return j.where((F.col("first") + F.greatest(crossed, F.lit(0))) % 2 == F.col("copy")).select("hap_id", "mut_id")


def new_mutations(gametes: DataFrame, model: Model, tick: int) -> DataFrame:
    """Rows (hap_id, mut_id, position, mut_type, s, dominance, origin_tick): a Poisson number for each gamete."""
    expected = model.mutation_rate * (model.last_position + 1)
    n = rpois(model.seed, F.lit(tick), "hap_id", lam=F.lit(float(expected)))
    m = gametes.select("hap_id", n.alias("n")).where(F.col("n") > 0).select("hap_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))
    m = m.withColumn("mut_id", F.xxhash64(F.lit("m"), F.lit(tick), "hap_id", "k")).withColumn("position", F.floor(uniform(model.seed, "mut_id", stream=2) * (model.last_position + 1)).cast("bigint"))
    m = genome.draw_types(m, [(t[0], t[1]) for t in model.mutation_types], model.seed, ["mut_id"])
    s = h = None
    for kind, _, dfe, parameters, dominance in model.mutation_types:
        drawn = genome.effect(dfe, model.seed, "mut_id", parameters=parameters)
        s = F.when(F.col("mut_type") == kind, drawn) if s is None else s.when(F.col("mut_type") == kind, drawn)
        h = F.when(F.col("mut_type") == kind, dominance) if h is None else h.when(F.col("mut_type") == kind, dominance)
    return m.select("hap_id", "mut_id", "position", F.col("mut_type").cast("int").alias("mut_type"), s.cast("double").alias("s"), h.cast("double").alias("dominance"), F.lit(tick).alias("origin_tick"))


def fitness(state: State, model: Model) -> DataFrame:
    """Rows (ind_id, subpop, fitness)."""
    f = popgen.fitness(state.carries, state.haplosome, state.mutation).join(state.individual.select("ind_id", "subpop"), "ind_id")
    return model.fitness_effect(f) if model.fitness_effect else f


Save = Callable[[DataFrame, str], DataFrame]


def _offspring(state: State, model: Model, children: DataFrame, tick: int, save: Save = lambda df, name: df) -> State:
    """children (ind_id, subpop, p1, p2, cloned) with their haplosomes, mutations and what they carry."""
    spark = children.sparkSession
    children = save(children, f"children-{tick}")
    hap = _haplosomes(children)
    gametes = hap.join(children, "ind_id").select("hap_id", "copy", F.when(F.col("copy") == 0, F.col("p1")).otherwise(F.col("p2")).alias("parent"), "cloned")
    crossing = spark.createDataFrame([(0, model.last_position, model.recombination_rate)], "start bigint, end bigint, rate double")
    sexual = gametes.where(~F.col("cloned")).select("hap_id", "parent")
    cuts = genome.breakpoints(sexual, crossing, model.recombination_rate * model.last_position, model.seed + tick, "hap_id")
    passed = recombine(sexual, state.carries, state.haplosome, state.mutation, cuts, model.seed, tick)
    copied = gametes.where("cloned").join(state.haplosome.select(F.col("ind_id").alias("parent"), "copy", F.col("hap_id").alias("strand")), ["parent", "copy"]).join(state.carries.withColumnRenamed("hap_id", "strand"), "strand").select("hap_id", "mut_id")
    new = save(new_mutations(gametes.select("hap_id"), model, tick), f"new-{tick}")
    carries = passed.unionByName(copied).unionByName(new.select("hap_id", "mut_id"))
    carries = save(carries, f"passed-{tick}")
    return State(children.select("ind_id", "subpop", "p1", "p2"), hap, carries, state.mutation.unionByName(new.drop("hap_id")), state.substitution, tick)


def wright_fisher_tick(state: State, model: Model, save: Save = lambda df, name: df) -> State:
    """The next generation: children choose a source by migration and parents by fitness; the parents go."""
    tick = state.tick + 1
    spark = state.individual.sparkSession
    sizes = spark.createDataFrame(sorted(model.sizes.items()), "subpop int, n bigint")
    kids = sizes.select("subpop", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")).withColumn("ind_id", F.xxhash64(F.lit(tick), "subpop", "k"))
    u, source = uniform(model.seed, F.lit(tick), "ind_id", stream=1), None
    upto: dict[int, float] = {}
    for src, dst, rate in model.migration:
        lo = upto.get(dst, 0.0)
        upto[dst] = lo + rate
        test = (F.col("subpop") == dst) & (u >= lo) & (u < lo + rate)
        source = F.when(test, src) if source is None else source.when(test, src)
    kids = kids.withColumn("source", (F.col("subpop") if source is None else source.otherwise(F.col("subpop"))).cast("int"))
    f = save(fitness(state, model), f"fitness-{tick}")
    both = kids.join(draw_parents(kids, f, model.seed, tick, 1), "ind_id").join(draw_parents(kids, f, model.seed, tick, 2), "ind_id")
    how = uniform(model.seed, F.lit(tick), "ind_id", stream=4)
    alone = how < model.cloning_rate + model.selfing_rate
    children = both.select("ind_id", "subpop", "p1", F.when(alone, F.col("p1")).otherwise(F.col("p2")).alias("p2"), (how < model.cloning_rate).alias("cloned"))
    return retire_fixed(_offspring(state, model, children, tick, save))


def survive(state: State, model: Model) -> State:
    """Individuals whose draw is below their fitness stay, with what they carry."""
    f = fitness(state, model)
    stay = f.where(uniform(model.seed, F.lit(state.tick), "ind_id", stream=6) < F.col("fitness")).select("ind_id")
    return kill(state, stay, keep=True)


def kill(state: State, individuals: DataFrame, keep: bool = False) -> State:
    how = "left_semi" if keep else "left_anti"
    ind, hap = (x.join(individuals.select("ind_id"), "ind_id", how) for x in (state.individual, state.haplosome))
    return replace(state, individual=ind, haplosome=hap, carries=state.carries.join(hap.select("hap_id"), "hap_id", "left_semi"))


def add_offspring(state: State, model: Model, crosses: DataFrame) -> State:
    """Overlapping generations: children (ind_id, subpop, p1, p2, cloned) join the living."""
    born = _offspring(state, model, crosses, state.tick + 1)
    return replace(born, individual=state.individual.unionByName(born.individual), haplosome=state.haplosome.unionByName(born.haplosome), carries=state.carries.unionByName(born.carries))


def migrate(state: State, moves: DataFrame) -> State:
    """Individuals (ind_id, to) move."""
    j = state.individual.join(moves, "ind_id", "left").withColumn("subpop", F.coalesce("to", "subpop")).drop("to")
    return replace(state, individual=j)


def retire_fixed(state: State) -> State:
    """Mutations that all haplosomes carry become substitutions, those that none carries go."""
    counts = popgen.mutation_counts(state.carries)
    freq = popgen.frequencies(counts, state.haplosome)
    fixed = freq.where(F.col("c") == F.col("n")).select("mut_id")
    gone = state.mutation.join(fixed, "mut_id", "left_semi").withColumn("fixation_tick", F.lit(state.tick))
    live = state.mutation.join(counts.select("mut_id"), "mut_id", "left_semi").join(fixed, "mut_id", "left_anti")
    return replace(state, mutation=live, carries=state.carries.join(fixed, "mut_id", "left_anti"), substitution=state.substitution.unionByName(gone))


def run(state: State, model: Model, ticks: int, save: Save, step=wright_fisher_tick) -> State:
    """Advances ticks; save(table, name) writes a table out and returns it as read again."""
    for _ in range(ticks):
        state = step(state, model, save)
        state = replace(state, **{n: save(getattr(state, n), f"{n}-{state.tick}") for n in ("carries", "mutation", "substitution")})
    return state


def displaced(individuals: DataFrame, sd: float, seed: int, tick: int) -> DataFrame:
    """Positions of offspring around their own."""
    return individuals.withColumns({k: rnorm(seed, F.lit(tick), "ind_id", F.lit(k), mean=F.col(k), sd=sd) for k in ("x", "y")})


def recombinant(gametes: DataFrame, strands: DataFrame, carries: DataFrame, mutations: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pairs (hap_id, mut_id) of gametes (hap_id) from explicit strands (hap_id, first, second), which may be null, and breakpoints
    (hap_id, position): the first strand is read up to the first breakpoint, then the other, and so on."""
    s = strands.join(gametes, "hap_id", "left_semi").select("hap_id", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("first").alias("strand")), F.struct(F.lit(1).alias("turn"), F.col("second").alias("strand")))).alias("s")).select("hap_id", "s.*").where(F.col("strand").isNotNull())
    held = s.join(carries.withColumnRenamed("hap_id", "strand"), "strand").join(mutations.select("mut_id", "position"), "mut_id")
    at = cuts.groupBy("hap_id").agg(F.collect_set("position").alias("cuts"))  # a few for each gamete
    crossed = F.greatest(F.size(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: c <= F.col("position"))), F.lit(0))
    return held.join(at, "hap_id", "left").where(crossed % 2 == F.col("turn")).select("hap_id", "mut_id")


def gene_conversion(cuts: DataFrame, seed: int, tick: int, share: float, mean_length: float) -> DataFrame:
    """Breakpoints (hap_id, position), of which a share become both ends of a short tract of geometric length."""
    from ..functions.distributions import rgeom

    tract = uniform(seed, F.lit(tick), "hap_id", "position", stream=40) < share
    end = F.col("position") + 1 + rgeom(seed + 1, F.lit(tick), "hap_id", "position", p=1.0 / mean_length)
    return cuts.select("hap_id", F.explode(F.when(tract, F.array(F.col("position"), end)).otherwise(F.array("position"))).alias("position")).distinct()


def add_empty(state: State, individuals: DataFrame) -> State:
    """Individuals (ind_id, subpop) whose haplosomes carry nothing join the living."""
    new = individuals.select("ind_id", "subpop", F.lit(-1).cast("bigint").alias("p1"), F.lit(-1).cast("bigint").alias("p2"))
    return replace(state, individual=state.individual.unionByName(new), haplosome=state.haplosome.unionByName(_haplosomes(new)))


def split_off(state: State, model: Model, source: int, subpop: int, n: int) -> State:
    """A new subpopulation of n clones of individuals drawn by fitness from a source."""
    spark = state.individual.sparkSession
    kids = spark.range(n).select(F.xxhash64(F.lit(state.tick), F.lit(subpop), "id").alias("ind_id"), F.lit(source).alias("source"))
    f = fitness(state, model)
    drawn = draw_parents(kids, f, model.seed, state.tick, 1).select("ind_id", F.lit(subpop).alias("subpop"), "p1", F.col("p1").alias("p2"), F.lit(True).alias("cloned"))
    return add_offspring(state, replace(model, mutation_rate=0.0), drawn)
