"""Spatial maps: grids of values as tables (i, j, value), i along x and j along y, from the lower bounds on.

Point queries send points to their grid cells, so a join by (i, j) finds values, however large the grid is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Grid:
    """A map: its values, numbers of grid points, and bounds (x0, y0, x1, y1)."""

    values: DataFrame
    nx: int
    ny: int
    bounds: tuple[float, float, float, float]
    periodic: tuple[bool, bool] = (False, False)

    def place(self, axis: int) -> Column:
        """A coordinate in grid steps."""
        lo, hi, n = self.bounds[axis], self.bounds[axis + 2], (self.nx, self.ny)[axis]
        return (F.col("xy"[axis]) - lo) / (hi - lo) * (n - 1)

    def combine(self, other: "Grid | DataFrame | float", f) -> "Grid":
        """f of own and other values, cell by cell."""
        if isinstance(other, (int, float)):
            out = self.values.withColumn("value", f(F.col("value"), F.lit(float(other))))
        else:
            theirs = (other.values if isinstance(other, Grid) else other).withColumnRenamed("value", "__other")
            out = self.values.join(theirs, ["i", "j"]).select("i", "j", f(F.col("value"), F.col("__other")).alias("value"))
        return Grid(out, self.nx, self.ny, self.bounds, self.periodic)

    def add(self, x):
        return self.combine(x, lambda a, b: a + b)

    def subtract(self, x):
        return self.combine(x, lambda a, b: a - b)

    def multiply(self, x):
        return self.combine(x, lambda a, b: a * b)

    def divide(self, x):
        return self.combine(x, lambda a, b: a / b)

    def power(self, x):
        return self.combine(x, F.pow)

    def blend(self, x, fraction: float):
        """fraction of x and the rest of its own."""
        return self.combine(x, lambda a, b: b * fraction + a * (1 - fraction))

    def exp(self) -> "Grid":
        return Grid(self.values.withColumn("value", F.exp("value")), self.nx, self.ny, self.bounds, self.periodic)

    def value_range(self) -> DataFrame:
        return self.values.agg(F.min("value").alias("low"), F.max("value").alias("high"))

    def rescale(self, low: float = 0.0, high: float = 1.0) -> "Grid":
        j = self.values.join(F.broadcast(self.value_range()), F.lit(True))  # one row
        return Grid(j.select("i", "j", (low + (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * (high - low)).alias("value")), self.nx, self.ny, self.bounds, self.periodic)

    def nearest_values(self, points: DataFrame, name: str = "map_value") -> DataFrame:
        """points (x, y, ...) with the value of the nearest grid point, halves rounding up."""
        at = points.withColumn("i", F.floor(self.place(0) + 0.5)).withColumn("j", F.floor(self.place(1) + 0.5))
        return at.join(self.values.withColumnRenamed("value", name), ["i", "j"], "left").drop("i", "j")

    def linear_values(self, points: DataFrame, key: str, name: str = "map_value") -> DataFrame:
        """points with the bilinear value of the four grid points around."""
        x, y = self.place(0), self.place(1)
        i0, j0 = F.least(F.floor(x), F.lit(self.nx - 2)), F.least(F.floor(y), F.lit(self.ny - 2))
        fx, fy = x - i0, y - j0
        corners = F.array(*[F.struct((i0 + a).alias("i"), (j0 + b).alias("j"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for a in (0, 1) for b in (0, 1)])
        rows = points.select(key, F.explode(corners).alias("c")).select(key, "c.*").join(self.values, ["i", "j"])
        return points.join(rows.groupBy(key).agg(F.sum(F.col("w") * F.col("value")).alias(name)), key)

    def interpolate(self, factor: int) -> "Grid":
        """A finer grid, by linear interpolation between points."""
        nx, ny = (self.nx - 1) * factor + 1, (self.ny - 1) * factor + 1
        # a point contributes to the finer ones less than a step away
        steps = range(-factor + 1, factor)
        near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((1 - abs(a) / factor) * (1 - abs(b) / factor)).alias("w")) for a in steps for b in steps]))
        fine = self.values.select("i", "j", "value", near.alias("n")).select((F.col("i") * factor + F.col("n.a")).alias("i"), (F.col("j") * factor + F.col("n.b")).alias("j"), (F.col("value") * F.col("n.w")).alias("v"))
        fine = fine.where(F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1))
        return Grid(fine.groupBy("i", "j").agg(F.sum("v").alias("value")), nx, ny, self.bounds, self.periodic)

    def smooth(self, radius: float, kernel) -> "Grid":
        """Weighted mean over grid points within a radius: weights are the kernel's (a function of the distance) times the
        share of the point's cell that lies inside, a half at each edge that isn't periodic."""
        dx, dy = (self.bounds[2] - self.bounds[0]) / (self.nx - 1), (self.bounds[3] - self.bounds[1]) / (self.ny - 1)
        ra, rb = math.floor(radius / dx + 1e-9), math.floor(radius / dy + 1e-9)
        offsets = [(a, b, float(kernel(d))) for a in range(-ra, ra + 1) for b in range(-rb, rb + 1) if (d := math.hypot(a * dx, b * dy)) <= radius]
        edge = lambda c, n, p: F.lit(1.0) if p else F.when((F.col(c) == 0) | (F.col(c) == n - 1), 0.5).otherwise(1.0)
        weight = edge("i", self.nx, self.periodic[0]) * edge("j", self.ny, self.periodic[1])
        near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in offsets]))
        sent = self.values.select("i", "j", "value", weight.alias("c"), near.alias("n"))
        wrap = lambda c, n, p: F.pmod(c, F.lit(n - 1)) if p else c
        sent = sent.select(wrap(F.col("i") + F.col("n.a"), self.nx, self.periodic[0]).alias("i"), wrap(F.col("j") + F.col("n.b"), self.ny, self.periodic[1]).alias("j"), (F.col("n.w") * F.col("c")).alias("w"), "value")
        sums = sent.groupBy("i", "j").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"))
        out = self.values.select("i", "j").join(sums, ["i", "j"], "left").select("i", "j", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("value"))
        return Grid(out, self.nx, self.ny, self.bounds, self.periodic)


def summarize(points: DataFrame, grid: Grid, operation: Column, empty: Column | float | None = 0.0, per_unit_area: bool = False) -> DataFrame:
    """Rows (i, j, value) for every cell: an aggregate over the points whose rounded place it is; per unit area, edge cells
    count half and corners a quarter of an inner cell."""
    i, j = F.floor(grid.place(0) + 0.5), F.floor(grid.place(1) + 0.5)
    x0, y0, x1, y1 = grid.bounds
    inside = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    found = inside.groupBy(i.alias("i"), j.alias("j")).agg(operation.cast("double").alias("value"))
    spark = points.sparkSession
    every = spark.range(grid.nx * grid.ny).select((F.col("id") % grid.nx).alias("i"), F.expr(f"id div {grid.nx}").alias("j"))
    out = every.join(found, ["i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(empty) if not isinstance(empty, Column) else empty))
    if per_unit_area:
        cell = (x1 - x0) / (grid.nx - 1) * (y1 - y0) / (grid.ny - 1)
        half = lambda c, n: F.when((F.col(c) == 0) | (F.col(c) == n - 1), 0.5).otherwise(1.0)
        out = out.withColumn("value", F.col("value") / (cell * half("i", grid.nx) * half("j", grid.ny)))
    return out


def uniform_points_on(df: DataFrame, grid: Grid, seed: int, key: str, tries: int = 32, rounds: int = 1000) -> DataFrame:
    """Points drawn in bounds and accepted with the map's value as their probability; rows that no try settles draw again, and again.

    A round makes few tries first, then up to ``tries``; the first accepted try counts, in whichever round it is made."""
    from ..functions.distributions import uniform
    from ..sources.state import fresh

    x0, y0, x1, y1 = grid.bounds
    t = F.col("t")
    x, y = x0 + (x1 - x0) * uniform(seed, key, stream=3 * t), y0 + (y1 - y0) * uniform(seed, key, stream=3 * t + 1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo, settled, done, step = df.select(key), [], 0, min(4, tries)
    while done < rounds * tries:
        upto = min(done + step, rounds * tries)
        # a table of few files is few tasks, so rows are spread before each becomes several
        rows = todo.repartition(parts, key).select(key, F.explode(F.sequence(F.lit(done), F.lit(upto - 1))).alias("t"))
        rows = rows.select(key, "t", x.alias("x"), y.alias("y"), uniform(seed, key, stream=3 * t + 2).alias("u"))
        good = grid.nearest_values(rows).where(F.col("u") < F.col("map_value"))
        settled.append(fresh(good.groupBy(key).agg(F.min("t").alias("t")), "points"))
        todo = fresh(todo.join(settled[-1], key, "left_anti"), "unsettled")
        if todo.isEmpty():
            break
        done, step = upto, min(2 * step, tries)
    else:
        raise ValueError(f"the map's values are too small: some points weren't accepted in {rounds * tries} tries")
    first = reduce(DataFrame.unionByName, settled)
    first = first.select(key, x.alias("x"), y.alias("y"))
    return df.drop("x", "y").join(first, key).select(*[c for c in df.columns if c not in ("x", "y")], "x", "y")


def improved_nearby(points: DataFrame, grid: Grid, seed: int, key: str, sd: float) -> DataFrame:
    """Each point or a displaced copy of it: taken if the map's value is higher there, else with the values' ratio as its probability."""
    from ..functions.distributions import normal, uniform

    x0, y0, x1, y1 = grid.bounds
    moved = points.select(key, F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("x") + sd * normal(seed, key, stream=1)).alias("x"), (F.col("y") + sd * normal(seed, key, stream=2)).alias("y"))
    new = grid.nearest_values(moved.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)), "new").select(key, F.col("x").alias("nx"), F.col("y").alias("ny"), "new")
    both = grid.nearest_values(points, "old").join(new, key, "left")
    take = F.coalesce(F.col("new") > uniform(seed, key, stream=9) * F.col("old"), F.lit(False))
    return both.withColumn("x", F.when(take, F.col("nx")).otherwise(F.col("x"))).withColumn("y", F.when(take, F.col("ny")).otherwise(F.col("y"))).select(*points.columns)
