"""Connected components of links between ids, as DataFrame joins and aggregates.

Alternating large and small stars: every round links each id to the smallest in its neighbourhood until only stars are
left, one around each component's smallest id.  A hub's links are pre-aggregated by partial minimums before any shuffle, and
joins let Spark split skewed keys.  Each round is written to the shared folder, so no round is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b."""
    if large:  # larger neighbours of an id go to the smallest of its neighbourhood
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # written out, so that the join has an exchange on either side and Spark can split the links of a hub
        least = stash(least.select("a", F.least("a", "m").alias("m")), "least")
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # an id and its smaller neighbours go to the smallest of them
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component, the smallest id that is reachable, of all ids in links (a, b) but the smallest ones themselves."""
    now = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    was = mark(now)
    for _ in range(MOST_ROUNDS):
        if not was[0]:
            break
        nxt = stash(_star(_star(now, True), False), "links")
        drop_stash(now)
        now, same = nxt, was
        if (was := mark(now)) == same:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
