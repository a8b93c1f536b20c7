"""Pedigrees: individuals (ind_id, p1, p2, g1..g4) with parents' and grandparents' ids, -1 where unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDS = ("ind_id", "p1", "p2", "g1", "g2", "g3", "g4")


def shared_parent_count(a: str = "a_", b: str = "b_") -> Column:
    """2 if both parents are the same in either order, 1 if any is, 0 otherwise or with an unknown one."""
    a1, a2, b1, b2 = (F.col(x + p) for x in (a, b) for p in ("p1", "p2"))
    unknown = (a1 < 0) | (a2 < 0) | (b1 < 0) | (b2 < 0)
    both = ((a1 == b1) & (a2 == b2)) | ((a1 == b2) & (a2 == b1))
    return F.when(unknown, 0).when(both, 2).when((a1 == b1) | (a1 == b2) | (a2 == b1) | (a2 == b2), 1).otherwise(0)


def _related(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two ids with what is known of their ancestors: (id,), (id, p1, p2) or all seven.

    The same id is wholly related, an unknown one not at all.  Otherwise the younger one's parents are each related to the
    other, half each; an id that is among the other's ancestors is the older one."""
    same = (a[0] >= 0) & (a[0] == b[0])
    older = F.lit(False)
    for x in b[1:]:
        older = older | (a[0] == x)
    parents = lambda t: [(t[1], t[3], t[4]), (t[2], t[5], t[6])] if len(t) == 7 else [(t[1],), (t[2],)]
    down_b = sum((_related(a, p) / 2 for p in parents(b)), F.lit(0.0)) if len(b) > 1 else F.lit(0.0)
    down_a = sum((_related(p, b) / 2 for p in parents(a)), F.lit(0.0)) if len(a) > 1 else F.lit(0.0)
    return F.when((a[0] < 0) | (b[0] < 0), 0.0).when(same, 1.0).when(older, down_b).otherwise(down_a)


def relatedness(a: str = "a_", b: str = "b_") -> Column:
    """Pedigree relatedness of a pair by autosomes, over two generations of ancestors."""
    return _related(tuple(F.col(a + c) for c in IDS), tuple(F.col(b + c) for c in IDS))


def pairs(asked: DataFrame, individuals: DataFrame) -> DataFrame:
    """Asked pairs (a, b) with both sides' ids, as a_... and b_..."""
    side = lambda x: individuals.select(*[F.col(c).alias(f"{x}_{c}") for c in IDS])
    return asked.join(side("a"), F.col("a") == F.col("a_ind_id")).join(side("b"), F.col("b") == F.col("b_ind_id"))
