"""Every registered query of the base library against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from genoflux.plans import more_queries  # noqa: F401
from genoflux.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(columns).collect())
    if name not in ORACLE:
        assert got
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(norm(r[i]) for i in order)) for r in want.fetchall())


def test_draws_are_made_by_several_tasks(spark):
    """Though the events lie in one file."""
    from pyspark.sql import functions as F

    assert QUERIES["draws"](spark, SF).select(F.spark_partition_id()).distinct().count() > 1
