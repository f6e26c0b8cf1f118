"""Every query with SQL gives the rows of its SQL; the others give rows."""

import compare
import pytest

from tracklane.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, name):
    assert compare.differences(spark, con, registry.QUERIES[name], registry.SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    sf = "/root/testdata/sf0.01" if name == "shortest_paths" else SF  # searches are ids divisible by 100
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_golden_split(spark):
    from pyspark.sql import functions as F

    from tracklane.operators import series

    parts = spark.range(720).groupBy(series.split_by_position(F.col("id"), F.lit(720)).alias("part")).count().collect()
    assert dict(map(tuple, parts)) == {"train": 503, "val": 108, "test": 109}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
