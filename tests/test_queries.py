"""Every query of the catalog against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from scoreframe.catalog import load_all
from tests.oracle import DATA, connect, differences, duck_rows, spark_rows

SF = f"{DATA}/sf0.001"
QUERIES = {name: entry.queries()[name] for name in load_all()}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF))
    assert sum(got[1].values()) > 0
    assert name in ORACLES
    assert differences(got, duck_rows(con, ORACLES[name])) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pass@5" in df.columns
