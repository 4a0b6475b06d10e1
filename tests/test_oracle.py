"""Every query on the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

from fenloom.plans import QUERIES, SQL
from tests.compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in SQL:
        problem = compare(got, con.execute(SQL[name]).df())
        assert problem is None, problem
