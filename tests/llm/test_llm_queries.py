import os

import pytest

from comparing import duck, normal
from hirelake.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, FOLDER).toPandas()
    if name in sql.oracle_sql():
        want = duck(FOLDER).execute(sql.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    elif name.endswith("_found"):
        assert not got.duplicated().any()


def test_sql_belongs_to_queries():
    assert set(sql.oracle_sql()) <= set(queries.queries())
