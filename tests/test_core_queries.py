import os

import pytest

from comparing import duck, normal
from hirelake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck(FOLDER).execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
