"""Every registered query against its SQL on the smallest scale."""

import pytest

import catalog
from catalog.compare import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got.columns)
    if name in catalog.ORACLE:
        assert same(got, con.execute(catalog.ORACLE[name]).df()) is None
    else:
        assert len(got)
