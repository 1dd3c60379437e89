"""Every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from cellspan.plans import catalog, catalog_files, catalog_records, catalog_sheets  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    assert sorted([plain(v) for v in r] for r in got.collect()) == sorted([plain(r[i]) for i in order] for r in want.fetchall())
