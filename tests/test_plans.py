"""Every registered query of the general engine against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from tessera.plans import catalog


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, small, name):
    df = catalog.QUERIES[name](spark, small)
    r = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = Counter(repr([plain(x[i]) for i in at]) for x in r.fetchall())
    got = Counter(repr([plain(x) for x in row]) for row in df.collect())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
