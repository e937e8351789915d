import os

import duckdb
import pytest

from stratalog.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_oracle(spark, con, name):
    got = catalogue.queries()[name](spark, DATA)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name not in catalogue.oracle_sql():
        assert rows
        return
    rel = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names))) for r in rel.fetchall())
    assert rows == want
