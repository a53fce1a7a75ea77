"""Every query with SQL gives the SQL's rows on the given tables."""

from collections import Counter

import duckdb
import pytest

from aiscope.plans import catalog, checks, detection, reports  # noqa: F401  the others add their queries to the catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(name, spark, sf, duck):
    frame = catalog.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    ours = Counter(tuple(map(str, row)) for row in frame.select(*columns).collect())
    result = duck.execute(catalog.ORACLES[name])
    theirs_columns = [d[0] for d in result.description]
    assert sorted(theirs_columns) == columns
    order = [theirs_columns.index(c) for c in columns]
    assert ours == Counter(tuple(str(row[i]) for i in order) for row in result.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
