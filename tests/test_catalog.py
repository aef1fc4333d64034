import os

import duckdb
import pytest

from vacantia.plans import catalog

TESTDATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{TESTDATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TESTDATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    mine = catalog.QUERIES[name](spark, TESTDATA)
    theirs = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, mine.select(*names).collect()), key=key) == sorted(theirs.fetchall(), key=key)


def test_entry_point():
    import __spark_entry__

    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
