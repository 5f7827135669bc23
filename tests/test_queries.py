"""Every registered query of the store against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want
    assert want, "an empty result tells nothing"


@pytest.mark.parametrize("name, table", [("pending_read_your_writes", "events"), ("write_full_chunks", "events"), ("write_partial_rmw", "events"), ("write_cross_chunk", "events"), ("write_non_adjacent", "events"), ("write_row_2d", "embeddings"), ("write_inner_patch_2d", "embeddings"), ("write_arrays_of_driver", "embeddings")])
def test_writes_are_read_whole(con, name, table):
    """What a write must leave is asked for every cell of the table, and the patch is no fixed number of them."""
    cells = {"events": "(select count(*) from events)", "embeddings": "(select 64 * count(*) from embeddings)"}[table]
    assert con.execute(f"select (select count(*) from ({SQL[name]})) = {cells}").fetchone() == (True,)
    assert name in QUERIES


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
