"""Every query with SQL gives the rows that DuckDB gives; the others give rows and a stable schema."""

import glob
import os

import duckdb
import pytest

from accordis.plans import queries as q

D = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    norm = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(str([norm(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, db, name):
    df = q.QUERIES[name](spark, D)
    rows = df.collect()
    assert df.columns and (rows or name in ("unmatched_skill_anti",))
    if name in q.ORACLE_SQL:
        res = db.execute(q.ORACLE_SQL[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == sorted(df.columns)
        want = [[r[names.index(c)] for c in df.columns] for r in res.fetchall()]
        assert plain(map(list, rows)) == plain(want)
