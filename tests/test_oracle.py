"""Every query that has SQL, held against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kinweave import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{float(v):.6g}" if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    mine = sorted("|".join(plain(r[c]) for c in order) for r in rows)
    theirs = sorted("|".join(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert mine == theirs
