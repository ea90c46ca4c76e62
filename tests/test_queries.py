"""Every query with SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from tallymark.plans import queries as library

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compared(spark, name, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(row[columns.index(c)]) for c in names) for row in rel.fetchall()), key=repr)
    assert got == want, name


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_matches_sql(spark, name):
    compared(spark, name, library.QUERIES[name], library.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_jobs_are_listed_in_order(spark):
    rows = [(r.ts, r.event_id) for r in library.QUERIES["jobs_in_order"](spark, SF).collect()]
    assert rows == sorted(rows) and len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
