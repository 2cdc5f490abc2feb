import duckdb
import pytest

from tidemill.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    want = db.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows
