"""Each registered core query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from countloom import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not DATA.is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as from '{f}'")
    return con


def near(a, b):
    if isinstance(a, (bool, float)) or isinstance(b, (bool, float)):
        return (a is None and b is None) or type(a) is type(b) and a == pytest.approx(b, abs=1e-7)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(ours.columns)
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=str)
    want = sorted((tuple(r) for r in theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert len(got) == len(want)
    assert all(near(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
