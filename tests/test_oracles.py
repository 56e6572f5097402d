"""Every core query against its DuckDB SQL at the smallest scale."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lineweave import queries as core

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(core.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rel = duck.execute(core.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in rel.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
