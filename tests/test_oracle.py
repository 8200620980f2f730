"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: None if x is None else (round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x)
    return Counter(tuple(clean(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())
