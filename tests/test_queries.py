"""Every engine query against its SQL on the smallest sample."""

from __future__ import annotations

import math
import os

import pytest

from tickloom import queries

SAMPLE = "/root/testdata/sf0.001"
TABLES = ("lineitem", "supplier", "nation", "region")
pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="no sample tables")


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLE}/{t}.parquet'")
    got = queries.queries()[name](spark, SAMPLE)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical([tuple(r[c] for c in columns) for r in got.collect()]) == canonical(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())
