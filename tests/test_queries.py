"""Every registered query of the reference's operators against its SQL on DuckDB."""

import math

import pytest

from lodestone.plans.registry import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert canonical_rows(got.columns, rows) == canonical_rows(columns, want.fetchall())
