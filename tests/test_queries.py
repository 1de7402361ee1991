"""Every registered query of the hydrological operators against its SQL twin."""

import duckdb
import pytest

from fluvia import plans

TABLES = "supplier lineitem events part".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, f"{v:+.4f}" if isinstance(v, float) else str(v)) for v in row))


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, sf_dir, con, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = ordered(map(tuple, df.select(*columns).collect()))
    if name not in plans.oracle_sql():
        assert got
        return
    made = con.sql(plans.oracle_sql()[name])
    assert sorted(made.columns) == columns
    want = ordered(made.select(*(f'"{c}"' for c in columns)).fetchall())
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
