"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from siltweb import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "null" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows), sorted(columns)


@pytest.fixture(scope="module")
def database(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, small, database, name):
    df = catalog.QUERIES[name](spark, small)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    want = database.sql(catalog.ORACLES[name])
    assert got == canonical(want.fetchall(), want.columns)
    assert got[0] or name == "fingerprint_refind"


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
