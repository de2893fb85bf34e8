"""Every query with SQL gives the oracle's rows on the smallest tables; those without give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from canopia.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in catalog.oracle_sql():
        found = oracle.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in found.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows) == want


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
