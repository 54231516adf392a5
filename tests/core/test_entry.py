import duckdb
import pytest

import __spark_entry__ as E
from orthospark.plans import catalog, catalog_more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert E.entry(spark).count() == 4
    assert set(catalog.SQL) <= set(catalog.Q) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def norm(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    clean = lambda v: f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted([clean(r[i]) for i in at] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.Q))
def test_query_against_its_oracle(spark, name):
    got = catalog.Q[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in catalog.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(catalog.SQL[name])
        assert norm(rows, got.columns) == norm(want.fetchall(), want.columns)
