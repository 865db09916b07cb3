"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from plumbline import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.6g}")
    return float(f"{float(v):.6g}") if hasattr(v, "as_tuple") else v


def ordered(rows):
    return sorted([tuple(map(plain, r)) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    other = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ordered(found.select(*columns).collect()) == ordered([tuple(r[i] for i in at) for r in other.fetchall()])
