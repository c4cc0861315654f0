"""Every query against its oracle SQL, and the driver contract."""

import math
import os

import duckdb
import pytest

from orrery.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(v[i]) for i in order) for v in values), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    got = catalogue.queries()[name](spark, data)
    values = [tuple(r) for r in got.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert values or name not in ("q49_entity_select", "q55_html_extract", "q57_url_normalise", "q72_ols_hc3")
        return
    made = duck.execute(sql)
    names, want = [d[0] for d in made.description], made.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, values) == rows(names, want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
