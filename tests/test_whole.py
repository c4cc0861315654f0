"""Queries over whole tables, against their SQL on tables whose keys begin past every prefix."""

import hashlib
import random

import duckdb
import pytest

from orrery.operators import graph, select
from orrery.plans import catalogue, selection
from tests.test_queries import TABLES, rows

WHOLE = (
    "q83_structural_consistency", "q86_quota_membership", "q54_fixed_text_rows", "q80_name_change_branch", "q56_header_matrix", "q52_parallel_array_transpose",
    "q50_reserve_first_match", "q27_recursive_lineage", "q26_amendment_families", "q84_acceptance_order",
)


@pytest.fixture(scope="module")
def far(data, tmp_path_factory):
    """A folder with the test tables, in which the keys of orders and users begin past every prefix."""
    folder, con = tmp_path_factory.mktemp("far"), duckdb.connect()
    for t in TABLES:
        what = {"orders": "* REPLACE (o_orderkey + 13000 AS o_orderkey)", "events": "* REPLACE (user_id + 700 AS user_id)"}.get(t, "*")
        con.execute(f"COPY (SELECT {what} FROM '{data}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table(spark, far, name):
    folder, con = far
    got, sql = catalogue.queries()[name](spark, folder), catalogue.oracle_sql()[name]
    made = con.execute(sql)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in made.description], made.fetchall())


def test_entities_of_all_customers(spark, data):
    """The choice is that of the search over every customer."""
    pool = [select.Candidate(r["c_custkey"], r["penalty"], hashlib.sha256(f"20260725|{r['c_custkey']}".encode()).hexdigest(), (r["segment"], r["zone"], r["balance"])) for r in selection.customers(spark, data).collect()]
    want = select.choose(pool, select.Quotas([{"BUILDING": 3, "MACHINERY": 3}, {"0": 2, "1": 2, "2": 2}, {"low": 1, "high": 5}]), node_limit=10**8)
    got = sorted(selection.q49(spark, data).collect(), key=lambda r: r["nth"])
    assert want.status == "feasible" and [(r["c_custkey"], r["status"], r["total_penalty"]) for r in got] == [(m, want.status, want.penalty) for m in want.members]


def test_choosable_keeps_the_choice(spark):
    rng, quotas = random.Random(3), select.Quotas([{"a": 2, "b": 1}, {"x": 1, "y": 2}], flagged=1)
    for trial in range(10):
        pool = [select.Candidate(i, rng.randint(0, 1), hashlib.sha256(f"{trial}|{i}".encode()).hexdigest(), (rng.choice("abc"), rng.choice("xy")), rng.random() < 0.3) for i in range(60)]
        few = select.choosable(pool, quotas)
        assert len(few) < 30 and select.choose(few, quotas) == select.choose(pool, quotas, node_limit=10**8)
    rows = [(i, rng.choice("abc"), rng.choice("xy"), rng.randint(0, 1)) for i in range(6000)]
    got = select.select_entities(spark.createDataFrame(rows, "id long, u string, v string, penalty int"), "id", ["u", "v"], select.Quotas([{"a": 2, "b": 1}, {"x": 1, "y": 2}])).collect()
    assert len(got) == 3 and {r["total_penalty"] for r in got} == {0}


def test_lineage_goes_on_to_the_end(spark):
    chain = [(k, k - 1) for k in range(2, 42)] + [(1, None)]
    ring = [(100 + k, 100 + (k + 1) % 15) for k in range(15)]
    fork = [(201, 202), (201, 203), (202, 204), (203, 204), (204, 205), (201, 205), (201, 205), (300, 300)]
    got = sorted(tuple(r) for r in graph.lineage(spark.createDataFrame(chain + ring + fork, "id long, parent long"), "id", "parent").collect())
    want = [(k, a, k - a) for k in range(2, 42) for a in range(1, k)] + [(100 + k, 100 + (k + n) % 15, n) for k in range(15) for n in range(1, 16)]
    want += [(201, 202, 1), (201, 203, 1), (201, 204, 2), (201, 205, 1), (202, 204, 1), (202, 205, 2), (203, 204, 1), (203, 205, 2), (204, 205, 1), (300, 300, 1)]
    assert got == sorted(want)
