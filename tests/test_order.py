"""Ranks and percentiles over ranges against sorting in one place."""

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import order, reconcile, study
from orrery.sources import submissions


def test_running_equals_one_sort(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(v), None if i % 7 == 0 else int(v) % 5) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "i long, v double, s int")
    got = {r["i"]: (r["rank"], r["n"], r["upto"], r["total_upto"]) for r in order.running(df, ["v", "i"], upto=F.col("s")).collect()}
    total, sums = 0, {}
    for rank, (i, _, s) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += s or 0
        sums[i] = (rank, total)
    assert got == {i: (rank, 500, upto, total) for i, (rank, upto) in sums.items()}


def test_percentiles_of_a_hot_value_nulls_and_null_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 5 == 0 else str(i % 3), 7.0 if i % 3 == 0 else None if i % 11 == 0 else float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in order.percentiles(df, "v", {"a": 0.5, "b": 0.99}, ["g"]).collect()}
    for g in (None, "0", "1", "2"):
        want = np.percentile([v for k, v in rows if k == g and v is not None], [50, 99])
        assert np.allclose(got[g], want, atol=1e-12)
    one = order.percentiles(df, "v", {"a": 0.25}).first()
    assert abs(one["a"] - np.percentile([v for _, v in rows if v is not None], 25)) < 1e-12


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert order.percentiles(none, "v", {"a": 0.5}).collect()[0]["a"] is None
    assert order.percentiles(none, "v", {"a": 0.5}, ["g"]).collect() == []
    assert order.running(none, ["v"]).collect() == []


def test_deciles_follow_ntile(spark):
    df = spark.range(23).select(F.col("id").cast("double").alias("p"), F.lit(1.0).alias("a"), "id")
    assert [r["n"] for r in study.deciles(df, "p", "a", ["id"]).orderBy("decile").collect()] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]
    few = study.deciles(df.where("id < 4"), "p", "a", ["id"]).orderBy("decile").collect()
    assert [(r["decile"], r["n"]) for r in few] == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_repeated_index_rows_each_yield_an_outcome(spark):
    index = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("", 3, "x"), (None, 4, "x")], "k string, line int, s string")
    derived = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, t string")
    plan = spark.createDataFrame([("q1", True), ("q2", None)], "q string, ok boolean")
    got = reconcile.reconcile_index(index, derived, "k", "line", {"s": "t"}, F.lit(False), F.lit(True), plan, "q", F.col("ok"))
    assert sorted((r["part"], r["k"], r["state"]) for r in got.where("part <> 'malformed'").collect() if r["k"]) == [("duplicate", "a", "conflicting"), ("duplicate", "a", "matching"), ("joined", "a", "matching"), ("joined", "b", "derived_only")]
    assert got.where("part = 'malformed'").count() == 2
    assert [r["instance"] for r in got.where("part = 'instance'").collect()] == ["q2"]


def test_a_document_without_a_usable_identity_gives_no_record(spark):
    texts = ['{"cik": "77", "name": "A", "filings": {"recent": {"f": ["1", "2"], "g": ["x", "y"]}, "files": []}}', '{"cik": "none", "name": "A", "filings": {}}', '{"cik": "5", "name": null, "filings": []}', "not json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = submissions.submissions(rows, "i", "t", ["f", "g"])
    assert [tuple(r) for r in got["registrants"].collect()] == [(0, "0000000077", "A")]
    assert sorted((r["position"], r["f"], r["g"]) for r in got["filings"].collect()) == [(0, "1", "x"), (1, "2", "y")]
    bad = {r["i"]: r["reason"] for r in got["quarantine"].collect()}
    assert bad[1] == "unusable:cik" and bad[2] == "type_changed:filings; unexpected_null:name" and bad[3] == bad[4] == "malformed_document:"
