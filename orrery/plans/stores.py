"""Queries on sinks, merges, scans and scalar rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators import quality as Q, reconcile as X, select as L, study as U
from orrery.runtime import shared_dir, table
from orrery.sources import store


def n_rows():
    return F.count(F.lit(1))


def pairs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), F.when(k % 13 != 0, F.col("o_custkey")).alias("customer"), F.when(k % 17 != 0, F.col("o_orderstatus")).alias("status"))


def q93(spark, d):
    new = pairs(spark, d)
    old = X.insert_new(spark.createDataFrame([], "row_id string"), new.where("k % 2 = 0"), ["customer", "status"])
    return X.insert_new(old, new, ["customer", "status"]).select("customer", "status")


PAIRS = "p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS customer, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS status FROM orders)"
Q93 = f"WITH {PAIRS} SELECT customer, status FROM p EXCEPT SELECT customer, status FROM p WHERE k % 2 = 0"


def q94(spark, d):
    o = table(spark, d, "orders")
    half = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))).alias("first_status"), F.max("o_totalprice").alias("largest"), n_rows().alias("total"))
    return X.upsert(half(0), half(1), "k", ["first_status"], ["largest"], ["total"])


Q94 = """
WITH h AS (SELECT o_orderkey % 2 AS r, o_custkey AS k, min(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END) AS s, max(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, b.s) AS first_status, greatest(a.m, b.m) AS largest, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS total
FROM (SELECT * FROM h WHERE r = 0) a FULL JOIN (SELECT * FROM h WHERE r = 1) b ON a.k = b.k
"""


def q95(spark, d):
    return store.scan_prefix(table(spark, d, "customer"), "c_mktsegment", "MA").select("c_custkey", "c_mktsegment")


Q95 = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'MA%'"


def q96(spark, d):
    return Q.missingness(pairs(spark, d), ["k", "customer", "status"])


Q96 = f"""
WITH {PAIRS} SELECT 'k' AS "column", count(*) - count(k) AS n_missing, count(*) AS n FROM p UNION ALL SELECT 'customer', count(*) - count(customer), count(*) FROM p UNION ALL SELECT 'status', count(*) - count(status), count(*) FROM p
"""


def q97(spark, d):
    return L.first_per_kind(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", ["o_totalprice", "o_orderkey"], 3)


Q97 = "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::INTEGER AS nth FROM orders QUALIFY nth <= 3"


def q98(spark, d):
    return X.representatives(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], ["l_partkey", "l_linenumber"])


Q98 = """
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) - 1 AS n_extra FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, n_extra FROM r WHERE k = 1
"""


def q99(spark, d):
    o = table(spark, d, "orders").withColumn("predicted", F.col("o_orderkey") % 1000 * 300.0).withColumn("baseline", F.lit(150000.0))
    return U.relative_mae(o, "o_totalprice", "predicted", "baseline", ["o_orderpriority"])


Q99 = "SELECT o_orderpriority, count(*) AS n, round(avg(abs(o_orderkey % 1000 * 300.0::DOUBLE - o_totalprice)) / avg(abs(150000.0::DOUBLE - o_totalprice)), 6) AS relative_mae FROM orders GROUP BY 1"


def q100(spark, d):
    k = F.col("o_orderkey")
    stamp = F.when(k % 5 == 0, "2024").when(k % 5 == 1, F.lit("20241399120000")).otherwise(F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    token = F.when(k % 4 == 0, F.concat(F.lit("  Partly \t "), F.col("o_orderstatus"), F.lit(" "))).otherwise(F.col("o_orderpriority"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("o_orderstatus")).alias("status"), F.when(k % 2 == 0, F.col("o_custkey")).alias("customer"), stamp.alias("stamp"), token.alias("token"), F.element_at(F.array(*map(F.lit, (200, 304, 403, 404, 429, 503, 500))), (k % 7 + 1).cast("int")).alias("code"))
    return o.select("o_orderkey", S.date_part(F.col("stamp")).cast("string").alias("day"), S.status_token(F.col("token")).alias("token"), F.array_join(S.missing_fields("status", "customer"), "+").alias("missing"), S.response_class(F.col("code")).alias("response"))


Q100 = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'partly ' || lower(o_orderstatus) ELSE lower(o_orderpriority) END AS token,
 array_to_string(list_filter([CASE WHEN o_orderkey % 3 <> 1 THEN 'status' END, CASE WHEN o_orderkey % 2 <> 0 THEN 'customer' END], lambda x: x IS NOT NULL), '+') AS missing,
 ['accept', 'reuse', 'block', 'fail', 'cool_down', 'retry', 'retry'][(o_orderkey % 7 + 1)::INTEGER] AS response FROM orders
"""


def q101(spark, d):
    """The contents are stored by two calls, the second with all of them again."""
    path = f"{shared_dir(spark)}/orrery-objects-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    store.write_objects(docs.where("doc_id % 3 = 0"), "content", path)
    store.write_objects(docs, "content", path)
    return store.verify_objects(spark, path).groupBy("digest", "ok").agg(n_rows().alias("n_stored"))


Q101 = "SELECT sha256(text) AS digest, true AS ok, 1::BIGINT AS n_stored FROM documents WHERE text IS NOT NULL GROUP BY 1"

QUERIES = {
    "q93_insert_new": (q93, Q93), "q94_upsert": (q94, Q94), "q95_prefix_scan": (q95, Q95), "q96_missingness": (q96, Q96), "q97_first_per_kind": (q97, Q97), "q98_representatives": (q98, Q98),
    "q99_relative_mae": (q99, Q99), "q100_scalar_rules": (q100, Q100), "q101_object_store": (q101, Q101),
}
