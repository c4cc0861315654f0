"""Queries on quotas, selection and reserves."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.scalars import seeded_rank
from orrery.operators import select as L
from orrery.runtime import table

NEED = {"BUILDING": 250, "AUTOMOBILE": 250, "MACHINERY": 400, "none": 1}


def customers(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).cast("string").alias("zone"), F.when(F.col("c_acctbal") < 0, "low").otherwise("high").alias("balance"), (F.floor(F.abs("c_acctbal")) % 4).cast("int").alias("penalty"))


def q48(spark, d):
    return L.quota_counts(customers(spark, d).where("penalty < 3"), "segment", "c_custkey", NEED)


Q48 = """
WITH w AS (SELECT unnest(['BUILDING', 'AUTOMOBILE', 'MACHINERY', 'none']) AS quota, unnest([250, 250, 400, 1])::BIGINT AS required),
h AS (SELECT c_mktsegment AS quota, count(DISTINCT c_custkey) AS n FROM customer WHERE CAST(floor(abs(c_acctbal)) AS BIGINT) % 4 < 3 GROUP BY 1)
SELECT quota, required, coalesce(n, 0)::BIGINT AS achieved, coalesce(n, 0) >= required AS met FROM w LEFT JOIN h USING (quota)
"""


def q49(spark, d):
    return L.select_entities(customers(spark, d), "c_custkey", ["segment", "zone", "balance"], L.Quotas([{"BUILDING": 3, "MACHINERY": 3}, {"0": 2, "1": 2, "2": 2}, {"low": 1, "high": 5}]), node_limit=2_000_000)


def q50(spark, d):
    c = customers(spark, d)
    return L.reserves(c.where("c_custkey % 50 = 7"), c.where("c_custkey % 50 <> 7"), "c_custkey", ["segment", "zone", "balance", "penalty"], seeded_rank("20260725", F.col("c_custkey"))).withColumn("reserve", F.col("reserve").cast("string"))


Q50 = """
WITH c AS (SELECT c_custkey, c_mktsegment AS segment, c_nationkey % 3 AS zone, c_acctbal < 0 AS low, CAST(floor(abs(c_acctbal)) AS BIGINT) % 4 AS penalty FROM customer),
p AS (SELECT segment, zone, low, penalty, arg_min(c_custkey, sha256('20260725|' || c_custkey::VARCHAR)) AS reserve FROM c WHERE c_custkey % 50 <> 7 GROUP BY 1, 2, 3, 4)
SELECT c.c_custkey, CAST(reserve AS VARCHAR) AS reserve, CASE WHEN reserve IS NULL THEN 'no_compatible_reserve' ELSE 'reserve' END AS outcome FROM c LEFT JOIN p ON c.segment = p.segment AND c.zone = p.zone AND c.low = p.low AND c.penalty = p.penalty WHERE c_custkey % 50 = 7
"""


def q51(spark, d):
    return L.cap_usage(table(spark, d, "orders"), "o_custkey", F.when(F.col("o_orderkey") % 4 == 3, "stress").otherwise("base"), {"base": 15, "stress": 24})


Q51 = """
WITH b AS (SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'stress' ELSE 'base' END AS role, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT role, sum(n)::BIGINT AS total, max(n) AS most_per_entity, (CASE role WHEN 'base' THEN 15 ELSE 24 END)::BIGINT AS cap, max(n) > CASE role WHEN 'base' THEN 15 ELSE 24 END AS over FROM b GROUP BY 1
"""

QUERIES = {"q48_quota_feasibility": (q48, Q48), "q49_entity_select": (q49, None), "q50_reserve_first_match": (q50, Q50), "q51_cap_usage": (q51, Q51)}
