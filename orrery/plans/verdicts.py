"""Queries on verdicts over evidence, and further study metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from orrery.functions import scalars as S
from orrery.operators import evidence as E, graph as G, study as U
from orrery.plans.common import SUPPORT, WINDOWS, label_sql
from orrery.plans.entities import CHAIN, chain
from orrery.plans.resolution import ORDERS, orders
from orrery.plans.studies import MARGINS, margins
from orrery.runtime import table


def n_rows():
    return F.count(F.lit(1))


def q81(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("tag", F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 2).cast("string"))).withColumn("m", F.col("event_id") % 4)
    lag = lambda c: F.lag(c).over(w)
    v = E.content_change(F.col("event_type"), lag("event_type"), F.col("tag"), lag("tag"), F.col("m"), lag("m"), F.col("user_id") % 3 == 0, F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 3 == 1), F.col("event_id") % 11 == 0)
    return e.select("user_id", v.alias("verdict")).groupBy("user_id", "verdict").agg(n_rows().alias("n"))


Q81 = """
WITH e AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN (event_id % 2)::VARCHAR END AS tag, event_id % 4 AS m FROM events),
p AS (SELECT *, lag(event_type) OVER w AS b, lag(tag) OVER w AS tb, lag(m) OVER w AS mb FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CASE WHEN b IS NULL THEN 'first' WHEN event_type = b THEN 'unchanged' WHEN CASE WHEN tag IS NOT NULL AND tb IS NOT NULL THEN tag = tb ELSE coalesce(m = mb, false) END THEN 'contradiction'
 WHEN user_id % 3 = 0 OR (user_id % 7 <> 0 AND user_id % 3 = 1) OR event_id % 11 = 0 THEN 'expected_update' ELSE 'anomaly' END AS verdict, count(*) AS n FROM p GROUP BY 1, 2
"""


def q82(spark, d):
    o = orders(spark, d)
    r = E.reuse_decision(same_day=F.col("day") == F.col("accepted"), finished=F.col("o_orderstatus") != "P", small=F.col("o_totalprice") < 250000)
    return o.select(r.alias("r")).select("r.*").groupBy("reusable", "failed").agg(n_rows().alias("n"))


Q82 = f"""
WITH {ORDERS}, f AS (SELECT array_to_string(list_filter([CASE WHEN NOT coalesce(day = accepted, false) THEN 'same_day' END, CASE WHEN o_orderstatus = 'P' THEN 'finished' END, CASE WHEN NOT o_totalprice < 250000 THEN 'small' END], lambda x: x IS NOT NULL), '+') AS failed FROM o)
SELECT failed = '' AS reusable, failed, count(*) AS n FROM f GROUP BY 1, 2
"""


def q83(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 30).alias("observation"), (F.col("event_id") % 2).alias("run"), "event_type")
    return E.structural_consistency(e, "observation", "run", "event_type")


Q83 = """
WITH s AS (SELECT user_id % 30 AS observation, event_id % 2 AS run, string_agg(DISTINCT event_type, chr(31) ORDER BY event_type) AS shapes, count(DISTINCT event_type) AS n FROM events GROUP BY 1, 2)
SELECT observation, count(*) AS n_runs, max(n) AS n_shapes, min(shapes) = max(shapes) AS consistent, CASE WHEN min(shapes) = max(shapes) THEN sha256(min(shapes)) END AS digest FROM s GROUP BY 1
"""


def q84(spark, d):
    found = G.roots(chain(spark, d), "o_orderkey", "parent").where("outcome = 'resolved'")
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    met = found.join(o, "o_orderkey").join(o.select(F.col("o_orderkey").alias("root"), F.col("day").alias("root_day")), "root")
    return met.groupBy(F.when(F.col("day") > F.col("root_day"), "admissible").otherwise("refused").alias("verdict")).agg(n_rows().alias("n"), F.sum("root").alias("total"))


Q84 = f"""
WITH RECURSIVE {CHAIN}, w AS (SELECT o_orderkey, o_orderkey AS root FROM ch WHERE parent IS NULL UNION ALL SELECT ch.o_orderkey, w.root FROM w JOIN ch ON ch.parent = w.o_orderkey)
SELECT CASE WHEN CAST(a.o_orderdate AS DATE) > CAST(b.o_orderdate AS DATE) THEN 'admissible' ELSE 'refused' END AS verdict, count(*) AS n, sum(root)::BIGINT AS total
FROM w JOIN orders a ON a.o_orderkey = w.o_orderkey JOIN orders b ON b.o_orderkey = w.root WHERE w.o_orderkey <> w.root GROUP BY 1
"""


def q85(spark, d):
    li = table(spark, d, "lineitem").withColumn("level", S.level_name((F.col("l_suppkey") % 4).cast("int")))
    return E.set_level(li, "l_orderkey", "level", F.col("l_quantity") > 10, F.col("l_linenumber") == 1)


Q85 = "SELECT l_orderkey, count(*) AS n, ['provisional', 'review_required', 'conflicting', 'unavailable'][max(l_suppkey % 4) + 1] AS level, count(*) FILTER (WHERE l_linenumber = 1) = 1 AS anchored FROM lineitem WHERE l_quantity > 10 GROUP BY 1"


def q86(spark, d):
    o = table(spark, d, "orders")
    return E.quota_membership(o, "o_orderkey", {"early": F.when(F.year("o_orderdate") < 1996, F.col("o_custkey")), "urgent": F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") % 50)})


Q86 = """
WITH u AS (SELECT o_orderkey, 'early' AS quota, o_custkey::VARCHAR AS unit FROM orders WHERE year(o_orderdate) < 1996 UNION ALL SELECT o_orderkey, 'urgent', (o_custkey % 50)::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT quota, unit, count(DISTINCT o_orderkey) AS n_witnesses, min(o_orderkey) AS first_member FROM u GROUP BY 1, 2
"""


def q87(spark, d):
    plan = orders(spark, d).select(F.trunc("day", "quarter").alias("quarter")).distinct().withColumn("open", F.col("quarter") >= F.lit("2001-04-01").cast("date"))
    return E.processing_order(plan, "open", "quarter", 20).withColumn("quarter", F.col("quarter").cast("string"))


Q87 = f"""
WITH {ORDERS}, p AS (SELECT DISTINCT CAST(date_trunc('quarter', day) AS DATE) AS quarter FROM o)
SELECT CAST(quarter AS VARCHAR) AS quarter, quarter >= DATE '2001-04-01' AS open, row_number() OVER (ORDER BY quarter >= DATE '2001-04-01', quarter)::INTEGER AS nth, row_number() OVER (ORDER BY quarter >= DATE '2001-04-01', quarter) <= 20 AS admitted FROM p
"""


def q88(spark, d):
    o = orders(spark, d)
    label = S.window_label(F.col("accepted"), WINDOWS, SUPPORT)
    a = E.cohort_applicability(label, F.when(F.col("o_orderkey") % 2 == 0, "provisional").otherwise("review_required"))
    ok = E.universe_eligible(F.col("o_orderstatus") != "P", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 2 == 0), F.col("o_custkey") % 10 == 0, a["applies"])
    fix = E.correction_status(F.col("accepted"), F.col("day"))
    return o.select(a.alias("a"), ok.alias("eligible"), fix.alias("correction")).groupBy("a.applies", "a.pre_study", "a.level", "eligible", "correction").agg(n_rows().alias("n"))


Q88 = f"""
WITH {ORDERS}, l AS (SELECT *, {label_sql('accepted')} AS label FROM o), a AS (SELECT *, label NOT IN ('out_of_scope', 'unresolved') AS applies FROM l)
SELECT applies, label = 'support' AS pre_study, CASE WHEN NOT applies THEN 'unavailable' WHEN o_orderkey % 2 = 0 THEN 'provisional' ELSE 'review_required' END AS level,
 o_orderstatus <> 'P' AND o_orderkey % 9 <> 0 AND o_orderkey % 2 = 0 AND o_custkey % 10 <> 0 AND applies AS eligible, CASE WHEN accepted IS NULL THEN 'unknown' WHEN accepted > day THEN 'corrected' ELSE 'original' END AS correction, count(*) AS n FROM a GROUP BY 1, 2, 3, 4, 5
"""


def q89(spark, d):
    return E.chained_digest(table(spark, d, "customer"), "c_nationkey", "c_custkey", F.concat_ws("|", "c_name", "c_mktsegment"))


Q89 = """
WITH g AS (SELECT c_nationkey, list(c_name || '|' || c_mktsegment ORDER BY c_custkey) AS r FROM customer GROUP BY 1)
SELECT c_nationkey, len(r) AS n, list_reduce(list_prepend(sha256(''), r), lambda h, t: sha256(h || '|' || t)) AS digest FROM g
"""


def q90(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size"), F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.col("doc_id") % 2).cast("int").alias("late"))
    return U.drift_classifier(x, ["size", "lines"], "late").select("doc_id", "drift")


def q91(spark, d):
    return U.rank_correlation(margins(spark, d).where("adjusted IS NOT NULL AND change IS NOT NULL"), "adjusted", "change", ["sector"])


Q91 = f"""
WITH {MARGINS}, r AS (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY adjusted) + (count(*) OVER (PARTITION BY sector, adjusted) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY sector ORDER BY change) + (count(*) OVER (PARTITION BY sector, change) - 1) / 2.0::DOUBLE AS b FROM ad WHERE adjusted IS NOT NULL AND change IS NOT NULL)
SELECT sector, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1
"""


def q92(spark, d):
    return U.deciles(margins(spark, d).where("adjusted IS NOT NULL AND change IS NOT NULL"), "change", "adjusted", ["firm", "y"])


Q92 = f"""
WITH {MARGINS}, r AS (SELECT ntile(10) OVER (ORDER BY change, firm, y) AS decile, change, adjusted FROM ad WHERE adjusted IS NOT NULL AND change IS NOT NULL)
SELECT decile::INTEGER AS decile, count(*) AS n, round(avg(change), 6) + 0.0 AS predicted, round(avg(adjusted), 6) + 0.0 AS actual FROM r GROUP BY 1
"""

QUERIES = {
    "q81_content_change": (q81, Q81), "q82_reuse_decision": (q82, Q82), "q83_structural_consistency": (q83, Q83), "q84_acceptance_order": (q84, Q84), "q85_multi_registrant_level": (q85, Q85), "q86_quota_membership": (q86, Q86),
    "q87_processing_order": (q87, Q87), "q88_universe_and_applicability": (q88, Q88), "q89_chained_digest": (q89, Q89), "q90_drift_classifier": (q90, None), "q91_rank_correlation": (q91, Q91), "q92_calibration_deciles": (q92, Q92),
}
