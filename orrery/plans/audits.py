"""Queries on whole documents, index outcomes, audits and their hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import digest as D, reconcile as X, study as U, temporal as T
from orrery.plans.resolution import DIVERGED, DUAL, diverged
from orrery.plans.studies import scored
from orrery.runtime import table
from orrery.sources import submissions as N


def n_rows():
    return F.count(F.lit(1))


def documents(spark, d):
    """One JSON document a conversation, with the faults that its number calls for."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("string"))).alias("turns"))
    k = F.col("conv_id")
    form = F.when(k % 5 == 3, F.slice("turns", 1, 1)).otherwise(F.col("turns"))
    recent = F.struct(F.col("turns").alias("accession"), form.alias("form"))
    name = F.concat(F.lit("CIK"), F.lpad(k.cast("string"), 10, "0"), F.when(k % 4 == 1, ".json").otherwise("-submissions-001.json"))
    files = F.array(F.struct(name.alias("name"), F.lit(2).alias("filingCount")))
    filings = F.when(k % 11 != 7, F.struct(recent.alias("recent"), files.alias("files")))
    whole = F.struct((k + 1).cast("string").alias("cik"), F.when(k % 7 == 2, " ").otherwise(F.lit(" Firm ")).alias("name"), filings.alias("filings"), F.when(k % 3 == 0, F.lit("x")).alias("extra"))
    return c.select("conv_id", F.when(k % 13 == 5, "[1]").otherwise(F.to_json(whole)).alias("document"))


DOCS = """c AS (SELECT conv_id AS k, count(*) AS n FROM conversations GROUP BY 1),
g AS (SELECT * FROM c WHERE k % 13 <> 5 AND k % 11 <> 7 AND k % 7 <> 2)"""


def q102(spark, d):
    parts = N.submissions(documents(spark, d), "conv_id", "document", ["accession", "form"])
    out = None
    for name in ("registrants", "filings", "references", "quarantine"):
        found = parts[name].groupBy("conv_id").agg(n_rows().alias("n")).select(F.lit(name).alias("part"), "conv_id", "n")
        out = found if out is None else out.unionByName(found)
    return out


Q102 = f"""
WITH {DOCS} SELECT 'registrants' AS part, k AS conv_id, 1::BIGINT AS n FROM g UNION ALL SELECT 'filings', k, n FROM g WHERE k % 5 <> 3 OR n = 1 UNION ALL SELECT 'references', k, 1 FROM g WHERE k % 4 <> 1
UNION ALL SELECT 'quarantine', k, CASE WHEN k % 13 = 5 OR k % 11 = 7 OR k % 7 = 2 THEN 1 ELSE (k % 5 = 3 AND n > 1)::BIGINT + (k % 4 = 1)::BIGINT END AS q FROM c WHERE q > 0
"""


def q103(spark, d):
    text = F.when(F.col("event_id") % 9 == 4, '{"k": null, "z": 1}').when(F.col("event_id") % 9 == 5, '{"k": "five", "tags": 3}').when(F.col("event_id") % 9 == 6, "{").otherwise(F.col("props"))
    e = table(spark, d, "events").select("event_id", text.alias("document"))
    return N.drift_events(e, "event_id", "document", {"k": "number"}, ["note"], ["tags"])


Q103 = """
WITH e AS (SELECT event_id, event_id % 9 AS r FROM events)
SELECT event_id, 'unexpected_null' AS event, 'k' AS field FROM e WHERE r = 4 UNION ALL SELECT event_id, 'unknown_field_retained', 'z' FROM e WHERE r = 4 UNION ALL SELECT event_id, 'type_changed', 'k' FROM e WHERE r = 5
UNION ALL SELECT event_id, 'malformed_nested_array', 'tags' FROM e WHERE r = 5 UNION ALL SELECT event_id, 'malformed_document', '' FROM e WHERE r = 6
"""


def q104(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    index = li.select(F.when(F.col("l_linenumber") % 6 != 5, F.col("l_orderkey")).alias("k"), "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, "F").otherwise(F.col("l_linestatus")).alias("status"), F.year("l_shipdate").alias("y"))
    derived = o.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("right_status"), F.year("o_orderdate").alias("right_y"))
    plan = spark.range(1, 13).select(F.concat(F.lit("Q"), "id").alias("quarter"), "id")
    return X.reconcile_index(index, derived, "k", "l_linenumber", {"status": "right_status", "y": "right_y"}, F.col("l_linenumber") % 7 == 6, F.col("k") % 8 != 1, plan, "quarter", F.col("id") % 4 != 0)


Q104 = """
WITH i AS (SELECT CASE WHEN l_linenumber % 6 <> 5 THEN l_orderkey END AS k, l_linenumber AS l, CASE WHEN l_orderkey % 2 = 0 THEN 'F' ELSE l_linestatus END AS s, year(l_shipdate) AS y FROM lineitem),
ok AS (SELECT *, row_number() OVER w AS r, first_value(s) OVER w AS s1, first_value(y) OVER w AS y1 FROM i WHERE k IS NOT NULL AND l % 7 <> 6 WINDOW w AS (PARTITION BY k ORDER BY l, s, y)),
b AS (SELECT o_orderkey AS k, o_orderstatus AS s, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 10 <> 3)
SELECT 'instance' AS part, 'Q' || q AS instance, NULL::VARCHAR AS k, 'unavailable' AS state FROM generate_series(4, 12, 4) t(q) UNION ALL SELECT 'malformed', NULL, k::VARCHAR, 'indeterminate' FROM i WHERE k IS NULL OR l % 7 = 6
UNION ALL SELECT 'duplicate', NULL, k::VARCHAR, CASE WHEN s <> s1 OR y <> y1 THEN 'conflicting' ELSE 'matching' END FROM ok WHERE r > 1
UNION ALL SELECT 'joined', NULL, coalesce(a.k, b.k)::VARCHAR, CASE WHEN b.k IS NOT NULL AND b.k % 8 = 1 THEN 'indeterminate' WHEN a.k IS NULL THEN 'derived_only' WHEN b.k IS NULL THEN 'index_only' WHEN a.s <> b.s OR a.y <> b.y THEN 'conflicting' ELSE 'matching' END
FROM (SELECT * FROM ok WHERE r = 1) a FULL JOIN b ON a.k = b.k
"""


def audit(spark, d):
    k = F.col("o_orderkey")
    return T.divergence_audit(diverged(spark, d), F.col("o_orderstatus"), k % 4 == 3, F.col("shipped"), F.col("accepted"), F.col("rule"), F.col("crossing"), F.col("coverage"), F.col("cohort_filed") == "primary_test", k % 10 != 0)


def q105(spark, d):
    return audit(spark, d)[0]


Q105 = f"""
WITH {DIVERGED}, x AS (SELECT *, coalesce(accepted <> shipped, false) AS dv, coalesce(crossing, false) AS cr, coalesce(coverage, false) AS co FROM v),
p AS (SELECT 'total' AS dimension, 'accessions' AS value FROM x UNION ALL SELECT 'total', 'diverging' FROM x WHERE dv UNION ALL SELECT 'total', 'crossings' FROM x WHERE cr UNION ALL SELECT 'total', 'coverage' FROM x WHERE co UNION ALL SELECT 'total', 'unexplained' FROM x WHERE co OR rule = 'unexplained'
UNION ALL SELECT 'total', 'unapproved_test' FROM x WHERE cohort_filed = 'primary_test' AND o_orderkey % 10 = 0 UNION ALL SELECT 'reason', rule FROM x UNION ALL SELECT 'form', o_orderstatus FROM x WHERE dv UNION ALL SELECT 'kind', CASE WHEN o_orderkey % 4 = 3 THEN 'amendment' ELSE 'original' END FROM x WHERE dv
UNION ALL SELECT 'accepted_year', year(accepted)::VARCHAR FROM x WHERE dv UNION ALL SELECT 'filed_year', year(shipped)::VARCHAR FROM x WHERE dv)
SELECT dimension, value, count(*) AS n FROM p GROUP BY 1, 2
"""


def q106(spark, d):
    return audit(spark, d)[1]


Q106 = f"""
WITH {DIVERGED} SELECT 'divergence_explained' AS gate, CASE WHEN count(*) FILTER (WHERE coverage OR rule = 'unexplained') > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM v UNION ALL SELECT 'boundary_review', CASE WHEN count(*) FILTER (WHERE crossing OR coverage) > 0 THEN 'fail' ELSE 'pass' END FROM v
UNION ALL SELECT 'coverage_divergence', CASE WHEN count(*) FILTER (WHERE coverage) > 0 THEN 'fail' ELSE 'pass' END FROM v UNION ALL SELECT 'test_membership_approved', CASE WHEN count(*) FILTER (WHERE cohort_filed = 'primary_test' AND o_orderkey % 10 = 0) > 0 THEN 'fail' ELSE 'pass' END FROM v
"""


def q107(spark, d):
    k = F.col("o_orderkey")
    payload = F.create_map(F.lit("status"), "o_orderstatus", F.lit("key"), k.cast("string"), F.lit("customer"), F.when(k % 6 != 0, F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", D.record_hash(payload, F.when(k % 3 == 0, F.array(F.lit("z.b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))).alias("hash"))


Q107 = """
SELECT o_orderkey, sha256('{"payload":{"customer":' || CASE WHEN o_orderkey % 6 <> 0 THEN '"' || o_custkey || '"' ELSE 'null' END || ',"key":"' || o_orderkey || '","status":"' || o_orderstatus || '"},"unknown_field_paths":[' || CASE WHEN o_orderkey % 3 = 0 THEN '"a","z.b"' ELSE '' END || ']}') AS hash FROM orders
"""


def q108(spark, d):
    v = diverged(spark, d)
    time = F.when(F.col("o_orderkey") % 9 != 2, F.col("accepted").cast("timestamp"))
    return v.select("o_orderkey", T.boundary(F.col("shipped"), F.col("accepted"), time).alias("b")).groupBy("b.precision", "b.basis").agg(n_rows().alias("n"))


Q108 = f"""
WITH {DUAL}, t AS (SELECT CASE WHEN accepted IS NULL OR o_orderkey % 9 = 2 THEN 0 WHEN accepted = shipped THEN 1 ELSE 2 END AS r FROM w WHERE shipped IS NOT NULL)
SELECT CASE r WHEN 1 THEN 'timestamp' ELSE 'date' END AS precision, ['filing_date_only', 'same_day_acceptance', 'later_official_filing_date'][r + 1] AS basis, count(*) AS n FROM t GROUP BY r
"""


def q109(spark, d):
    return U.confusion(scored(spark, d), "quality", "score", 0.5)


Q109 = """
WITH b AS (SELECT quality = 1 AS y, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 6))::BIGINT / 16777216.0::DOUBLE >= 0.5 AS p FROM labels),
c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM b)
SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c
"""

QUERIES = {
    "q102_submissions_document": (q102, Q102), "q103_drift_events": (q103, Q103), "q104_index_reconciliation": (q104, Q104), "q105_divergence_counts": (q105, Q105), "q106_divergence_gates": (q106, Q106),
    "q107_record_envelope_hash": (q107, Q107), "q108_availability_boundary": (q108, Q108), "q109_confusion_matrix": (q109, Q109),
}
