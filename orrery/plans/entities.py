"""Queries on identifiers, classification, chains, reconciliation and quality."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from orrery.functions import scalars as S
from orrery.operators import classify as C, digest as D, graph as G, quality as Q, reconcile as X, resolve as R, temporal as T
from orrery.plans.common import SUPPORT, WINDOWS
from orrery.plans.resolution import BLOCKING, DIVERGED, ORDERS, diverged, orders
from orrery.runtime import table


def n_rows():
    return F.count(F.lit(1))


def q16(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("CIK"), S.pad_identifier(F.col("c_custkey")))).when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).alias("raw"))
    return a.select("id", "raw", S.normalise_registrant(F.col("raw")).alias("registrant"), S.parse_accession(F.concat(S.pad_identifier(F.col("id")), F.lit("-24-"), S.pad_identifier(F.col("id"), 6)))["sequence"].alias("sequence"))


Q16 = """
WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'CIK' || lpad(c_custkey::VARCHAR, 10, '0') WHEN 1 THEN c_custkey::VARCHAR ELSE 'x' || c_custkey::VARCHAR END AS raw FROM customer)
SELECT id, raw, CASE WHEN raw NOT LIKE 'x%' AND id BETWEEN 1 AND 9999999999 THEN lpad(id::VARCHAR, 10, '0') END AS registrant, lpad(id::VARCHAR, 6, '0') AS sequence FROM a
"""
RANGES = [(1, 10, "small"), (11, 20, "medium"), (21, 35, "large"), (41, 50, "bulk")]


def q17(spark, d):
    ranges = spark.createDataFrame(RANGES, "lo int, hi int, family string")
    return C.code_family(table(spark, d, "part"), "p_size", ranges).groupBy("family").agg(n_rows().alias("n"), F.min("p_size").alias("lowest"), F.max("p_size").alias("highest"))


Q17 = "WITH f AS (SELECT p_size, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 20 THEN 'medium' WHEN p_size BETWEEN 21 AND 35 THEN 'large' WHEN p_size BETWEEN 41 AND 50 THEN 'bulk' ELSE 'unmapped' END AS family FROM part) SELECT family, count(*) AS n, min(p_size) AS lowest, max(p_size) AS highest FROM f GROUP BY 1"
STRATA = {"BUILDING": "large", "AUTOMOBILE": "large", "MACHINERY": "small", "FURNITURE": "small"}


def q18(spark, d):
    c = table(spark, d, "customer").withColumn("bucket", F.col("c_custkey") % 400).withColumn("label", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return C.size_stratum(c, ["bucket"], "label", STRATA)


Q18 = """
WITH c AS (SELECT c_custkey % 400 AS bucket, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS label FROM customer),
m AS (SELECT *, CASE WHEN label IN ('BUILDING', 'AUTOMOBILE') THEN 'large' WHEN label IN ('MACHINERY', 'FURNITURE') THEN 'small' END AS k FROM c),
g AS (SELECT bucket, count(DISTINCT k) AS strata, min(k) AS stratum, count(*) FILTER (WHERE label IS NOT NULL AND k IS NULL) AS unmapped, count(label) AS labels FROM m GROUP BY 1),
l AS (SELECT *, CASE WHEN labels = 0 THEN 'unavailable' WHEN strata > 1 OR (strata = 1 AND unmapped > 0) THEN 'conflicting' WHEN strata = 0 THEN 'review_required' ELSE 'provisional' END AS level FROM g)
SELECT bucket, CASE WHEN level = 'provisional' THEN stratum END AS stratum, level FROM l
"""


def q19(spark, d):
    s = table(spark, d, "supplier")
    v = C.control_verdict(poor=F.col("s_acctbal") < 0, home=F.col("s_nationkey") == 5, even=F.col("s_suppkey") % 10 == 0, rich=F.col("s_acctbal") > 9000)
    return s.select("s_suppkey", v.alias("verdict"))


Q19 = """
WITH f AS (SELECT s_suppkey, list_filter([CASE WHEN s_acctbal < 0 THEN 'poor' END, CASE WHEN s_nationkey = 5 THEN 'home' END, CASE WHEN s_suppkey % 10 = 0 THEN 'even' END, CASE WHEN s_acctbal > 9000 THEN 'rich' END], lambda x: x IS NOT NULL) AS l FROM supplier)
SELECT s_suppkey, CASE WHEN len(l) > 1 THEN 'conflicting' WHEN len(l) = 1 THEN l[1] ELSE 'none' END AS verdict FROM f
"""


def flags(spark, d):
    o = orders(spark, d)
    by = o.groupBy("o_custkey").agg(n_rows().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("accepted").isNull()).alias("blank"), F.max("o_totalprice").alias("top"), F.count_distinct("o_orderpriority").alias("priorities"))
    return by.select("o_custkey", "n", "blank", F.array_join(S.reasons(many=F.col("n") > 14, large=F.col("top") > 490000, all_priorities=F.col("priorities") == 5, half_f=2 * F.col("n_f") > F.col("n")), "+").alias("flags"))


FLAGS = f"""{ORDERS}, g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE accepted IS NULL) AS blank, max(o_totalprice) AS top, count(DISTINCT o_orderpriority) AS priorities FROM o GROUP BY 1),
fl AS (SELECT o_custkey, n, blank, array_to_string(list_filter([CASE WHEN n > 14 THEN 'many' END, CASE WHEN top > 490000 THEN 'large' END, CASE WHEN priorities = 5 THEN 'all_priorities' END, CASE WHEN 2 * n_f > n THEN 'half_f' END], lambda x: x IS NOT NULL), '+') AS flags FROM g)"""


def q20(spark, d):
    return flags(spark, d).select("o_custkey", "flags")


Q20 = f"WITH {FLAGS} SELECT o_custkey, flags FROM fl"


def q21(spark, d):
    f = flags(spark, d)
    n = F.when(F.col("flags") == "", 0).otherwise(F.size(F.split("flags", r"\+")))
    return f.select("o_custkey", C.history_class(n, F.col("blank"), F.col("n")).alias("history"))


Q21 = f"WITH {FLAGS} SELECT o_custkey, CASE WHEN flags <> '' THEN 'eventful' WHEN blank = 0 AND n >= 4 THEN 'stable' ELSE 'indeterminate' END AS history FROM fl"


def q22(spark, d):
    o = orders(spark, d)
    shell = F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderkey") % 23 == 0)
    e = C.eligibility(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 29 == 0, shell, F.col("o_orderkey") % 7 == 0, F.year("day") == 1999, F.col("o_orderstatus") == "P", {"REVIEW_DATE": F.col("accepted").isNull(), "REVIEW_MULTI_REGISTRANT": F.col("o_orderkey") % 31 == 0})
    return o.select("o_orderkey", e.alias("e")).select("o_orderkey", "e.*")


Q22 = f"""
WITH {ORDERS}, p AS (SELECT *, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 23 = 0 END AS shell, o_orderpriority <> '5-LOW' AS ok, o_orderkey % 7 = 0 AS amend FROM o),
r AS (SELECT *, list_filter([CASE WHEN accepted IS NULL THEN 'REVIEW_DATE' END, CASE WHEN o_orderkey % 31 = 0 THEN 'REVIEW_MULTI_REGISTRANT' END, CASE WHEN shell IS NULL THEN 'REVIEW_SHELL_UNKNOWN' END], lambda x: x IS NOT NULL) AS found,
 CASE WHEN NOT ok THEN 'control_evidence' WHEN amend THEN 'non_target' WHEN year(day) = 1999 THEN 'support_only' ELSE 'primary' END AS role FROM p),
s AS (SELECT *, CASE WHEN NOT ok OR o_custkey % 29 = 0 OR coalesce(shell, false) THEN 'excluded' WHEN len(list_filter(found, lambda x: x <> 'REVIEW_MULTI_REGISTRANT')) > 0 THEN 'review_required' ELSE 'eligible' END AS state FROM r)
SELECT o_orderkey, role, state, role = 'primary' AND state = 'eligible' AS "primary",
 CASE WHEN NOT ok THEN 'UNSUPPORTED_FORM' WHEN o_custkey % 29 = 0 THEN 'EXCLUDED_ISSUER_TYPE' WHEN coalesce(shell, false) THEN 'SHELL_COMPANY'
 ELSE array_to_string(list_concat(found, CASE WHEN o_orderstatus = 'P' AND NOT amend AND year(day) <> 1999 THEN ['TRANSITION_FORM'] ELSE [] END), '+') END AS reasons FROM s
"""


def q23(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left")
    level = F.when(F.col("quality").isNull(), "unavailable").when(F.col("quality") == 1, "provisional").otherwise("review_required")
    size = F.when(F.col("n_chars") < 500, "conflicting").otherwise("provisional")
    return j.select("doc_id", C.evidence_penalty([(F.lit(True), level), (F.col("lang") == "en", size)]).cast("long").alias("penalty"), S.weakest([level, size]).alias("weakest"))


Q23 = """
WITH j AS (SELECT d.doc_id, lang, n_chars, CASE WHEN quality IS NULL THEN 4 WHEN quality = 1 THEN 1 ELSE 2 END AS a, CASE WHEN n_chars < 500 THEN 3 ELSE 1 END AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, (CASE WHEN a > 1 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' AND b > 1 THEN 1 ELSE 0 END)::BIGINT AS penalty, ['provisional', 'review_required', 'conflicting', 'unavailable'][greatest(a, b)] AS weakest FROM j
"""


def q24(spark, d):
    k = F.col("o_orderkey")
    amend = k % 6 == 0
    role = C.filing_role(F.col("o_custkey") % 10 == 0, ~amend, F.year("o_orderdate") < 1996, amend, k % 11 == 0, k % 2 == 1, k % 3 == 0, k % 5 == 0, k % 4 == 1)
    return table(spark, d, "orders").select("o_orderkey", role.alias("role"))


Q24 = """
WITH p AS (SELECT o_orderkey AS k, o_custkey % 10 = 0 AS control, o_orderkey % 6 = 0 AS amend, year(o_orderdate) < 1996 AS pre FROM orders),
m AS (SELECT *, list_filter([CASE WHEN pre AND k % 5 = 0 THEN 'support' END, CASE WHEN NOT amend AND k % 2 = 1 AND NOT pre THEN 'base' END, CASE WHEN (amend OR k % 11 = 0) AND k % 3 = 0 THEN 'stress' END], lambda x: x IS NOT NULL) AS l FROM p)
SELECT k AS o_orderkey, CASE WHEN control THEN CASE WHEN NOT amend AND k % 4 = 1 THEN 'control' END WHEN len(l) = 1 THEN l[1] END AS role FROM m
"""


def filings(spark, d):
    o = orders(spark, d)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.date_format("day", "yyyy").alias("period"), "day", (F.col("o_orderkey") % 4 == 3).alias("amendment"), F.when(F.col("o_orderkey") % 8 == 7, F.min("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("reference"))


FILINGS = f"""{ORDERS}, fi AS (SELECT o_orderkey AS id, o_custkey AS entity, strftime(day, '%Y') AS period, day, o_orderkey % 4 = 3 AS amendment, CASE WHEN o_orderkey % 8 = 7 THEN min(o_orderkey) OVER (PARTITION BY o_custkey) END AS reference FROM o)"""


def q25(spark, d):
    f = filings(spark, d)
    return C.amendment_link(f.where("amendment"), f.where("NOT amendment")).withColumn("parent", F.col("parent").cast("string"))


Q25 = f"""
WITH {FILINGS}, og AS (SELECT * FROM fi WHERE NOT amendment), bp AS (SELECT entity, period, count(*) AS n, min(id) AS one FROM og GROUP BY 1, 2),
m AS (SELECT a.id, a.day, og.id AS named, og.day AS nd, coalesce(bp.n, 0) AS n, bp.one FROM fi a LEFT JOIN og ON og.entity = a.entity AND og.id = a.reference LEFT JOIN bp ON bp.entity = a.entity AND bp.period = a.period WHERE a.amendment),
r AS (SELECT *, CASE WHEN named IS NOT NULL AND nd > day THEN 'refused' WHEN named IS NOT NULL THEN 'amendment_of' WHEN n = 1 THEN 'possible_amendment_of' WHEN n > 1 THEN 'unresolved' ELSE 'no_parent' END AS relation FROM m)
SELECT id, CAST(CASE relation WHEN 'amendment_of' THEN named WHEN 'possible_amendment_of' THEN one END AS VARCHAR) AS parent, relation FROM r
"""


def chain(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderkey") + 100000000).otherwise(F.col("before")).alias("parent"))


CHAIN = "ch AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 100000000 ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent FROM orders)"


def q26(spark, d):
    return G.roots(chain(spark, d), "o_orderkey", "parent").withColumn("root", F.col("root").cast("string"))


Q26 = f"""
WITH RECURSIVE {CHAIN}, w AS (
 SELECT o_orderkey, o_orderkey AS root, 0 AS depth, CASE WHEN parent IS NULL THEN 'root' ELSE 'missing_parent' END AS outcome FROM ch WHERE parent IS NULL OR parent NOT IN (SELECT o_orderkey FROM ch)
 UNION ALL SELECT ch.o_orderkey, w.root, w.depth + 1, CASE WHEN w.outcome = 'missing_parent' THEN 'missing_parent' ELSE 'resolved' END FROM w JOIN ch ON ch.parent = w.o_orderkey)
SELECT o_orderkey, CAST(root AS VARCHAR) AS root, depth::BIGINT AS depth, outcome FROM w
"""


def q27(spark, d):
    return G.lineage(chain(spark, d).where("o_orderkey % 13 <> 0"), "o_orderkey", "parent").groupBy("o_orderkey").agg(n_rows().alias("n_ancestors"), F.max("depth").cast("long").alias("depth"), F.min("ancestor").alias("oldest"))


Q27 = f"""
WITH RECURSIVE {CHAIN}, ed AS (SELECT * FROM ch WHERE parent IS NOT NULL AND o_orderkey % 13 <> 0), w AS (
 SELECT o_orderkey, parent AS a, 1 AS depth FROM ed UNION ALL SELECT w.o_orderkey, ed.parent, w.depth + 1 FROM w JOIN ed ON ed.o_orderkey = w.a)
SELECT o_orderkey, count(*) AS n_ancestors, max(depth)::BIGINT AS depth, min(a) AS oldest FROM w GROUP BY 1
"""


def q28(spark, d):
    return G.shared_alias(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


Q28 = 'SELECT a.s_suppkey AS "left", b.s_suppkey AS "right", count(*) AS n_shared FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY 1, 2'


def q29(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").cast("string").alias("y"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.year(F.min("l_shipdate")).cast("string").alias("y2"), F.lit("F").alias("s2"), F.max("l_quantity").alias("q"))
    return X.reconcile(o, li, "k", {"y": "y2", "s": "s2"}, F.col("q") > 5).groupBy("state").agg(n_rows().alias("n"), F.min("k").alias("lowest"), F.sum("k").alias("total"))


Q29 = """
WITH a AS (SELECT o_orderkey AS k, year(o_orderdate)::VARCHAR AS y, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT l_orderkey AS k, year(min(l_shipdate))::VARCHAR AS y, 'F' AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL AND b.q <= 5 THEN 'indeterminate' WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' WHEN a.y <> b.y OR coalesce(a.s <> b.s, false) THEN 'conflicting' ELSE 'matching' END AS state FROM a FULL JOIN b ON a.k = b.k)
SELECT state, count(*) AS n, min(k) AS lowest, sum(k)::BIGINT AS total FROM j GROUP BY 1
"""


def q30(spark, d):
    plan = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return X.plan_status(plan, table(spark, d, "customer").where("c_nationkey % 4 <> 0"), "c_nationkey")


Q30 = "SELECT n_nationkey AS c_nationkey, n_name, r_name, count(c_custkey) AS n_done, CASE WHEN count(c_custkey) > 0 THEN 'satisfied' ELSE 'missing' END AS status FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 4 <> 0 GROUP BY 1, 2, 3"


def q31(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


Q31 = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"


def q32(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(n_rows().alias("n_lines"), F.min("l_linenumber").alias("first_line"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.agg(n_rows().alias("n_orders"), F.count_if(F.col("n_lines").isNull()).alias("n_empty"), F.count_if(F.col("first_line") > 1).alias("n_late_start"), F.sum(F.coalesce("n_lines", F.lit(0))).alias("n_lines"), F.max("n_lines").alias("most"))


Q32 = """
WITH o AS (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS f FROM orders)
SELECT count(*) AS n_orders, count(*) FILTER (WHERE n = 0) AS n_empty, count(*) FILTER (WHERE f > 1) AS n_late_start, sum(n)::BIGINT AS n_lines, max(n) AS most FROM o
"""


def q33(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("m"), "l_linenumber")
    known = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("m"))
    return R.membership(li.where("l_linenumber <= 3"), li.where("l_linenumber <> 2"), "k", "m", known).withColumn("only", F.col("only").cast("string"))


Q33 = """
WITH u AS (SELECT l_orderkey AS k, l_suppkey AS m, bool_or(l_linenumber <= 3) AS s, bool_or(l_linenumber <> 2) AS i FROM lineitem GROUP BY 1, 2),
g AS (SELECT k, count(*) AS n_union, count(*) FILTER (WHERE s) AS n_submissions, count(*) FILTER (WHERE i) AS n_index, count(*) FILTER (WHERE s AND NOT i) AS uncorroborated, count(*) FILTER (WHERE m % 9 <> 0) AS n_bindable, max(CASE WHEN m % 9 <> 0 THEN m END) AS one FROM u GROUP BY 1)
SELECT k, n_union, n_submissions, n_index, uncorroborated, n_bindable, CAST(CASE WHEN n_bindable = 1 THEN one END AS VARCHAR) AS only, n_submissions > 0 AND n_index > 0 AND uncorroborated = 0 AND n_bindable = n_union AS established FROM g
"""


def q34(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    one = li.select("l_orderkey", "l_suppkey").distinct().join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return one.groupBy("s_nationkey").agg(F.count_distinct("l_orderkey").alias("n_filings"), n_rows().alias("n_attributions"))


Q34 = "SELECT s_nationkey, count(DISTINCT l_orderkey) AS n_filings, count(DISTINCT l_orderkey * 1000000 + l_suppkey) AS n_attributions FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"


def q35(spark, d):
    o = table(spark, d, "orders")
    leg = lambda y: o.where(F.year("o_orderdate") == y).select("o_custkey")
    return leg(1996).intersect(leg(1997))


Q35 = "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997"


def q36(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")).union(s.where("s_acctbal < 1000").select("s_nationkey", F.lit("supplier"))).distinct()


Q36 = "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey, 'supplier' FROM supplier WHERE s_acctbal < 1000"


def q37(spark, d):
    o, li, e = (table(spark, d, t) for t in ("orders", "lineitem", "events"))
    parts = [Q.metric(o, "orders", n_rows()), Q.metric(li.where("l_quantity > 1000"), "huge_lines", n_rows()), Q.metric(e.where("event_type = 'none'"), "last_missing", F.max("event_id")), Q.metric(li, "distinct_suppliers", F.count_distinct("l_suppkey")), Q.metric(e, "refunds", n_rows(), blocked=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


Q37 = """
WITH m AS (SELECT 'orders' AS metric, count(*)::DOUBLE AS v, false AS blocked FROM orders UNION ALL SELECT 'huge_lines', count(*)::DOUBLE, false FROM lineitem WHERE l_quantity > 1000
UNION ALL SELECT 'last_missing', max(event_id)::DOUBLE, false FROM events WHERE event_type = 'none' UNION ALL SELECT 'distinct_suppliers', count(DISTINCT l_suppkey)::DOUBLE, false FROM lineitem UNION ALL SELECT 'refunds', count(*)::DOUBLE, true FROM events),
s AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN v IS NULL THEN 'unavailable' WHEN v = 0 THEN 'zero' ELSE 'value' END AS status FROM m)
SELECT metric, status, CASE WHEN status = 'value' THEN v END AS value FROM s
"""


def q38(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority", F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), 1, 4).alias("year")).agg(n_rows().alias("n"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", 1)), F.lit(0)).alias("n_p"))


Q38 = "SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS year, count(*) AS n, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0)::BIGINT AS n_p FROM orders GROUP BY 1, 2"


def q39(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("n_days"), F.count_distinct("event_type").alias("n_types"))


Q39 = "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1"


def q40(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("n_first"), n_rows().alias("n"))
    return g.where("n_first <> CASE WHEN n > 5 THEN 2 ELSE 1 END")


Q40 = "SELECT l_orderkey, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)::BIGINT AS n_first, count(*) AS n FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) <> CASE WHEN count(*) > 5 THEN 2 ELSE 1 END"


def q41(spark, d):
    return Q.distribution(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


def dist_sql(value: str, source: str, by: str) -> str:
    at = lambda p: f"min(CASE WHEN r >= greatest(1, least(n, round_even({p}.0::DOUBLE / 100.0::DOUBLE * n + 0.5::DOUBLE, 0))) THEN x END)"
    return f"""r AS (SELECT {by} AS g, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {value} IS NOT NULL),
di AS (SELECT g, max(n) AS n, min(x) AS lowest, {at(50)} AS median, round(avg(x), 6) AS mean, {at(75)} AS p75, {at(90)} AS p90, {at(95)} AS p95, max(x) AS highest FROM r GROUP BY 1)"""


Q41 = f"WITH {dist_sql('l_quantity', 'lineitem', 'l_returnflag')} SELECT g AS l_returnflag, n, lowest, median, mean, p75, p90, p95, highest FROM di"


def q42(spark, d):
    return Q.forecast(Q.distribution(table(spark, d, "documents"), "n_chars"), 5000)


Q42 = f"""
WITH {dist_sql('n_chars', 'documents', '1')},
s AS (SELECT unnest(['base', 'high_storage', 'high_failure']) AS scenario, unnest([mean, p95, p90]) AS unit, unnest([1, 1, 2]) AS times, unnest([0.0, 0.02, 0.1]::DOUBLE[]) AS share FROM di),
b AS (SELECT scenario, times, unit * 5000 * times * (1 + share) AS bytes FROM s), p AS (SELECT *, bytes * 1.05::DOUBLE + 5000 * times * 16000 AS peak FROM b)
SELECT scenario, round(bytes, 3) AS bytes, round(peak, 3) AS peak_bytes, round(peak * 2.0::DOUBLE, 3) AS local_needed, round(bytes * 1.2::DOUBLE, 3) AS backup_needed FROM p
"""


def q43(spark, d):
    return Q.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "lang"), ["digest", "lang"])


Q43 = "SELECT sha256(text) AS digest, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1"


def q44(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return D.table_digest(r, "region", ["r_regionkey", "r_name"]).union(D.table_digest(n, "nation", ["n_nationkey", "n_name", "n_regionkey"]))


def digest_sql(name: str, cols: list[str]) -> str:
    row = " || chr(31) || ".join(f"{c}::VARCHAR" for c in cols)
    return f"SELECT '{name}' AS \"table\", count(*) AS n_rows, sha256('{name}' || chr(30) || '{cols[0]}' || {' || '.join(f'chr(31) || {chr(39)}{c}{chr(39)}' for c in cols[1:])} || chr(30) || string_agg({row}, chr(30) ORDER BY {row})) AS digest FROM {name}"


Q44 = digest_sql("region", ["r_regionkey", "r_name"]) + " UNION ALL " + digest_sql("nation", ["n_nationkey", "n_name", "n_regionkey"])


def q45(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("string").alias("y"))
    # texts that are equal once they run together, and a null that changes its place
    old = o.withColumn("o_orderstatus", F.when(k % 11 == 4, "ab").when(k % 11 != 5, F.col("o_orderstatus"))).withColumn("y", F.when(k % 11 == 4, "c").when(k % 11 == 5, "a").otherwise(F.col("y")))
    new = o.withColumn("o_orderstatus", F.when(k % 11 == 4, "a").when(k % 11 == 5, "a").when(k % 9 == 0, "Z").otherwise(F.col("o_orderstatus"))).withColumn("y", F.when(k % 11 == 4, "bc").when(k % 11 != 5, F.col("y")))
    return X.release_diff(old.where("o_orderkey % 7 <> 0"), new.where("o_orderkey % 10 <> 0"), "o_orderkey", ["o_orderstatus", "y"])


Q45 = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, year(o_orderdate)::VARCHAR AS y FROM orders),
a AS (SELECT k, CASE WHEN k % 11 = 4 THEN 'ab' WHEN k % 11 <> 5 THEN s END AS s, CASE WHEN k % 11 = 4 THEN 'c' WHEN k % 11 = 5 THEN 'a' ELSE y END AS y FROM o WHERE k % 7 <> 0),
b AS (SELECT k, CASE WHEN k % 11 IN (4, 5) THEN 'a' WHEN k % 9 = 0 THEN 'Z' ELSE s END AS s, CASE WHEN k % 11 = 4 THEN 'bc' WHEN k % 11 <> 5 THEN y END AS y FROM o WHERE k % 10 <> 0),
j AS (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s OR a.y IS DISTINCT FROM b.y THEN 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k)
SELECT * FROM j WHERE change IS NOT NULL
"""


def q46(spark, d):
    v = diverged(spark, d)
    return Q.gates(v, some_rows=n_rows() > 0, none_crossing=F.count_if("crossing") == 0, few_blocking=F.count_if(T.divergence_blocks(F.col("rule"))) * 10 < n_rows() * 9, all_dated=F.bool_and(F.col("shipped").isNotNull()))


Q46 = f"""
WITH {DIVERGED}, g AS (SELECT count(*) > 0 AS a, count(*) FILTER (WHERE crossing) = 0 AS b, count(*) FILTER (WHERE rule IN {BLOCKING}) * 10 < count(*) * 9 AS c, bool_and(shipped IS NOT NULL) AS d FROM v)
SELECT unnest(['some_rows', 'none_crossing', 'few_blocking', 'all_dated', 'all']) AS gate, unnest([CASE WHEN a THEN 'pass' ELSE 'fail' END, CASE WHEN b THEN 'pass' ELSE 'fail' END, CASE WHEN c THEN 'pass' ELSE 'fail' END, CASE WHEN d THEN 'pass' ELSE 'fail' END, CASE WHEN a AND b AND c AND d THEN 'pass' ELSE 'fail' END]) AS verdict FROM g
"""


def q47(spark, d):
    c = table(spark, d, "customer").withColumn("rank_key", S.seeded_rank("20260725", F.col("c_custkey")))
    w = Window.partitionBy("c_mktsegment").orderBy("rank_key", "c_custkey")
    return c.withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("c_mktsegment", "nth", "c_custkey", "rank_key")


Q47 = "SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('20260725|' || c_custkey::VARCHAR), c_custkey)::INTEGER AS nth, c_custkey, sha256('20260725|' || c_custkey::VARCHAR) AS rank_key FROM customer QUALIFY nth <= 3"

QUERIES = {
    "q16_identifier_normalise": (q16, Q16), "q17_code_range_family": (q17, Q17), "q18_size_stratum": (q18, Q18), "q19_control_count_verdict": (q19, Q19), "q20_event_flags": (q20, Q20),
    "q21_history_class": (q21, Q21), "q22_eligibility_classify": (q22, Q22), "q23_evidence_penalty": (q23, Q23), "q24_role_assign": (q24, Q24), "q25_amendment_link": (q25, Q25),
    "q26_amendment_families": (q26, Q26), "q27_recursive_lineage": (q27, Q27), "q28_shared_alias_edges": (q28, Q28), "q29_reconcile_full_outer": (q29, Q29), "q30_plan_left_join_status": (q30, Q30),
    "q31_orphan_anti": (q31, Q31), "q32_scalar_subquery_totality": (q32, Q32), "q33_bridge_membership": (q33, Q33), "q34_joint_attribution_counts": (q34, Q34), "q35_pair_legs_intersection": (q35, Q35),
    "q36_evidence_union": (q36, Q36), "q37_qa_metrics_table": (q37, Q37), "q38_form_year_counts": (q38, Q38), "q39_distinct_day_counts": (q39, Q39), "q40_having_integrity": (q40, Q40),
    "q41_distribution_summary": (q41, Q41), "q42_forecast_scenarios": (q42, Q42), "q43_duplicate_identities": (q43, Q43), "q44_table_digest": (q44, Q44), "q45_release_diff": (q45, Q45),
    "q46_gate_results": (q46, Q46), "q47_seeded_rank_topk": (q47, Q47),
}
