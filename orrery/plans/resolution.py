"""Queries on resolution and on dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import scalars as S
from orrery.operators import resolve as R, temporal as T
from orrery.plans.common import SUPPORT, WINDOWS, label_sql, mapped_sql
from orrery.runtime import table


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their date, and an acceptance date a few days off that is missing for some."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    shift = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.expr("date_sub(day, cast(o_orderkey % 5 as int) - 1)"))
    return o.withColumn("accepted", shift)


ORDERS = "o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) - (o_orderkey % 5 - 1)::INTEGER END AS accepted FROM orders)"


def resolve_events(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.get_json_object("props", "$.k")))
    return R.resolve_field(e, ["user_id", "event_type"], F.col("v"), F.col("event_id") % 5, F.col("event_id") % 17 == 0, F.col("event_id")).withColumn("leader_id", F.col("leader_id").cast("string"))


RESOLVE_SQL = """
WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS raw, event_id % 5 AS level, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS plain FROM events),
c AS (SELECT *, trim(coalesce(raw, '')) AS c FROM e),
k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY level, plain) AS r FROM c WHERE level < 4),
b AS (SELECT user_id, event_type, min(plain) AS plain, count(DISTINCT c) AS vals, count(*) AS n, min(event_id) AS leader, arg_min(coalesce(raw, '#null'), event_id) AS raw FROM k WHERE r = 1 GROUP BY 1, 2),
a AS (SELECT user_id, event_type, count(*) AS n_competing FROM c GROUP BY 1, 2)
SELECT a.user_id, a.event_type,
  CASE WHEN b.vals IS NULL OR b.vals > 1 THEN 'unresolved' WHEN b.plain = 0 THEN 'resolved_by_correction' ELSE 'resolved' END AS status,
  CASE WHEN b.vals = 1 AND b.raw <> '#null' THEN b.raw END AS value,
  CASE WHEN b.vals = 1 THEN b.n ELSE 0 END AS n_winners, CASE WHEN b.vals = 1 THEN CAST(b.leader AS VARCHAR) END AS leader_id, a.n_competing,
  CASE WHEN b.vals IS NULL THEN 'MATERIAL_CONFLICT' WHEN b.vals > 1 THEN 'EQUAL_AUTHORITY+MATERIAL_CONFLICT' ELSE '' END AS codes
FROM a LEFT JOIN b USING (user_id, event_type)
"""


def q02(spark, d):
    li = table(spark, d, "lineitem")
    eav = li.select("l_orderkey", "l_linenumber", F.explode(F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus", F.lit("year"), F.year("l_shipdate").cast("string"))).alias("field", "value"))
    res = R.resolve_field(eav, ["l_orderkey", "field"], F.col("value"), F.col("l_linenumber") % 3, F.col("l_linenumber") == 7, F.col("l_linenumber"))
    return R.resolve_record(res, ["l_orderkey"], "field", ["flag", "year"])


Q02 = """
WITH e AS (SELECT l_orderkey, l_linenumber, unnest(['flag', 'status', 'year']) AS field, unnest([l_returnflag, l_linestatus, CAST(year(l_shipdate) AS VARCHAR)]) AS value FROM lineitem),
k AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey, field ORDER BY l_linenumber % 3, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END) AS r FROM e),
f AS (SELECT l_orderkey, field, count(DISTINCT trim(value)) > 1 AS bad FROM k WHERE r = 1 GROUP BY 1, 2)
SELECT l_orderkey, count(*) FILTER (WHERE NOT bad) AS n_resolved, count(*) FILTER (WHERE bad) AS n_unresolved,
  coalesce(string_agg(CASE WHEN bad AND field IN ('flag', 'year') THEN field END, '+' ORDER BY field), '') AS blocking,
  count(*) FILTER (WHERE bad AND field IN ('flag', 'year')) = 0 AS complete
FROM f GROUP BY 1
"""


def q03(spark, d):
    e = table(spark, d, "events")
    return R.contributors(e, ["user_id", "event_type"], F.col("event_id") % 4, F.floor("value").cast("long"))


Q03 = """
WITH k AS (SELECT user_id, event_type, event_id % 4 AS precedence, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, rank() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 4) AS r FROM events)
SELECT user_id, event_type, min(precedence)::INTEGER AS precedence, min(value) AS value, count(*) AS n FROM k WHERE r = 1 GROUP BY 1, 2 HAVING min(value) = max(value)
"""


def q04(spark, d):
    return R.conflict_mark(table(spark, d, "events"), ["user_id", "event_type"], F.floor(F.col("value") / 20).cast("long"))


Q04 = "SELECT user_id, event_type, count(DISTINCT CAST(floor(value / 20) AS BIGINT)) AS n_values, count(*) AS n_rows, count(DISTINCT CAST(floor(value / 20) AS BIGINT)) > 1 AS conflicting FROM events GROUP BY 1, 2"


def q05(spark, d):
    return R.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


Q05 = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def q06(spark, d):
    e = table(spark, d, "events").withColumn("digest", F.sha2(F.concat_ws("|", "event_type", (F.col("event_id") % 3).cast("string")), 256))
    return T.supersession(e.select("user_id", "ts", "event_id", "digest"), "user_id", ["ts", "event_id"], "digest").groupBy("user_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


Q06 = """
WITH e AS (SELECT user_id, ts, event_id, sha256(event_type || '|' || (event_id % 3)::VARCHAR) AS digest FROM events),
p AS (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e),
v AS (SELECT *, CASE WHEN previous IS NULL THEN 'first' WHEN previous = digest THEN 'unchanged' ELSE 'superseded' END AS verdict FROM p)
SELECT user_id, verdict, count(*) AS n, max(event_id) AS last_id FROM v GROUP BY 1, 2
"""


def q07(spark, d):
    o = orders(spark, d)
    return o.groupBy(S.window_label(F.col("accepted"), WINDOWS, SUPPORT).alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.min("accepted").cast("string").alias("first_day"), F.max("accepted").cast("string").alias("last_day"))


Q07 = f"WITH {ORDERS} SELECT {label_sql('accepted')} AS cohort, count(*) AS n, CAST(min(accepted) AS VARCHAR) AS first_day, CAST(max(accepted) AS VARCHAR) AS last_day FROM o GROUP BY 1"


def dual(spark, d):
    o = orders(spark, d)
    ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("shipped"))
    return T.assign_cohorts(o.join(ship, "o_orderkey", "left"), F.col("shipped"), F.col("accepted"), WINDOWS, SUPPORT)


DUAL = f"""{ORDERS}, ship AS (SELECT l_orderkey AS o_orderkey, CAST(min(l_shipdate) AS DATE) AS shipped FROM lineitem GROUP BY 1),
u AS (SELECT o.*, ship.shipped FROM o LEFT JOIN ship USING (o_orderkey)),
l AS (SELECT *, {label_sql('shipped')} AS cohort_filed, CASE WHEN accepted IS NOT NULL THEN {label_sql('accepted')} END AS cohort_accepted FROM u),
w AS (SELECT *, {mapped_sql('cohort_filed')} AND {mapped_sql('cohort_accepted')} AND cohort_filed <> cohort_accepted AS crossing, accepted IS NOT NULL AND {mapped_sql('cohort_filed')} <> {mapped_sql('cohort_accepted')} AS coverage FROM l)"""


def q08(spark, d):
    w = dual(spark, d)
    return w.select("o_orderkey", "cohort_filed", "cohort_accepted", F.coalesce("crossing", F.lit(False)).alias("crossing"), "coverage")


Q08 = f"WITH {DUAL} SELECT o_orderkey, cohort_filed, cohort_accepted, coalesce(crossing, false) AS crossing, coverage FROM w"


def spine(spark, d):
    off = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-02").cast("date"), F.lit("2001-12-31").cast("date"), F.expr("interval 6 months"))).alias("day"))
    return T.calendar_spine(off, "1994-12-01", "2002-02-28", off)


SPINE = """hol AS (SELECT CAST(unnest(generate_series(DATE '1995-01-02', DATE '2001-12-31', INTERVAL 6 MONTH)) AS DATE) AS day),
sp AS (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2002-02-28', INTERVAL 1 DAY)) AS DATE) AS day),
op AS (SELECT sp.day, dayofweek(sp.day) NOT IN (0, 6) AND hol.day IS NULL AS operates FROM sp LEFT JOIN hol ON sp.day = hol.day),
cal AS (SELECT day, operates, min(CASE WHEN operates THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS next_operating FROM op)"""


def diverged(spark, d):
    w = dual(spark, d)
    cal = F.broadcast(spine(spark, d).select(F.col("day").alias("accepted"), (F.col("status") == "operating").alias("operates"), "next_operating"))
    rule = T.divergence(F.col("shipped"), F.col("accepted"), F.col("o_orderkey") % 13 == 0, F.col("operates"), F.col("o_orderstatus") != "P", F.col("next_operating"))
    return w.where("shipped IS NOT NULL").join(cal, "accepted", "left").withColumn("rule", rule)


DIVERGED = f"""{DUAL}, {SPINE}, v AS (SELECT w.*, CASE WHEN accepted IS NULL THEN 'missing_acceptance' WHEN shipped = accepted THEN 'same_day' WHEN shipped < accepted THEN 'before_acceptance' WHEN o_orderkey % 13 = 0 THEN 'correction'
 WHEN operates IS NULL THEN 'no_calendar' WHEN NOT operates THEN 'non_operating_acceptance' WHEN o_orderstatus = 'P' THEN 'unsupported_form' WHEN shipped = next_operating THEN 'rollover' ELSE 'unexplained' END AS rule
 FROM w LEFT JOIN cal ON w.accepted = cal.day WHERE shipped IS NOT NULL)"""


def q09(spark, d):
    v = diverged(spark, d).withColumn("blocks", T.divergence_blocks(F.col("rule")))
    return v.groupBy("rule", F.year("shipped").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if("crossing").alias("n_crossing"), F.count_if("blocks").alias("n_blocking"))


BLOCKING = "('before_acceptance', 'no_calendar', 'non_operating_acceptance', 'unsupported_form', 'unexplained')"
Q09 = f"WITH {DIVERGED} SELECT rule, year(shipped)::INTEGER AS year, count(*) AS n, count(*) FILTER (WHERE crossing) AS n_crossing, count(*) FILTER (WHERE rule IN {BLOCKING}) AS n_blocking FROM v GROUP BY 1, 2"


def q10(spark, d):
    e = table(spark, d, "events").where("event_type in ('purchase', 'signup')").withColumn("day", F.to_date("ts"))
    a, b = e.where("event_type = 'signup'").alias("a"), e.where("event_type = 'purchase'").alias("b")
    verdict = T.availability(F.col("a.ts"), F.col("a.day"), F.col("a.event_id") % 3 != 0, F.col("b.ts"), F.col("b.day"), F.col("b.event_id") % 4 != 0, F.col("a.event_id") % 10 == F.col("b.event_id") % 10)
    return a.join(b, F.col("a.user_id") == F.col("b.user_id")).groupBy(F.col("a.user_id").alias("user_id"), verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


Q10 = """
WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events)
SELECT a.user_id, CASE WHEN a.event_id % 10 = b.event_id % 10 THEN 'eligible' WHEN a.event_id % 3 <> 0 AND b.event_id % 4 <> 0 THEN CASE WHEN a.ts <= b.ts THEN 'eligible' ELSE 'ineligible' END
 WHEN a.day < b.day THEN 'eligible' WHEN a.day > b.day THEN 'ineligible' ELSE 'indeterminate' END AS verdict, count(*) AS n
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY 1, 2
"""


def q11(spark, d):
    n = orders(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n_orders"))
    return spine(spark, d).join(n, "day", "left").select(F.col("day").cast("string").alias("day"), "status", F.col("next_operating").cast("string").alias("next_operating"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


Q11 = f"WITH {ORDERS}, {SPINE}, n AS (SELECT day, count(*) AS n_orders FROM o GROUP BY 1) SELECT CAST(cal.day AS VARCHAR) AS day, CASE WHEN operates THEN 'operating' ELSE 'non_operating' END AS status, CAST(next_operating AS VARCHAR) AS next_operating, coalesce(n_orders, 0) AS n_orders FROM cal LEFT JOIN n ON cal.day = n.day"


def q12(spark, d):
    p = T.quarter_plan(orders(spark, d), "day", "1994-11-15", "2002-02-01", "2001-06-30")
    return p.select(F.col("quarter_start").cast("string").alias("quarter_start"), F.col("quarter_end").cast("string").alias("quarter_end"), "state", "n_rows", "covered")


Q12 = f"""
WITH {ORDERS}, p AS (SELECT CAST(unnest(generate_series(date_trunc('quarter', DATE '1994-11-15'), DATE '2002-02-01', INTERVAL 3 MONTH)) AS DATE) AS qs),
n AS (SELECT CAST(date_trunc('quarter', day) AS DATE) AS qs, count(*) AS n FROM o GROUP BY 1)
SELECT CAST(p.qs AS VARCHAR) AS quarter_start, CAST(CAST(p.qs + INTERVAL 3 MONTH AS DATE) - 1 AS VARCHAR) AS quarter_end, CASE WHEN CAST(p.qs + INTERVAL 3 MONTH AS DATE) - 1 <= DATE '2001-06-30' THEN 'closed' ELSE 'open' END AS state, coalesce(n.n, 0) AS n_rows, coalesce(n.n, 0) > 0 AS covered
FROM p LEFT JOIN n ON p.qs = n.qs
"""


def q13(spark, d):
    o = orders(spark, d)
    return T.change_points(o, "o_custkey", "accepted", "o_orderkey", S.circular_day_distance(F.col("accepted"), F.col("previous")), 7)


Q13 = f"""
WITH {ORDERS}, g AS (SELECT o_custkey, accepted, lag(accepted) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM o),
m AS (SELECT *, abs(make_date(2000, month(accepted)::INTEGER, day(accepted)::INTEGER) - make_date(2000, month(previous)::INTEGER, day(previous)::INTEGER)) AS dd FROM g)
SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (WHERE nth > 1 AND accepted IS NOT NULL AND previous IS NOT NULL AND least(dd, 366 - dd) > 7) AS n_changes, count(*) FILTER (WHERE nth > 1 AND (accepted IS NULL OR previous IS NULL)) AS n_unresolved FROM m GROUP BY 1
"""


def q14(spark, d):
    o = orders(spark, d)
    return T.change_points(o, "o_custkey", "day", "o_orderkey", F.abs(F.datediff("day", "previous")), 365)


Q14 = f"""
WITH {ORDERS}, g AS (SELECT o_custkey, day, lag(day) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM o)
SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (WHERE abs(day - previous) > 365) AS n_changes, 0::BIGINT AS n_unresolved FROM g GROUP BY 1
"""


def q15(spark, d):
    o = orders(spark, d)
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("day", "yyyy-MM-dd")).when(k == 1, F.date_format("day", "yyyyMMdd")).when(k == 2, F.concat(F.year("day").cast("string"), F.lit("-"), F.month("day").cast("string"), F.lit("-"), F.dayofmonth("day").cast("string"))).otherwise(F.concat(F.year("day").cast("string"), F.lit("-02-30")))
    return o.select(text.alias("text"), S.strict_date(text).cast("string").alias("parsed")).groupBy("parsed").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("example"))


Q15 = f"""
WITH {ORDERS}, t AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%Y%m%d') WHEN 2 THEN year(day) || '-' || month(day) || '-' || day(day) ELSE year(day) || '-02-30' END AS text FROM o),
p AS (SELECT text, CASE WHEN regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(TRY_CAST(text AS DATE) AS VARCHAR) END AS parsed FROM t)
SELECT parsed, count(*) AS n, min(text) AS example FROM p GROUP BY 1
"""

QUERIES = {
    "q01_resolve_field": (resolve_events, RESOLVE_SQL),
    "q02_resolve_record": (q02, Q02),
    "q03_contributor_selection": (q03, Q03),
    "q04_conflict_mark": (q04, Q04),
    "q05_latest_per_source": (q05, Q05),
    "q06_supersession_chain": (q06, Q06),
    "q07_cohort_assign": (q07, Q07),
    "q08_dual_cohort_divergence": (q08, Q08),
    "q09_divergence_audit": (q09, Q09),
    "q10_availability_tristate": (q10, Q10),
    "q11_calendar_spine": (q11, Q11),
    "q12_quarter_plan": (q12, Q12),
    "q13_circular_month_day": (q13, Q13),
    "q14_change_points": (q14, Q14),
    "q15_strict_date_parse": (q15, Q15),
}
