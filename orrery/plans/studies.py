"""Queries on sources and on study analytics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from orrery.functions import scalars as S
from orrery.operators import graph as G, quality as Q, reconcile as X, resolve as R, study as U
from orrery.runtime import table
from orrery.sources import fixed_text, html, json_arrays as J


def n_rows():
    return F.count(F.lit(1))


def nested(spark, d):
    e = table(spark, d, "events")
    one = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("r"))
    return one.select("user_id", F.col("r.event_id").alias("ids"), F.when(F.col("user_id") % 7 == 3, F.slice("r.event_type", 1, 2)).otherwise(F.col("r.event_type")).alias("types"))


def q52(spark, d):
    good, bad = J.transpose(nested(spark, d), ["user_id"], ["ids", "types"])
    return good.select("user_id", "position", F.col("ids").alias("event_id"), F.col("types").alias("event_type")).union(bad.select("user_id", F.lit(-1), F.lit(0).cast("long"), "reason"))


Q52 = """
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS position, event_id, event_type FROM events WHERE user_id % 7 <> 3
UNION ALL SELECT DISTINCT user_id, -1, 0, 'UNEQUAL_ARRAYS' FROM events WHERE user_id % 7 = 3
"""


def q53(spark, d):
    k = F.col("event_id") % 6
    doc = F.when(k == 0, F.concat(F.lit('{"r": '), F.col("props"), F.lit("}"))).when(k == 1, '{"r": {}}').when(k == 2, '{"r": [1]}').when(k == 3, "{broken").when(k == 4, '{"x": 1}').otherwise(F.col("props"))
    e = table(spark, d, "events").withColumn("doc", doc)
    v = e.select(J.region_verdict(F.col("doc"), "$.r").alias("region"), J.schema_drift(F.col("doc"), ["r"], ["k"]).alias("s"))
    return v.groupBy("region", "s.missing", "s.unknown", "s.verdict").agg(n_rows().alias("n"))


Q53 = """
WITH e AS (SELECT event_id % 6 AS k FROM events)
SELECT CASE k WHEN 0 THEN 'valid' WHEN 1 THEN 'valid_empty' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'malformed' ELSE 'missing' END AS region, CASE WHEN k IN (3, 4, 5) THEN 'r' ELSE '' END AS missing, CASE WHEN k = 4 THEN 'x' ELSE '' END AS unknown,
 CASE WHEN k = 3 THEN 'not_an_object' WHEN k IN (4, 5) THEN 'missing_required' ELSE 'as_contracted' END AS verdict, count(*) AS n FROM e GROUP BY 1, 2, 3, 4
"""


def q54(spark, d):
    o = table(spark, d, "orders")
    row = F.concat(F.rpad(F.concat(F.lit("Customer No "), F.col("o_custkey").cast("string")), 40, " "), F.lit("  "), F.rpad("o_orderstatus", 12, " "), F.lit("  "), F.rpad(F.col("o_custkey").cast("string"), 12, " "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("  edgar/"), F.col("o_orderkey").cast("string"))
    doc = (F.col("o_orderkey") % 5).alias("document")
    body = o.select(doc, (F.col("o_orderkey") + 100).alias("line_number"), F.when(F.col("o_orderkey") % 37 == 0, F.lit("broken row")).otherwise(row).alias("line"))
    rule = spark.range(4).select(F.col("id").alias("document"), F.lit(50).cast("long").alias("line_number"), F.lit("-" * 60).alias("line"))
    rows, bad, docs = fixed_text.parse_index(body.union(rule))
    counts = rows.groupBy("document").agg(n_rows().alias("n_rows"), F.min("filed").alias("first_filed"), F.count_distinct("cik").alias("n_entities"))
    return docs.join(counts, "document", "left").join(bad.groupBy("document").agg(n_rows().alias("n_bad")), "document", "left").select("document", "state", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("n_rows", "first_filed", "n_entities", "n_bad")))


Q54 = """
WITH o AS (SELECT o_orderkey % 5 AS document, o_orderkey % 37 = 0 AS bad, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders)
SELECT document, CASE WHEN document = 4 THEN 'unreadable' ELSE 'readable' END AS state,
 CASE WHEN document = 4 THEN 'unknown' ELSE (count(*) FILTER (WHERE NOT bad))::VARCHAR END AS n_rows, CASE WHEN document = 4 THEN 'unknown' ELSE min(CASE WHEN NOT bad THEN filed END) END AS first_filed,
 CASE WHEN document = 4 THEN 'unknown' ELSE (count(DISTINCT CASE WHEN NOT bad THEN o_custkey END))::VARCHAR END AS n_entities, CASE WHEN document = 4 THEN 'unknown' ELSE (count(*) FILTER (WHERE bad))::VARCHAR END AS n_bad FROM o GROUP BY 1
"""


def q55(spark, d):
    x = html.extract(table(spark, d, "pages"), "page_id", "html")
    return x.select("page_id", "title", F.size("items").cast("long").alias("n_items"), F.size("links").cast("long").alias("n_links"), F.array_join(F.slice("items", 1, 5), "|").alias("first_items"))


def q56(spark, d):
    lab = table(spark, d, "labels")
    one = lab.groupBy((F.col("doc_id") % 50).alias("part")).agg(F.array_sort(F.collect_list(F.array("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long")))).alias("data"))
    one = one.withColumn("fields", F.when(F.col("part") == 30, F.array(F.lit("doc"), F.lit("q"))).otherwise(F.array(F.lit("doc"), F.lit("quality"), F.lit("toxic"))))
    return J.header_matrix(one, ["part"], "fields", "data", ["toxic", "doc"])


Q56 = "SELECT doc_id % 50 AS part, (row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) - 1)::INTEGER AS position, toxic::BIGINT AS toxic, doc_id AS doc FROM labels WHERE doc_id % 50 <> 30"


def q57(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.regexp_replace("url", "^(https?)://([^/]+)", "$1://$2:80")).when(k == 1, F.concat(F.col("url"), F.lit("/a//./b"))).when(k == 2, F.concat(F.lit("HTTP"), F.expr("substring(url, 5)"))).when(k == 3, F.concat(F.col("url"), F.lit("/../x"))).otherwise(F.col("url"))
    return p.select("page_id", raw.alias("raw"), S.normalise_url(raw).alias("url"))


def q58(spark, d):
    docs = table(spark, d, "documents")
    h = docs.select("doc_id", "source", F.sha2(X.cells(["lang", "source", "text"]), 256).alias("digest"), F.sha2("text", 256).alias("content"))
    return h.groupBy("content").agg(n_rows().alias("n"), F.count_distinct("digest").alias("n_records"), F.min("doc_id").alias("first_id"))


Q58 = "SELECT sha256(text) AS content, count(*) AS n, count(DISTINCT sha256(lang || '|' || source || '|' || text)) AS n_records, min(doc_id) AS first_id FROM documents GROUP BY 1"
TONE = ("the", "and", "worthless", "loser", "pathetic", "great")


def q59(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "x").alias("text"))
    return U.style_features(docs, "doc_id", "text", TONE).select("doc_id", "n_words", "n_sentences", "sentence_words", "word_chars", "type_token", "numeric", "tone", "list_lines")


Q59 = f"""
WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w, greatest(len(regexp_extract_all(text, '[.!?]+([ \\t\\n\\r\\f]|\\z)')), 1) AS s, string_split(text, chr(10)) AS l FROM t)
SELECT doc_id, len(w) AS n_words, s::BIGINT AS n_sentences, round(len(w) / s::DOUBLE, 6) AS sentence_words, round(length(array_to_string(w, '')) / greatest(len(w), 1)::DOUBLE, 6) AS word_chars, round(len(list_distinct(w)) / greatest(len(w), 1)::DOUBLE, 6) AS type_token,
 round(len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$'))) / greatest(len(w), 1)::DOUBLE, 6) AS numeric, round(len(list_filter(w, lambda x: x IN {TONE})) / greatest(len(w), 1)::DOUBLE, 6) AS tone, round(len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*|]'))) / len(l)::DOUBLE, 6) AS list_lines FROM w
"""


def neighbours(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", "source", F.lag("doc_id").over(w).alias("before")).where("before IS NOT NULL").select(F.col("before").alias("a"), F.col("doc_id").alias("b"))


def q60(spark, d):
    return U.cosine_pairs(U.term_counts(table(spark, d, "documents"), "doc_id", "text"), neighbours(spark, d), "doc_id", "term", "tf")


TERMS = "wd AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM wd WHERE term <> '' GROUP BY 1, 2)"
Q60 = f"""
WITH {TERMS}, pr AS (SELECT lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS a, doc_id AS b FROM documents), p AS (SELECT * FROM pr WHERE a IS NOT NULL),
nm AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY 1), dt AS (SELECT p.a, p.b, sum(x.tf * y.tf) AS dot FROM p JOIN tf x ON x.doc_id = p.a JOIN tf y ON y.doc_id = p.b AND x.term = y.term GROUP BY 1, 2)
SELECT p.a, p.b, round(coalesce(dot, 0) / (n1.norm * n2.norm), 6) AS similarity FROM p LEFT JOIN dt ON p.a = dt.a AND p.b = dt.b LEFT JOIN nm n1 ON n1.doc_id = p.a LEFT JOIN nm n2 ON n2.doc_id = p.b
"""


def q61(spark, d):
    return U.boilerplate(table(spark, d, "documents"), "doc_id", "text")


Q61 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, trim(line) AS line FROM l WHERE trim(line) <> ''),
c AS (SELECT line FROM k GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line IN (SELECT line FROM c)) AS n_shared, round(count(*) FILTER (WHERE line IN (SELECT line FROM c)) / count(*)::DOUBLE, 6) AS share FROM k GROUP BY 1
"""


def q62(spark, d):
    return U.tfidf(table(spark, d, "documents"), "doc_id", "text", 5)


Q62 = f"""
WITH {TERMS}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, term, round(tf * ln((1 + n) / (1 + df)::DOUBLE), 6) AS score FROM tf JOIN df USING (term), n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INTEGER AS nth, term, score FROM s QUALIFY nth <= 5
"""
FOLDS = [(1995, 1996, 1997, 1997), (1995, 1997, 1998, 1998), (1995, 1998, 1999, 1999), (1995, 1999, 2000, 2000), (1995, 2000, 2001, 2001)]


def q63(spark, d):
    return U.rolling_folds(table(spark, d, "orders"), F.year("o_orderdate"), FOLDS).groupBy("fold", "part").agg(n_rows().alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


Q63 = f"""
WITH f(fold, a, b, c, d) AS (VALUES {', '.join(str((i + 1, *f)) for i, f in enumerate(FOLDS))}), o AS (SELECT year(o_orderdate) AS y, o_totalprice FROM orders),
p AS (SELECT fold, CASE WHEN y BETWEEN a AND b THEN 'train' WHEN y BETWEEN c AND d THEN 'test' END AS part, o_totalprice FROM o, f)
SELECT fold::INTEGER AS fold, part, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM p WHERE part IS NOT NULL GROUP BY 1, 2
"""


def margins(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("firm"), F.year("l_shipdate").alias("y")).agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")).alias("margin"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("firm"), F.col("s_nationkey").alias("industry"), (F.col("s_nationkey") % 5).alias("sector"))
    m = U.yearly_change(li.withColumn("day", F.make_date("y", F.lit(12), F.lit(31))), "firm", "day", "margin").join(s, "firm")
    return U.median_adjusted(m, "change", ["industry", "y"], ["sector", "y"], "firm", 5)


MARGINS = """li AS (SELECT l_suppkey AS firm, year(l_shipdate) AS y, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS margin FROM lineitem GROUP BY 1, 2),
ch AS (SELECT *, CASE WHEN make_date(y::INTEGER, 12, 31) - lag(make_date(y::INTEGER, 12, 31)) OVER w BETWEEN 300 AND 430 THEN margin - lag(margin) OVER w END AS change FROM li WINDOW w AS (PARTITION BY firm ORDER BY y)),
mg AS (SELECT ch.*, s_nationkey AS industry, s_nationkey % 5 AS sector FROM ch JOIN supplier ON firm = s_suppkey),
mf AS (SELECT industry, y, median(change) AS m FROM mg WHERE change IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT firm) >= 5), mc AS (SELECT sector, y, median(change) AS m FROM mg WHERE change IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT firm) >= 5),
ad AS (SELECT mg.*, mg.change - coalesce(mf.m, mc.m) AS adjusted FROM mg LEFT JOIN mf ON mg.industry = mf.industry AND mg.y = mf.y LEFT JOIN mc ON mg.sector = mc.sector AND mg.y = mc.y)"""


def q64(spark, d):
    return margins(spark, d).select("firm", "y", (F.round(F.coalesce("adjusted", F.lit(-9.0)), 6) + 0.0).alias("adjusted"))


Q64 = f"WITH {MARGINS} SELECT firm, y::INTEGER AS y, round(coalesce(adjusted, -9), 6) + 0.0 AS adjusted FROM ad"


def q65(spark, d):
    m = U.severe(U.winsor(margins(spark, d), "adjusted", F.col("y") <= 1999), "capped", F.col("y") <= 1999)
    return m.where("capped IS NOT NULL").select("firm", "y", (F.round("capped", 6) + 0.0).alias("capped"), "cut", "severe")


Q65 = f"""
WITH {MARGINS}, q AS (SELECT quantile_cont(adjusted, 0.01) AS lo, quantile_cont(adjusted, 0.99) AS hi FROM ad WHERE y <= 1999), c AS (SELECT ad.*, least(greatest(adjusted, lo), hi) AS capped FROM ad, q WHERE adjusted IS NOT NULL),
k AS (SELECT round(quantile_cont(capped, 0.1), 6) AS cut FROM c WHERE y <= 1999) SELECT firm, y::INTEGER AS y, round(capped, 6) + 0.0 AS capped, cut, round(capped, 6) <= cut AS severe FROM c, k
"""


def labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


def q66(spark, d):
    x = labelled(spark, d).withColumn("quality", F.col("quality").cast("double")).withColumn("size", F.when(F.col("doc_id") % 9 != 0, F.col("n_chars").cast("double"))).select("doc_id", "size", "quality")
    return U.impute_scale(x, ["size", "quality"], F.col("doc_id") % 3 != 0).select("doc_id", "size_missing", "size_scaled")


Q66 = """
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN n_chars::DOUBLE END AS size FROM documents), q AS (SELECT quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.5) AS m, quantile_cont(size, 0.75) AS b FROM x WHERE doc_id % 3 <> 0)
SELECT doc_id, (size IS NULL)::INTEGER AS size_missing, round((coalesce(size, m) - m) / CASE WHEN b > a THEN b - a ELSE 1 END, 6) AS size_scaled FROM x, q
"""


def q67(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size"), F.size(F.split("text", "\n")).cast("double").alias("lines"))
    return U.composite(x, ["size", "lines"], F.col("doc_id") % 2 == 0).select("doc_id", "composite")


Q67 = """
WITH x AS (SELECT doc_id, n_chars::DOUBLE AS size, len(string_split(text, chr(10)))::DOUBLE AS lines FROM documents), s AS (SELECT avg(size) AS a, stddev_samp(size) AS b, avg(lines) AS c, stddev_samp(lines) AS e FROM x WHERE doc_id % 2 = 0)
SELECT doc_id, round(((size - a) / b + (lines - c) / e) / 2, 6) AS composite FROM x, s
"""


def q68(spark, d):
    m = margins(spark, d).where("adjusted IS NOT NULL").withColumn("predicted", F.col("change") * 0.5)
    return U.regression_metrics(m, "adjusted", "predicted", ["sector"])


Q68 = f"""
WITH {MARGINS}, p AS (SELECT sector, adjusted AS a, change * 0.5 AS p FROM ad WHERE adjusted IS NOT NULL)
SELECT sector, count(*) AS n, round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse, round(quantile_cont(abs(p - a), 0.5), 6) AS medae, round(1 - sum((p - a) * (p - a)) / (var_pop(a) * count(*)), 6) AS r2, round(avg(p - a), 6) AS bias, round(regr_slope(a, p), 6) AS slope, round(regr_intercept(a, p), 6) AS intercept FROM p GROUP BY 1
"""


def scored(spark, d):
    return table(spark, d, "labels").withColumn("score", F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 6), 16, 10).cast("long") / F.lit(16777216.0))


def q69(spark, d):
    return U.classification_metrics(scored(spark, d), "quality", "score", "doc_id")


Q69 = """
WITH b AS (SELECT quality AS y, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 6))::BIGINT / 16777216.0::DOUBLE AS p, doc_id AS i FROM labels),
r AS (SELECT *, row_number() OVER (ORDER BY p, i) AS up, count(*) OVER () AS n, sum(y) OVER () AS pos, sum(y) OVER (ORDER BY p DESC, i DESC ROWS UNBOUNDED PRECEDING) AS hits FROM b),
k AS (SELECT *, n - up + 1 AS down, floor((up - 1) * 10 / n::DOUBLE) AS bin, ceil(n * 0.1::DOUBLE) AS top FROM r), g AS (SELECT abs(avg(y) - avg(p)) AS gap, count(*) AS c FROM k GROUP BY bin)
SELECT max(n) AS n, round(avg(y), 6) AS prevalence, round(avg((p - y) * (p - y)), 6) AS brier, round((sum(y * up) - max(pos) * (max(pos) + 1) / 2.0::DOUBLE) / (max(pos) * (max(n) - max(pos))), 6) AS roc_auc, round(sum(y * hits / down::DOUBLE) / max(pos), 6) AS average_precision,
 round(avg(CASE WHEN down <= top THEN y END), 6) AS precision_at, round(sum(CASE WHEN down <= top THEN y END) / max(pos)::DOUBLE, 6) AS recall_at, (SELECT round(sum(gap * c) / sum(c), 6) FROM g) AS ece FROM k
"""


def q70(spark, d):
    return U.interval(U.bootstrap(margins(spark, d), "firm", "adjusted", 2000, "20260725"))


Q70 = f"""
WITH {MARGINS}, e AS (SELECT firm, sum(adjusted) AS s, count(*) AS c FROM ad WHERE adjusted IS NOT NULL GROUP BY 1), r AS (SELECT unnest(generate_series(1, 2000)) AS rep),
u AS (SELECT rep, s, c, ('0x' || substr(sha256('20260725|' || rep || '|' || firm), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM e, r),
m AS (SELECT *, CASE {' '.join(f'WHEN u < {p:.8f} THEN {k}' for k, p in enumerate(U.POISSON))} ELSE {len(U.POISSON)} END AS m FROM u), b AS (SELECT rep, round(sum(m * s) / sum(m * c), 6) AS est FROM m GROUP BY 1)
SELECT count(est) AS replicates, round(quantile_cont(est, 0.025), 6) AS low, round(quantile_cont(est, 0.5), 6) AS middle, round(quantile_cont(est, 0.975), 6) AS high FROM b
"""
PVALUES = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", 0.9)]


def q71(spark, d):
    return U.holm(spark.createDataFrame(PVALUES, "test string, p double"), "test", "p")


Q71 = f"""
WITH t(test, p) AS (VALUES {', '.join(f"('{t}', {p}::DOUBLE)" for t, p in PVALUES)}), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM t)
SELECT test, p, round(max(least(1.0::DOUBLE, p * (m - k + 1))) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM k
"""


def q72(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("y"), (F.col("c_nationkey") / 10.0).alias("x1"), (F.col("c_custkey") % 7).cast("double").alias("x2"))
    return U.ols_hc3(c, "y", ["x1", "x2"], "c_custkey").select("term", F.round("coefficient", 3).alias("coefficient"), F.round("std_error", 3).alias("std_error"))


def q73(spark, d):
    return U.subgroups(labelled(spark, d), "lang", "quality", F.col("n_chars").cast("double"), 20)


Q73 = """
SELECT coalesce(lang, 'all') AS lang, coalesce(quality::VARCHAR, 'all') AS quality, CASE WHEN count(*) >= 20 THEN count(*)::VARCHAR END AS n, CASE WHEN count(*) >= 20 THEN round(avg(n_chars), 6) END AS mean
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((lang, quality), (lang), (quality), ())
"""


def q74(spark, d):
    x = labelled(spark, d)
    return Q.waterfall(x, {"unlabelled": F.col("quality").isNull(), "short": F.col("n_chars") < 500, "toxic": F.col("toxic") == 1, "not_english": F.col("lang") != "en"})


Q74 = """
WITH x AS (SELECT CASE WHEN quality IS NULL THEN 0 WHEN n_chars < 500 THEN 1 WHEN toxic = 1 THEN 2 WHEN lang <> 'en' THEN 3 ELSE 4 END AS step FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r(step, rule) AS (VALUES (0, 'unlabelled'), (1, 'short'), (2, 'toxic'), (3, 'not_english')), c AS (SELECT r.step, r.rule, count(x.step) AS n FROM r LEFT JOIN x ON x.step = r.step GROUP BY 1, 2)
SELECT step::INTEGER AS step, rule, n AS n_excluded, ((SELECT count(*) FROM x) - sum(n) OVER (ORDER BY step))::BIGINT AS n_left FROM c
"""


def q75(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size"), F.size(F.split("text", " ")).cast("double").alias("words"))
    return U.rewrite_sensitivity(neighbours(spark, d), x, "doc_id", ["size", "words"])


Q75 = """
WITH x AS (SELECT doc_id, n_chars::DOUBLE AS size, len(string_split(text, ' '))::DOUBLE AS words FROM documents), pr AS (SELECT lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS a, doc_id AS b FROM documents),
m AS (SELECT quantile_cont(abs(x.size - y.size), 0.5) AS s, quantile_cont(abs(x.words - y.words), 0.5) AS w FROM pr JOIN x ON pr.a = x.doc_id JOIN x y ON pr.b = y.doc_id), q AS (SELECT quantile_cont(size, 0.75) - quantile_cont(size, 0.25) AS s, quantile_cont(words, 0.75) - quantile_cont(words, 0.25) AS w FROM x)
SELECT 'size' AS "column", round(m.s / q.s, 6) AS sensitivity FROM m, q UNION ALL SELECT 'words', round(m.w / q.w, 6) FROM m, q
"""
CUTOFFS = ["1996-01-01", "1998-01-01", "2000-01-01"]


def q76(spark, d):
    return U.placebo(table(spark, d, "orders"), "o_orderdate", "o_totalprice", CUTOFFS)


Q76 = f"""
WITH c AS (SELECT unnest({CUTOFFS}) AS cutoff)
SELECT cutoff, count(*) FILTER (WHERE o_orderdate < cutoff::DATE) AS n_before, count(*) FILTER (WHERE o_orderdate >= cutoff::DATE) AS n_after, round(avg(CASE WHEN o_orderdate >= cutoff::DATE THEN o_totalprice END) - avg(CASE WHEN o_orderdate < cutoff::DATE THEN o_totalprice END), 6) AS difference FROM orders, c GROUP BY 1
"""


def q77(spark, d):
    c = table(spark, d, "conversations")
    kids = c.where("turn > 0").select(F.concat_ws("-", "conv_id", "turn").alias("name"), F.col("conv_id").alias("own"))
    t = F.col("turn")
    claims = c.where("turn > 0 AND turn % 5 <> 4").select(F.concat_ws("-", "conv_id", "turn").alias("declared"), F.explode(F.when(t % 3 == 0, F.array("conv_id", F.col("conv_id") + 1)).otherwise(F.array("conv_id"))).alias("by"), F.when(t % 7 == 1, F.lit(-1).cast("long")).otherwise(F.col("conv_id")).alias("claimed"))
    return G.declared_parent(kids, claims, "name", "own", "declared", "by", "claimed").groupBy("binding").agg(n_rows().alias("n"), F.coalesce(F.sum("parent"), F.lit(0)).alias("parents"))


Q77 = """
WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'missing' WHEN turn % 3 = 0 THEN 'ambiguous' WHEN turn % 7 = 1 THEN 'contradictory' ELSE 'bound' END AS binding FROM conversations WHERE turn > 0)
SELECT binding, count(*) AS n, coalesce(sum(CASE WHEN binding = 'bound' THEN conv_id END), 0)::BIGINT AS parents FROM k GROUP BY 1
"""


def q78(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    bridge = li.join(s.select("s_suppkey", (F.col("s_nationkey") % 3).alias("category")), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "category")
    return G.attach(bridge, "l_orderkey", "category").withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("closed")))


Q78 = "SELECT l_orderkey, CASE WHEN count(DISTINCT s_nationkey % 3) = 1 THEN min(s_nationkey % 3)::VARCHAR ELSE 'closed' END AS category, count(DISTINCT s_nationkey % 3) AS n_categories FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"


def q79(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return X.reconstruction(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 77, "?").otherwise(F.col("o_orderstatus"))).where("o_orderkey <> 99"))


Q79 = "SELECT 'extra' AS side, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (77, 99) UNION ALL SELECT 'missing', o_orderkey, o_custkey, '?' FROM orders WHERE o_orderkey = 77"


def q80(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 3
    role = F.when(F.col("event_type") == "view", "ticker").when(k == 0, "winning").otherwise("other")
    return R.name_change(e.select("user_id", "event_type", role.alias("role"), (F.col("value") > 10).alias("good")), ["user_id", "event_type"])


Q80 = """
WITH e AS (SELECT user_id, event_type, CASE WHEN event_type = 'view' THEN 'ticker' WHEN event_id % 3 = 0 THEN 'winning' ELSE 'other' END AS role, value > 10 AS good FROM events),
g AS (SELECT user_id, event_type, count(*) FILTER (WHERE role = 'winning') AS w, count(*) FILTER (WHERE role = 'winning' AND good) AS g, count(*) FILTER (WHERE role = 'ticker') AS t, count(*) AS n FROM e GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN t = n THEN 'unavailable' WHEN w >= 2 THEN 'conflicting' WHEN w = 1 AND g = 1 THEN 'provisional' ELSE 'review_required' END AS branch FROM g
"""

QUERIES = {
    "q52_parallel_array_transpose": (q52, Q52), "q53_region_and_drift": (q53, Q53), "q54_fixed_text_rows": (q54, Q54), "q55_html_extract": (q55, None), "q56_header_matrix": (q56, Q56), "q57_url_normalise": (q57, None),
    "q58_record_hash": (q58, Q58), "q59_style_features": (q59, Q59), "q60_yoy_similarity": (q60, Q60), "q61_boilerplate_share": (q61, Q61), "q62_tfidf_top_terms": (q62, Q62), "q63_rolling_folds": (q63, Q63),
    "q64_margin_change_adjusted": (q64, Q64), "q65_winsor_severe": (q65, Q65), "q66_impute_scale": (q66, Q66), "q67_drift_composite": (q67, Q67), "q68_regression_metrics": (q68, Q68), "q69_classification_metrics": (q69, Q69),
    "q70_bootstrap_interval": (q70, Q70), "q71_holm": (q71, Q71), "q72_ols_hc3": (q72, None), "q73_subgroup_suppressed": (q73, Q73), "q74_exclusion_waterfall": (q74, Q74), "q75_rewrite_sensitivity": (q75, Q75),
    "q76_placebo_cutoffs": (q76, Q76), "q77_declared_parent_join": (q77, Q77), "q78_attachment_join": (q78, Q78), "q79_reconstruction_diff": (q79, Q79), "q80_name_change_branch": (q80, Q80),
}
