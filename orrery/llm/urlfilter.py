"""Operator 6: temporal list join of captures against dated URL list entries.

A list is a log of dated entries: a host suffix is added to a category, or removed from
it. Entries become validity intervals [from, to): the last entry of a suffix, category
and day counts, and lasts until the next one. Every capture is joined to the intervals of
its host and of each parent domain that hold at its fetch time (an equality join on the
suffix with the as-of bounds as its residual), by a broadcast where the list is small enough
for the engine's threshold, else by a shuffle whose hot hosts the engine splits.

Defined results: a capture without a host or a fetch time matches nothing and stays;
entries with a null suffix, category or day are left out; repeated captures are rows of
their own; of entries of one day the addition wins; an empty list or table gives no match
or no row; all columns of the captures are kept, whatever their names, but for those named
host, n_active, categories or blocked, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.runtime import materialize, table

CATEGORIES = ("ads", "adult", "malware")


def host(url: Column) -> Column:
    """The lower-case host of an http(s) URL without user, port and closing dot, or ''."""
    return F.lower(F.regexp_extract(url, r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(suffix, category, valid_from, valid_to) from entries (suffix, category, day, added); an open interval has no valid_to."""
    known = entries.where("suffix IS NOT NULL AND category IS NOT NULL AND day IS NOT NULL")
    daily = known.groupBy("suffix", "category", "day").agg(F.max(F.coalesce("added", F.lit(False))).alias("added"))
    following = F.lead("day").over(Window.partitionBy("suffix", "category").orderBy("day"))
    return daily.withColumn("valid_to", following).where("added").select("suffix", "category", F.col("day").alias("valid_from"), "valid_to")


RESULTS = ("host", "n_active", "categories", "blocked")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures with host, n_active (intervals that hold), categories (sorted, comma-joined) and blocked.

    The captures are written once; only (row, suffix, time) is exploded and joined with the
    intervals, and what holds comes back by row. The engine knows the sizes of the list and of
    the rows with a match, and chooses each join by them.
    """
    valid = materialize(intervals(entries), "intervals")
    kept = [c for c in captures.columns if c not in RESULTS]
    rows = captures.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), F.col(f"`{time_col}`").alias("time"), host(F.coalesce(F.col(f"`{url_col}`"), F.lit(""))).alias("host"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "captures")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = rows.where("time IS NOT NULL AND host <> ''").select("row", "time", F.explode(suffixes).alias("suffix"))
    met = each.join(valid, "suffix").where((F.col("valid_from") <= F.col("time")) & (F.col("valid_to").isNull() | (F.col("time") < F.col("valid_to"))))
    held = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    out = rows.join(materialize(held, "held"), "row", "left")
    n = F.coalesce("n_active", F.lit(0))
    return out.select(*(F.col(f"kept.`{c}`").alias(c) for c in kept), "host", n.cast("long").alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"), (n > 0).alias("blocked"))


def demo_entries(captures: DataFrame) -> DataFrame:
    """A list by rule: two thirds of the captures' parent domains are added, removed and added again at days from a digest."""
    domain = captures.select(F.array_join(F.slice(F.split(host("url"), r"\."), -3, 3), ".").alias("suffix")).distinct()
    code = F.conv(F.substring(F.md5("suffix"), 1, 6), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (code % 3 + 1).cast("int"))
    log = [(code % 120, True), (code % 120 + 60 + code % 90, False), (code % 120 + 200 + code % 40, True)]
    moves = F.explode(F.array(*(F.struct(day(n).alias("day"), F.lit(a).alias("added")) for n, a in log)))
    return domain.where((code % 5 < 3) & (F.col("suffix") != "")).select("suffix", category.alias("category"), moves.alias("m")).select("suffix", "category", "m.day", "m.added")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time: the day is 2024-01-01 plus page_id modulo 365."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 365 as int))").alias("fetched"))
    return judge(pages, demo_entries(pages)).select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "n_active", "categories", "blocked")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE = {
    "op6_url_filter": r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 365)::INTEGER AS fetched,
         lower(regexp_extract(coalesce(url, ''), '^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host
  FROM pages),
d AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS suffix FROM p),
c AS (SELECT suffix, ('0x' || substr(md5(suffix), 1, 6))::BIGINT AS code FROM d WHERE suffix <> ''),
e AS (
  SELECT suffix, ['ads', 'adult', 'malware'][(code % 3 + 1)::INTEGER] AS category, unnest([code % 120, code % 120 + 60 + code % 90, code % 120 + 200 + code % 40]) AS n, unnest([true, false, true]) AS added
  FROM c WHERE code % 5 < 3),
daily AS (SELECT suffix, category, DATE '2024-01-01' + n::INTEGER AS day, bool_or(added) AS added FROM e GROUP BY 1, 2, 3),
v AS (SELECT *, lead(day) OVER (PARTITION BY suffix, category ORDER BY day) AS valid_to FROM daily),
hit AS (
  SELECT p.page_id, v.category FROM p JOIN v ON (p.host = v.suffix OR ends_with(p.host, '.' || v.suffix))
  WHERE v.added AND v.day <= p.fetched AND (v.valid_to IS NULL OR p.fetched < v.valid_to))
SELECT p.page_id, p.host, CAST(p.fetched AS VARCHAR) AS fetched, count(h.category) AS n_active, coalesce(string_agg(DISTINCT h.category, ',' ORDER BY h.category), '') AS categories, count(h.category) > 0 AS blocked
FROM p LEFT JOIN hit h ON p.page_id = h.page_id GROUP BY p.page_id, p.host, p.fetched
"""
}
