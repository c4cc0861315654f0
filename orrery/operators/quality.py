"""Metrics, distributions, forecasts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.operators import order


def metric(df: DataFrame, name: str, value: Column, blocked: bool = False) -> DataFrame:
    """One row (metric, status, value): zero is a status of its own, and null is unavailable."""
    out = df.agg(value.cast("double").alias("value"))
    status = F.lit("blocked") if blocked else F.when(F.col("value").isNull(), "unavailable").when(F.col("value") == 0, "zero").otherwise("value")
    return out.select(F.lit(name).alias("metric"), status.alias("status"), F.when(status == "value", F.col("value")).alias("value"))


def percentile_rank(p: float, n: Column) -> Column:
    """round(p / 100 * n + 0.5), half to even, within 1..n: not the textbook nearest rank."""
    return F.greatest(F.lit(1), F.least(n, F.bround(F.lit(float(p)) / F.lit(100.0) * n.cast("double") + F.lit(0.5), 0).cast("long")))


def distribution(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n, lowest, median, mean, p75, p90, p95, highest by the rank rule above.

    Values are counted first, and the distinct ones ranked by ranges.
    """
    keys = by or []
    cum = order.counted(rows, value, keys).withColumnRenamed(value, "x").withColumn("to", F.col("first") + F.col("c"))
    at = lambda p: F.min(F.when(F.col("to") >= percentile_rank(p, F.col("n")), F.col("x")))
    return cum.groupBy(*keys).agg(F.max("n").alias("n"), F.min("x").alias("lowest"), at(50).alias("median"), F.round(F.sum(F.col("x") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(75).alias("p75"), at(90).alias("p90"), at(95).alias("p95"), F.max("x").alias("highest"))


def forecast(dist: DataFrame, requests: int) -> DataFrame:
    """scenario, bytes, peak_bytes, local_needed, backup_needed from one distribution row."""
    plans = (("base", "mean", 1, 0.0), ("high_storage", "p95", 1, 0.02), ("high_failure", "p90", 2, 0.10))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.col(c).cast("double").alias("unit"), F.lit(m).alias("times"), F.lit(q).alias("share")) for n, c, m, q in plans)))
    out = dist.select(each.alias("s")).select("s.*").withColumn("bytes", F.col("unit") * requests * F.col("times") * (1 + F.col("share")))
    peak = F.col("bytes") * 1.05 + requests * F.col("times") * (12_000 + 4_000)
    out = out.withColumn("peak_bytes", peak)
    return out.select("scenario", *(F.round(c, 3).alias(n) for n, c in (("bytes", F.col("bytes")), ("peak_bytes", F.col("peak_bytes")), ("local_needed", F.col("peak_bytes") * 2.0), ("backup_needed", F.col("bytes") * 1.2))))


def gates(df: DataFrame, **tests: Column) -> DataFrame:
    """(gate, verdict) for each aggregate condition, and for all of them; null fails."""
    one = df.agg(*(F.coalesce(t, F.lit(False)).alias(n) for n, t in tests.items()))
    all_ = F.lit(True)
    for n in tests:
        all_ = all_ & F.col(n)
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), F.when(c, "pass").otherwise("fail").alias("verdict")) for n, c in (*((n, F.col(n)) for n in tests), ("all", all_))))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def duplicates(rows: DataFrame, identity: list[str]) -> DataFrame:
    """identity, n of identities that occur more than once."""
    return rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def waterfall(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """step, rule, n_excluded, n_left: each row falls to the first rule that it breaks."""
    code = F.lit(len(rules))
    for i, test in reversed(list(enumerate(rules.values()))):
        code = F.when(F.coalesce(test, F.lit(False)), i).otherwise(code)
    n = rows.groupBy(code.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(len(rules)).select(F.col("id").cast("int").alias("step"), F.element_at(F.array(*map(F.lit, rules)), F.col("id").cast("int") + 1).alias("rule"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row a rule
    out = every.join(n, "step", "left").withColumn("n_excluded", F.coalesce("n", F.lit(0)).cast("long")).crossJoin(F.broadcast(total))
    return out.withColumn("n_left", F.col("total") - F.sum("n_excluded").over(w)).select("step", "rule", "n_excluded", "n_left")


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, n of each column, in one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"), "n") for c in columns))).alias("r")).select("r.*")
