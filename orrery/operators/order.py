"""Ranks, running sums and exact percentiles over an order of all rows, without one partition for all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.runtime import materialize, shuffle_partitions


def running(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """The rows with rank (from 1), n, and for each named sum its running sum in order, own row included, and total_<name>.

    Rows are dealt by range of the order and written with the number of their range, so a
    retried task can't deal them anew. Each range is summed (one row a range, the only part in
    one task) and its rows add what stands in front of it. Rows equal in all of `order` meet in
    one range: name columns that tell them apart, or count equal rows first. Nulls come first,
    and a null summand counts as nothing.
    """
    names = list(sums)
    made = rows.select("*", *(F.coalesce(c, F.lit(0)).alias(f"orrery_{s}") for s, c in sums.items()))
    dealt = materialize(made.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("orrery_range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("orrery_range").agg(F.count(F.lit(1)).alias("b_rank"), *(F.sum(f"orrery_{s}").alias(f"b_{s}") for s in names))
    front, every = Window.orderBy("orrery_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select("orrery_range", F.sum("b_rank").over(every).alias("n"), *(F.sum(f"b_{s}").over(every).alias(f"total_{s}") for s in names), *(F.coalesce(F.sum(f"b_{s}").over(front), F.lit(0)).alias(f"f_{s}") for s in ("rank", *names)))
    w = Window.partitionBy("orrery_range").orderBy(*order)
    out = dealt.join(F.broadcast(per), "orrery_range")  # one row a range
    out = out.withColumn("rank", F.row_number().over(w) + F.col("f_rank"))
    for s in names:
        out = out.withColumn(s, F.sum(f"orrery_{s}").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"f_{s}"))
    return out.select(*rows.columns, "rank", "n", *names, *(f"total_{s}" for s in names))


def counted(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, value, c (rows of that value), first (how many of the group stand before it), n (rows of the group); nulls are left out.

    Equal values are counted before anything is ordered, so a value with a third of all rows is one row.
    """
    keys = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    run = running(counts, [*keys, value], upto=F.col("c"))
    if not keys:
        return run.select(value, "c", (F.col("upto") - F.col("c")).alias("first"), F.col("total_upto").alias("n"))
    run = run.withColumn("before", F.col("upto") - F.col("c"))
    starts = run.groupBy(*(F.col(k).alias(f"g_{k}") for k in keys)).agg(F.sum("c").alias("n_group"), F.min("before").alias("start"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    return run.drop("n").join(starts, same).select(*keys, value, "c", (F.col("before") - F.col("start")).alias("first"), F.col("n_group").alias("n"))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by, and one column a share: the exact percentile, interpolated between the two nearest ranks.

    A group without a value has no row; without `by` there is always one row, of nulls over no values.
    """
    ranked = counted(rows, value, by)
    x, first, c = F.col(value).cast("double"), F.col("first"), F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < first + c), x))

    parts = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("n") - 1)
        parts += [at(F.floor(place)).alias(f"lo_{name}"), at(F.ceil(place)).alias(f"hi_{name}"), F.max(place - F.floor(place)).alias(f"at_{name}")]
    got = ranked.groupBy(*by).agg(*parts) if by else ranked.agg(*parts)
    return got.select(*by, *((F.col(f"lo_{m}") + (F.col(f"hi_{m}") - F.col(f"lo_{m}")) * F.col(f"at_{m}")).alias(m) for m in shares))
