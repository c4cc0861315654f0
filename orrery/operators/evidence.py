"""Verdicts on evidence: content changes, reuse, consistency of runs, levels of sets, chained digests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.scalars import level_name, level_rank, reasons


def content_change(digest: Column, before: Column, etag: Column, etag_before: Column, modified: Column, modified_before: Column, mutable: Column, period_open: Column, corrected: Column) -> Column:
    """first, unchanged, contradiction, expected_update or anomaly of an observation against the one before.

    Equal content is unchanged whatever the validators say; an equal validator with other
    content is a contradiction (the modification time counts only where one side has no
    tag); a dated source may change while its period is known to be open, or by a correction.
    """
    same_tag = F.when(etag.isNotNull() & etag_before.isNotNull(), etag == etag_before).otherwise(F.coalesce(modified == modified_before, F.lit(False)))
    return (
        F.when(before.isNull(), "first").when(digest == before, "unchanged").when(same_tag, "contradiction")
        .when(mutable | F.coalesce(period_open, F.lit(False)) | F.coalesce(corrected, F.lit(False)), "expected_update").otherwise("anomaly")
    )


def reuse_decision(**preconditions: Column) -> Column:
    """struct<reusable, failed>: the names of the preconditions that don't hold; null doesn't."""
    failed = reasons(**{n: ~F.coalesce(c, F.lit(False)) for n, c in preconditions.items()})
    return F.struct((F.size(failed) == 0).alias("reusable"), F.array_join(failed, "+").alias("failed"))


def structural_consistency(shapes: DataFrame, observation: str, run: str, shape: str) -> DataFrame:
    """observation, n_runs, n_shapes, consistent, digest: whether every parser run gave the same set of shapes.

    The set's digest is given once, where all runs agree.
    """
    one = shapes.select(observation, run, shape).distinct()
    per_run = one.groupBy(observation, run).agg(F.array_join(F.array_sort(F.collect_set(shape)), "\x1f").alias("shapes"), F.count(F.lit(1)).alias("n"))
    out = per_run.groupBy(observation).agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("n_shapes"), F.min("shapes").alias("lo"), F.max("shapes").alias("hi"))
    ok = F.col("lo") == F.col("hi")
    return out.select(observation, "n_runs", "n_shapes", ok.alias("consistent"), F.when(ok, F.sha2("lo", 256)).alias("digest"))


def correction_status(changed: Column, filed: Column) -> Column:
    """corrected when the change came after the filing, original otherwise, unknown without a date."""
    return F.when(changed.isNull() | filed.isNull(), "unknown").when(changed > filed, "corrected").otherwise("original")


def universe_eligible(operating: Column, levels_ok: Column, engineering_only: Column, supported: Column) -> Column:
    """All four conditions known and met."""
    return F.coalesce(operating & levels_ok & ~engineering_only & supported, F.lit(False))


def set_level(members: DataFrame, key: str, level: str, substantive: Column, anchor: Column) -> DataFrame:
    """key, n, level (weakest of the substantive members), anchored: whether just one of them is the anchor."""
    s = members.where(substantive)
    out = s.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(level_rank(F.col(level))).alias("r"), F.count_if(anchor).alias("anchors"))
    return out.select(key, "n", level_name(F.col("r")).alias("level"), (F.col("anchors") == 1).alias("anchored"))


def cohort_applicability(cohort: Column, level: Column) -> Column:
    """struct<applies, pre_study, level>: a support label applies to pre-study evidence alone."""
    inside = cohort.isNotNull() & ~cohort.isin("out_of_scope", "unresolved")
    return F.struct(inside.alias("applies"), (cohort == "support").alias("pre_study"), F.when(inside, level).otherwise("unavailable").alias("level"))


def processing_order(plan: DataFrame, open_: str, period: str, budget: int) -> DataFrame:
    """The plan with nth and admitted: closed periods from the oldest on, open ones last. One row a planned period."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col(open_), F.col(period))
    return plan.withColumn("nth", F.row_number().over(w)).withColumn("admitted", F.col("nth") <= budget)


def quota_membership(members: DataFrame, member: str, contributions: Mapping[str, Column]) -> DataFrame:
    """quota, unit, n_witnesses, first_member: which members made which unit; a unit counts once."""
    each = F.filter(F.array(*(F.struct(F.lit(q).alias("quota"), u.cast("string").alias("unit")) for q, u in contributions.items())), lambda s: s["unit"].isNotNull())
    rows = members.select(member, F.explode(each).alias("s")).select(member, "s.*")
    return rows.groupBy("quota", "unit").agg(F.count_distinct(member).alias("n_witnesses"), F.min(member).alias("first_member"))


def chained_digest(rows: DataFrame, group: str, order: str, text: Column) -> DataFrame:
    """group, n, digest: SHA-256 over a group's rows in order, each with the digest before it. For groups known to be small."""
    one = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("r"))
    return one.select(group, F.size("r").cast("long").alias("n"), F.aggregate("r", F.sha2(F.lit(""), 256), lambda h, r: F.sha2(F.concat_ws("|", h, r["t"]), 256)).alias("digest"))
