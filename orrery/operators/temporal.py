"""Dates: availability, divergence of two dates, cohort assignment, calendar and quarter spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.scalars import mapped, window_label


def availability(left_time: Column, left_day: Column, left_exact: Column, right_time: Column, right_day: Column, right_exact: Column, same: Column) -> Column:
    """Whether what the left side knows was there for the right side: eligible, ineligible or indeterminate.

    A side's own package always is; two exact instants compare exactly; otherwise days do,
    and one day with a side of day precision can't be told.
    """
    exact = left_exact & right_exact & left_time.isNotNull() & right_time.isNotNull()
    by_time = F.when(left_time <= right_time, "eligible").otherwise("ineligible")
    by_day = F.when(left_day.isNull() | right_day.isNull(), "indeterminate").when(left_day < right_day, "eligible").when(left_day > right_day, "ineligible").otherwise("indeterminate")
    return F.when(same, "eligible").when(exact, by_time).otherwise(by_day)


def divergence(filed: Column, accepted: Column, corrected: Column, operating: Column, supported: Column, next_operating: Column) -> Column:
    """The first rule that explains why two dates of a filing differ. `operating` is null outside the calendar."""
    return (
        F.when(accepted.isNull(), "missing_acceptance")
        .when(filed == accepted, "same_day")
        .when(filed < accepted, "before_acceptance")
        .when(F.coalesce(corrected, F.lit(False)), "correction")
        .when(operating.isNull(), "no_calendar")
        .when(~operating, "non_operating_acceptance")
        .when(~supported, "unsupported_form")
        .when(filed == next_operating, "rollover")
        .otherwise("unexplained")
    )


def divergence_blocks(rule: Column) -> Column:
    """Missing and before-acceptance need a look; only these rules keep a release from going out."""
    return rule.isin("before_acceptance", "no_calendar", "non_operating_acceptance", "unsupported_form", "unexplained")


def assign_cohorts(rows: DataFrame, filed: Column, accepted: Column, windows: Sequence[tuple[str, str, str]], support: tuple[str, str, str] | None = None) -> DataFrame:
    """Adds cohort_filed, cohort_accepted, crossing (both mapped and different), coverage (just one mapped)."""
    a = F.when(accepted.isNotNull(), window_label(accepted, windows, support))
    out = rows.withColumn("cohort_filed", window_label(filed, windows, support)).withColumn("cohort_accepted", a)
    f, c = F.col("cohort_filed"), F.col("cohort_accepted")
    both = mapped(f) & mapped(c)
    return out.withColumn("crossing", both & (f != c)).withColumn("coverage", accepted.isNotNull() & (mapped(f) != mapped(c)))


def calendar_spine(days: DataFrame, first: str, last: str, non_operating: DataFrame | None = None) -> DataFrame:
    """day, status, next_operating over a gap-free spine.

    Weekends, and days of `non_operating` (day), don't operate; the next operating day is
    looked for at most 30 days ahead. The spine has one row a day, whatever the input.
    """
    spine = days.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    off = F.dayofweek("day").isin(1, 7)
    if non_operating is not None:
        spine = spine.join(non_operating.select("day", F.lit(True).alias("closed")).distinct(), "day", "left")
        off = off | F.coalesce("closed", F.lit(False))
    spine = spine.withColumn("operates", ~off)
    ahead = Window.orderBy("day").rowsBetween(1, 30)
    spine = spine.withColumn("next_operating", F.first(F.when(F.col("operates"), F.col("day")), ignorenulls=True).over(ahead))
    return spine.select("day", F.when(F.col("operates"), "operating").otherwise("non_operating").alias("status"), "next_operating")


def calendar_verdict(announced_open: Column, announced_closed: Column, weekend: Column, holiday: Column, snapshot: Column, activity: Column) -> Column:
    """operating, non_operating or unknown from four kinds of evidence: announcements win, disagreement is unknown."""
    announced = F.when(announced_open & announced_closed, "unknown").when(announced_open, "operating").when(announced_closed, "non_operating")
    rule = F.when(weekend, "non_operating").when(snapshot & holiday, "non_operating").when(snapshot, "operating")
    rest = F.when(activity & (rule == "non_operating"), "unknown").when(activity, "operating").otherwise(F.coalesce(rule, F.lit("unknown")))
    return F.coalesce(announced, rest)


def quarter_plan(facts: DataFrame, day: str, start: str, end: str, as_of: str) -> DataFrame:
    """quarter_start, quarter_end, state, n_rows, covered: every quarter that the window touches, whole.

    A quarter that ends on the as-of date is closed.
    """
    spine = facts.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "quarter"), F.lit(end).cast("date"), F.expr("interval 3 months"))).alias("quarter_start"))
    plan = spine.withColumn("quarter_end", F.date_sub(F.add_months("quarter_start", 3), 1))
    plan = plan.withColumn("state", F.when(F.col("quarter_end") <= F.lit(as_of).cast("date"), "closed").otherwise("open"))
    have = facts.groupBy(F.trunc(day, "quarter").alias("quarter_start")).agg(F.count(F.lit(1)).alias("n_rows"))
    out = plan.join(have, "quarter_start", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
    return out.withColumn("covered", F.col("n_rows") > 0)


def change_points(rows: DataFrame, key: str, day: str, order: str, distance: Column, limit: int) -> DataFrame:
    """key, n_rows, n_changes, n_unresolved of adjacent rows of a key in order: a change is more than `limit`, an undated side unresolved.

    `distance` is an expression over `day` and `previous`.
    """
    w = Window.partitionBy(key).orderBy(order)
    pairs = rows.select(key, order, day).withColumn("previous", F.lag(day).over(w)).withColumn("nth", F.row_number().over(w))
    later = F.col("nth") > 1
    blank = F.col(day).isNull() | F.col("previous").isNull()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(later & ~blank & (distance > limit)).alias("n_changes"), F.count_if(later & blank).alias("n_unresolved"))


def supersession(rows: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """Adds previous (digest) and verdict (first, unchanged, superseded) to each observation of a key in order."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumn("previous", F.lag(digest).over(w))
    return out.withColumn("verdict", F.when(F.col("previous").isNull(), "first").when(F.col("previous") == F.col(digest), "unchanged").otherwise("superseded"))


def boundary(filed: Column, accepted_day: Column, accepted_time: Column) -> Column:
    """struct<precision, basis>: an exact instant only for acceptance on the day of filing; none is made up otherwise."""
    none, same = accepted_day.isNull() | accepted_time.isNull(), accepted_day == filed
    precision = F.when(none | ~same, "date").otherwise("timestamp")
    return F.struct(precision.alias("precision"), F.when(none, "filing_date_only").when(same, "same_day_acceptance").otherwise("later_official_filing_date").alias("basis"))


def divergence_audit(rows: DataFrame, form: Column, amendment: Column, filed: Column, accepted: Column, rule: Column, crossing: Column, coverage: Column, in_test: Column, approved: Column) -> tuple[DataFrame, DataFrame]:
    """(counts, gates) over filings with two dates: dimension, value, n; and gate, verdict.

    Dimensions: total (accessions, diverging, crossings, coverage, unexplained, unapproved_test) and reason
    over all filings; form, kind, accepted_year and filed_year over those whose dates differ. Rows are counted by
    all of their values first, so the rest works on combinations. A gate fails by one row that breaks it.
    """
    off = lambda c: F.coalesce(c, F.lit(False))
    diverging = off(accepted != filed)
    parts = {"form": form, "kind": F.when(off(amendment), "amendment").otherwise("original"), "accepted_year": F.year(accepted).cast("string"), "filed_year": F.year(filed).cast("string")}
    unexplained = off(rule == "unexplained") | off(coverage)
    flags = {"diverging": diverging, "crossings": off(crossing), "coverage": off(coverage), "unexplained": unexplained, "unapproved_test": off(in_test) & ~off(approved)}
    combos = rows.groupBy(rule.alias("reason"), *(c.alias(k) for k, c in parts.items()), *(c.alias(f"is_{k}") for k, c in flags.items())).agg(F.count(F.lit(1)).alias("c"))
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
    named = [pair("total", F.lit("accessions")), pair("reason", F.col("reason")), *(F.when(F.col(f"is_{k}"), pair("total", F.lit(k))) for k in flags), *(F.when(F.col("is_diverging") & F.col(k).isNotNull(), pair(k, F.col(k))) for k in parts)]
    counts = combos.select("c", F.explode(F.array_compact(F.array(*named))).alias("p")).groupBy("p.dimension", "p.value").agg(F.sum("c").alias("n"))
    broken = {"divergence_explained": "unexplained", "boundary_review": "crossings", "coverage_divergence": "coverage", "test_membership_approved": "unapproved_test"}
    one = combos.agg(*(F.coalesce(F.max(F.col(f"is_{k}") | (F.col("is_coverage") if k == "crossings" else F.lit(False))), F.lit(False)).alias(k) for k in flags))
    gates = one.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.when(F.col(k), "fail").otherwise("pass").alias("verdict")) for g, k in broken.items()))).alias("g")).select("g.*")
    return counts, gates
