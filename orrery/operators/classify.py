"""Rules that classify filings and entities: ordered, fail-closed, with every reason kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.scalars import LEVELS, only_one, reasons


def code_family(rows: DataFrame, code: str, ranges: DataFrame, most: int = 500) -> DataFrame:
    """Adds family of an integer code from inclusive ranges (lo, hi, family); `unmapped` outside.

    The ranges are disjoint. They are taken to the driver after a count of at most `most` and become
    one expression, so there is no join; a longer table is an error.
    """
    n = ranges.count()
    if n > most:
        raise ValueError(f"{n} ranges, more than {most}")
    found = F.lit(None).cast("string")
    for r in ranges.select("lo", "hi", "family").collect():
        found = F.when(F.col(code).between(r["lo"], r["hi"]), r["family"]).otherwise(found)
    return rows.withColumn("family", found).withColumn("family", F.coalesce("family", F.lit("unmapped")))


def size_stratum(rows: DataFrame, keys: list[str], label: str, strata: Mapping[str, str]) -> DataFrame:
    """keys, stratum, level: labels are compared after mapping; a mapped and an unmapped one conflict; none is unavailable."""
    known = F.element_at(F.create_map(*(F.lit(x) for kv in strata.items() for x in kv)), F.col(label))
    some = F.col(label).isNotNull()
    by = rows.groupBy(*keys).agg(F.count_distinct(known).alias("strata"), F.min(known).alias("stratum"), F.count_if(some & known.isNull()).alias("unmapped"), F.count_if(some).alias("labels"))
    level = F.when(F.col("labels") == 0, "unavailable").when((F.col("strata") > 1) | ((F.col("strata") == 1) & (F.col("unmapped") > 0)), "conflicting").when(F.col("strata") == 0, "review_required").otherwise("provisional")
    return by.select(*keys, F.when(level == "provisional", F.col("stratum")).alias("stratum"), level.alias("level"))


def control_verdict(**tests: Column) -> Column:
    """The one control kind that holds, `conflicting` for several, `none`."""
    found = reasons(**tests)
    return F.when(F.size(found) > 1, "conflicting").when(F.size(found) == 1, found[0]).otherwise("none")


def history_class(flags: Column, unresolved: Column, originals: Column, enough: int = 4) -> Column:
    """eventful with one positive flag; stable without flags, unresolved comparisons and with enough originals; else indeterminate."""
    return F.when(flags > 0, "eventful").when((unresolved == 0) & (originals >= enough), "stable").otherwise("indeterminate")


def eligibility(supported: Column, excluded_type: Column, shell: Column, amendment: Column, support_year: Column, transition: Column, review: Mapping[str, Column], harmless: str = "REVIEW_MULTI_REGISTRANT") -> Column:
    """struct<role, state, primary, reasons> of a filing. `shell` may be null, which forces a review."""
    found = reasons(**review, REVIEW_SHELL_UNKNOWN=shell.isNull())
    blocking = F.filter(found, lambda c: c != harmless)
    out = F.when(~supported, F.lit("control_evidence")).when(amendment, "non_target").when(support_year, "support_only").otherwise("primary")
    state = F.when(~supported | excluded_type | F.coalesce(shell, F.lit(False)), "excluded").when(F.size(blocking) > 0, "review_required").otherwise("eligible")
    why = (
        F.when(~supported, F.array(F.lit("UNSUPPORTED_FORM")))
        .when(excluded_type, F.array(F.lit("EXCLUDED_ISSUER_TYPE")))
        .when(F.coalesce(shell, F.lit(False)), F.array(F.lit("SHELL_COMPANY")))
        .otherwise(F.concat(found, F.when(transition & ~amendment & ~support_year, F.array(F.lit("TRANSITION_FORM"))).otherwise(F.array().cast("array<string>"))))
    )
    return F.struct(out.alias("role"), state.alias("state"), ((out == "primary") & (state == "eligible")).alias("primary"), F.array_join(why, "+").alias("reasons"))


def evidence_penalty(levels: Sequence[tuple[Column, Column]]) -> Column:
    """How many applicable dimensions (applies, level) are weaker than provisional."""
    return sum((F.when(applies & (F.coalesce(level, F.lit("unavailable")) != LEVELS[0]), 1).otherwise(0) for applies, level in levels), F.lit(0))


def filing_role(control: Column, original: Column, pre_study: Column, amendment: Column, transition: Column, base: Column, stress: Column, support: Column, control_ok: Column) -> Column:
    """base, stress, support or control; null when no rule or more than one matches."""
    operating = only_one(support=pre_study & support, base=original & base & ~pre_study, stress=(amendment | transition) & stress)
    return F.when(control, F.when(original & control_ok, "control")).otherwise(operating)


def amendment_link(amendments: DataFrame, originals: DataFrame, key: str = "id", reference: str = "reference", entity: str = "entity", period: str = "period", day: str = "day") -> DataFrame:
    """key, parent, relation of each amendment.

    An explicit reference among the entity's candidates wins, but is refused when the parent is
    later; otherwise exactly one original of the period is a possible parent, several are
    unresolved.
    """
    o = originals.select(F.col(key).alias("o_key"), F.col(entity).alias("o_entity"), F.col(period).alias("o_period"), F.col(day).alias("o_day"))
    named = amendments.join(o, (F.col(entity) == F.col("o_entity")) & (F.col(reference) == F.col("o_key")), "left").select(amendments["*"], F.col("o_key").alias("named"), F.col("o_day").alias("named_day"))
    by_period = o.groupBy("o_entity", "o_period").agg(F.count(F.lit(1)).alias("n"), F.min("o_key").alias("one"))
    met = named.join(by_period, (F.col(entity) == F.col("o_entity")) & (F.col(period) == F.col("o_period")), "left")
    late = F.col("named_day") > F.col(day)
    n = F.coalesce("n", F.lit(0))
    relation = F.when(F.col("named").isNotNull() & late, "refused").when(F.col("named").isNotNull(), "amendment_of").when(n == 1, "possible_amendment_of").when(n > 1, "unresolved").otherwise("no_parent")
    return met.select(key, F.when(relation == "amendment_of", F.col("named")).when(relation == "possible_amendment_of", F.col("one")).alias("parent"), relation.alias("relation"))
