"""Many observations of a key and field to one canonical value, or to an explicit unresolved state.

All of it is partial aggregation on (key, field): observations are first reduced to one
row per value and authority class, so a key with a third of all observations costs one
row a task and value, and no window ever sorts a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def canonical(value: Column) -> Column:
    """Text under which values are compared: null is blank, ends are trimmed."""
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def version_key(version: Column | None) -> Column:
    """Newer digits first; an unversioned observation has the sentinel '~', which sorts before inverted digits."""
    if version is None:
        return F.lit("~")
    return F.coalesce(F.translate(version, "0123456789", "".join(chr(0x10FFFF - d) for d in range(10))), F.lit("~"))


def resolve_field(obs: DataFrame, keys: list[str], value: Column, level: Column, correction: Column, obs_id: Column, version: Column | None = None, alias_level: int = 4, material: Column | None = None) -> DataFrame:
    """keys, status, value, n_winners, n_competing, leader_id, codes.

    The strongest authority decides, a correction before an original of the same class;
    recency never does. Peers that disagree, and evidence of the alias class alone, stay
    unresolved.
    """
    rows = obs.select(*keys, canonical(value).alias("c"), value.cast("string").alias("raw"), level.cast("int").alias("level"), F.when(correction, 0).otherwise(1).alias("plain"), version_key(version).alias("v"), obs_id.alias("id"), (F.lit(True) if material is None else material).alias("material"))
    by_value = rows.groupBy(*keys, "level", "plain", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("v", "id", "raw")).alias("lead"), F.max("material").alias("material"))
    by_peer = by_value.groupBy(*keys, "level", "plain").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"), F.min("lead").alias("lead"), F.max("material").alias("material"))
    best = F.min(F.when(F.col("level") < alias_level, F.struct("level", "plain", "values", "n", "lead")))
    out = by_peer.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("n_competing"), F.max("material").alias("material"))
    conflict = F.when(F.col("material"), "MATERIAL_CONFLICT").otherwise("NON_MATERIAL_CONFLICT")
    disagree = F.col("b.values") > 1
    status = F.when(F.col("b").isNull() | disagree, "unresolved").when(F.col("b.plain") == 0, "resolved_by_correction").otherwise("resolved")
    good = F.col("b").isNotNull() & ~disagree
    codes = F.when(F.col("b").isNull(), F.array(conflict)).when(disagree, F.array(F.lit("EQUAL_AUTHORITY"), conflict)).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, status.alias("status"), F.when(good, F.col("b.lead.raw")).alias("value"), F.when(good, F.col("b.n")).otherwise(0).cast("long").alias("n_winners"), F.when(good, F.col("b.lead.id")).alias("leader_id"), "n_competing", F.array_join(codes, "+").alias("codes"))


def resolve_record(resolved: DataFrame, keys: list[str], field: str, material: list[str]) -> DataFrame:
    """keys, n_resolved, n_unresolved, blocking (material unresolved fields, sorted), complete: one row per key of field verdicts."""
    bad = F.col("status") == "unresolved"
    out = resolved.groupBy(*keys).agg(F.count_if(~bad).alias("n_resolved"), F.count_if(bad).alias("n_unresolved"), F.array_join(F.array_sort(F.collect_set(F.when(bad & F.col(field).isin(material), F.col(field)))), "+").alias("blocking"))
    return out.withColumn("complete", F.col("blocking") == "")


def contributors(obs: DataFrame, keys: list[str], precedence: Column, value: Column) -> DataFrame:
    """keys, precedence, value, n: the strongest precedence's value where its rows agree; nothing where they don't."""
    rows = obs.select(*keys, precedence.cast("int").alias("precedence"), canonical(value).alias("value"))
    by = rows.groupBy(*keys, "precedence").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    best = by.groupBy(*keys).agg(F.min(F.struct("precedence", "n", "lo", "hi")).alias("b"))
    return best.where("b.lo = b.hi").select(*keys, "b.precedence", F.col("b.lo").alias("value"), "b.n")


def conflict_mark(obs: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, n_values, n_rows, conflicting: whether any two observations of a key differ."""
    out = obs.groupBy(*keys).agg(F.count_distinct(canonical(value)).alias("n_values"), F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("conflicting", F.col("n_values") > 1)


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by `order`: a partial aggregate, no window."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in columns))


def membership(submissions: DataFrame, index: DataFrame, key: str, member: str, known: DataFrame) -> DataFrame:
    """key, n_union, n_submissions, n_index, uncorroborated, n_bindable, established, only: set corroboration of two sources."""
    both = submissions.select(key, member, F.lit(True).alias("s")).unionByName(index.select(key, member, F.lit(False).alias("s")))
    one = both.groupBy(key, member).agg(F.max("s").alias("in_s"), F.max(~F.col("s")).alias("in_i"))
    bound = one.join(known.select(member).distinct().withColumn("bindable", F.lit(True)), member, "left").withColumn("bindable", F.coalesce("bindable", F.lit(False)))
    out = bound.groupBy(key).agg(F.count(F.lit(1)).alias("n_union"), F.count_if("in_s").alias("n_submissions"), F.count_if("in_i").alias("n_index"), F.count_if(F.col("in_s") & ~F.col("in_i")).alias("uncorroborated"), F.count_if("bindable").alias("n_bindable"), F.max(F.when(F.col("bindable"), F.col(member))).alias("only"))
    fixed = (F.col("n_submissions") > 0) & (F.col("n_index") > 0) & (F.col("uncorroborated") == 0) & (F.col("n_bindable") == F.col("n_union"))
    return out.withColumn("established", fixed).withColumn("only", F.when(F.col("n_bindable") == 1, F.col("only")))


def name_change(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, branch from rows with role (winning, other, ticker) and good: the evidence level of a name change."""
    win = F.col("role") == "winning"
    out = rows.groupBy(*keys).agg(F.count_if(win).alias("w"), F.count_if(win & F.col("good")).alias("g"), F.count_if(F.col("role") == "ticker").alias("t"), F.count(F.lit(1)).alias("n"))
    branch = F.when(F.col("t") == F.col("n"), "unavailable").when(F.col("w") >= 2, "conflicting").when((F.col("w") == 1) & (F.col("g") == 1), "provisional").otherwise("review_required")
    return out.select(*keys, branch.alias("branch"))
