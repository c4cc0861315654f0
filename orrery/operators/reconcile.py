"""Comparisons of two tables: states by key, differences, reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compare(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether any two present values differ after trimming; a missing one isn't compared."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    out = F.lit(False)
    for a, b in pairs:
        out = out | F.coalesce(blank(a) != blank(b), F.lit(False))
    return out


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: dict[str, str], usable: Column | None = None, names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """key, state, from one row a key on each side: matching, conflicting, one-sided, or indeterminate.

    `fields` maps left columns to right ones; `usable` is a condition on the right side's columns.
    """
    a = left.select(F.col(key).alias("a_key"), *(F.col(c).alias(f"a_{i}") for i, c in enumerate(fields)))
    use = F.lit(True) if usable is None else usable
    b = right.select(F.col(key).alias("b_key"), *(F.col(c).alias(f"b_{i}") for i, c in enumerate(fields.values())), use.alias("b_ok"))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full")
    differ = compare([(F.col(f"a_{i}"), F.col(f"b_{i}")) for i in range(len(fields))])
    state = F.when(F.col("b_key").isNotNull() & ~F.col("b_ok"), "indeterminate").when(F.col("a_key").isNull(), names[1]).when(F.col("b_key").isNull(), names[0]).when(differ, "conflicting").otherwise("matching")
    return both.select(F.coalesce("a_key", "b_key").alias(key), state.alias("state"))


def representatives(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key, columns of its first row in order, n_extra: further rows each yield an outcome of their own elsewhere."""
    return rows.groupBy(key).agg(F.min(F.struct(*order, *(c for c in columns if c not in order))).alias("m"), (F.count(F.lit(1)) - 1).alias("n_extra")).select(key, *(F.col(f"m.{c}").alias(c) for c in columns), "n_extra")


def cells(columns: list[str]) -> Column:
    """The columns as one text in which no two different rows are equal: a null has a mark of its own, and the separator is escaped."""
    plain = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), plain(c)), F.lit("null")) for c in columns))


def release_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change (added, removed, changed) between two releases; unchanged keys are left out."""
    digest = F.sha2(cells(columns), 256)
    a, b = old.select(F.col(key).alias("a"), digest.alias("a_digest")), new.select(F.col(key).alias("b"), digest.alias("b_digest"))
    out = a.join(b, F.col("a") == F.col("b"), "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a_digest") != F.col("b_digest"), "changed")
    return out.select(F.coalesce("a", "b").alias(key), change.alias("change")).where("change IS NOT NULL")


def reconstruction(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """All rows that only one of two tables has, by multiplicity: side (extra: stored only, missing: derived only) and the row."""
    extra = stored.exceptAll(derived).select(F.lit("extra").alias("side"), "*")
    return extra.union(derived.exceptAll(stored).select(F.lit("missing").alias("side"), "*"))


def plan_status(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The plan with n_done and status (satisfied, missing); the plan's rows all stay."""
    n = done.groupBy(key).agg(F.count(F.lit(1)).alias("n_done"))
    out = plan.join(n, key, "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("n_done") > 0, "satisfied").otherwise("missing"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_first: list[str], largest: list[str], add: list[str]) -> DataFrame:
    """One row a key of old and new: the old value where it isn't null, the largest, or the sum."""
    both = old.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("o"))).alias(c) for c in keep_first]
    return both.groupBy(key).agg(*first, *(F.max(c).alias(c) for c in largest), *(F.sum(c).alias(c) for c in add))


def insert_new(old: DataFrame, new: DataFrame, id_columns: list[str]) -> DataFrame:
    """The new rows, with their deterministic id (of `cells`), that the old table doesn't have yet."""
    made = new.withColumn("row_id", F.sha2(cells(id_columns), 256))
    return made.dropDuplicates(["row_id"]).join(old.select("row_id"), "row_id", "left_anti")


def reconcile_index(index: DataFrame, derived: DataFrame, key: str, line: str, fields: dict[str, str], problem: Column, usable: Column, plan: DataFrame, instance: str, satisfied: Column) -> DataFrame:
    """part, instance, key, state: one row an outcome of comparing an index with derived records; nothing is merged or dropped.

    instance: a planned index that wasn't read, `unavailable`. malformed: an index row without a key or
    with a problem, `indeterminate`. duplicate: each further row of a key, `matching` or `conflicting` by its
    first row (by line, then fields). joined: the first rows against the derived records, as in `reconcile`.
    Rows equal in all of these columns are counted before they meet, so a hot key costs its distinct rows.
    """
    none = F.lit(None).cast("string")
    missing = plan.where(~F.coalesce(satisfied, F.lit(False))).select(F.lit("instance").alias("part"), F.col(instance).cast("string").alias("instance"), none.alias(key), F.lit("unavailable").alias("state"))
    marked = index.withColumn("orrery_bad", F.coalesce(problem, F.lit(False)) | F.col(key).isNull() | (F.col(key).cast("string") == ""))
    malformed = marked.where("orrery_bad").select(F.lit("malformed").alias("part"), none.alias("instance"), F.col(key).cast("string").alias(key), F.lit("indeterminate").alias("state"))
    entry = F.struct(line, *fields)
    counts = marked.where("NOT orrery_bad").groupBy(F.col(key), entry.alias("row")).agg(F.count(F.lit(1)).alias("c"))
    first = counts.groupBy(key).agg(F.min("row").alias("one"), F.sum("c").alias("n"))
    many = first.where("n > 1").select(F.col(key).alias("orrery_key"), "one")
    again = counts.join(many, F.col(key) == F.col("orrery_key")).withColumn("c", F.col("c") - (F.col("row") == F.col("one")).cast("int")).where("c > 0")
    differ = compare([(F.col(f"row.{f}"), F.col(f"one.{f}")) for f in fields])
    again = again.select(F.col(key).cast("string").alias(key), F.when(differ, "conflicting").otherwise("matching").alias("state"), F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    again = again.select(F.lit("duplicate").alias("part"), none.alias("instance"), key, "state")
    joined = reconcile(first.select(key, *(F.col(f"one.{f}").alias(f) for f in fields)), derived, key, fields, usable, ("index_only", "derived_only"))
    joined = joined.select(F.lit("joined").alias("part"), none.alias("instance"), F.col(key).cast("string").alias(key), "state")
    return missing.unionByName(malformed).unionByName(again).unionByName(joined)
