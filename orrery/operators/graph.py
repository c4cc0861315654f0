"""Edges, chains and declared parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.runtime import discard, materialize


def roots(nodes: DataFrame, key: str, parent: str, most: int = 64) -> DataFrame:
    """key, root, depth, outcome (root, resolved, missing_parent, cycle) of every node by pointer doubling.

    Each round joins every pointer with the pointer's own, so a chain of n takes log2(n) joins;
    a pointer that has not ended after `most` doublings, or that returns, is in a cycle.
    """
    one = nodes.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    ids = one.select(F.col("k").alias("p_k"))
    at = one.join(ids, F.col("p") == F.col("p_k"), "left")
    # `to`: the furthest known ancestor; done: it is a root, or its parent is missing
    state = at.select("k", F.when(F.col("p").isNull() | F.col("p_k").isNull(), F.col("k")).otherwise(F.col("p")).alias("to"), (F.col("p").isNull() | F.col("p_k").isNull()).alias("done"), F.when(F.col("p").isNull() | F.col("p_k").isNull(), 0).otherwise(1).cast("long").alias("depth"), (F.col("p").isNotNull() & F.col("p_k").isNull()).alias("missing"))
    state = materialize(state, "roots")
    before = None
    for _ in range(most):
        begun = state
        far = state.select(F.col("k").alias("f_k"), F.col("to").alias("f_to"), F.col("done").alias("f_done"), F.col("depth").alias("f_depth"), F.col("missing").alias("f_missing"))
        # an ancestor that is done is the end; `done` is taken over from it
        state = state.join(far, F.col("to") == F.col("f_k")).select("k", F.when(F.col("done"), F.col("to")).otherwise(F.col("f_to")).alias("to"), (F.col("done") | F.col("f_done")).alias("done"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("f_depth")).alias("depth"), F.when(F.col("done"), F.col("missing")).otherwise(F.col("f_missing")).alias("missing"))
        state = materialize(state, "roots")
        discard(begun)
        left = state.where(~F.col("done")).count()
        if left == 0 or left == before:
            break
        before = left
    outcome = F.when(~F.col("done"), "cycle").when(F.col("missing"), "missing_parent").when(F.col("depth") == 0, "root").otherwise("resolved")
    return state.select(F.col("k").alias(key), F.when(F.col("done"), F.col("to")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"), outcome.alias("outcome"))


def lineage(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """child, ancestor, depth: every ancestor once, at its least depth; a node on a cycle is its own ancestor.

    Each round joins the ancestors at the furthest depth with their own, so a chain of n takes
    log2(n) joins; it ends when no new ancestor appears.
    """
    one = edges.select(F.col(child).alias("c"), F.col(parent).alias("a")).where("a IS NOT NULL").distinct()
    known, reach = materialize(one.withColumn("depth", F.lit(1)), "lineage"), 1
    while True:
        far = known.where(F.col("depth") == reach).select("c", F.col("a").alias("via"))
        more = known.select(F.col("c").alias("via"), "a", F.col("depth").alias("further"))
        step = far.join(more, "via").groupBy("c", "a").agg((F.min("further") + reach).alias("depth"))
        new = materialize(step.join(known.select("c", "a"), ["c", "a"], "left_anti"), "lineage")
        if new.isEmpty():
            return known.select(F.col("c").alias(child), F.col("a").alias("ancestor"), "depth")
        known, reach = known.union(new), 2 * reach


def shared_alias(rows: DataFrame, entity: str, alias: str, most: int | None = None) -> DataFrame:
    """left, right, n_shared: unordered pairs of entities that share an alias value.

    Values held by one entity drop out before the join; `most` leaves out values that more
    entities hold, and is a rule of the caller's, not a default.
    """
    one = rows.select(entity, alias).where(F.col(alias).isNotNull()).distinct()
    held = one.groupBy(alias).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if most:
        held = held.where(F.col("n") <= most)
    kept = one.join(held.select(alias), alias)
    a, b = kept.select(F.col(entity).alias("left"), alias), kept.select(F.col(entity).alias("right"), F.col(alias).alias("alias_b"))
    pairs = a.join(b, (F.col(alias) == F.col("alias_b")) & (F.col("left") < F.col("right")))
    return pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n_shared"))


def declared_parent(children: DataFrame, declarations: DataFrame, child_name: str, child_id: str, declared_name: str, parent: str, declared_id: str) -> DataFrame:
    """Adds parent and binding: a child is bound only where exactly one parent declares its exact name and the ids agree."""
    by = declarations.groupBy(F.col(declared_name).alias("d_name")).agg(F.count_distinct(parent).alias("n"), F.min(parent).alias("d_parent"), F.min(declared_id).alias("d_lo"), F.max(declared_id).alias("d_hi"))
    met = children.join(by, F.col(child_name) == F.col("d_name"), "left")
    binding = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when((F.col("d_lo") != F.col("d_hi")) | (F.col("d_lo") != F.col(child_id)), "contradictory").otherwise("bound")
    return met.withColumn("binding", binding).withColumn("parent", F.when(F.col("binding") == "bound", F.col("d_parent"))).drop("d_name", "n", "d_parent", "d_lo", "d_hi")


def attach(bridge: DataFrame, key: str, category: str) -> DataFrame:
    """key, category, n_categories: through any member; null where the members span categories."""
    out = bridge.groupBy(key).agg(F.count_distinct(category).alias("n_categories"), F.min(category).alias("one"))
    return out.select(key, F.when(F.col("n_categories") == 1, F.col("one")).alias("category"), "n_categories")
