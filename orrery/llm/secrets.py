"""Operator 1: secret scan with corpus-wide ownership frequency (SQL functions only).

Candidates are found in each whole text: assigned values, access keys, hexadecimal runs,
and opaque tokens (20 or more token characters with a digit, a letter and ten different
characters). Their hashes are counted over the corpus by distinct repositories and owners.
A hash of more than `max_owners` owners is a widely copied example; the others are
owner-specific and look live. Opaque tokens become spans only when they do; spans of the
other kinds stay and are counted on either side.

Hashes are reduced to distinct (hash, repository, owner) with partial aggregates before
they are counted, so an example that a third of all rows copy costs one row a task, and
the join back is one whose hot partitions the engine splits.

Defined results: a null text is empty and has no span; a null repository or owner counts
as one of its own; repeated rows are scanned each; texts are read whole; an empty table
gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.spans import apart, count_of, let, listed, matches
from orrery.runtime import materialize, table

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?=[pPsStTaA])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"


def candidates(text: Column) -> Column:
    """array<struct<start, kind, stop, hash>> of every candidate."""

    def named(kind: int, found: Column, value) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop"), F.sha2(value(m["text"]), 256).alias("hash")))

    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(value(m["text"])) >= 12)
    looks = lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(m, ""))) >= 10)
    opaque = F.filter(matches(text, OPAQUE), lambda m: looks(m["text"]))
    same = lambda m: m
    return F.concat(named(0, assign, value), named(1, matches(text, ACCESS), same), named(2, matches(text, HEX), same), named(3, opaque, same))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) of candidate rows (hash, repository, owner)."""
    one = found.groupBy("hash", "repository", "owner").agg(F.lit(1).alias("one"))
    by_owner = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = 1) -> DataFrame:
    """id_col and spans array<struct<start, kind, stop, hash, n_repositories, n_owners, live>> of every row.

    kind is a place in KINDS.
    """
    rows = docs.select(F.col(id_col).alias("id"), repository.alias("repository"), owner.alias("owner"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.select("row", "repository", "owner", F.explode("spans").alias("s")).select("row", "repository", "owner", "s.*")
    judged = each.join(ownership(each), "hash").withColumn("live", F.col("n_owners") <= max_owners)
    judged = judged.where((F.col("kind") < 3) | F.col("live"))
    # an opaque token that is, or holds, a candidate of another kind is that candidate
    spans = judged.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop", "hash", "n_repositories", "n_owners", "live")).alias("found"))
    base, other = F.filter("found", lambda s: s["kind"] < 3), F.filter("found", lambda s: s["kind"] == 3)
    fresh = let(base, lambda b: let(other, lambda o: F.concat(b, F.transform(apart(o, b), lambda x: F.get(o, x["at"])))))
    out = rows.select("row", "id").join(spans.select("row", fresh.alias("spans")), "row", "left")
    none = F.array().cast(spans.schema["found"].dataType)
    return out.select(F.col("id").alias(id_col), F.array_sort(F.coalesce("spans", none)).alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources; a repository is a source's documents of one language."""
    found = scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = [count_of(F.col("spans"), "kind", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    live = [count_of(F.col("spans"), "live", v).alias(name) for name, v in (("n_live", True), ("n_copied", False))]
    return found.select("doc_id", *n, F.sha2(listed(base, KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"), *live)


QUERIES = {"op1_secrets": op1_secrets}
ORACLE: dict[str, str] = {}
