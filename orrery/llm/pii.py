"""Operator 8: personal data by bootstrapped contextual extraction (SQL functions only).

Seeds are the addresses, cards and telephone numbers that fixed expressions find. Instances
are the seeds and all identifier-like tokens that no seed overlaps: runs of letters, digits
and `@._%+()/-`, and further groups of digits after single spaces, with `least_digits`
digits or more in all, of any length and form. An instance's patterns are lexical alone: the
word before it, the word after it, and both together (lower-cased letters; nothing but marks
and white space in between). The graph of patterns and instances is scored in rounds:

* a pattern by the lower Wilson bound (z = Z) of the share that its good instances have
  among its distinct ones: a seed counts 1, an accepted instance its score;
* an instance by the chance that one of its trusted patterns (`trust` or more) is right; at
  `accept` it is accepted for good, supports its other patterns from the next round on, and
  every occurrence of its text becomes a span of the kind `context`.

Rounds end when none is accepted: scores of patterns only rise, so an end is reached.
Patterns and instances meet as distinct pairs, counted before they are dealt; the joins
are ones whose hot partitions the engine splits. Spans are found in n log n of a text's
matches.

Defined results: a null text is empty and has no span (redacted, it stays null); repeated
rows are scanned each; texts are read whole; an empty table gives an empty table; scores are
rounded to six places before they are compared; columns of any other name are kept by
`redact` and not read by `extract`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.llm.spans import apart, count_of, digits, in_order, let, listed, matches, part, pieces, reached, replaced
from orrery.runtime import materialize, table

KINDS = ("email", "ip", "card", "phone", "context")
# \G: a match may begin where the one before ended, else only where a run begins
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9][0-9\x20-]{13})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: identifier-like tokens, and a condition that every text with one of so many digits meets
TOKEN = r"(?<![A-Za-z0-9@._%+()/-])(?=[A-Za-z@._%+()/-]*+[0-9])[A-Za-z0-9@._%+()/-]*[A-Za-z0-9)](?:\x20[(+]?[0-9](?:[0-9()./+-]*[0-9)])?(?![A-Za-z0-9@_%]))*+"
ENOUGH = r"(?:[0-9][A-Za-z@._%+()/\x20-]*+)"
#: quantile of the normal distribution that bounds a pattern's share of good instances
Z = 1.96


def luhn(text: Column) -> Column:
    """Whether the digits of `text` pass the checksum of card numbers."""
    each = F.transform(F.split(F.reverse(digits(text)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop, text>> of the fixed expressions' matches that hold."""
    n = lambda m: F.length(digits(m["text"]))
    small = lambda m: F.forall(F.split(m["text"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(m["text"], r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
    found = (
        matches(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(matches(text, IP), small),
        F.filter(matches(text, CARD), lambda m: n(m).between(14, 19) & luhn(m["text"])),
        F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda m: n(m).between(10, 15)),
    )

    def named(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop"), m["text"].alias("text")))

    return F.concat(*(named(k, f) for k, f in enumerate(found)))


def instances(text: Column, base: Column, least_digits: int) -> Column:
    """array<struct<start, stop, value, seed, patterns>> of the seeds and of all other identifier-like tokens, by start."""
    found = F.filter(matches(text, TOKEN, F.rlike(text, F.lit(f"{ENOUGH}{{{least_digits}}}"))), lambda m: F.length(digits(m["text"])) >= least_digits)
    span = lambda s, seed: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(seed).alias("seed"))
    every = F.array_sort(F.concat(F.transform(base, lambda b: span(b, True)), F.transform(apart(found, base), lambda t: span(t, False))))

    def described(all_: Column, cut: Column) -> Column:
        def one(m: Column, before: Column, after: Column) -> Column:
            left = F.lower(F.regexp_extract(part(cut, before, m["start"]), r"(?<!\p{L})(\p{L}++)[^\p{L}\p{N}]*+$", 1))
            right = F.lower(F.regexp_extract(part(cut, m["stop"], after), r"^[^\p{L}\p{N}]*+(\p{L}++)", 1))
            patterns = F.array(F.when(left != "", F.concat(F.lit("< "), left)), F.when(right != "", F.concat(F.lit("> "), right)), F.when((left != "") & (right != ""), F.concat(left, F.lit(" <> "), right)))
            return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.sha2(part(cut, m["start"], m["stop"]), 256).alias("value"), m["seed"].alias("seed"), F.array_compact(patterns).alias("patterns"))

        ends = F.concat(F.transform(F.slice(all_, F.lit(2), F.size(all_)), lambda s: s["start"]), F.array(F.length(text).cast("long")))
        around = F.zip_with(reached(all_), ends, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        return F.zip_with(all_, around, lambda m, x: one(m, x["before"], x["after"]))

    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string,seed:boolean,patterns:array<string>>>")
    return let(every, lambda all_: F.when(F.size(all_) > 0, let(pieces(text), lambda cut: described(all_, cut))).otherwise(none))


def wilson(good: Column, n: Column) -> Column:
    """The lower bound of a share: good of n."""
    share = good / n
    return (share + Z * Z / (2 * n) - Z * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def bootstrap(edges: DataFrame, trust: float = 0.8, accept: float = 0.8) -> DataFrame:
    """(value, score) of the instances that patterns vouch for, from distinct edges (pattern, value, seed)."""
    stats = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").cast("double").alias("good"))
    # a pattern of fewer instances is never trusted, were they all good
    stats = materialize(stats.where(F.col("n") >= int(trust * Z * Z / (1 - trust))), "patterns")
    open_ = materialize(edges.where(~F.col("seed")).join(stats.select("pattern"), "pattern").select("pattern", "value"), "open")
    accepted, good = None, stats.select("pattern", "n", "good")
    while True:
        trusted = good.withColumn("p", F.round(wilson(F.col("good"), F.col("n")), 6)).where(F.col("p") >= trust).select("pattern", "p")
        score = open_.join(trusted, "pattern").groupBy("value").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("p")))), 6).alias("score")).where(F.col("score") >= accept)
        fresh = materialize(score if accepted is None else score.join(accepted.select("value"), "value", "left_anti"), "accepted")
        accepted = fresh if accepted is None else accepted.union(fresh)
        if fresh.isEmpty():
            return accepted
        more = open_.join(fresh, "value").groupBy("pattern").agg(F.sum("score").alias("more"))
        good = materialize(good.join(more, "pattern", "left").select("pattern", "n", (F.col("good") + F.coalesce("more", F.lit(0.0))).alias("good")), "good")


def scanned(docs: DataFrame, kept: list[Column], text_col: str, least_digits: int, trust: float, accept: float) -> tuple[DataFrame, DataFrame]:
    """(rows, more): a written table of the kept columns with base spans and row, and rows' discovered spans (row, more)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("kept"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = instances(F.col("text"), F.col("base"), least_digits)
    rows = materialize(rows.select("kept", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop"))).alias("base"), found.alias("found"), F.monotonically_increasing_id().alias("row")), "instances")
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    good = bootstrap(edges, trust, accept)
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "stop")
    more = each.where(~F.col("seed")).join(good.select("value"), "value").groupBy("row").agg(F.collect_list(span).alias("more"))
    return rows.select("row", "kept", "base"), more


SPANS = "array<struct<start:bigint,kind:int,stop:bigint>>"


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_digits: int = 6, trust: float = 0.8, accept: float = 0.8) -> DataFrame:
    """id_col, spans array<struct<start, kind, stop>> of every row; kind is a place in KINDS."""
    rows, more = scanned(docs, [F.col(id_col).alias("id")], text_col, least_digits, trust, accept)
    out = rows.join(more, "row", "left")
    return out.select(F.col("kept.id").alias(id_col), in_order(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", least_digits: int = 6, trust: float = 0.8, accept: float = 0.8) -> DataFrame:
    """The rows of `docs` with '[KIND]' in place of each span, and size_col as the new length.

    The rows are written once with their base spans; discovered ones are joined by row. The
    engine sees the size of their table and chooses the join.
    """
    rows, more = scanned(docs, [F.col(f"`{c}`") for c in docs.columns], text_col, least_digits, trust, accept)
    joined = rows.join(materialize(more, "discovered"), "row", "left")
    spans = F.concat("base", F.coalesce("more", F.array().cast(SPANS)))
    text = F.col(f"kept.`{text_col}`")
    joined = joined.select("kept", F.when(F.size("base") + F.coalesce(F.size("more"), F.lit(0)) > 0, replaced(text, spans, KINDS)).otherwise(text).alias("fresh"))
    fresh = {text_col: F.col("fresh")}
    if size_col in docs.columns:
        fresh[size_col] = F.length("fresh").cast(docs.schema[size_col].dataType)
    return joined.select(*(fresh.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    n = [count_of(F.col("spans"), "kind", k).alias(f"n_{KINDS[k]}") for k in range(5)]
    return found.select("doc_id", *n, F.sha2(listed(base, KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLE: dict[str, str] = {}
