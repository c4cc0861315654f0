"""Study analytics, from a written specification: folds, outcomes, text features, metrics, bootstrap.

Everything learned from training rows (caps, medians, means, labels) is one aggregate row
or one row a group, joined back by broadcast of that checked, small side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions.scalars import seeded_rank
from orrery.operators import order
from orrery.runtime import materialize


def rolling_folds(rows: DataFrame, year: Column, folds: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    """Rows repeated for each fold (train_from, train_to, test_from, test_to) they are in: adds fold and part."""
    table = F.array(*(F.struct(F.lit(i + 1).alias("fold"), *(F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), f, strict=True))) for i, f in enumerate(folds)))
    each = rows.withColumn("orrery_year", year).withColumn("orrery_f", F.explode(table))
    part = F.when(F.col("orrery_year").between(F.col("orrery_f.a"), F.col("orrery_f.b")), "train").when(F.col("orrery_year").between(F.col("orrery_f.c"), F.col("orrery_f.d")), "test")
    return each.withColumn("fold", F.col("orrery_f.fold")).withColumn("part", part).where("part IS NOT NULL").drop("orrery_year", "orrery_f")


def yearly_change(rows: DataFrame, entity: str, day: str, value: str, least: int = 300, most: int = 430) -> DataFrame:
    """Adds change: the difference to the entity's row before, where the gap in days is that of a year; else null."""
    w = Window.partitionBy(entity).orderBy(day)
    gap = F.datediff(day, F.lag(day).over(w))
    return rows.withColumn("change", F.when(gap.between(least, most), F.col(value) - F.lag(value).over(w)))


def median_adjusted(rows: DataFrame, value: str, fine: list[str], coarse: list[str], entity: str, firms: int = 10) -> DataFrame:
    """Adds adjusted: the value less its group's median; of the coarse group where the fine one has too few entities; null where both have."""
    rows = materialize(rows, "medians")  # read by both medians and the join

    def medians(keys: list[str], name: str) -> DataFrame:
        many = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(entity).alias("orrery_n")).where(F.col("orrery_n") >= firms)
        return order.percentiles(rows, value, {name: 0.5}, keys).join(many.drop("orrery_n"), keys)

    out = rows.join(medians(fine, "m_fine"), fine, "left").join(medians(coarse, "m_coarse"), coarse, "left")
    return out.withColumn("adjusted", F.col(value) - F.coalesce("m_fine", "m_coarse")).drop("m_fine", "m_coarse")


def winsor(rows: DataFrame, value: str, train: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds capped: the value within the training rows' percentiles."""
    caps = order.percentiles(rows.where(train), value, {"orrery_lo": low, "orrery_hi": high})
    out = rows.crossJoin(F.broadcast(caps))  # one row
    return out.withColumn("capped", F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("orrery_lo")), F.col("orrery_hi")))).drop("orrery_lo", "orrery_hi")


def severe(rows: DataFrame, value: str, train: Column, share: float = 0.10) -> DataFrame:
    """Adds cut and severe: at or below the training rows' percentile, rounded to six decimals."""
    cut = order.percentiles(rows.where(train), value, {"cut": share}).select(F.round("cut", 6).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("severe", F.round(F.col(value), 6) <= F.col("cut"))


def impute_scale(rows: DataFrame, columns: list[str], train: Column, drop_above: float = 0.4) -> DataFrame:
    """Each column with its training median in place of nulls, scaled by the interquartile range, and a missing flag.

    Columns with a larger share of nulls in training than `drop_above` are left out; that
    share is one row on the driver.
    """
    share = rows.where(train).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).first()
    kept = [c for c in columns if share[c] is not None and share[c] <= drop_above]
    out = rows
    for c in kept:
        found = order.percentiles(rows.where(train), c, {"low": 0.25, "middle": 0.5, "high": 0.75})
        out = out.crossJoin(F.broadcast(found.select(F.array("low", "middle", "high").alias(f"q_{c}"))))  # one row
        q = F.col(f"q_{c}")
        spread = F.when(q[2] > q[0], q[2] - q[0]).otherwise(F.lit(1.0))
        out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("int")).withColumn(f"{c}_scaled", F.round((F.coalesce(F.col(c), q[1]) - q[1]) / spread, 6))
    return out.drop(*(f"q_{c}" for c in kept), *(c for c in columns if c not in kept))


def composite(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Adds composite: the mean of the columns' z-scores by the training mean and deviation."""
    stats = rows.where(train).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns))
    z = sum(((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) for c in columns), F.lit(0.0)) / len(columns)
    return rows.crossJoin(F.broadcast(stats)).withColumn("composite", F.round(z, 6)).drop(*(f"{k}_{c}" for k in "ms" for c in columns))


def style_features(docs: DataFrame, id_col: str, text_col: str, tone: Sequence[str]) -> DataFrame:
    """id_col and style: words, sentences, words a sentence, characters a word, type-token ratio, numbers and tone words a word, list lines a line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col), F.filter(F.split(F.lower(text), r"[^\p{L}0-9]+"), lambda w: w != "").alias("w"), F.greatest(F.regexp_count(text, F.lit(r"[.!?]+(\s|$)")), F.lit(1)).alias("n_sentences"), F.split(text, "\n").alias("lines"))
    n = F.size("w")
    per = lambda c: F.round(c / F.greatest(n, F.lit(1)), 6)
    return one.select(
        id_col, n.cast("long").alias("n_words"), F.col("n_sentences").cast("long").alias("n_sentences"), F.round(n / F.col("n_sentences"), 6).alias("sentence_words"),
        per(F.length(F.array_join("w", ""))).alias("word_chars"), per(F.size(F.array_distinct("w"))).alias("type_token"), per(F.size(F.filter("w", lambda x: F.rlike(x, F.lit("^[0-9]+$"))))).alias("numeric"),
        per(F.size(F.filter("w", lambda x: x.isin(*tone)))).alias("tone"), F.round(F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"^\s*[-*|]")))) / F.size("lines"), 6).alias("list_lines"),
    )


def boilerplate(docs: DataFrame, id_col: str, text_col: str, shared: int = 3) -> DataFrame:
    """id_col, n_lines, n_shared, share: lines that at least `shared` documents have.

    Lines travel as digests; they are counted once a document, with partial aggregates.
    """
    lines = docs.select(id_col, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line")).where(F.trim("line") != "").select(id_col, F.md5(F.trim("line")).alias("digest"))
    one = lines.groupBy(id_col, "digest").agg(F.count(F.lit(1)).alias("n"))
    common = one.groupBy("digest").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= shared).select("digest", F.lit(1).alias("hit"))
    out = one.join(common, "digest", "left").groupBy(id_col).agg(F.sum("n").alias("n_lines"), F.coalesce(F.sum(F.col("n") * F.col("hit")), F.lit(0)).alias("n_shared"))
    return out.withColumn("share", F.round(F.col("n_shared") / F.col("n_lines"), 6))


def cosine_pairs(terms: DataFrame, pairs: DataFrame, doc: str, term: str, weight: str) -> DataFrame:
    """pairs with similarity: the cosine of sparse vectors (doc, term, weight) of the named pairs (a, b) only."""
    norm = terms.groupBy(doc).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))
    left = pairs.join(terms.select(F.col(doc).alias("a"), F.col(term).alias("t"), F.col(weight).alias("wa")), "a")
    both = left.join(terms.select(F.col(doc).alias("b"), F.col(term).alias("t"), F.col(weight).alias("wb")), ["b", "t"])
    dot = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(dot, ["a", "b"], "left").join(norm.select(F.col(doc).alias("a"), F.col("norm").alias("na")), "a", "left").join(norm.select(F.col(doc).alias("b"), F.col("norm").alias("nb")), "b", "left")
    return out.select("a", "b", F.round(F.coalesce(F.col("dot"), F.lit(0)) / (F.col("na") * F.col("nb")), 6).alias("similarity"))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = docs.select(id_col, F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("term")).where("term <> ''")
    return words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame:
    """id_col, nth, term, score: each document's highest tf * ln((1 + N) / (1 + df)), ties by term."""
    tf = term_counts(docs, id_col, text_col)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log((1 + F.col("n")) / (1 + F.col("df"))), 6))
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "term")
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top).select(id_col, "nth", "term", "score")


def regression_metrics(rows: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """n, mae, rmse, medae, r2, bias, slope, intercept by group."""
    e = F.col(predicted) - F.col(actual)
    both = rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    middle = order.percentiles(both.select(*by, F.abs(e).alias("orrery_error")), "orrery_error", {"medae": 0.5}, by)
    middle = middle.select(*(F.col(k).alias(f"m_{k}") for k in by), "medae")
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"), F.avg(e).alias("bias"), F.regr_slope(actual, predicted).alias("slope"), F.regr_intercept(actual, predicted).alias("intercept"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    out = out.join(middle, same)
    return out.select(*by, "n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "medae", "r2", "bias", "slope", "intercept")))


def classification_metrics(rows: DataFrame, label: str, score: str, id_col: str, bins: int = 10, capacity: float = 0.1) -> DataFrame:
    """One row: n, prevalence, brier, ece (equal-frequency bins), roc_auc, average precision, precision and recall at capacity.

    Ranks go by (score, id), by ranges of them; sums and averages are partial aggregates.
    """
    base = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("p"), F.col(id_col).alias("i"))
    ranked = order.running(base, ["p", "i"], below=F.col("y")).withColumnsRenamed({"rank": "up", "total_below": "pos"})
    ranked = ranked.withColumn("down", F.col("n") - F.col("up") + 1).withColumn("hits", F.col("pos") - F.col("below") + F.col("y"))
    ranked = ranked.withColumn("bin", F.floor((F.col("up") - 1) * bins / F.col("n")))
    ece = ranked.groupBy("bin").agg(F.abs(F.avg("y") - F.avg("p")).alias("gap"), F.count(F.lit(1)).alias("c")).agg((F.sum(F.col("gap") * F.col("c")) / F.sum("c")).alias("ece"))
    top = F.ceil(F.col("n") * capacity)
    one = ranked.agg(F.max("n").alias("n"), F.avg("y").alias("prevalence"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), ((F.sum(F.col("y") * F.col("up")) - F.max("pos") * (F.max("pos") + 1) / 2) / (F.max("pos") * (F.max("n") - F.max("pos")))).alias("roc_auc"), (F.sum(F.col("y") * F.col("hits") / F.col("down")) / F.max("pos")).alias("average_precision"), F.avg(F.when(F.col("down") <= top, F.col("y"))).alias("precision_at"), (F.sum(F.when(F.col("down") <= top, F.col("y"))) / F.max("pos")).alias("recall_at"))
    names = ("prevalence", "brier", "roc_auc", "average_precision", "precision_at", "recall_at", "ece")
    return one.crossJoin(F.broadcast(ece)).select("n", *(F.round(c, 6).alias(c) for c in names))


#: Chances of at most 0, 1, 2, ... under a Poisson(1) count, as far as a 24-bit number tells them from 1.
POISSON = tuple(round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 8) for k in range(10))


def bootstrap(rows: DataFrame, entity: str, value: str, replicates: int, seed: str) -> DataFrame:
    """replicate, estimate: the mean over entities drawn with Poisson(1) multiplicities of a hash (seed, replicate, entity).

    The same seed gives an entity the same multiplicity whatever the value column, so estimates
    of two columns are paired by replicate.

    Entities are summed first; each then meets the replicates, so the work is entities times
    replicates, whatever their rows.
    """
    by = rows.where(F.col(value).isNotNull()).groupBy(entity).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    each = by.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.conv(F.substring(seeded_rank(seed, F.col("replicate"), F.col(entity)), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)
    m = F.lit(len(POISSON))
    for k, below in reversed(list(enumerate(POISSON))):
        m = F.when(u < below, k).otherwise(m)
    drawn = each.withColumn("m", m).groupBy("replicate").agg((F.sum(F.col("m") * F.col("s")) / F.nullif(F.sum(F.col("m") * F.col("c")), F.lit(0))).alias("estimate"))
    return drawn.withColumn("estimate", F.round("estimate", 6))


def interval(estimates: DataFrame, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    n = estimates.agg(F.count("estimate").alias("replicates"))
    found = order.percentiles(estimates, "estimate", {"low": tail, "middle": 0.5, "high": 1 - tail})
    return n.crossJoin(F.broadcast(found)).select("replicates", *(F.round(c, 6).alias(c) for c in ("low", "middle", "high")))


def holm(tests: DataFrame, id_col: str, p: str) -> DataFrame:
    """id_col, p, adjusted: step-down adjusted p-values; one row a test, so one partition holds them."""
    w = Window.orderBy(p, id_col)
    ranked = tests.withColumn("k", F.row_number().over(w)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    step = F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("k") + 1))
    return ranked.withColumn("adjusted", F.round(F.max(step).over(w.rowsBetween(Window.unboundedPreceding, 0)), 9)).select(id_col, p, "adjusted")


def ols_hc3(rows: DataFrame, y: str, xs: list[str], key: str) -> DataFrame:
    """term, coefficient, std_error (HC3) of a linear model with an intercept.

    The Gram matrix and the weighted one are sums over the rows; only (k+1)^2 numbers reach the
    driver. Leverages come from the inverse as literal coefficients.
    """
    terms = ["intercept", *xs]
    clean = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (y, *xs))).withColumn("intercept", F.lit(1.0))
    k = len(terms)

    def gram(df: DataFrame, weight: Column, right: list[str]) -> np.ndarray:
        got = df.agg(*(F.sum(weight * F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(right))).first()
        return np.array([[got[f"s{i}_{j}"] or 0.0 for j in range(len(right))] for i in range(k)], float)

    inverse = np.linalg.inv(gram(clean, F.lit(1.0), terms))
    beta = inverse @ gram(clean, F.lit(1.0), [y])[:, 0]
    fitted = sum((F.col(t) * float(b) for t, b in zip(terms, beta, strict=True)), F.lit(0.0))
    lever = sum((F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(terms) for j, b in enumerate(terms)), F.lit(0.0))
    meat = gram(clean, F.pow((F.col(y) - fitted) / (1 - lever), F.lit(2.0)), terms)
    cov = inverse @ meat @ inverse
    out = [(t, round(float(b), 6), round(float(np.sqrt(max(0.0, cov[i, i]))), 6)) for i, (t, b) in enumerate(zip(terms, beta, strict=True))]
    return rows.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double")


def subgroups(rows: DataFrame, a: str, b: str, value: Column, least: int) -> DataFrame:
    """Means over both keys, each one and all; a group of fewer than `least` rows is suppressed."""
    out = rows.groupingSets([[a, b], [a], [b], []], a, b).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.coalesce(F.col(a).cast("string"), F.lit("all")).alias(a), F.coalesce(F.col(b).cast("string"), F.lit("all")).alias(b), F.when(F.col("n") >= least, F.col("n")).cast("string").alias("n"), F.when(F.col("n") >= least, F.round("mean", 6)).alias("mean"))


def rewrite_sensitivity(pairs: DataFrame, rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """column, sensitivity: the median absolute shift of a column over pairs (a, b), in interquartile ranges of all rows."""
    met = pairs.join(rows.select(F.col(id_col).alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns)), "a").join(rows.select(F.col(id_col).alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns)), "b")
    one = None
    for c in columns:
        shift = order.percentiles(met.select(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("shift")), "shift", {c: 0.5})
        spread = order.percentiles(rows, c, {"high": 0.75, "low": 0.25}).select((F.col("high") - F.col("low")).alias(f"s_{c}"))
        both = shift.crossJoin(F.broadcast(spread))
        one = both if one is None else one.crossJoin(F.broadcast(both))  # one row each
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(c) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), 6).alias("sensitivity")) for c in columns))).alias("r")).select("r.*")


def drift_classifier(rows: DataFrame, columns: list[str], label: str, regularisation: float = 0.01) -> DataFrame:
    """Rows with a drift score: a regularised logistic model of the later cohort, trained by the ML library over the cluster."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=columns, outputCol="orrery_x").transform(rows)
    model = LogisticRegression(featuresCol="orrery_x", labelCol=label, regParam=regularisation, standardization=True, maxIter=50).fit(made)
    return model.transform(made).withColumn("drift", F.round(vector_to_array("probability")[1], 6)).drop("orrery_x", "rawPrediction", "probability", "prediction")


def placebo(rows: DataFrame, day: str, value: str, cutoffs: Sequence[str]) -> DataFrame:
    """cutoff, n_before, n_after, difference of means for each of a few cutoff dates, in one pass."""
    each = rows.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    late = F.col(day) >= F.col("cutoff").cast("date")
    out = each.groupBy("cutoff").agg(F.count_if(~late).alias("n_before"), F.count_if(late).alias("n_after"), (F.avg(F.when(late, F.col(value))) - F.avg(F.when(~late, F.col(value)))).alias("d"))
    return out.select("cutoff", "n_before", "n_after", F.round("d", 6).alias("difference"))


def rank_correlation(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n, spearman: the correlation of the ranks within a group, ties at their mean rank.

    Pairs of equal (by, a, b) are counted first and carry their weight, so a value that many rows share is one row.
    """

    def ranks(c: str, name: str) -> DataFrame:
        mean = F.col("first") + (F.col("c") + 1) / 2.0
        return order.counted(cells, c, by).select(*(F.col(k).alias(f"{name}_{k}") for k in by), F.col(c).alias(f"{name}_x"), mean.alias(name))

    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    out = cells.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("w"))
    for c, name in ((a, "ra"), (b, "rb")):
        same = F.col(c) == F.col(f"{name}_x")
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
        out = out.join(ranks(c, name), same)
    w, x, y = F.col("w"), F.col("ra"), F.col("rb")
    sums = out.groupBy(*by).agg(F.sum("w").alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    n = F.col("n")
    cov, vx, vy = F.col("xy") / n - F.col("x") / n * F.col("y") / n, F.col("xx") / n - F.pow(F.col("x") / n, F.lit(2)), F.col("yy") / n - F.pow(F.col("y") / n, F.lit(2))
    return sums.select(*by, "n", F.round(cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)), 6).alias("spearman"))


def deciles(rows: DataFrame, predicted: str, actual: str, ties: list[str]) -> DataFrame:
    """decile, n, predicted, actual: means over ten groups in the order of the prediction; the first ones take a row more where ten don't divide all."""
    k = F.col("rank") - 1
    size, more = F.floor(F.col("n") / 10), F.col("n") % 10
    wide = more * (size + 1)
    out = order.running(rows, [predicted, *ties]).withColumn("decile", (F.when(k < wide, F.floor(k / (size + 1))).otherwise(more + F.floor((k - wide) / F.greatest(size, F.lit(1)))) + 1).cast("int"))
    return out.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg(predicted), 6) + 0.0).alias("predicted"), (F.round(F.avg(actual), 6) + 0.0).alias("actual"))


def relative_mae(rows: DataFrame, actual: str, predicted: str, baseline: str, by: list[str]) -> DataFrame:
    """by, n, relative_mae: the mean absolute error over that of a baseline; their decay is a difference of two groups."""
    e = lambda c: F.avg(F.abs(F.col(c) - F.col(actual)))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(e(predicted) / F.nullif(e(baseline), F.lit(0.0)), 6).alias("relative_mae"))


def confusion(rows: DataFrame, label: str, score: str, cut: float) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, specificity, f1 of calling scores of at least `cut` positive; null where nothing stands below the line."""
    y, p = F.col(label).cast("int") == 1, F.col(score) >= cut
    one = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return one.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tn", "fp").alias("specificity"), F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6).alias("f1"))
