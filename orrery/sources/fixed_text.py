"""Fixed-text index files: a header, a rule of dashes, and rows anchored by a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROW = r"^(.*\S)\s{2,}(\S+)\s+([0-9]{1,10})\s+([0-9]{4}-[0-9]{2}-[0-9]{2})\s+(\S+)\s*$"
NAMES = ("company", "form", "cik", "filed", "path")


def parse_index(lines: DataFrame, document: str = "document", number: str = "line_number", text: str = "line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, documents) of numbered lines.

    Rows are the lines after a document's first rule of dashes; one that has another form is
    kept in quarantine with its text. A document without a rule has an unknown number of rows,
    not none.
    """
    rule = F.rlike(text, F.lit(r"^-{10,}\s*$"))
    heads = lines.groupBy(document).agg(F.min(F.when(rule, F.col(number))).alias("rule_at"), F.count(F.lit(1)).alias("n_lines"))
    body = lines.join(heads, document).where((F.col(number) > F.col("rule_at")) & (F.trim(text) != ""))
    good = F.rlike(text, F.lit(ROW))
    rows = body.where(good).select(document, number, *(F.regexp_extract(text, ROW, k + 1).alias(n) for k, n in enumerate(NAMES)))
    bad = body.where(~good).select(document, number, F.col(text).alias("excerpt"), F.lit("MALFORMED_ROW").alias("reason"))
    return rows, bad, heads.select(document, "n_lines", F.when(F.col("rule_at").isNull(), "unreadable").otherwise("readable").alias("state"))
