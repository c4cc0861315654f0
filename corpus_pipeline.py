"""A corpus pipeline: language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
`documents`. Counted as part of the subpackage llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import jaccard, language, packing, pii
from orrery.runtime import discard, materialize, table

#: Name of a column that no table of documents has.
ROW = "orrery_document_row"
#: Rows of duplicates that are broadcast at most (under 100 MB); beyond, the texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels, predict every text, and drop the documents whose language is rejected."""
    return language.keep_identified(docs, language.fit(docs))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a Jaccard similarity of 0.75 or more stays: that of the smallest id.

    Decided by row: a row is named by its id and its text's digest, so of different texts
    under one id only those stay out that resemble another row. A null id counts last; of
    rows of one id in a component the smallest digest stays; of rows equal in id and text one
    stays, the first by its other columns. A row without a word stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("blank"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    named = docs.withColumn(ROW, key)
    classes, _ = jaccard.links_and_classes(named, id_col=ROW)
    classes = classes.where("n_shingles > 0").groupBy(ROW).agg(F.first("component_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    # what leaves, and what stays once: a row of some 80 bytes each, sent to all executors up to BROADCAST_ROWS of them
    odd = materialize(classes.where((F.col(ROW) != F.col("kept")) | (F.col("copies") > 1)).select(ROW, (F.col(ROW) == F.col("kept")).alias("orrery_once")), "duplicates")
    met = named.join(F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd, ROW, "left")
    clean = met.where("orrery_once IS NULL").select(*docs.columns)
    if odd.where("orrery_once").isEmpty():
        return clean
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = met.where("orrery_once").groupBy(ROW).agg(F.min(others).alias("orrery_row"))
    return clean.unionByName(once.select("orrery_row.*"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data found in it gives way to the name of its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences of at most 2048."""
    return packing.pack(materialize(packing.pieces(docs, TOKENIZER), "pieces"))


STAGES = [("language", language_stage), ("duplicates", duplicates_stage), ("privacy", privacy_stage), ("packing", packing_stage)]
#: The language model and the packing can't be stated in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all stages over `documents`; a stage's table is removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
