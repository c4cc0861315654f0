"""Sinks: content-addressed objects, JSON lines, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_objects(rows: DataFrame, content: str, path: str) -> DataFrame:
    """Store each distinct content once under its SHA-256, partitioned by the digest's first digits; returns (digest, size).

    Contents that an earlier call stored are not written again. One writer at a time: two that
    run together may both store a content, which `verify_objects` and readers by digest bear.
    """
    spark = rows.sparkSession
    every = rows.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    every = every.withColumn("shard", F.substring("digest", 1, 2))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = every
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.schema("digest string, content binary, shard string").parquet(path).select("digest", "shard")
        fresh = every.join(known, ["digest", "shard"], "left_anti").select("digest", "content", "shard")
    fresh.write.mode("append").partitionBy("shard").parquet(path)
    return every.select("digest", F.length("content").alias("size"))


def verify_objects(spark: SparkSession, path: str) -> DataFrame:
    """digest, ok of each stored object."""
    return spark.read.parquet(path).select("digest", (F.sha2("content", 256) == F.col("digest")).alias("ok"))


def write_json_lines(df: DataFrame, order: list[str], path: str) -> None:
    """A small table as one ordered file of JSON objects with sorted keys."""
    df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns)))).alias("value"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order))).coalesce(1).sortWithinPartitions(*(f"o{i}" for i in range(len(order)))).select("value").write.mode("overwrite").text(path)


def audit_json_lines(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """(side, value) of lines that only the file (extra) or only the table (missing) has."""
    want = df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns)))).alias("value"))
    have = spark.read.text(path)
    return have.exceptAll(want).select(F.lit("extra").alias("side"), "value").union(want.exceptAll(have).select(F.lit("missing").alias("side"), "value"))


def scan_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text begins with `prefix`, as a half-open range that reaches the file statistics."""
    upper = prefix[:-1] + chr(ord(prefix[-1]) + 1)
    return df.where((F.col(column) >= prefix) & (F.col(column) < upper))
