"""Structured Streaming forms of the append-only observation log: an extension of the batch operators.

Every function returns a streaming DataFrame; a query's checkpoint folder is the caller's,
in a shared store. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive under `path`, with the schema of `like`; zoneless times count in the session's zone."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    zoneless = [c for c, kind in stream.dtypes if kind == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def idempotent(stream: DataFrame, identity: list[str], time: str, late: str) -> DataFrame:
    """Each observation once: repeats of an identity within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


def period_counts(stream: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts a period and key; in append mode a period is given out once, when the watermark closes it."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *keys, "n")


def sessions(stream: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    """Counts a session of a key: rows that follow each other within `gap`."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def latest_state(stream: DataFrame, key: str, time: str, digest: str) -> DataFrame:
    """For update mode: each key's newest observation so far and how many distinct digests it had."""
    return stream.groupBy(key).agg(F.max(F.struct(time, digest)).alias("m"), F.approx_count_distinct(digest).alias("n_digests"), F.count(F.lit(1)).alias("n")).select(key, F.col(f"m.{time}").alias(time), F.col(f"m.{digest}").alias(digest), "n_digests", "n")


def append_once(stream: DataFrame, path: str, checkpoint: str, identity: list[str]):
    """A writer that appends each identity once, whatever is delivered twice: a batch's rows that the table has are left out."""

    def write(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates(identity)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(*identity), identity, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
