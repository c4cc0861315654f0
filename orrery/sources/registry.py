"""Approved sources as a small literal table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name, kind of document, whether it may change in place
SOURCES = (("submissions", "json", True), ("overflow", "json", True), ("quarter_index", "fixed_text", False), ("open_quarter_index", "fixed_text", True), ("industry_codes", "html", True), ("calendar", "html", True), ("announcement", "html", False), ("tickers", "json", True), ("exchange_tickers", "json", True))


def approved(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source string, kind string, mutable boolean")
