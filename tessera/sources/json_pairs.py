"""Reads back the partitioned JSON output of an earlier job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_values(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """(key STRING, value) rows from files that each hold one JSON object of key -> list."""
    raw = spark.read.text(path, wholetext=True)
    objects = raw.select(F.from_json("value", f"map<string, array<{value_type}>>").alias("m"))
    pairs = objects.select(F.explode("m").alias("key", "values"))
    return pairs.select("key", F.explode("values").alias("value"))
