"""Partitioned JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_output(input_dir: str) -> str:
    """Where results go when no output folder is named."""
    return input_dir.rstrip("/") + "/output/"


def write_json_partitions(groups: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Writes (pid, key, values) rows as JSON lines under ``out/pid=<id>/``; empty partitions leave nothing.

    ``mode`` is overwrite, or errorifexists for stores that refuse to replace files.
    """
    cut = groups.repartition("pid").sortWithinPartitions("pid")
    cut.write.mode(mode).partitionBy("pid").json(out)


def write_json_objects(groups: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Like write_json_partitions, but each partition file holds one JSON object of key -> values.

    Entries are lines, sorted by key; the first opens the object and the last closes it, so no group of rows is held
    in memory. Keys are unique within a partition, as they are after a reduce.
    """
    key = F.col("key").cast("string")
    # to_json of a one-element array is ["key"]; the brackets go
    name = F.regexp_replace(F.to_json(F.array(key)), r'^\[("(?:[^"\\]|\\.)*+")\]', "$1")
    entry = groups.select("pid", key.alias("key"), F.concat(name, F.lit(": "), F.to_json("values")).alias("body"))
    ends = entry.groupBy("pid").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    before = F.when(F.col("key") == F.col("low"), F.lit("{\n")).otherwise(F.lit(","))
    after = F.when(F.col("key") == F.col("high"), F.lit("\n}")).otherwise(F.lit(""))
    rows = entry.join(ends, "pid").select("pid", "key", F.concat(before, "body", after).alias("body"))
    rows.repartition("pid").sortWithinPartitions("pid", "key").select("pid", "body").write.mode(mode).partitionBy("pid").text(out)
