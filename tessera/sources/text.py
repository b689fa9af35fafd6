"""Text sources: lines, whole splits with their path, delimited records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import quoted_fields, strip_cr, tokens

MB = 1_000_000
DEFAULT_MAP_SIZE_MB = 64


def set_map_size(spark: SparkSession, megabytes: int = DEFAULT_MAP_SIZE_MB) -> None:
    """Input split size in megabytes of 10**6 bytes, 1 at least."""
    if megabytes < 1:
        raise ValueError("map size must be 1 MB or more")
    spark.conf.set("spark.sql.files.maxPartitionBytes", megabytes * MB)


def input_files(spark: SparkSession, path: str) -> str | list[str]:
    """What Spark shall read: the files directly in a folder, or the file itself; an error when there is none.

    A folder without folders inside is given to Spark as it is, so that no list of its files is made here. Hidden files
    do not count.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        raise FileNotFoundError(f"{path} does not exist")
    hidden = lambda s: s.getPath().getName().startswith(("_", "."))
    files = folders = False
    each = fs.listStatusIterator(at)
    while each.hasNext() and not folders:
        s = each.next()
        files |= s.isFile() and not hidden(s)
        folders |= s.isDirectory() and not hidden(s)
    if folders:
        names = [s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and not hidden(s)]
        if names:
            return names
    elif files:
        return path
    raise FileNotFoundError(f"no files in {path}")


def text_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Lines of the files directly in ``path`` (path STRING, value STRING).

    Only a line feed ends a line; one carriage return before it is dropped. With ``strict``, invalid
    UTF-8 fails the job, as a malformed record should.
    """
    raw = spark.read.option("lineSep", "\n").text(input_files(spark, path))
    value = F.validate_utf8("value") if strict else F.col("value")
    return raw.select(F.col("_metadata.file_path").alias("path"), strip_cr(value).alias("value"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file (path STRING, value STRING), for mappers that need the whole text."""
    raw = spark.read.text(input_files(spark, path), wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.validate_utf8("value").alias("value"))


def records(lines: DataFrame, names: list[str], split: str = "quoted") -> DataFrame:
    """Named string columns of delimited lines; ``split`` is quoted (commas) or blank (white space)."""
    parts = quoted_fields(F.col("value")) if split == "quoted" else tokens(F.col("value"))
    cut = lines.select(parts.alias("_f"))
    return cut.select(*(F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def by_field_count(lines: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Lines with ``n`` quoted fields, and the others; both keep the fields as an array column."""
    cut = lines.select(quoted_fields(F.col("value")).alias("fields"))
    return cut.where(F.size("fields") == n), cut.where(F.size("fields") != n)


def field(column: Column, index: int, kind: str) -> Column:
    """A typed field; a value that cannot be parsed fails the task under ANSI rules."""
    return F.get(column, F.lit(index)).cast(kind)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
