"""A corpus pipeline: quality rules, near-duplicates, repeated strings, mixing, SentencePiece ids.

Every stage reads what the one before it has written and keeps the columns of documents, but for the last. Clean
documents stay: only those that the quality rules reject and all but one of each near-duplicate group go; repeated
strings are cut out of texts; the mix then takes documents once, twice or not at all, as the source targets say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, pieces, quality, repeats
from tessera.llm.shared import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word, line and compression rules."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word Jaccard links of 0.8 or more."""
    return neardup.kept_documents(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that started earlier in the corpus."""
    return repeats.without_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target takes them."""
    return mixing.mixed(docs, shard=None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, decoded_same) of every document."""
    return pieces.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: No SQL for compression ratios and piece ids; the test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, each one before it written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
