"""Command line: runs a named workload over a folder of text and writes partitioned JSON; shows and cancels jobs.

    python -m tessera.cli run word-count --input /data/in --output /data/out --priority 3 --map-size 64
    python -m tessera.cli status
    python -m tessera.cli cancel --job ID
    python -m tessera.cli cluster-status

Paths are absolute. Jobs write their states into a folder of the user (``--state``), which the other commands read; a
client is known by an id kept there.
"""

from __future__ import annotations

import argparse
import time
import uuid
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import alpha_bucket, first_letter_half, tokens
from tessera.operators import workloads as wl
from tessera.operators.mapreduce import hash_partitioner
from tessera.plans.jobs import Jobs, Status, ask_cancel, noted
from tessera.session import PRIORITIES, builder
from tessera.sinks.json_parts import default_output, write_json_partitions
from tessera.sources.text import DEFAULT_MAP_SIZE_MB, records, set_map_size, text_lines

PARTITIONS = 15
STATE = Path.home() / ".local/share/tessera"


def grouped(df: DataFrame, key: str, value: str) -> DataFrame:
    """(pid, key, values) with one value a key, dealt by hash."""
    return df.select(hash_partitioner(PARTITIONS)(F.col(key), F.col(value)).alias("pid"), F.col(key).alias("key"), F.array(value).alias("values"))


def word_count(lines: DataFrame) -> DataFrame:
    return grouped(wl.word_count(lines, "value"), "word", "n")


def grep(lines: DataFrame) -> DataFrame:
    g = wl.grep_groups(lines, "value")
    return g.select(hash_partitioner(PARTITIONS)(F.col("longest"), F.col("lines")).alias("pid"), F.col("longest").alias("key"), F.col("lines").alias("values"))


def ngrams(lines: DataFrame) -> DataFrame:
    r = records(lines, ["w1", "w2", "year"], split="blank").where(F.col("year").cast("int") >= 2000)
    n = wl.distinct_predecessors(r)
    return n.select(alpha_bucket(F.col("word")).alias("pid"), F.col("word").alias("key"), F.array("n").alias("values"))


def rating_aggregator(lines: DataFrame) -> DataFrame:
    return grouped(wl.aggregate_lines(wl.rated_from_lines(lines)), "key", "value")


def rating_by_genre(lines: DataFrame) -> DataFrame:
    best = wl.best_per_genre(wl.aggregate_records(lines))
    return best.select(F.lit(0).alias("pid"), F.col("genre").alias("key"), F.array("title", F.col("rating").cast("string")).alias("values"))


def rating_by_year(lines: DataFrame) -> DataFrame:
    r = wl.ratings_by_title_year(wl.aggregate_records(lines))
    return r.select(F.col("year").alias("pid"), F.col("title").alias("key"), "values")


def concat(lines: DataFrame) -> DataFrame:
    words = lines.select(F.explode(tokens(F.col("value"))).alias("key"), F.lit("test").alias("value"))
    return wl.concat_values(words).select(first_letter_half(F.col("key")).alias("pid"), "key", F.array("joined").alias("values"))


WORKLOADS = {"word-count": word_count, "grep": grep, "ngrams": ngrams, "rating-aggregator": rating_aggregator, "rating-by-genre": rating_by_genre, "rating-by-year": rating_by_year, "concat": concat}


def input_lines(spark: SparkSession, source: str) -> DataFrame:
    """Lines (value) of text files, or the values of an earlier job's output."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(at) and any(s.isDirectory() and s.getPath().getName().startswith("pid=") for s in fs.listStatus(at)):
        return spark.read.json(source).select(F.explode("values").alias("value")).select(F.col("value").cast("string"))
    return text_lines(spark, source)


def run(spark: SparkSession, workload: str, source: str, output: str | None = None, map_size: int = DEFAULT_MAP_SIZE_MB, mode: str = "overwrite") -> str:
    """Runs a workload over the files in ``source``; returns the output folder."""
    set_map_size(spark, map_size)
    out = output or default_output(source)
    write_json_partitions(WORKLOADS[workload](input_lines(spark, source)), out, mode)
    return out


def client_id(state: Path) -> str:
    """The id of this user, made at the first call."""
    path = state / "client"
    if not path.exists():
        state.mkdir(parents=True, exist_ok=True)
        path.write_text(uuid.uuid4().hex)
    return path.read_text()


def absolute(path: str) -> str:
    if not path.startswith("/") and "://" not in path:
        raise argparse.ArgumentTypeError("paths have to be absolute")
    return path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--state", type=Path, default=STATE)
    commands = p.add_subparsers(dest="command", required=True)
    r = commands.add_parser("run")
    r.add_argument("workload", choices=sorted(WORKLOADS))
    r.add_argument("--input", required=True, type=absolute)
    r.add_argument("--output", type=absolute)
    r.add_argument("--priority", type=int, choices=PRIORITIES, default=3)
    r.add_argument("--map-size", type=int, default=DEFAULT_MAP_SIZE_MB)
    commands.add_parser("status").add_argument("--job")
    commands.add_parser("cancel").add_argument("--job")
    commands.add_parser("cluster-status")
    return p


def show(jobs: list[dict]) -> None:
    at = lambda t: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(t)) if t else "-"
    for j in jobs:
        print(j["id"], j["name"], j["status"], j["priority"], at(j["queued"]), at(j["started"]), at(j["done"]), sep="\t")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    folder, client = str(a.state / "jobs"), client_id(a.state)
    if a.command == "status":
        found = [j for j in noted(folder, client) if a.job in (None, j["id"])]
        show(found)
        return int(not found)
    if a.command == "cancel":
        job = ask_cancel(folder, a.job, client)
        print(job or "nothing to cancel")
        return int(job is None)
    if a.command == "cluster-status":
        for state, n in sorted(Counter(j["status"] for j in noted(folder)).items()):
            print(state, n, sep="\t")
        return 0
    spark = spark or builder("tessera").getOrCreate()
    jobs = Jobs(spark, folder)
    job = jobs.submit(a.workload, lambda s: run(s, a.workload, a.input, a.output, a.map_size), client, a.priority, lambda: input_lines(spark, a.input).schema)
    status = jobs.wait(job)
    print(job, status.value, jobs.jobs[job].result or jobs.jobs[job].error)
    return int(status is not Status.DONE)


if __name__ == "__main__":
    raise SystemExit(main())
