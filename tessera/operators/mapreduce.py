"""The generic job: map, optional combine, partition, reduce, lowered to one DataFrame plan.

    map + combine (Arrow batches, one Python worker per task)
      -> shuffle on (partition id, key), pieces of a group sorted next to each other
      -> reduce (Arrow batches), a group's pieces one after the other

The grouping key is (partition id, key), since a partitioner may look at the value. Values travel in pieces of bounded
length, so that no row, batch or task holds more of a group than its reducer keeps. Texts travel to the mapper in cuts of
bounded length, since Spark counts a batch's rows and not its bytes; the mapper gets each text whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mapper = Callable[[str, str], Iterable[tuple[Any, Any]]]
Folder = Callable[[Any, list], Iterable[Any]]
Partitioner = Callable[[Column, Column], Column]

#: Pairs that a map task holds before it combines and passes them on.
COMBINE_EVERY = 500_000
#: Bytes of a text in a row on the way to the mapper, at most.
CUT = 512
#: Rows that a map task gathers before it passes them on.
ROWS_EVERY = 10_000
#: Values in a row on the way to the reducer, at most; an Arrow batch holds 10,000 rows by default.
PIECE = 256
#: Groups, and outputs, that a reduce task holds before it passes them on.
GROUPS_EVERY, OUTPUTS_EVERY = 10_000, 200_000


@dataclass(frozen=True)
class JobSpec:
    """What a job is made of. Types are DDL strings; a combiner returns values of the intermediate type.

    A reducer gets the list of a group's values; with ``streams`` an iterator over them, so that the group need not fit
    in memory."""

    mapper: Mapper | None = None
    reducer: Folder | None = None
    partitioner: Partitioner | None = None
    combiner: Folder | None = None
    key_type: str = "string"
    value_type: str = "string"
    output_type: str = "string"
    streams: bool = False

    def validate(self) -> JobSpec:
        """The job itself, or an error that names what is missing."""
        for part in ("mapper", "reducer", "partitioner"):
            if getattr(self, part) is None:
                raise ValueError(f"the job has no {part}")
        return self

    @property
    def has_combiner(self) -> bool:
        return self.combiner is not None


def hash_partitioner(n: int) -> Partitioner:
    """pid = hash of the key modulo ``n``."""
    if n < 1:
        raise ValueError("a partitioner needs one partition or more")
    return lambda key, value: F.pmod(F.xxhash64(key), F.lit(n))


def combined(pairs: dict[Any, list], combiner: Folder | None) -> Iterator[tuple[list, list[list]]]:
    """Keys and, for each, a piece of its values; groups with one value pass as they are. A piece holds only nulls or none."""
    keys, pieces = [], []
    for key, values in pairs.items():
        if combiner and len(values) > 1:
            values = list(combiner(key, values))
        if None in values:
            keys.append(key)
            pieces.append([None])
            values = [v for v in values if v is not None]
        for i in range(0, len(values), PIECE):
            keys.append(key)
            pieces.append(values[i : i + PIECE])
        if len(keys) >= ROWS_EVERY:
            yield keys, pieces
            keys, pieces = [], []
    if keys:
        yield keys, pieces


def cut(rows: DataFrame) -> DataFrame:
    """(path, part, more) of (path, value) rows: the bytes of a text in parts, one after the other. The last has the path."""
    # bytes, since a place in a string is only found by counting from its start
    out = rows.select("path", F.col("value").cast("binary").alias("value"))
    out = out.withColumn("n", F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("value"), F.lit(0)) / CUT)).cast("int"))
    out = out.select("path", "value", "n", F.posexplode(F.sequence(F.lit(1), "n")).alias("before", "i"))
    more = F.col("i") < F.col("n")
    part = F.substring("value", F.col("before") * CUT + 1, F.lit(CUT))
    return out.select(F.when(~more, F.col("path")).alias("path"), part.alias("part"), more.alias("more"))


def texts(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, str]]:
    """(path, value): the texts that were cut, whole again."""
    parts: list[bytes] = []
    for batch in batches:
        for path, part, more in zip(batch["path"], batch["part"], batch["more"], strict=True):
            parts.append(part)
            if not more:
                value = None if part is None else b"".join(parts).decode()
                parts.clear()
                yield path, value


def map_stage(job: JobSpec, rows: DataFrame) -> DataFrame:
    """(key, values) of (path, value) rows: pieces of the values of a key."""
    mapper, combiner = job.mapper, job.combiner

    def passed_on(held: dict[Any, list]) -> Iterator[pd.DataFrame]:
        for keys, pieces in combined(held, combiner):
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "values": pd.Series(pieces, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[Any, list] = defaultdict(list)
        n = 0
        for path, value in texts(batches):
            for k, v in mapper(path, value):
                held[k].append(v)
                n += 1
                if n >= COMBINE_EVERY:
                    yield from passed_on(held)
                    held, n = defaultdict(list), 0
        yield from passed_on(held)

    return cut(rows).mapInPandas(run, f"key {job.key_type}, values array<{job.value_type}>")


def placed(job: JobSpec, pieces: DataFrame) -> DataFrame:
    """(pid, key, values): pieces of one partition each. Nulls are left out; their groups stay."""
    try:
        # a partitioner that only looks at the key runs once for each piece
        out = pieces.select("key", F.col("values").alias("kept")).withColumn("pid", job.partitioner(F.col("key"), F.col("value")))
    except AnalysisException:
        out = pieces.select("key", F.explode("values").alias("value"))
        out = out.select("key", F.array("value").alias("kept"), job.partitioner(F.col("key"), F.col("value")).alias("pid"))
    values = F.when(F.get("kept", F.lit(0)).isNotNull(), F.col("kept")).otherwise(F.array().cast(f"array<{job.value_type}>"))
    return out.select(F.col("pid").cast("long").alias("pid"), "key", values.alias("values"))


def group_stage(job: JobSpec, pieces: DataFrame) -> DataFrame:
    """(pid, key, values): what the reducer sees, the pieces of a group next to each other. Their order is not defined."""
    return placed(job, pieces).repartition("pid", "key").sortWithinPartitions("key", "pid")


def plain(values: Any) -> list:
    """The items of an array that came by Arrow, numbers as Python's own."""
    return values.tolist() if values.dtype.kind in "biufO" else list(values)


def reduce_stage(job: JobSpec, groups: DataFrame) -> DataFrame:
    """(pid, key, values) with the reducer's outputs; a group without output keeps an empty list."""
    reducer, streams = job.reducer, job.streams

    def whole(rows: Iterable[tuple]) -> Iterator[tuple]:
        # the hash stands for pid and key of any type; strings are compared as well
        for _, same in groupby(rows, lambda r: (r[0], r[2]) if type(r[2]) is str else r[0]):
            _, pid, key, values = next(same)
            values = chain(plain(values), chain.from_iterable(plain(r[3]) for r in same))
            yield pid, key, list(reducer(key, values if streams else list(values)))

    def passed_on(out: list[tuple]) -> pd.DataFrame:
        pids, keys, values = zip(*out, strict=True)
        return pd.DataFrame({"pid": pids, "key": pd.Series(keys), "values": pd.Series(values, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for row in whole(r for b in batches for r in zip(b["id"], b["pid"], b["key"], b["values"], strict=True)):
            out.append(row)
            n += len(row[2])
            if len(out) >= GROUPS_EVERY or n >= OUTPUTS_EVERY:
                yield passed_on(out)
                out, n = [], 0
        if out:
            yield passed_on(out)

    named = groups.select(F.xxhash64("pid", "key").alias("id"), "pid", "key", "values")
    return named.mapInPandas(run, f"pid long, key {job.key_type}, values array<{job.output_type}>")


def run_job(job: JobSpec, rows: DataFrame) -> DataFrame:
    """The whole job over (path, value) rows."""
    job.validate()
    return reduce_stage(job, group_stage(job, map_stage(job, rows)))
