"""WARC archives with revisit records.

Records are described by headers (payload digest, length, id); only headers are shuffled by digest. Of the records
with one digest the smallest id keeps its payload as ``response``; the others are joined to it and become
``revisit`` records with an empty block and a fresh header that refers to the original. Archives are written by
Spark's text writer, whose line separator is the blank lines that end a WARC record; each file holds about
``file_bytes`` of payload, less while there are fewer files than the session has shuffle partitions. That writer makes
one gzip member of a file, so single records cannot be sought in it; ``compression="none"`` gives archives in which they
can. Reading back parses every file by Content-Length, so payloads may hold anything. Record ids are made of the
page id, the digest and the number among repeated rows, so they differ for all records.

Defined cases: null html is an empty payload, always a response; payloads under ``min_bytes`` are responses; of
repeated rows with one id and one payload the first is the response and the others are revisits of that id; a null
id sorts last; null urls give no target header; blanks and controls in urls are percent-encoded; an empty table
gives an empty archive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, new_folder, whole_text

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 128_000_000
#: A task of a small archive writes this much or more.
TASK_BYTES = 4_000_000
MIN_REVISIT_BYTES = 100
RECORD_END = "\r\n\r\n"
BACK_SCHEMA = "page_id string, record_type string, digest string, declared_bytes long, refers_to string, uri string, payload binary"


def headers(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(row, id, uri, digest, bytes) of every page; row tells repeated rows apart."""
    body = whole_text(F.col(payload))
    return pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("uri"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))


def resolved(heads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, uri, digest, bytes, kept, n): what becomes of each different header; n counts repeated rows.

    kept is the id of the response. The originals are found by an aggregate, so that a digest which holds a third
    of all rows is reduced where it is read; the join back by digest runs on headers only, in which Spark can
    split a large partition.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    first = cut(heads.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1))
    return heads.join(first.select("digest", F.col("first.id").alias("kept"), F.lit(True).alias("shared")), "digest", "left")


def field(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def optional(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(field(name, value))


def safe(uri: Column) -> Column:
    """A URL that fits on a header line: percent signs of escapes stay, blanks and controls are encoded."""
    return F.regexp_replace(F.regexp_replace(uri, "\r", "%0D"), r"[\x00-\x20\x7F]", "%20")


def record(date: str) -> Column:
    """One WARC record (without the blank lines that end it) from the columns of ``written``."""
    rid = lambda c, n: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.substring("digest", 1, 16), F.lit(":"), n.cast("string"), F.lit(">"))
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(VERSION + "\r\n"),
        field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", rid(F.col("id"), F.col("copy"))),
        optional("WARC-Target-URI", safe(F.col("uri"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", rid(F.col("kept"), F.lit(1))))).otherwise(F.lit("")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> str:
    """Writes the pages as WARC files under ``path`` and returns it."""
    heads = cut(headers(pages, key, url, payload))
    total = heads.agg(F.coalesce(F.sum(F.col("bytes") + 400), F.lit(0))).first()[0]
    few = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    files = max(1, -(-total // file_bytes), few)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    keep = resolved(heads.select("id", "digest", "bytes"), min_bytes).where("shared")
    keep = keep.groupBy(known("id").alias("k"), "digest").agg(F.min("kept").alias("kept"), F.lit(True).alias("shared"))
    body = whole_text(F.col(payload))
    rows = pages.select(F.col(key).alias("id"), known(key).alias("k"), F.col(url).cast("string").alias("uri"), body.alias("payload"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    # one shuffle of the payloads serves the join, the window and the files
    rows = rows.repartition(int(files), "k", "digest").join(keep.repartition(int(files), "k", "digest"), ["k", "digest"], "left")
    # of repeated rows with the response's own id, one is the response
    copy = F.row_number().over(Window.partitionBy("k", "digest").orderBy("uri"))
    spread = rows.withColumn("copy", copy).withColumn("revisit", F.coalesce("shared", F.lit(False)) & (~F.col("id").eqNullSafe(F.col("kept")) | (F.col("copy") > 1)))
    spread.select(record(date).alias("value")).write.option("lineSep", RECORD_END).option("compression", compression).text(path)
    return path


PAGE = re.compile(r"<urn:page:(.*):[0-9a-f]{16}:\d+>$")
HEAD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive as BACK_SCHEMA rows."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        h = {k.decode(): v.decode() for k, v in HEAD.findall(data, at, end)}
        n = int(h["Content-Length"])
        number = lambda name: PAGE.match(h[name])[1] if name in h else None
        yield number("WARC-Record-ID"), h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["WARC-Payload-Length"]), number("WARC-Refers-To"), h.get("WARC-Target-URI"), data[end : end + n]
        at = end + n + len(RECORD_END)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``, gzipped or not, by Content-Length."""
    import gzip

    names = [f.split()[0] for f in BACK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                rows: list[tuple] = []
                held = 0
                for r in parse(gzip.decompress(raw) if raw.size and raw[:2].to_pybytes() == b"\x1f\x8b" else raw.to_pybytes()):
                    rows.append(r)
                    held += len(r[-1])
                    if held > 4_000_000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, BACK_SCHEMA)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages into a new shared folder and reads the archives back, revisits resolved to their originals.

    Returns page_id, payload_bytes, payload_digest (recomputed from the payload where the record holds it),
    record_type and refers_to.
    """
    spark = pages.sparkSession
    back = read_archives(spark, write_archives(pages, new_folder(spark, "warc"), **options))
    number = lambda c: F.when(F.col(c) == "null", F.lit(None)).otherwise(F.col(c)).cast("long")
    is_response = F.col("record_type") == "response"
    size = F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes"))
    digest = F.when(is_response, F.sha2("payload", 256)).otherwise(F.col("digest"))
    return back.select(number("page_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
