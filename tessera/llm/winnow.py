"""Document fingerprints by winnowing, with built-in functions only.

A text is cut into tokens: words of up to 12 characters, and the single characters of longer runs without ASCII blanks
(Chinese, Japanese, Thai, base64), so that what two texts share has the same tokens wherever it stands in a run. Runs
of ``k`` tokens get a cyclic-polynomial rolling hash, built by doubling; of every window of ``window`` such hashes the
smallest is kept, the rightmost of equal ones, with its position. Two texts that share a run of ``window + k - 1``
tokens share a fingerprint entry (the guarantee; as many characters inside long runs), and no run under ``k`` tokens
can match.

Entries are structs (hash, position): the whole 64-bit hash and the number of the run's first token. While minima are
searched both are packed into one long, the hash's upper 32 bits above 31 bits of (MAX_POSITION - position): an array
holds fewer than 2**31 tokens, so every position is exact, and hashes that agree in those 32 bits count as equal when
the smallest is chosen, but not when texts are compared.

Order of documents: null ids first, then by id; rows with one id by a hash of the text, then the text. The order is cut
into buckets of about ROWS_PER_BUCKET rows, as many as the table needs; an id that many rows share, or null, is cut by
that hash.

Defined cases: null is the empty text, whose fingerprint is empty; two empty fingerprints are alike (1.0); texts
under ``k`` tokens have one entry for the whole text; equal rows follow each other; ids must be whole numbers; other
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import let, whole_text

SOLID = r"[^\x20\x09-\x0D]"
#: A whole word of up to 12 characters, or one character of a longer one.
PIECE = f"(?<!{SOLID}){SOLID}{{1,12}}(?!{SOLID})|{SOLID}"
K = 4
WINDOW = 16
POSITION_BITS = 31
MAX_POSITION = (1 << POSITION_BITS) - 1
HASH_MASK = ((1 << 63) - 1) ^ MAX_POSITION
#: Rows between two boundaries of the order.
ROWS_PER_BUCKET = 20_000


def rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def rolled(bits: int) -> Callable[[Column, Column], Column]:
    return lambda a, b: a.bitwiseXOR(rotated(b, bits))


def pairwise(items: Column, step: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(items[i], items[i + step]) for every i; empty when there are not enough items."""

    def body(a: Column) -> Column:
        n = F.greatest(F.size(a) - step, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), combine)

    return let(items, body)


def gram_hashes(hashes: Column, k: int) -> Column:
    """Rolling hashes of runs of ``k`` items, by doubling and one overlapping-free rest."""
    if k < 1 or k & (k - 1):
        raise ValueError("k must be a power of two")
    step = 1
    while step < k:
        hashes = pairwise(hashes, step, rolled(step))
        step *= 2
    return hashes


def window_minima(packed: Column, window: int) -> Column:
    """The different minima of all windows, in order of position; of all items when they are fewer."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    small = lambda a, b: F.least(a, b)

    def body(p: Column) -> Column:
        m, step = p, 1
        while step < window:
            m = pairwise(m, step, small)
            step *= 2
        return F.when(F.size(p) <= window, F.when(F.size(p) > 0, F.array(F.array_min(p))).otherwise(p)).otherwise(F.array_distinct(m))

    return let(packed, body)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Entries (hash, position) of a text without null."""
    words = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    whole = lambda h: F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), ",")))
    grams = let(hashed, lambda h: F.when((F.size(h) > 0) & (F.size(h) < k), whole(h)).otherwise(gram_hashes(h, k)))

    def chosen(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(HASH_MASK)).bitwiseOR(F.lit(MAX_POSITION) - i.cast("long")))
        place = lambda e: (F.lit(MAX_POSITION) - e.bitwiseAND(F.lit(MAX_POSITION))).cast("int")
        return F.transform(window_minima(packed, window), lambda e: F.struct(F.get(g, place(e)).alias("hash"), place(e).alias("position")))

    return let(grams, chosen)


def hashes(entries: Column) -> Column:
    """The different hashes of a fingerprint."""
    return F.array_distinct(F.transform(entries, lambda e: e["hash"]))


def positions(entries: Column) -> Column:
    """Token positions of the entries."""
    return F.transform(entries, lambda e: e["position"])


def as_string(entries: Column) -> Column:
    """``hash@position`` of every entry, in order, hashes in hexadecimal."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.hex(e["hash"]), F.lit("@"), e["position"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of different hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every).cast("double")


def place_of(id: str, text: str) -> Column:
    """What rows are ordered by."""
    return F.struct(F.col(id).isNotNull().alias("known"), F.coalesce(id, F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"))


def boundaries(rows: DataFrame, per_bucket: int) -> list[tuple[bool, int, int]]:
    """First places (known, id, hash) of all buckets but the lowest, ascending; as many as the rows need.

    They come from quantiles of the ids, so a value that takes several of them is an id of many rows; it, like null, is
    cut into equal ranges of the hash.
    """
    n, known = rows.agg(F.count("*"), F.count("id")).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // per_bucket))
    if n <= parts:
        return []
    asked = rows.where("id is not null").agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 5 * parts)).first()[0] or []
    low, step = -(1 << 63), 1 << 64
    cuts: set[tuple[bool, int, int]] = set()
    held = Counter(asked)
    for value, times in held.items():
        cuts.add((True, value, low))
        if times > 1:
            cuts.update((True, value, low + step * i // (times + 1)) for i in range(1, times + 1))
            if value < (1 << 63) - 1:
                cuts.add((True, value + 1, low))
    nulls = -(-(n - known) * parts // n)
    cuts.update((False, 0, low + step * i // nulls) for i in range(1, nulls))
    return sorted(cuts)


def bucket_of(place: Column, cuts: list[tuple[bool, int, int]]) -> Column:
    """Number of boundaries at or below a place, by binary search over a constant array."""
    if not cuts:
        return F.lit(0)
    # one literal, folded into an array by the optimizer, however many boundaries there are
    known, ids, hashed = (F.from_json(F.lit(json.dumps(c)), f"array<{t}>") for c, t in zip(zip(*cuts, strict=True), ("boolean", "bigint", "bigint"), strict=True))

    def reached(i: Column) -> Column:
        k, v, h = F.get(known, i), F.get(ids, i), F.get(hashed, i)
        return (k < place["known"]) | ((k == place["known"]) & ((v < place["id"]) | ((v == place["id"]) & (h <= place["hash"]))))

    steps = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(at + s > len(cuts), at).when(reached(at + s - 1), at + s).otherwise(at))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: Callable[[Column], Column] | None = None, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(id, text, extra, next_text, next_extra): every document with the next one in order, the last with the first.

    Each bucket also gets the first row of the bucket that follows, so one shuffle by bucket and one window find every
    next row; no task sees more than a bucket.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), whole_text(F.col(text)).alias("text"))
    cuts = boundaries(rows.select("id"), per_bucket)
    rows = rows.withColumn("place", place_of("id", "text")).withColumn("bucket", bucket_of(F.col("place"), cuts))
    first = rows.groupBy("bucket").agg(F.min("place").alias("place"))
    # as many rows as buckets, so they may meet in one task and be broadcast
    every = Window.orderBy("bucket")
    chain = first.withColumn("to", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first = rows.join(F.broadcast(chain), ["bucket", "place"]).groupBy("to").agg(F.min(F.struct("place", "text", "id")).alias("f"))
    led = rows.withColumn("last", F.lit(0)).unionByName(first.select("f.id", "f.text", "f.place", F.col("to").alias("bucket"), F.lit(1).alias("last")))
    if extra:
        led = led.withColumn("extra", extra(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("last", "place", "text")
    led = led.withColumn("next_text", F.lead("text").over(w))
    if extra:
        led = led.withColumn("next_extra", F.lead("extra").over(w))
    return led.where(F.col("last") == 0).drop("bucket", "last", "place")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
