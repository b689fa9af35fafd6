"""Removal of byte strings that occurred before, by external induced sorting of suffixes.

Every byte under a string of ``LENGTH`` (100) bytes that also starts earlier is removed. A suffix array over all bytes
would hold a tuple for each byte; here, as in induced sorting, only sample suffixes are sorted and the order of the
others is induced from them. Sample positions are chosen by content: of the GRAM-byte strings inside each
100-byte window the one with the smallest hash (the leftmost of equals), so that equal windows hold the same sample
at the same offset. There is about one sample for 31 bytes. The queues of the method are Spark's external sorts: all
sorted tuples pass through shuffles that spill to disk.

1. Naming. Each document sends (sample name, context name, document, number of the sample); the context is all
   text of the windows that hold the sample. Sorted by name and context, the first row of each context stands for
   it. Samples that are not first in their context are repeats in all their windows.
2. Induction, of one level. Firsts that share their name with other contexts are sorted with their bytes: the sort
   orders suffixes at the samples, neighbours give common prefix values, and from there the order of the suffixes
   one byte further left is induced step by step, with its common prefix values taken over the ranges in between.
   Runs with common prefixes of 100 bytes are equal windows; all but the first are repeats.
3. Each document takes its lists and removes the bytes under repeated windows. A sample that is in no list is not
   the first of its context, so nothing has to be sent for the many copies of a text.

Names that very many documents share (found in a hash sample of documents; this decides the route only, never the
result) and names with more than MAX_GROUP contexts are not sorted by name, but window by window: rows of windows,
known by 128-bit hashes, are pre-aggregated where they are made and only the first place of each window is kept. So no key has more rows in
a shuffle than there are tasks that send it.

Names are 64-bit hashes and contexts and windows pairs of them; in step 2 bytes are compared.

Defined cases: null text is empty; a null id counts as the smallest one; rows with equal ids and texts are one document
(each gets the same result); rows with one id and different texts are ordered by a hash of the text; other columns
pass in ``without_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm import wordbytes as wb
from tessera.llm.shared import new_folder, whole_text

LENGTH = 100
GRAM = 40
#: Windows that can share a sample; their flags fit in one long.
REACH = LENGTH - GRAM + 1
#: Contexts of one name that are sorted in one place.
MAX_GROUP = 20_000
#: One document in SAMPLE is read to find names that a share of 1 / COMMON of documents have; HOT names at most.
SAMPLE, COMMON, HOT = 16, 256, 20_000
#: ... or that this many of the sampled documents have, however large the table is.
HOT_DOCS = 4096
FIRST_ID = -(1 << 63)
C1, C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM-byte string, by doubling."""
    h = wb.BYTE_VALUES[data]
    size, parts = 1, {}
    while size < GRAM:
        if GRAM & size:
            parts[size] = h.copy()
        if size * 2 > GRAM:
            break
        m = np.uint64(pow(int(wb.BASE), size, 1 << 64))
        low = h[size:]
        h = h[:-size] * m
        h += low
        size *= 2
    done, out = 0, None
    for size in sorted({*parts, size}, reverse=True):  # the binary parts of GRAM, the largest first
        piece = (h if size == max({*parts, size}) else parts[size])[done:]
        if out is None:
            out = piece.copy()
        else:
            n = min(len(out), len(piece))
            out = out[:n] * np.uint64(pow(int(wb.BASE), size, 1 << 64)) + piece[:n]
        done += size
    return wb.mixed(out[: len(data) - GRAM + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class Samples:
    """The samples of some documents: document, number in it, place, first and last window, names."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets - offsets[0]
        docs = len(offsets) - 1
        none = np.zeros(0, np.int64)
        self.doc = self.place = self.low = self.high = none
        self.name = self.context = np.zeros(0, np.uint64)
        self.first = np.zeros(docs + 1, np.int64)
        if len(data) >= LENGTH:
            self.grams = gram_hashes(data)
            keyed = (self.grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(self.grams), dtype=np.uint64)
            chosen = (sliding_min(keyed, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            n = len(chosen)  # windows that fit in the data; those across documents do not count
            new = np.empty(n, bool)
            new[0], new[1:] = True, chosen[1:] != chosen[:-1]
            valid = np.ones(n, bool)
            ends = self.offsets[1:-1]
            for d in (ends[(ends > 0) & (ends < len(data))] if docs > 1 else []):
                valid[max(0, d - LENGTH + 1) : d] = False
            starts = self.offsets[:-1]
            new[starts[starts < n]] = True
            new &= valid
            low = np.flatnonzero(new)
            self.doc = np.searchsorted(self.offsets, low, "right") - 1
            # the last window of a sample lies before the next sample's, or is the last of the document
            last = np.minimum(self.offsets[self.doc + 1] - LENGTH, n - 1)
            self.low, self.high = low, np.minimum(np.append(low[1:] - 1, n), last)
            self.place = chosen[low]
            self.name = self.grams[self.place]
            end = self.high + LENGTH - GRAM
            context = self.grams[low] * C1
            for step in (GRAM, 2 * GRAM, 3 * GRAM):
                context = wb.mixed(context ^ self.grams[np.minimum(low + step, end)]) * C2
            shape = ((self.place - low) * 1000 + self.high - low).astype(np.uint64)
            self.context = wb.mixed(context ^ shape * C1)
            self.first = np.searchsorted(self.doc, np.arange(docs + 1))
        self.number = np.arange(len(self.doc)) - self.first[self.doc]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, name, second name) of all windows of some samples."""
        count = (self.high - self.low + 1)[which]
        start = np.repeat(self.low[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        doc = np.repeat(self.doc[which], count)
        g = self.grams
        a = wb.mixed(g[start] * C1 ^ wb.mixed(g[start + GRAM] * C2 ^ g[start + LENGTH - GRAM]))
        b = wb.mixed(g[start] * C2 ^ wb.mixed(g[start + GRAM] * C1 + g[start + LENGTH - GRAM] * C2))
        return doc, start, a, b


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def each_chunk(b: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, Samples]]:
    data, offsets = wb.text_bytes(b.column(text))
    for i, j in wb.chunks(offsets):
        yield i, j, Samples(data[offsets[i] : offsets[j]], offsets[i : j + 1])


NAMES = "name long, context long, id long, sub long, at int, window boolean"


def name_rows(base: DataFrame, hot: np.ndarray) -> DataFrame:
    """NAMES rows of all samples; hot names give the first of each of their windows in a chunk instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, s in each_chunk(b, 2):
                is_hot = np.isin(s.name, hot)
                cold = np.flatnonzero(~is_hot)
                yield pa.RecordBatch.from_arrays([signed(s.name[cold]), signed(s.context[cold]), pa.array(ids[i:j][s.doc[cold]]), pa.array(subs[i:j][s.doc[cold]]), pa.array(s.number[cold].astype(np.int32)), pa.array(np.zeros(len(cold), bool))], names=[f.split()[0] for f in NAMES.split(", ")])
                if is_hot.any():
                    yield first_windows(s, np.flatnonzero(is_hot), ids[i:j], subs[i:j])

    return base.select("id", "sub", "text").mapInArrow(run, NAMES)


def first_windows(s: Samples, which: np.ndarray, ids: np.ndarray, subs: np.ndarray) -> pa.RecordBatch:
    """NAMES rows of the windows of some samples, the first place of each window in the chunk."""
    doc, start, a, b = s.windows(which)
    at = start - s.offsets[doc]
    order = np.lexsort((at, subs[doc], ids[doc], b, a))
    a, b, doc, at = a[order], b[order], doc[order], at[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, doc, at = a[first], b[first], doc[first], at[first]
    return pa.RecordBatch.from_arrays([signed(a), signed(b), pa.array(ids[doc]), pa.array(subs[doc]), pa.array(at.astype(np.int32)), pa.array(np.ones(len(a), bool))], names=[f.split()[0] for f in NAMES.split(", ")])


def hot_names(base: DataFrame) -> np.ndarray:
    """Names that very many documents have, from a hash sample of documents; HOT of them at most."""
    some = base.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, s in each_chunk(b, 0):
                pair = np.unique(np.stack([s.doc.astype(np.uint64), s.name]), axis=1)
                names, n = np.unique(pair[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(names), pa.array(n)], names=["name", "n"])

    n = some.count()
    counts = some.select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= max(16, min(n // COMMON, HOT_DOCS))).orderBy(F.desc("n")).limit(HOT).collect()
    return np.array([r["name"] for r in rows], np.int64).view(np.uint64)


def first_lists(base: DataFrame, hot: np.ndarray, max_group: int) -> DataFrame:
    """(id, sub, firsts, shared, large, windows): for each document the numbers of its samples that are first in their
    context, of those whose name has several contexts (sorted next) or too many to be sorted in one place, and the
    starts of hot windows that are first."""
    by_context = Window.partitionBy("name", "context", "window").orderBy("id", "sub", "at")
    rows = name_rows(base, hot).repartition("name").withColumn("r", F.row_number().over(by_context)).where("r = 1").drop("r")
    rows = rows.withColumn("m", F.count("*").over(Window.partitionBy("name")))
    own, shared, large = ~F.col("window"), F.col("m") > 1, F.col("m") > max_group
    pick = lambda c: F.collect_list(F.when(c, F.col("at")))
    return rows.groupBy("id", "sub").agg(pick(own).alias("firsts"), pick(own & shared & ~large).alias("shared"), pick(own & large).alias("large"), pick(F.col("window")).alias("windows"))


def listed(s: Samples, lists: pa.Array, i: int, j: int) -> np.ndarray:
    """Indices of the samples whose numbers are in the lists of rows i to j."""
    part = lists.slice(i, j - i)
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0))
    return np.repeat(s.first[:-1], counts) + np.asarray(part.flatten(), np.int64)


CONTEXTS = "name long, right binary, left binary, id long, sub long, at int, near int, far int, place long"


def context_rows(docs: DataFrame) -> DataFrame:
    """CONTEXTS rows of the samples in ``shared``: bytes right of the sample and left of it (nearest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs, shared = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for i, j, s in each_chunk(b, 2):
                w = listed(s, shared, i, j)
                if not len(w):
                    continue
                p, doc = s.place[w], s.doc[w]
                ends = s.offsets[doc + 1]
                cols = p[:, None] + np.arange(LENGTH)
                right = np.where(cols < ends[:, None], s.data[np.minimum(cols, len(s.data) - 1)], 0).astype(np.uint8)
                cols = p[:, None] - 1 - np.arange(REACH - 1)
                left = np.where(cols >= s.offsets[doc][:, None], s.data[np.maximum(cols, 0)], 0).astype(np.uint8)
                fixed = lambda m: pa.array(np.ascontiguousarray(m).view(f"V{m.shape[1]}").ravel().tolist(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [signed(s.name[w]), fixed(right), fixed(left), pa.array(ids[i:j][doc]), pa.array(subs[i:j][doc]), pa.array(s.number[w].astype(np.int32)), pa.array((p - s.high[w]).astype(np.int32)), pa.array((p - s.low[w]).astype(np.int32)), pa.array(p - s.offsets[doc])],
                    names=[f.split()[0] for f in CONTEXTS.split(", ")],
                )

    return docs.select("id", "sub", "text", "shared").mapInArrow(run, CONTEXTS)


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for each range of one or more."""
    table, span = [values], high - low
    while 2 ** len(table) <= (int(span.max()) if len(span) else 0):
        t, step = table[-1], 2 ** (len(table) - 1)
        table.append(np.minimum(t[:-step], t[step:]))
    out = np.empty(len(low), values.dtype)
    level = np.frexp(span.astype(float))[1] - 1
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] - 2**k])
    return out


def induced(group: np.ndarray, right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Flags of repeated windows of samples that are sorted by group and right bytes.

    Bit o stands for the window that starts o bytes left of the sample; near and far bound the windows that a sample
    has. rank orders places; the window with the smallest rank is the first.
    """
    n = len(group)
    flags = np.zeros(n, np.int64)
    order = np.arange(n)
    same = group[1:] == group[:-1]
    equal = right[1:] == right[:-1]
    common = np.where(equal.all(axis=1), LENGTH, equal.argmin(axis=1))
    #: common[i]: common prefix of the suffixes in places i - 1 and i, 0 across groups
    common = np.concatenate([[0], np.where(same, common, 0)]).astype(np.int16)
    top = np.iinfo(np.int64).max
    for o in range(REACH):
        has = (near[order] <= o) & (o <= far[order])
        if has.any():
            starts = np.flatnonzero(common < LENGTH)
            held = np.where(has, rank[order], top)
            first = np.repeat(np.minimum.reduceat(held, starts), np.diff(np.append(starts, n)))
            flags[order[has & (held != first)]] |= np.int64(1) << np.int64(o)
        if o == REACH - 1 or not (far > o).any():
            break
        # one byte to the left: stable sort by that byte inside groups, common prefixes over the ranges between
        byte = left[order, o]
        perm = np.lexsort((byte, group[order]))
        joins = (group[order[perm[1:]]] == group[order[perm[:-1]]]) & (byte[perm[1:]] == byte[perm[:-1]])
        new = np.zeros(n, np.int16)
        at = np.flatnonzero(joins)
        if len(at):
            new[at + 1] = np.minimum(range_min(common, perm[at] + 1, perm[at + 1] + 1) + 1, LENGTH)
        order, common = order[perm], new
    return flags


FLAGS = "id long, sub long, at int, bits long"
#: Rows that are induced together, cut at the border of a name.
TOGETHER = 20_000


def window_flags(contexts: DataFrame) -> DataFrame:
    """FLAGS rows of the samples that have repeated windows."""
    dealt = contexts.repartition("name").sortWithinPartitions("name", "right")

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        name = t.column("name").to_numpy()
        bytes_of = lambda c, width: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, width)
        rank = np.empty(len(name), np.int64)
        rank[np.lexsort((t.column("place").to_numpy(), t.column("sub").to_numpy(), t.column("id").to_numpy()))] = np.arange(len(name))
        bits = induced(name, bytes_of("right", LENGTH), bytes_of("left", REACH - 1), t.column("near").to_numpy(), t.column("far").to_numpy(), rank)
        hit = np.flatnonzero(bits)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([*(pa.array(t.column(c).to_numpy()[hit]) for c in ("id", "sub", "at")), pa.array(bits[hit])], names=["id", "sub", "at", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            name = t.column("name").to_numpy()
            cut = int(np.searchsorted(name, name[-1]))
            if cut and (out := solve(t.slice(0, cut))) is not None:
                yield out
            held, rows = t.slice(cut).combine_chunks().to_batches(), len(name) - cut
        if rows and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return dealt.mapInArrow(run, FLAGS)


def large_windows(docs: DataFrame) -> DataFrame:
    """(id, sub, starts): of the samples in ``large``, the windows that are first; an aggregate over window names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs, large = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for i, j, s in each_chunk(b, 2):
                w = listed(s, large, i, j)
                if len(w):
                    yield first_windows(s, w, ids[i:j], subs[i:j])

    rows = docs.where(F.size("large") > 0).select("id", "sub", "text", "large").mapInArrow(run, NAMES)
    first = rows.groupBy("name", "context").agg(F.min(F.struct("id", "sub", "at")).alias("f"))
    return first.groupBy(F.col("f.id").alias("id"), F.col("f.sub").alias("sub")).agg(F.collect_list("f.at").alias("starts"))


def covered_bytes(s: Samples, i: int, j: int, lists: dict[str, pa.Array], hot: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk lie under repeated windows."""
    first = np.zeros(len(s.doc), bool)
    first[listed(s, lists["firsts"], i, j)] = True
    by_window = np.isin(s.name, hot)
    by_window[listed(s, lists["large"], i, j)] = True
    delta = np.zeros(len(s.data) + 1, np.int32)

    def cover(low: np.ndarray, high: np.ndarray) -> None:
        np.add.at(delta, low, 1)
        np.add.at(delta, high + LENGTH, -1)

    again = ~first & ~by_window
    cover(s.low[again], s.high[again])
    # windows that are looked at one by one: those that are not listed as first
    if by_window.any():
        known = np.zeros(len(s.data) + 1, bool)
        for name in ("windows", "starts"):
            part = lists[name].slice(i, j - i)
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0))
            known[np.repeat(s.offsets[:-1], counts) + np.asarray(part.flatten(), np.int64)] = True
        _, start, _, _ = s.windows(np.flatnonzero(by_window))
        start = start[~known[start]]
        cover(start, start)
    part = lists["flags"].slice(i, j - i)
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0))
    if counts.sum():
        flat = part.flatten()
        at = np.repeat(s.first[:-1], counts) + flat.field("at").to_numpy().astype(np.int64)
        bits = flat.field("bits").to_numpy()
        for o in range(REACH):
            w = at[(bits >> o) & 1 == 1]
            cover(s.place[w] - o, s.place[w] - o)
    return np.cumsum(delta[:-1]) > 0


LISTS = ("firsts", "large", "windows", "starts", "flags")


def base_rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """(id, sub, text) of the rows, (id, sub, doc, none) of the same rows, and whether ids are unique.

    sub tells rows with one id and different texts apart; it is 0 where ids are unique. doc holds the columns other
    than the text, none tells whether that is null.
    """
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST_ID)).alias("id"))
    unique = ids.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    body = whole_text(F.col(text))
    named = [F.coalesce(F.col(key).cast("long"), F.lit(FIRST_ID)).alias("id"), (F.lit(0).cast("long") if unique else F.xxhash64(body)).alias("sub")]
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    return docs.select(*named, body.alias("text")), docs.select(*named, others.alias("doc"), F.col(text).isNull().alias("none")), unique


def with_lists(docs: DataFrame, key: str, text: str, max_group: int) -> tuple[DataFrame, np.ndarray]:
    """The rows (id, doc, none, text) with all lists that say what is repeated in them, and the hot names.

    The lists of step 1 are written to the shared folder. The texts are shuffled once, by document; that shuffle
    serves step 2 and step 3, and what else is joined by document is small.
    """
    spark = docs.sparkSession
    base, others, unique = base_rows(docs, key, text)
    hot = hot_names(base)
    path = new_folder(spark, "repeats")
    first_lists(base, hot, max_group).write.parquet(path)
    lists = spark.read.parquet(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartition(parts, "id", "sub")
    if not unique:
        dealt = dealt.dropDuplicates(["id", "sub"])
    rows = dealt.join(lists, ["id", "sub"], "left")
    flags = window_flags(context_rows(rows.where(F.size("shared") > 0)))
    flags = flags.groupBy("id", "sub").agg(F.collect_list(F.struct("at", "bits")).alias("flags"))
    rows = rows.join(flags, ["id", "sub"], "left")
    if lists.where(F.size("large") > 0).isEmpty():
        rows = rows.withColumn("starts", F.array().cast("array<int>"))
    else:
        rows = rows.join(large_windows(dealt.join(lists, ["id", "sub"])), ["id", "sub"], "left")
    return rows.join(others, ["id", "sub"]), hot


def removal(docs: DataFrame, key: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, hot = with_lists(docs, key, text, max_group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {n: b.column(2 + k) for k, n in enumerate(LISTS)}
            size, gone, spans, digests = [], [], [], []
            for i, j, s in each_chunk(b, 1):
                cover = covered_bytes(s, i, j, lists, hot)
                begins = cover.copy()
                begins[1:] &= ~cover[:-1]
                edges = s.offsets[:-1][np.diff(s.offsets) > 0]
                begins[edges] = cover[edges]
                count = lambda f, o=s.offsets: np.diff(np.concatenate([[0], np.cumsum(f)])[o])
                size.append(np.diff(s.offsets))
                gone.append(count(cover))
                spans.append(count(begins))
                for x, y in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
                    digests.append(hashlib.sha256(s.data[x:y][~cover[x:y]].tobytes()).hexdigest())
            whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), whole(size), whole(gone), whole(spans), pa.array(digests, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = F.col("doc")[key].cast("long").alias("id")
    return rows.select(own, "text", *LISTS).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """The rows with repeated strings cut out of their texts, at character borders inside the repeated bytes."""
    rows, hot = with_lists(docs, key, text, max_group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {n: b.column(2 + k) for k, n in enumerate(LISTS)}
            left = []
            for i, j, s in each_chunk(b, 1):
                cover = covered_bytes(s, i, j, lists, hot)
                # a character stays whole unless all its bytes are covered
                begin = np.flatnonzero((s.data & 0xC0) != 0x80)
                if len(begin):
                    cover = np.repeat(np.logical_and.reduceat(cover, begin), np.diff(np.append(begin, len(cover))))
                for x, y in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
                    left.append(s.data[x:y][~cover[x:y]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string()), b.column(7)], names=["doc", "left", "none"])

    kind = rows.schema["doc"].dataType.simpleString()
    out = rows.select("doc", "text", *LISTS, "none").mapInArrow(run, f"doc {kind}, left string, none boolean")
    return out.select(*(F.when(~F.col("none"), F.col("left")).alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))
