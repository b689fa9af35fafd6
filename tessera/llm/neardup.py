"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is the hashes of its different runs of ``shingle`` words. Its sketch is the ``k`` smallest of them.

1. Documents with equal sets form a class, found by an aggregate over two set digests; only the smallest id of a
   class goes on.
2. Inverted lists of retained values generate overlaps. If two sets reach the threshold, their sketches share at
   least ``least_shared(k)`` values, but for a chance of 1e-9, so they share one of the rarest k - least_shared + 1
   values of each, in order of document frequency. Only these rarest values make lists. A value that a third of
   all documents retain is thus left out, except in documents made mostly of such values.
3. Each list is compared around a hub, its document with the most frequent sketch values, which in a group of near
   copies is close to what they were copied from. A row (hub, document) carries a set once, and blocks of a large group
   carry the hub's set along, so what is shuffled grows with the lists, not with pairs. The union-sketch estimate filters
   (again with a chance of loss of 1e-9), exact Jaccard on full sets verifies. A hub is then done in its list, and so
   is, after components are taken, a list whose documents are all in one.
4. What is left are pairs with an end outside the largest component of a list. These ends are compared with their whole
   lists, in blocks of both: one block of ends, as a rule, so that sets are again sent once.
   Only a dense group whose documents share half of their sketches and are not linked has many blocks of both, and its
   candidates are quadratic by nature. A task returns a spanning forest of its links, never all pairs.
5. Components of the links by label spreading with pointer jumps.

Defined cases: null and blank texts have an empty set, linked with nothing; texts under ``shingle`` words have one
shingle, the whole sequence; repeated rows are one class; rows that share an id are one document in links; rows with
a null id link with nothing and have a null component; other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordbytes as wb
from tessera.llm.shared import cut, new_folder

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Chance that a pair at the threshold is lost in each statistical step.
LOSS = 1e-9
#: Bytes of full sets, and documents, in one block of a group.
BLOCK_BYTES, BLOCK_ROWS = 1_000_000, 500


@dataclass(frozen=True)
class Near:
    """shingle: words in a shingle; percent: least Jaccard index in percent; k: values in a sketch."""

    shingle: int = 5
    percent: int = 80
    k: int = 48


@lru_cache
def least_shared(k: int, percent: int) -> int:
    """Values of k that two sketches share at least, at the threshold, with a chance of LOSS to be wrong."""
    p, total = percent / 100, 0.0
    for x in range(k + 1):
        total += comb(k, x) * p**x * (1 - p) ** (k - x)
        if total >= LOSS:
            return x
    return k


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of every document of some concatenated texts."""
    for i, j in wb.chunks(offsets):
        c = wb.Chunk(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1])
        words = c.word_hashes()
        found = wb.runs(words, shingle)
        for a, b in zip(c.word_at[:-1].tolist(), c.word_at[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(found[a : b - shingle + 1])
            elif b > a:
                yield wb.runs(words[a:b], b - a) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def sketches(docs: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """(id, n, h1, h2, sketch) of every row; h1 and h2 are digests of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, parts = [], [], [], []
            for s in sets_of(*wb.text_bytes(b.column(1)), near.shingle):
                n.append(len(s))
                h1.append(int(s.sum().view(np.int64)) if len(s) else 0)
                h2.append(int(wb.mixed(s + wb.BASE).sum().view(np.int64)) if len(s) else 0)
                parts.append(s[: near.k].view(np.int64))
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)) if parts else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], names=["id", "n", "h1", "h2", "sketch"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, h1 long, h2 long, sketch array<long>")


def prefix_lists(reps: DataFrame, near: Near) -> DataFrame:
    """(value, id, n, w): the rarest retained values of each document; w is high where its sketch is often retained."""
    values = reps.select("id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    often = cut(values.groupBy("value").agg(F.count("*").alias("df")).where(F.col("df") > 1))
    shared = values.join(often, "value").groupBy("id", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("w"))
    # small sets are retained whole, with all sets they can be linked with: the bound on their overlap is exact
    exact = F.col("n") * 100 <= near.k * near.percent
    need = F.when(exact, F.ceil(F.col("n") * near.percent / 100)).otherwise(least_shared(near.k, near.percent))
    length = F.col("s") - F.least(need, F.col("s")) + 1 - (F.col("s") - F.size("v"))
    kept = shared.select("id", "n", "w", F.explode(F.slice("v", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("e"))
    return kept.select(F.col("e.value").alias("value"), "id", "n", "w")


def full_sets(docs: DataFrame, wanted: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """(id, items): the whole sets of the wanted documents, as the bytes of sorted hashes, written once."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [s.tobytes() for s in sets_of(*wb.text_bytes(b.column(1)), near.shingle)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.binary())], names=["id", "items"])

    path = new_folder(docs.sparkSession, "near-sets")
    rows.join(wanted, "id").select("id", "text").mapInArrow(run, "id long, items binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def open_lists(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The lists of several components, with component c of each row and the largest of the list, top."""
    c = F.coalesce("component", "id").alias("c")
    named = cut(lists.join(label, "id", "left").select("value", "id", "n", "w", c))
    sizes = named.groupBy("value", "c").agg(F.count("*").alias("size"))
    top = sizes.groupBy("value").agg(F.max(F.struct("size", "c")).alias("t"), F.count("*").alias("parts"))
    return named.join(top.where("parts > 1").select("value", F.col("t.c").alias("top")), "value")


def fits(near: Near, n: Column, m: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * near.percent


def star_pairs(lists: DataFrame, near: Near) -> DataFrame:
    """(hub, hub_n, id, n): the different pairs of lists with a hub, in which they can be linked."""
    pair = (F.col("c") != F.col("hub.c")) & fits(near, F.col("n"), F.col("hub.n"))
    return lists.where(pair).groupBy(F.col("hub.id").alias("hub"), "id").agg(F.max("hub.n").alias("hub_n"), F.max("n").alias("n"))


def with_hubs(lists: DataFrame, outside: Column) -> DataFrame:
    """Lists of two or more with a hub, the member with the largest w (then the smallest id) of those that may be one."""
    best = F.max(F.when(outside, F.struct("w", (-F.col("id")).alias("low"), "id", "n", "c"))).alias("hub")
    hubs = lists.groupBy("value").agg(best, F.count("*").alias("held")).where("hub is not null and held > 1")
    return cut(lists.join(hubs.drop("held"), "value"))


def star_links(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """(a, b): the pairs (hub, id) that are linked. Every set is sent once for each of its hubs, a hub's to each block."""
    pairs = cut(pairs)
    size = F.greatest(F.lit(BLOCK_BYTES), F.max("hub_n") * 32)
    blocks = F.greatest(F.ceil(F.sum("n") * 8 / size), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    hubs = pairs.groupBy("hub").agg(blocks.alias("blocks"))
    place = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    members = pairs.join(hubs, "hub").select("hub", place, "id", F.lit(1).alias("member"))
    centres = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("id"), F.lit(0).alias("member"))
    dealt = members.unionByName(centres).join(sets, "id").repartition("hub", "block").sortWithinPartitions("hub", "block", "member", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            found = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            linked = hub_links(found, near)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(linked), t.column("hub")[0].as_py())), pa.array(t.column("id").to_numpy()[linked])], names=["a", "b"])

    return dealt.select("hub", "block", "id", "items").mapInArrow(run, "a long, b long")


def hub_links(sets: list[np.ndarray], near: Near) -> np.ndarray:
    """Places of the sets that are linked to the first one."""
    hub, sizes = sets[0], np.array([len(s) for s in sets])
    table, lengths = padded(sets, near.k)
    others = np.arange(1, len(sets))
    sure = np.maximum(sizes[others], sizes[0]) < near.k
    others = others[sure | (estimated(table, lengths, 0, others, near.k) >= least_shared(near.k, near.percent))]
    if not len(others):
        return others
    flat = np.concatenate([sets[i] for i in others])
    inside = hub[np.minimum(np.searchsorted(hub, flat), len(hub) - 1)] == flat
    both = np.add.reduceat(inside.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
    return others[both * 100 >= near.percent * (sizes[others] + sizes[0] - both)]


def padded(sets: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A table of the sets' sketches, and their lengths."""
    table = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(sets):
        table[i, : min(k, len(s))] = s[:k]
    return table, np.minimum([len(s) for s in sets], k)


def shares(sets: list[np.ndarray], x: int, others: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Size of the intersection of set ``x`` with each of ``others``."""
    values, at, owner = postings
    where = np.searchsorted(values, sets[x])
    spans = [owner[a:b] for a, b in zip(at[where].tolist(), at[where + 1].tolist(), strict=True)]
    return np.bincount(np.concatenate(spans), minlength=len(sets))[others]


def estimated(table: np.ndarray, lengths: np.ndarray, x: int, others: np.ndarray, k: int) -> np.ndarray:
    """Values that the union sketch of ``x`` and each other set has in both; table rows are padded sketches."""
    own = table[x, : lengths[x]]
    rows = table[others]
    place = np.searchsorted(own, rows)
    common = own[np.minimum(place, len(own) - 1)] == rows
    common &= np.arange(table.shape[1]) < lengths[others, None]
    before = np.cumsum(common, axis=1) - common
    return (common & (np.arange(table.shape[1]) + place - before < k)).sum(axis=1)


def task_links(ids: np.ndarray, sets: list[np.ndarray], component: np.ndarray, ends: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """A spanning forest of the links between components among the sets of one task, with an end in ``ends``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    k, need = near.k, least_shared(near.k, near.percent)
    table, lengths = padded(sets, k)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    values, first = np.unique(flat[order], return_index=True)
    postings = (values, np.append(first, len(flat)), owner)
    root = component.copy()
    found: list[tuple[int, int]] = []

    def compare(x: int) -> None:
        others = np.flatnonzero(root != root[x])
        fits = (sizes[others] * 100 >= near.percent * sizes[x]) & (sizes[x] * 100 >= near.percent * sizes[others])
        others = others[fits]
        if not len(others):
            return
        # the estimate holds where the union fills a sketch; smaller sets are compared exactly at once
        sure = np.maximum(sizes[others], sizes[x]) < k
        others = others[sure | (estimated(table, lengths, x, others, k) >= need)]
        if not len(others):
            return
        both = shares(sets, x, others, postings)
        linked = others[both * 100 >= near.percent * (sizes[others] + sizes[x] - both)]
        for y in linked.tolist():
            if root[y] != root[x]:
                found.append((int(ids[x]), int(ids[y])))
                root[root == root[y]] = root[x]

    for x in ends.tolist():
        compare(x)
    return found


def whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The rows of each key (the first ``width`` columns), from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(width)), strict=True))
        start = 0
        for i, k in enumerate(keys):
            if k != key:
                if held or i > start:
                    yield pa.Table.from_batches([*held, *([b.slice(start, i - start)] if i > start else [])])
                held, start, key = [], i, k
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def rest_tasks(lists: DataFrame) -> DataFrame:
    """(hub, i, j, id, c, end): tasks of what the hubs did not settle. i counts blocks of ends, j blocks of all members.

    ``lists`` has hubs and top; a list is known by its hub, so that equal lists are one group.
    """
    end = F.max((F.col("c") != F.col("top")).cast("int")).alias("end")
    members = cut(lists.groupBy(F.col("hub.id").alias("hub"), "id").agg(F.max("n").alias("n"), F.max("c").alias("c"), end))
    blocks = lambda rows, size: F.greatest(F.lit(1), F.ceil(size * 8 / (4 * BLOCK_BYTES)), F.ceil(rows / BLOCK_ROWS)).cast("int")
    groups = members.groupBy("hub").agg(blocks(F.sum("end"), F.sum(F.col("n") * F.col("end"))).alias("ni"), blocks(F.count("*"), F.sum("n")).alias("nj"))
    placed = members.join(groups, "hub")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    ends = placed.where("end = 1").select("hub", own("ni").alias("i"), every("nj").alias("j"), "id", "c", F.lit(1).alias("end"))
    others = placed.select("hub", every("ni").alias("i"), own("nj").alias("j"), "id", "c", F.lit(0).alias("end"))
    return ends.unionByName(others).groupBy("hub", "i", "j", "id", "c").agg(F.max("end").alias("end"))


def rest_links(tasks: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """(a, b): links between components in the tasks, enough of them to connect what the threshold connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 3):
            if t.num_rows > 1:
                sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
                component = np.unique(t.column("c").to_numpy(), return_inverse=True)[1]
                found = task_links(t.column("id").to_numpy(), sets, component, np.flatnonzero(t.column("end").to_numpy()), near)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = tasks.join(sets, "id").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id")
    return dealt.select("hub", "i", "j", "id", "c", "end", "items").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """(id, component) of the representatives that are linked."""
    hubbed = with_hubs(cut(prefix_lists(reps, near)).withColumn("c", F.col("id")), F.lit(True))
    sets = full_sets(docs, hubbed.select("id").distinct(), near, key, text)
    found = cut(star_links(star_pairs(hubbed, near), sets, near))
    label = components(found)
    # a hub has been compared with all of its list
    left = open_lists(hubbed.where(F.col("id") != F.col("hub.id")).select("value", "id", "n", "w"), label)
    rest = with_hubs(left, F.col("c") != F.col("top"))
    if rest.isEmpty():
        return label
    more = cut(rest_links(rest_tasks(rest), sets, near))
    return label if more.isEmpty() else components(found.unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge can reach.

    Every round takes the smallest label among the neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of the longest path.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("c")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        step = label.join(near, "id").select("id", "c", F.least("c", "m").alias("m"))
        jump = step.join(label.select(F.col("id").alias("m"), F.col("c").alias("mm")), "m", "left")
        new = cut(jump.select("id", "c", F.least("m", F.coalesce("mm", "m")).alias("to")))
        done = new.where(F.col("to") < F.col("c")).isEmpty()
        label = new.select("id", F.col("to").alias("c"))
        if done:
            return label.withColumnRenamed("c", "component")


def near_duplicates(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    every = cut(sketches(docs, near, key, text))
    full = every.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = cut(full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("members")))
    reps = full.join(classes.select(F.col("rep").alias("id"), "n", "h1", "h2"), ["id", "n", "h1", "h2"]).dropDuplicates(["id", "n", "h1", "h2"]).select("id", "n", "sketch")
    label = links(docs, cut(reps), near, key, text)
    named = classes.join(label, classes["rep"] == label["id"], "left").select("n", "h1", "h2", "members", F.coalesce("component", "rep").alias("component"))
    # only classes of several documents or with links have to be looked up
    named = cut(named)
    out = every.select("id", "n", "h1", "h2").join(named.select("n", "h1", "h2", "component"), ["n", "h1", "h2"], "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"), (own.isNull() | (own == F.col("id"))).alias("kept"))


def kept_documents(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; null ids stay."""
    found = near_duplicates(docs, near, key, text)
    gone = cut(found.where(~F.col("kept")).select(F.col("id").alias(key)).distinct())
    return docs.join(gone, key, "left_anti").select(docs.columns)
