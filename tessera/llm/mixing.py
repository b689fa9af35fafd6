"""Mixing sources to target weights.

A source's documents fall into blocks by a hash of their id and text. What the mix takes of a source is its target in
words: some whole passes over the source, then a part of a further pass, made of blocks in a random order and, in
the last of them, of documents in hash order. A splitting tree then deals the block draws to the output shards:
at each node the draws of all sources are split in halves by an urn draw without replacement, so that the numbers by
source follow the multivariate hypergeometric law and add up exactly. The urns of all nodes are read from one random
order of the draws: the draws of a node are a range of it, and its left child has the first half of that range. At the
leaves each shard draws its quota of every source's permuted blocks; no two shards draw the same one. Rows are
shuffled inside their shard only.

A source has a block for 1024 documents (for 64 in small sources). Orders of blocks and draws are cut by their hash into
ranges of about RANGE rows, so that no task holds the blocks of a whole source; only the table of sources (a row of
about 100 bytes each, sorted externally) passes through one task, for the weights go by its order.

Defined cases: null or blank text has size 0; null sources form one source, the last; rows with equal ids and equal
texts stand or fall together, other rows of one id (or without one) do not; an empty table gives no rows; other
columns pass, but for one that has the name of the shard column, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, whole_text, word_count

DOCS_PER_BLOCK = 1024
#: Small sources have up to MIN_BLOCKS blocks, of SMALL documents or more.
MIN_BLOCKS, SMALL = 16, 64
#: Rows of one range of an order, about.
RANGE = 4096
#: A table of blocks or sources up to this many rows (of about 200 bytes) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 50_000

SOURCE = ["src_null", "src"]


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in order, repeating; share: of all words that the mix takes; cap: passes at most."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    shards: int = 16
    seed: str = "mix"


def unit(mix: Mix, *parts: Column) -> Column:
    """A random-looking hexadecimal string that orders things."""
    return F.md5(F.concat_ws("|", F.lit(mix.seed), *(p.cast("string") for p in parts)))


def named(docs: DataFrame, mix: Mix, key: str, text: str, source: str) -> DataFrame:
    """Adds the source as two columns without nulls, and the document's place in the order of its source."""
    return docs.withColumns(
        {
            "src_null": F.col(source).isNull(),
            "src": F.coalesce(F.col(source).cast("string"), F.lit("")),
            "place": unit(mix, F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(whole_text(F.col(text)))),
        }
    )


def small_broadcast(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def source_blocks(rows: DataFrame) -> DataFrame:
    """(src_null, src, blocks): the number of blocks of every source."""
    n = F.count("*")
    blocks = F.greatest(F.least(F.lit(MIN_BLOCKS), F.ceil(n / SMALL)), F.floor(n / DOCS_PER_BLOCK)).cast("int")
    return rows.groupBy(*SOURCE).agg(blocks.alias("blocks"))


def with_block(rows: DataFrame, sources: DataFrame) -> DataFrame:
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    return rows.join(sources, SOURCE).withColumn("block", (number % F.col("blocks")).cast("int")).drop("blocks")


def running(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, per_range: int = RANGE) -> DataFrame:
    """``df`` with ``after``, the sum of a value over the rows of a key up to this one in a hexadecimal random order.

    The order is cut into ranges; sums of whole ranges are added up first, then the rows inside each.
    """
    ranges = 1 << max(0, (df.count() // per_range).bit_length())
    inside = Window.partitionBy(*keys, "range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumns({"value": value, "range": F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * ranges / (1 << 32))})
    if ranges == 1:
        return held.withColumn("after", F.sum("value").over(inside)).drop("range", "value")
    sums = held.groupBy(*keys, "range").agg(F.sum("value").alias("whole"))
    sums = sums.withColumn("below", F.sum("whole").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole"))
    return held.join(sums.drop("whole"), [*keys, "range"]).withColumn("after", F.col("below") + F.sum("value").over(inside)).drop("range", "below", "value")


def targets(blocks: DataFrame, mix: Mix) -> DataFrame:
    """(src_null, src, source_size, target): shares by weight, the excess over the cap shared again.

    Sources are filled in the order of cap / weight: those whose cap lies below the common level stop at it.
    """
    s = blocks.groupBy(*SOURCE).agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(*SOURCE)
    w = F.get(F.array(*(F.lit(float(x)) for x in mix.weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(mix.weights))))
    s = s.withColumn("weight", w).withColumn("most", F.col("source_size") * float(mix.cap))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), *SOURCE)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    s = s.withColumns(
        {
            "capped_before": F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_from": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
            "wanted": F.sum("source_size").over(every) * mix.share,
        }
    )
    level = (F.col("wanted") - F.col("capped_before")) / F.col("weight_from")
    s = s.withColumn("level", level).withColumn("stops", F.col("most") <= F.col("level") * F.col("weight"))
    # the level of the first source that does not stop holds for all that follow
    s = s.withColumn("common", F.min(F.when(~F.col("stops"), F.struct(F.col("capped_before"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.least(F.col("common") * F.col("weight"), F.col("most")))
    return s.select(*SOURCE, "source_size", target.alias("target"))


def block_draws(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row for each block: passes over it, and how far the partial pass goes.

    passes: whole passes; in_part: whether the partial pass reads the block; upto: null, or the last place that it
    reads in it. ``sized`` has the columns of with_block and size.
    """
    blocks = cut(sized.groupBy(*SOURCE, "block").agg(F.sum("size").alias("words")))
    t = targets(blocks, mix)
    joined = blocks.join(t, SOURCE)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    joined = joined.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    joined = cut(joined.withColumn("order", unit(mix, F.lit("block"), *map(F.col, SOURCE), F.col("block"))))
    joined = cut(running(joined, SOURCE, "order", ["block"], F.col("words")).withColumn("before", F.col("after") - F.col("words")))
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    joined = joined.withColumns({"in_part": F.col("before") < F.col("rest"), "edge": edge})
    # in the block where the partial pass ends, documents count while half of them fits
    need = joined.where("edge").select(*SOURCE, "block", (F.col("rest") - F.col("before")).alias("need"))
    inside = sized.join(need, [*SOURCE, "block"])
    so_far = F.sum("size").over(Window.partitionBy(*SOURCE, "block").orderBy("place"))
    peers = F.sum("size").over(Window.partitionBy(*SOURCE, "block", "place"))
    fits = so_far - peers / 2 <= F.col("need")
    upto = inside.withColumn("fits", fits).groupBy(*SOURCE, "block").agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("place"))), F.lit("")).alias("upto"))
    keep = [*SOURCE, "block", "source_size", "target", "passes", "in_part"]
    return joined.join(upto, [*SOURCE, "block"], "left").select(*keep, "upto")


def leaf(rank: Column, total: Column, shards: int) -> Column:
    """Leaf of the splitting tree to which the draw at a rank (from 0) of the random order of all draws falls."""

    def below(first: Column, size: Column, node: int, leaves: int) -> Column:
        if leaves == 1:
            return F.lit(node)
        left = (leaves + 1) // 2
        half = F.round(size * left / leaves).cast("long")
        return F.when(rank < first + half, below(first, half, node, left)).otherwise(below(first + half, size - half, node + left, leaves - left))

    return below(F.lit(0).cast("long"), total, 0, shards)


def split_quotas(draws: DataFrame, mix: Mix) -> DataFrame:
    """(src_null, src, shard, quota): block quotas of every shard, from the splitting tree over the shards."""
    urn = cut(draws.select(*SOURCE, F.lit(0).alias("root"), unit(mix, F.lit("urn"), *map(F.col, SOURCE), F.col("block"), F.col("pass_no")).alias("order"), "block", "pass_no"))
    ranked = running(urn, ["root"], "order", [*SOURCE, "block", "pass_no"], F.lit(1))
    shard = leaf(F.col("after") - 1, F.lit(urn.count()).cast("long"), mix.shards)
    return ranked.groupBy(*SOURCE, shard.alias("shard")).agg(F.count("*").alias("quota"))


def deal(draws: DataFrame, mix: Mix) -> DataFrame:
    """The draws with ``full`` (shards of the whole passes) and ``part`` (shard of the partial one, or null)."""
    none = F.array().cast("array<int>")
    passes = F.concat(F.when(F.col("passes") > 0, F.sequence(F.lit(1), F.col("passes"))).otherwise(none), F.when(F.col("in_part"), F.array(F.lit(0))).otherwise(none))
    each = draws.select(*SOURCE, "block", F.explode(passes).alias("pass_no"))
    each = cut(each.withColumn("order", unit(mix, F.lit("draw"), *map(F.col, SOURCE), F.col("block"), F.col("pass_no"))))
    ranked = running(each, SOURCE, "order", ["block", "pass_no"], F.lit(1))
    # each shard takes the next of its source's permuted draws, as many as its quota says
    quotas = split_quotas(each, mix).groupBy(*SOURCE).agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("quotas"))
    upper = F.aggregate("quotas", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("shard")), lambda a, q: F.when(a["shard"].isNotNull(), a).otherwise(F.struct((a["sum"] + q["quota"]).alias("sum"), F.when(F.col("after") <= a["sum"] + q["quota"], q["shard"]).alias("shard"))), lambda a: a["shard"])
    held = ranked.join(quotas, SOURCE).withColumn("shard", upper)
    g = held.groupBy(*SOURCE, "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("pass_no") > 0, F.col("shard")))).alias("full"),
        F.max(F.when(F.col("pass_no") == 0, F.col("shard"))).alias("part"),
    )
    return draws.join(g, [*SOURCE, "block"], "left")


def draw(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The tables of dealt blocks and of the numbers of blocks of the sources."""
    small = docs.select(F.col(key).alias("id"), F.col(text).alias("body"), F.col(source).alias("from"))
    small = cut(named(small, mix, "id", "body", "from").withColumn("size", word_count(F.col("body"))).select(*SOURCE, "place", "size"))
    sources = cut(source_blocks(small))
    return cut(deal(block_draws(cut(with_block(small, small_broadcast(sources))), mix), mix)), sources


def taken_shards() -> Column:
    """Shards that get a copy of a row which is joined with its block."""
    in_part = F.col("part").isNotNull() & (F.col("upto").isNull() | (F.col("place") <= F.col("upto")))
    none = F.array().cast("array<int>")
    return F.concat(F.coalesce("full", none), F.when(in_part, F.array("part")).otherwise(none))


def located(docs: DataFrame, mix: Mix, key: str, text: str, source: str) -> DataFrame:
    """Rows (id, size, place, doc) with their block's draws; ``doc`` holds all columns of the row."""
    table, sources = draw(docs, mix, key, text, source)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body"), F.col(source).alias("from"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = named(rows, mix, "id", "body", "from").withColumn("size", word_count(F.col("body"))).drop("body", "from")
    return with_block(rows, small_broadcast(sources)).join(small_broadcast(table), [*SOURCE, "block"]).withColumn("shards", taken_shards())


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source", shard: str | None = "mix_shard") -> DataFrame:
    """The mix: the rows of ``docs``, as often as they are taken, shuffled inside their output shard, whose number is the
    last column (``shard`` None: it is left out)."""
    rows = located(docs, mix, key, text, source).select("place", "doc", F.posexplode("shards").alias("copy", "shard"))
    order = unit(mix, F.lit("row"), F.col("shard"), F.col("place"), F.col("copy"))
    # a shard's rows spread over several tasks by a piece of that order, so that no shard is one task
    dealt = rows.withColumn("order", order).repartition("shard", F.substring("order", 1, 4)).sortWithinPartitions("shard", "order")
    return dealt.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c != shard), *([F.col("shard").alias(shard)] if shard else []))


def plan(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of each row: id, size, source_size, target, taken (words, repeats counted), shards."""
    rows = located(docs.select(key, text, source), mix, key, text, source)
    return rows.select("id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
