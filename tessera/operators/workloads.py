"""The seven named workloads as DataFrame plans, without Python in the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import has_long_word, longest_alpha_bytes, plain_number, quoted_fields, quoted_line, title_year, tokens, trimmed


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all tokens."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.split(F.col(text), "\n")).alias("line"))


def grep_long_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(longest, line): lines with a word of 15 or more characters, keyed by the byte length of their longest
    run of letters. The rows stay flat; ``grep_groups`` gathers them."""
    hits = lines_of(docs, text).where(has_long_word(F.col("line")))
    return hits.select(longest_alpha_bytes(F.col("line")).alias("longest"), "line")


def grep_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(longest, lines): the grouped form, for outputs whose groups are known to be small."""
    return grep_long_words(docs, text).groupBy("longest").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def bigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w1, w2) for adjacent tokens."""
    w = docs.select(tokens(F.col(text)).alias("w")).where(F.size("w") > 1)
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("w1"), F.slice("w", F.lit(2), F.size("w") - 1).alias("w2"))
    return w.select(F.inline(pairs).alias("w1", "w2"))


def distinct_predecessors(pairs: DataFrame) -> DataFrame:
    """(word, n): number of different w1 before each w2."""
    return pairs.groupBy(F.col("w2").alias("word")).agg(F.count_distinct("w1").alias("n"))


def rating_aggregate(items: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """Left join of items with the mean and number of their ratings; 0 and 0 without ratings."""
    sums = ratings.groupBy(key).agg(F.sum("rating").alias("s"), F.count("rating").alias("c"))
    mean = F.coalesce(F.col("s") / F.col("c"), F.lit(0.0))
    return items.join(sums, key, "left").select(key, "title", "genres", mean.alias("rating"), F.coalesce("c", F.lit(0)).alias("rating_count"))


def rating_aggregate_tagged(items: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """The same result from a union of both inputs and one grouping; unknown items are dropped."""
    both = items.select(key, "title", "genres").unionByName(ratings.select(key, "rating"), allowMissingColumns=True)
    g = both.groupBy(key).agg(
        F.max("title").alias("title"),
        F.max("genres").alias("genres"),
        F.coalesce(F.sum("rating") / F.count("rating"), F.lit(0.0)).alias("rating"),
        F.count("rating").alias("rating_count"),
    )
    return g.where(F.col("title").isNotNull())


def aggregate_lines(rated: DataFrame) -> DataFrame:
    """(key, value): the text output of the aggregator, ``"title","genres",rating,count``."""
    return rated.select(F.col(rated.columns[0]).cast("string").alias("key"), quoted_line([F.col("title"), F.col("genres")], [plain_number(F.col("rating")), F.col("rating_count").cast("string")]).alias("value"))


def aggregate_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """(title, genres, rating, rating_count) of such lines; blank lines and lines without four fields are passed over."""
    f = lines.select(quoted_fields(trimmed(F.col(value))).alias("f")).where(F.size("f") == 4)
    return f.select(F.col("f")[0].alias("title"), F.col("f")[1].alias("genres"), F.col("f")[2].cast("double").alias("rating"), F.col("f")[3].cast("long").alias("rating_count"))


def ratings_by_title_year(rated: DataFrame) -> DataFrame:
    """(year, title, values): the ratings of each title, in the year that its title names."""
    return values_by_year(rated, title_year(F.col("title")), "title", F.col("rating"))


def rated_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The aggregator over mixed lines: three fields are an item (id, title, genres), other numbers of fields a rating
    (field 1 the item's id, field 2 the rating)."""
    f = lines.select(quoted_fields(F.col(value)).alias("f"))
    is_item = F.size("f") == 3
    get = lambda i: F.get("f", F.lit(i))
    items = f.where(is_item).select(get(0).cast("long").alias("item"), get(1).alias("title"), get(2).alias("genres"))
    ratings = f.where(~is_item).select(get(1).cast("long").alias("item"), get(2).cast("double").alias("rating"))
    return rating_aggregate_tagged(items, ratings, "item")


def ordered_parts(rows: DataFrame, bucket: str, key: str, files: int) -> DataFrame:
    """Rows dealt to output files in ascending order of their bucket, each file sorted by key."""
    return rows.repartitionByRange(files, bucket).sortWithinPartitions(bucket, key)


def best_per_genre(rated: DataFrame, more_than: int = 100, separator: str = "|", tie: str | None = None) -> DataFrame:
    """(genre, title, rating): the best item of each genre among those rated more than ``more_than`` times.

    Ratings of zero or below and NaN never win. Ties go to the smallest ``tie`` column, then title. One aggregate
    with partial results, so no genre is gathered in one task.
    """
    ok = rated.where((F.col("rating_count") > more_than) & (F.col("rating") > 0) & ~F.isnan("rating"))
    cut = ok.withColumn("genre", F.explode(F.split("genres", f"[{separator}]")))
    rank = F.struct((-F.col("rating")).alias("r"), F.col(tie or "title").alias("t"), F.col("title").alias("title"), "rating")
    return cut.groupBy("genre").agg(F.min(rank).alias("b")).select("genre", "b.title", "b.rating")


def values_by_year(rows: DataFrame, year: Column, title: str, value: Column) -> DataFrame:
    """(year, title, values): all values of a title in a year, repeats kept, in order."""
    flat = rows.select(year.cast("int").alias("year"), F.col(title).alias("title"), value.alias("v"))
    return flat.groupBy("year", "title").agg(F.sort_array(F.collect_list("v")).alias("values"))


def concat_values(pairs: DataFrame) -> DataFrame:
    """(key, joined): string concatenation of the values of each key."""
    return pairs.groupBy("key").agg(F.concat_ws("", F.sort_array(F.collect_list("value"))).alias("joined"))


def top_per_key(rows: DataFrame, key: str, order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
