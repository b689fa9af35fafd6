"""Registered queries of the map/reduce workloads and their components, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import mapreduce as mr
from tessera.operators import workloads as wl
from tessera.sources.text import table
from tessera.streaming import counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WORDS = r"SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents"
WORD_COUNT = f"SELECT word, count(*) AS n FROM ({WORDS}) WHERE word <> '' GROUP BY word"


def words_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("word"))


def items_and_ratings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_type").alias("genres"))
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"))
    return part, line


RATED = """SELECT p_partkey AS item, p_name AS title, p_type AS genres, coalesce(s / c, 0.0) AS rating, coalesce(c, 0) AS rating_count
FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS s, count(l_quantity) AS c FROM lineitem GROUP BY 1) ON p_partkey = l_partkey"""


@query(WORD_COUNT)
def word_count(spark, sf):
    return wl.word_count(table(spark, sf, "documents"))


LONG = r"regexp_matches(line, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{15}')"
LONGEST = r"coalesce(list_max(list_transform(regexp_extract_all(line, '[\p{L}\p{Nl}]+'), lambda w: strlen(w))), 0)::INT"
LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"SELECT {LONGEST} AS longest, line FROM ({LINES}) WHERE {LONG}")
def grep_long_words(spark, sf):
    return wl.grep_long_words(table(spark, sf, "documents"))


@query(f"SELECT longest, count(*) AS n_lines, count(DISTINCT line) AS n_different FROM (SELECT {LONGEST} AS longest, line FROM ({LINES}) WHERE {LONG}) GROUP BY longest")
def grep_lines_per_length(spark, sf):
    rows = wl.grep_long_words(table(spark, sf, "documents"))
    return rows.groupBy("longest").agg(F.count("*").alias("n_lines"), F.count_distinct("line").alias("n_different"))


PAIRS = r"""SELECT ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM
(SELECT list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents {where}) WHERE len(ws) > 1)"""


@query(f"SELECT w2 AS word, count(DISTINCT w1) AS n FROM ({PAIRS.format(where='WHERE n_chars >= 200')}) GROUP BY w2")
def distinct_predecessors(spark, sf):
    """With a numeric predicate on a field, as the n-gram workload has one on its year; see distinct_predecessors_of_all."""
    docs = table(spark, sf, "documents").where(F.col("n_chars") >= 200)
    return wl.distinct_predecessors(wl.bigrams(docs))


@query(RATED)
def rating_aggregate(spark, sf):
    return wl.rating_aggregate(*items_and_ratings(spark, sf), "item")


@query(RATED)
def rating_aggregate_tagged_union(spark, sf):
    return wl.rating_aggregate_tagged(*items_and_ratings(spark, sf), "item")


@query(f"""SELECT genre, title, rating FROM (SELECT genre, title, rating, row_number() OVER (PARTITION BY genre ORDER BY rating DESC, item, title) AS r
FROM (SELECT *, unnest(string_split(title, ' ')) AS genre FROM ({RATED}) WHERE rating_count > 20)) WHERE r = 1""")
def best_per_token(spark, sf):
    rated = wl.rating_aggregate(*items_and_ratings(spark, sf), "item").withColumn("genres", F.col("title"))
    return wl.best_per_genre(rated, more_than=20, separator=" ", tie="item")


@query("""SELECT year(o_orderdate)::INT AS year, o_custkey AS title, string_agg(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))::VARCHAR, ','
ORDER BY CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))) AS vals FROM orders GROUP BY ALL""")
def values_by_year(spark, sf):
    price = F.round("o_totalprice", 2).cast("decimal(18,2)")
    g = wl.values_by_year(table(spark, sf, "orders"), F.year("o_orderdate"), "o_custkey", price)
    return g.select("year", "title", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("vals"))


@query(f"SELECT word AS key, repeat('test', count(*)::INT) AS joined FROM ({WORDS}) WHERE word <> '' GROUP BY word")
def concat_values(spark, sf):
    return wl.concat_values(words_of(spark, sf).select(F.col("word").alias("key"), F.lit("test").alias("value")))


HALF = r"""CASE WHEN unicode(substr(word, 1, 1)) > CASE WHEN regexp_matches(substr(word, 1, 1), '^\p{Ll}') THEN 109 ELSE 77 END THEN 1 ELSE 0 END"""


@query(f"SELECT word, {HALF}::INT AS pid FROM ({WORD_COUNT})")
def first_letter_partition(spark, sf):
    words = wl.word_count(table(spark, sf, "documents"))
    return words.select("word", tx.first_letter_half(F.col("word")).alias("pid"))


def digit_sql(place: int) -> str:
    c = f"substr(word, {place}, 1)"
    return f"CASE WHEN {c} = '' THEN 0 WHEN unicode({c}) < 128 AND instr('{tx.BASE36_DIGITS}', lower({c})) > 0 THEN instr('{tx.BASE36_DIGITS}', lower({c})) - 1 ELSE 37 END"


BUCKET = f"""SELECT word, (CASE WHEN b >= 37 THEN hi ELSE lo + (b * (hi - lo)) // 37 END)::INT AS bucket FROM (SELECT *,
CASE WHEN a >= 37 THEN 200 ELSE (a * 200) // 37 END AS lo, CASE WHEN a + 1 >= 37 THEN 200 ELSE ((a + 1) * 200) // 37 END AS hi
FROM (SELECT word, {digit_sql(1)} AS a, {digit_sql(2)} AS b FROM ({WORDS}) WHERE word <> ''))"""


@query(f"SELECT bucket, count(*) AS n, count(DISTINCT word) AS n_words FROM ({BUCKET}) GROUP BY bucket")
def alphabetic_buckets(spark, sf):
    # the bucket is worked out once for each different word
    b = wl.word_count(table(spark, sf, "documents")).select("n", tx.alpha_bucket(F.col("word")).alias("bucket"))
    return b.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("n_words"))


@query("SELECT year(l_shipdate)::INT AS pid, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM lineitem GROUP BY 1")
def partition_by_year(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("int").alias("pid"), "l_orderkey")
    return rows.groupBy("pid").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


def word_job(combine: bool) -> mr.JobSpec:
    def mapper(path: str, value: str):
        return ((w, 1) for w in value.split())

    def add(key, values):
        return [sum(values)]

    return mr.JobSpec(mapper, add, mr.hash_partitioner(15), add if combine else None, value_type="long", output_type="long", streams=True)


def as_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("value"))


def counted(spark: SparkSession, sf: str, combine: bool) -> DataFrame:
    out = mr.run_job(word_job(combine), as_rows(table(spark, sf, "documents")))
    return out.select(F.col("key").alias("word"), F.col("values")[0].alias("n"))


@query(WORD_COUNT)
def generic_job_word_count(spark, sf):
    return counted(spark, sf, combine=False)


@query(WORD_COUNT)
def generic_job_word_count_combined(spark, sf):
    return counted(spark, sf, combine=True)


@query(f"SELECT w2 AS word, count(DISTINCT w1) AS n FROM ({PAIRS.format(where='')}) GROUP BY w2")
def generic_job_distinct_predecessors(spark, sf):
    def mapper(path: str, value: str):
        w = value.split()
        return zip(w[1:], w[:-1], strict=True)

    job = mr.JobSpec(mapper, lambda k, v: [len(set(v))], lambda k, v: tx.alpha_bucket(k).cast("long"), lambda k, v: set(v), output_type="long", streams=True)
    out = mr.run_job(job, as_rows(table(spark, sf, "documents")))
    return out.select(F.col("key").alias("word"), F.col("values")[0].alias("n"))


@query("SELECT event_type, user_id % 4 AS pid, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def value_aware_groups(spark, sf):
    """The group key is (partition, key) when the partitioner looks at the value."""
    e = table(spark, sf, "events").withColumn("pid", F.col("user_id") % 4)
    return e.groupBy("event_type", "pid").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, user_id % 4 AS pid, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def generic_job_value_partitions(spark, sf):
    """The generic job with a partitioner that looks at the value, and a set as its combiner."""

    def mapper(path: str, value: str):
        return [(path, int(value))]

    job = mr.JobSpec(mapper, lambda k, v: [len(set(v))], lambda k, v: v % 4, lambda k, v: sorted(set(v)), value_type="long", output_type="long", streams=True)
    rows = table(spark, sf, "events").select(F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("value"))
    return mr.run_job(job, rows).select(F.col("key").alias("event_type"), "pid", F.col("values")[0].alias("users"))


@query(RATED)
def rating_aggregate_from_lines(spark, sf):
    """Lines of both kinds, told apart by their number of fields."""
    item = table(spark, sf, "part").select(F.concat_ws(",", "p_partkey", "p_name", "p_type").alias("value"))
    rating = table(spark, sf, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber").alias("value"))
    return wl.rated_from_lines(item.unionByName(rating))


DATED = f"SELECT item, title || ' (' || (1990 + item % 12)::VARCHAR || ')' AS title, replace(genres, ' ', '|') AS genres, rating, rating_count FROM ({RATED})"


def dated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregator's output as text lines, with titles that end in a year."""
    rated = wl.rating_aggregate(*items_and_ratings(spark, sf), "item")
    title = F.concat("title", F.lit(" ("), (F.col("item") % 12 + 1990).cast("string"), F.lit(")"))
    return wl.aggregate_lines(rated.withColumns({"title": title, "genres": F.replace("genres", F.lit(" "), F.lit("|"))}))


@query(f"""SELECT item::VARCHAR AS key, '"' || title || '","' || genres || '",' || regexp_replace(rating::VARCHAR, '\\.0$', '') || ',' || rating_count::VARCHAR AS value FROM ({DATED})""")
def aggregator_text(spark, sf):
    return dated_lines(spark, sf)


@query(f"""SELECT genre, title, rating FROM (SELECT genre, title, rating, row_number() OVER (PARTITION BY genre ORDER BY rating DESC, title) AS r
FROM (SELECT *, unnest(string_split(genres, '|')) AS genre FROM ({DATED})) WHERE rating_count > 20 AND rating > 0) WHERE r = 1""")
def best_per_genre_from_text(spark, sf):
    return wl.best_per_genre(wl.aggregate_records(dated_lines(spark, sf)), more_than=20)


@query(f"SELECT (1990 + item % 12)::INT AS year, title, rating FROM ({DATED})")
def ratings_by_title_year(spark, sf):
    by_year = wl.ratings_by_title_year(wl.aggregate_records(dated_lines(spark, sf)))
    return by_year.select("year", "title", F.explode("values").alias("rating"))


@query(r"SELECT o_orderkey, regexp_replace((o_totalprice * 1000)::VARCHAR, '\.0$', '') AS price FROM orders")
def plain_number_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.plain_number(F.col("o_totalprice") * 1000).alias("price"))


@query(r"SELECT doc_id, md5(regexp_replace(chr(10) || ' ' || text || chr(9), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def trimmed_text(spark, sf):
    padded = F.concat(F.lit("\n "), "text", F.lit("\t"))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.trimmed(padded)).alias("digest"))


@query(f"SELECT w2 AS word, count(DISTINCT w1) AS n FROM ({PAIRS.format(where='')}) GROUP BY w2")
def distinct_predecessors_of_all(spark, sf):
    return wl.distinct_predecessors(wl.bigrams(table(spark, sf, "documents")))


@query(r"""SELECT item, title, n FROM (SELECT p_partkey AS item, p_name AS title, len(string_split(p_name || ',' || p_brand || ',' || p_type, ',')) AS n FROM part) WHERE n = 3""")
def dispatch_by_field_count(spark, sf):
    part = table(spark, sf, "part")
    line = part.select(F.col("p_partkey").alias("item"), F.concat_ws(",", "p_name", "p_brand", "p_type").alias("value"))
    cut = line.select("item", tx.quoted_fields(F.col("value")).alias("f"))
    return cut.select("item", F.col("f")[0].alias("title"), F.size("f").cast("long").alias("n")).where("n = 3")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e') AND (starts_with(p_type, 'S') OR suffix(p_type, 'S')) AND p_size > 10")
def string_predicates(spark, sf):
    p = table(spark, sf, "part")
    hit = F.col("p_name").contains("e") & (F.col("p_type").startswith("S") | F.col("p_type").endswith("S")) & (F.col("p_size") > 10)
    return p.where(hit).select("p_partkey", "p_name")


@query("SELECT l_shipdate_year AS year, sum(q) AS total, count(*) AS n, sum(q) / count(*) AS mean FROM (SELECT year(l_shipdate)::INT AS l_shipdate_year, l_quantity AS q FROM lineitem WHERE year(l_shipdate) >= 1994) GROUP BY 1")
def sum_count_mean(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("int").alias("year"), F.col("l_quantity").alias("q")).where("year >= 1994")
    return rows.groupBy("year").agg(F.sum("q").alias("total"), F.count("*").alias("n"), (F.sum("q") / F.count("*")).alias("mean"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS priorities, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_order FROM orders GROUP BY o_custkey")
def distinct_and_arg_max(spark, sf):
    o = table(spark, sf, "orders")
    top = F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey"))
    return o.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("priorities"), F.max("o_totalprice").alias("best"), top.alias("best_order"))


@query("SELECT c_custkey, c_name, n_name, count(o_orderkey) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def left_join_counts(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    out = c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS place FROM (" + WORD_COUNT + ") ORDER BY n DESC, word LIMIT 20")
def most_frequent_words(spark, sf):
    """A top-k report; the ranks are taken after the limit, over twenty rows."""
    top = wl.word_count(table(spark, sf, "documents")).orderBy(F.desc("n"), "word").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long"))


LINES_SQL = r"SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\r$', '') AS line FROM documents"


@query(f"SELECT doc_id, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes, count(DISTINCT line) AS n_different FROM ({LINES_SQL}) GROUP BY doc_id")
def lines_per_document(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", tx.strip_cr(F.col("line")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"), F.count_distinct("line").alias("n_different"))


@query("""SELECT c_custkey, c_name AS name, c_mktsegment || ',' || c_nationkey::VARCHAR AS quoted, c_nationkey::VARCHAR AS nation FROM customer""")
def quoted_csv_fields(spark, sf):
    """Comma-separated lines with a quoted field that holds a comma; quotes are dropped, commas inside stay."""
    c = table(spark, sf, "customer")
    line = F.concat(F.col("c_name"), F.lit(',"'), F.col("c_mktsegment"), F.lit(","), F.col("c_nationkey").cast("string"), F.lit('",'), F.col("c_nationkey").cast("string"))
    cut = c.select("c_custkey", tx.quoted_fields(line).alias("f"))
    return cut.select("c_custkey", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("quoted"), F.get("f", F.lit(2)).alias("nation"))


@query("SELECT o_orderkey, o_orderstatus AS w1, o_orderpriority AS w2, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) >= 1995")
def blank_separated_records(spark, sf):
    """Records of blank-separated fields with a numeric predicate; a year that is no number fails the task."""
    o = table(spark, sf, "orders")
    value = F.concat_ws(" \t", "o_orderstatus", F.translate("o_orderpriority", " ", "·"), F.year("o_orderdate"))
    cut = o.select("o_orderkey", tx.tokens(value).alias("f"))
    cut = cut.select("o_orderkey", F.get("f", F.lit(0)).alias("w1"), F.translate(F.get("f", F.lit(1)), "·", " ").alias("w2"), F.get("f", F.lit(2)).cast("int").alias("year"))
    return cut.where("year >= 1995")


@query(f"SELECT word, n, 1 AS n_partitions, true AS in_range FROM ({WORD_COUNT})")
def hash_partition_invariants(spark, sf):
    """Each key lies in one hash partition, and every partition id is below the number of partitions."""
    words = words_of(spark, sf).withColumn("pid", mr.hash_partitioner(15)(F.col("word"), F.lit(1)))
    g = words.groupBy("word").agg(F.count("*").alias("n"), F.max("pid").alias("high"), F.min("pid").alias("low"))
    one = F.when(F.col("high") == F.col("low"), 1).otherwise(2).alias("n_partitions")
    return g.select("word", "n", one, ((F.col("high") < 15) & (F.col("low") >= 0)).alias("in_range"))


@query("SELECT c_mktsegment, c_name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'supplier', s_name FROM supplier WHERE s_acctbal > 0")
def union_all_of_sources(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select("c_mktsegment", "c_name")
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.lit("supplier").alias("c_mktsegment"), F.col("s_name").alias("c_name"))
    return c.unionByName(s)


@query("SELECT genre, count(*) AS n, max(r)::DOUBLE AS best FROM (SELECT unnest(string_split(p_type, ' ')) AS genre, p_retailprice AS r FROM part) WHERE genre <> '' GROUP BY genre")
def explode_and_maximum(spark, sf):
    p = table(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("genre"), F.col("p_retailprice").alias("r")).where("genre <> ''")
    return p.groupBy("genre").agg(F.count("*").alias("n"), F.max("r").alias("best"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return counts.event_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
