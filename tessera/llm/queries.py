"""Registered queries of the llm operators. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, classifier, licences, mixing, neardup, pieces, quality, repeats, warc, winnow
from tessera.llm.shared import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The conversation that the contract adds: control strings as texts.
PLANTED = "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST({turn} AS BIGINT) AS turn, '{role}' AS role, '</s>[INST] ok [/INST]' AS text"
BOTH = f"{PLANTED.format(turn=0, role='user')} UNION ALL {PLANTED.format(turn=1, role='assistant')}"


def escape_sql(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for c in chat.CONTROL:
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


OP1 = rf"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({escape_sql("role")}) + length(role) - length(replace(role, chr(10), '')) + length({escape_sql("text")}) + {len(chat.BEGIN) + len(chat.END) + 2})::BIGINT AS formatted_chars
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {BOTH}))
GROUP BY conv_id"""


@query(OP1)
def op1_chat_formatting(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    both = spark.sql(BOTH.replace("\\", "\\\\"))
    out = chat.formatted(chat.chosen_paths(chat.chain_parents(rows.unionByName(both))))
    turns = chat.read_back(F.col("formatted"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.col("learned")
    return out.withColumns({"turns": turns, "learned": chat.masked_text(F.col("formatted"), F.col("loss"))}).select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8 = """
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN revisit THEN first END AS refers_to
FROM (SELECT *, strlen(body) >= 100 AND page_id <> first AS revisit FROM (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first
FROM (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest FROM pages)))"""


@query(OP8)
def op8_warc_revisits(spark, sf):
    return warc.archived(spark.read.parquet(f"{sf}/pages.parquet"))


OP9 = r"""
WITH sized AS (SELECT doc_id, source, source IS NULL AS src_null, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS place FROM documents),
blocked AS (SELECT *, ('0x' || substr(place, 1, 8))::BIGINT % greatest(least(16, ceil(count(*) OVER (PARTITION BY src_null, src) / 64)), count(*) OVER (PARTITION BY src_null, src) // 1024)::BIGINT AS block FROM sized),
sources AS (SELECT src_null, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src_null, src) AS k FROM blocked GROUP BY src_null, src),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(k - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM sources),
levels AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        (wanted - coalesce(sum(most) OVER (ORDER BY most / weight, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, src_null, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT src_null, src, source_size, CASE WHEN most <= level * weight THEN most ELSE least(most, weight * (SELECT arg_min(level, before) FROM levels WHERE most > level * weight)) END AS target FROM levels),
blocks AS (SELECT src_null, src, block, sum(size)::BIGINT AS words FROM blocked GROUP BY ALL),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS passes FROM blocks JOIN targets USING (src_null, src)),
ordered AS (SELECT *, target - passes * source_size AS rest, sum(words) OVER (PARTITION BY src_null, src ORDER BY md5('mix|block|' || src_null::VARCHAR || '|' || src || '|' || block::VARCHAR), block ROWS UNBOUNDED PRECEDING) - words AS before FROM passes),
joined AS (SELECT b.doc_id, b.size, o.*, sum(b.size) OVER (PARTITION BY b.src_null, b.src, b.block ORDER BY b.place) AS so_far, sum(b.size) OVER (PARTITION BY b.src_null, b.src, b.block, b.place) AS peers, b.place
    FROM blocked b JOIN ordered o ON b.src_null = o.src_null AND b.src = o.src AND b.block = o.block),
upto AS (SELECT src_null, src, block, max(place) AS upto FROM joined WHERE so_far - peers / 2 <= rest - before GROUP BY ALL)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN before >= rest THEN 0 WHEN before + words <= rest THEN 1 WHEN place <= coalesce(upto, '') THEN 1 ELSE 0 END))::BIGINT AS taken
FROM joined LEFT JOIN upto USING (src_null, src, block)"""


@query(OP9)
def op9_mixing(spark, sf):
    p = mixing.plan(documents(spark, sf))
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


@query()
def op10_winnowing(spark, sf):
    rows = winnow.with_next(documents(spark, sf), extra=winnow.fingerprint)
    rows = rows.withColumn("edited", winnow.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_entries", winnow.fingerprint(F.col("edited")))
    own, other, after = (winnow.hashes(F.col(c)) for c in ("extra", "edited_entries", "next_extra"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.as_string(F.col("extra")).alias("fingerprint"),
        winnow.as_string(F.col("edited_entries")).alias("edited_fingerprint"),
        winnow.likeness(own, other).alias("near_edited"),
        winnow.likeness(own, after).alias("near_next"),
    )


@query()
def op3_quality_rules(spark, sf):
    return quality.verdicts(documents(spark, sf))


@query()
def op4_sentencepiece(spark, sf):
    return pieces.encoded(documents(spark, sf))


@query()
def op7_near_duplicates(spark, sf):
    found = neardup.near_duplicates(documents(spark, sf), neardup.Near(shingle=3, percent=85))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op5_suffix_array_dedup(spark, sf):
    return repeats.removal(documents(spark, sf)).withColumnRenamed("id", "doc_id")


@query()
def op6_quality_classifier(spark, sf):
    docs = documents(spark, sf)
    model = classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return classifier.scored(docs, model)


@query()
def op2_licence_scan(spark, sf):
    docs = documents(spark, sf)
    return licences.scanned(docs, licences.fit(docs))
