"""The pipeline's stages against plain versions."""

import zlib
from collections import Counter

import pytest

import brute
import corpus_pipeline
from tessera.llm import licences, pieces, quality
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"file://{folder}/{i}")
        out.append((docs, spark.read.parquet(f"file://{folder}/{i}")))
        docs = out[-1][1]
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "repeated strings", "source mix", "token ids"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_each_stage(stages):
    rows = [([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()]) for a, b in stages]
    before, after = rows[0]
    keeps = {r["doc_id"] for r in quality.verdicts(stages[0][0]).collect() if r["kept"]}
    assert {r["doc_id"] for r in after} == keeps and len(after) < len(before)
    before, after = rows[1]
    want = brute.near_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {k for k, (_, c) in want.items() if k == c}
    before, after = rows[2]
    want = brute.repeats([(r["doc_id"], r["text"]) for r in before])
    for r in after:
        n, gone, spans, _ = want[r["doc_id"]]
        left = len(r["text"].encode())
        # characters that only lose some of their bytes stay
        assert n - gone <= left <= n - gone + 6 * spans
        assert r["n_chars"] == len(r["text"])
    before, after = rows[3]
    times = Counter(r["doc_id"] for r in after)
    assert set(times) <= {r["doc_id"] for r in before} and max(times.values()) <= 2
    before, after = rows[4]
    e = pieces.Encoder(pieces.Model())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == Counter((r["doc_id"], tuple(e.encode(r["text"]))) for r in before)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages[-1][1]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == Counter((r["doc_id"], tuple(r["ids"])) for r in want.collect())


def rows_by_count(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("at", range(5))
def test_stages_without_documents(spark, no_docs, at):
    out = corpus_pipeline.STAGES[at][1](spark, no_docs, SF)
    assert out.count() == 0
    if at < 4:
        assert out.columns == no_docs.columns


@pytest.mark.parametrize("at", range(5))
def test_stages_on_edges(spark, edge_docs, at):
    """Nulls in all columns, empty and long texts, ties, repeated rows, clashing names."""
    out = corpus_pipeline.STAGES[at][1](spark, edge_docs, SF)
    before, after = rows_by_count(edge_docs), rows_by_count(out)
    texts = Counter((r["doc_id"], r["text"] or "") for r in edge_docs.collect())
    if at == 0:
        fine = {r["doc_id"] for r in quality.verdicts(edge_docs).collect() if r["kept"]}
        assert after == Counter({r: n for r, n in before.items() if r[0] in {str(k) for k in fine}})
    elif at == 1:
        want = brute.near_components(sorted({k for k in texts if k[0] is not None}), 5, 80)
        # rows without id stay, and so do all rows of an id that stays
        stay = {str(k) for k, (_, c) in want.items() if k == c} | {"None"}
        assert after == Counter({r: n for r, n in before.items() if r[0] in stay})
    elif at == 2:
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in edge_docs.collect())
    elif at == 3:
        # a copy of a row with the same id and text is taken as often as the row
        assert all(n <= 2 * before[r] for r, n in after.items()) and after
    else:
        e = pieces.Encoder(pieces.Model())
        got = Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect())
        assert got == count_ids(texts, e)


def count_ids(texts, e):
    out = Counter()
    for (k, t), n in texts.items():
        out[k, tuple(e.encode(t))] += n
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_registered_near_duplicates(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op7_near_duplicates"](spark, SF).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute.near_components(documents, 3, 85).items()}


def test_registered_repeats(spark, documents):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op5_suffix_array_dedup"](spark, SF).collect()}
    assert got == brute.repeats(documents)


def test_registered_quality_rules(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, SF).collect()}
    assert rows.keys() == {k for k, _ in documents}
    for k, t in documents:
        n, chars, symbols, lines, again = brute.base_counts(t)
        r = rows[k]
        failed = n < 20 or 100 * again > 30 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, again, failed)
        assert not (failed and r["kept"])


def test_registered_pieces(spark, documents):
    e = pieces.Encoder(pieces.Model())
    got = {r["doc_id"]: tuple(r["ids"]) for r in QUERIES["op4_sentencepiece"](spark, SF).collect()}
    assert got == {k: tuple(e.encode(t or "")) for k, t in documents}


def test_registered_scores(spark, documents):
    rows = QUERIES["op6_quality_classifier"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {k for k, _ in documents}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_registered_licences(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op2_licence_scan"](spark, SF).collect()}
    assert rows.keys() == {k for k, _ in documents}
    for k, t in documents:
        r = rows[k]
        assert len(r["families"]) > 0 if r["n_confirmed"] else r["families"] == []
        # whoever confirms a licence on plain comparison of a line with the one-line clauses is found
        if any(clause in (t or "").split("\n") for f in ("mit", "apache-2.0") for clause in licences.TEMPLATES[f]):
            assert r["n_confirmed"]
