"""Document operators against plain versions, on edge cases and on a given table."""

import base64
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tessera.llm import classifier, licences, mixing, neardup, pieces, quality, repeats, winnow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return Counter(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("which", ["table", "edge_docs", "no_docs"])
def test_quality_counts(which, request):
    docs = request.getfixturevalue(which)
    got = quality.verdicts(docs).collect()
    want = [(k, *brute.base_counts(t)) for k, t in pairs(docs)]
    assert multiset(r[:6] for r in got) == multiset(want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in got)


def test_bands_reject_noise_and_repetition():
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.integers(33, 0x2FF, 20_000))
    pack = __import__("zstandard").ZstdCompressor(3)
    b = quality.Bands()
    assert not quality.in_bands(memoryview(noise.encode()), b, pack)[2]
    assert not quality.in_bands(memoryview(rng.bytes(20_000)), b, pack)[2]
    assert not quality.in_bands(memoryview(b"the same words again " * 800), b, pack)[2]
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(3000)]
    weights = 1 / np.arange(1, 3001)
    for n in (30, 300, 3000, 30_000):
        prose = " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
        assert quality.in_bands(memoryview(prose.encode()), b, pack)[2]


@pytest.mark.parametrize("n", [300, 500, 700, 1000, 2000, 4096, 10_000, 40_000])
def test_bands_reject_random_text(n):
    rng = np.random.default_rng(n)
    pack = __import__("zstandard").ZstdCompressor(3)
    b = quality.Bands()
    coded = base64.b64encode(rng.bytes(n)).decode()
    texts = {
        "base64": "\n".join(coded[i : i + 76] for i in range(0, n, 76)).encode()[:n],
        "printable": bytes(rng.integers(32, 127, n, dtype=np.uint8)),
        "cjk": "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n // 3))).encode(),
    }
    for kind, text in texts.items():
        assert not quality.in_bands(memoryview(text), b, pack)[2], kind
        if n >= b.chunk_bytes:
            assert len(pack.compress(text[: b.chunk_bytes])) / b.chunk_bytes > b.chunk[1], kind


def test_chunks_see_the_whole_text():
    rng = np.random.default_rng(12)
    pack = __import__("zstandard").ZstdCompressor(3)
    b = quality.Bands()
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(3000)]
    weights = 1 / np.arange(1, 3001)
    prose = " ".join(rng.choice(vocabulary, 80_000, p=weights / weights.sum())).encode()
    random = bytes(rng.integers(32, 127, 8000, dtype=np.uint8))
    assert len(prose) > 300_000
    for n in (4095, 4096, 4097, 8190, 16_383, 300_000):
        assert quality.in_bands(memoryview(prose[:n]), b, pack)[2], n
    for text in (
        prose[:4095] + b"=" * 4095,
        prose[: 16_383 - 4095] + b"=" * 4095,
        prose[: 16_383 - 4095] + random[:4095],
        prose[:300_000] + b"the same words again " * 4762,
        prose[:101_000] + random[:6144] + prose[101_000:300_000],
        prose[:101_000] + b"=" * 6144 + prose[101_000:300_000],
    ):
        assert not quality.in_bands(memoryview(text), b, pack)[2]


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    rows = quality.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    assert rows.where("not kept").count() == 0 and rows.count() > 300


@pytest.mark.parametrize(("which", "near"), [("table", (3, 85)), ("table", (5, 80)), ("edge_docs", (3, 85)), ("no_docs", (3, 85))])
def test_near_duplicates(which, near, request):
    docs = request.getfixturevalue(which)
    setting = neardup.Near(shingle=near[0], percent=near[1])
    rows = neardup.near_duplicates(docs, setting).collect()
    known = [(k, t) for k, t in pairs(docs) if k is not None]
    want = brute.near_components(sorted(set(known), key=lambda x: (x[0], str(x[1]))), *near)
    assert len(rows) == docs.count()
    for r in rows:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]], r
            assert r["kept"] == (r["component_id"] == r["id"])
    kept = neardup.kept_documents(docs, setting)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["id"] for r in rows if r["kept"]}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group that is cut into blocks, with copies on both sides of the threshold."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.integers(0, 300, int(rng.integers(0, 14))).tolist():
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, neardup.Near(3, 85)).collect()}
    assert got == brute.near_components(rows, 3, 85)
    assert len({c for _, c in got.values()}) > 1


@pytest.mark.parametrize("edits", [4, 13])
def test_near_duplicate_rows_are_linear(spark, monkeypatch, edits):
    """One large group of near copies, cut into many blocks: sets are sent a few times each, not once for each block."""
    sent = {"pairs": 0, "tasks": 0}
    star, rest = neardup.star_links, neardup.rest_links

    def counted_star(pairs, sets, near):
        sent["pairs"] += pairs.count()
        return star(pairs, sets, near)

    def counted_rest(tasks, sets, near):
        sent["tasks"] += tasks.count()
        return rest(tasks, sets, near)

    monkeypatch.setattr(neardup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neardup, "star_links", counted_star)
    monkeypatch.setattr(neardup, "rest_links", counted_rest)
    rng = np.random.default_rng(15)
    base = [f"w{i}" for i in range(600)]
    rows = [(0, " ".join(base))]
    for k in range(1, 600):
        w = list(base)
        for at in rng.integers(0, 600, edits).tolist():
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(docs, neardup.Near(3, 85)).collect()}
    assert got == {k: c for k, (_, c) in brute.near_components(rows, 3, 85).items()}
    assert sent["pairs"] + sent["tasks"] <= 12 * len(rows), sent


@pytest.mark.parametrize("which", ["table", "edge_docs", "no_docs"])
def test_repeated_bytes(which, request):
    docs = request.getfixturevalue(which)
    rows = repeats.removal(docs).collect()
    assert len(rows) == docs.count()
    want = brute.repeats({(k, t) for k, t in pairs(docs) if k is not None})
    for r in rows:
        if r["id"] is not None:
            assert tuple(r)[1:] == want[r["id"]]
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where(F.col("text").isNull()).count() == docs.where(F.col("text").isNull()).count()


@pytest.mark.parametrize("route", ["large", "hot"])
def test_repeated_bytes_by_window(spark, monkeypatch, route):
    """The routes for names that very many documents share give the same result."""
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    rows = []
    for k in range(80):
        own = "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 300))))
        a, b = sorted(rng.integers(0, 400, 2).tolist())
        rows.append((k * 3, own + passage[a:b] + own[::-1] + (passage if k % 3 else "") + "é" * int(rng.integers(0, 90))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    most = repeats.MAX_GROUP
    if route == "large":
        most = 2
    else:

        def names(base):
            found = repeats.name_rows(base, np.zeros(0, np.uint64)).groupBy("name").count().where("count > 20").collect()
            return np.array([r["name"] for r in found], np.int64).view(np.uint64)

        monkeypatch.setattr(repeats, "hot_names", names)
    got = {r["id"]: tuple(r)[1:] for r in repeats.removal(docs, max_group=most).collect()}
    assert got == brute.repeats(rows)


def test_equal_ids_are_told_apart(spark):
    text = "".join(np.random.default_rng(6).choice(list("abcdefghij"), 300))
    low = -(1 << 63)
    docs = spark.createDataFrame([(low, text), (None, text + "a"), (5, text)], "doc_id long, text string")
    assert sorted((r["id"] is not None, r["id"] or 0, r["n_removed"] > 0) for r in repeats.removal(docs).collect())[2] == (True, 5, True)
    assert {r["id"] for r in repeats.removal(docs).collect()} == {low, None, 5}
    docs = spark.createDataFrame([(1, text), (1, text), (1, "z" + text), (2, text)], "doc_id long, text string")
    rows = sorted((r["id"], r["n_bytes"], r["n_removed"]) for r in repeats.removal(docs).collect())
    ones = [x for x in rows if x[0] == 1]
    assert rows[-1] == (2, 300, 300)
    # equal rows fare alike, and either the longer or the shorter text came first
    assert [x for x in ones if x[1] == 300][0] == [x for x in ones if x[1] == 300][1]
    assert sorted({x[2] for x in ones}) == [0, 300]


@pytest.mark.parametrize("which", ["table", "edge_docs", "no_docs"])
def test_pieces(which, request):
    import sentencepiece

    docs = request.getfixturevalue(which)
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    text = {}
    for k, t in pairs(docs):
        text.setdefault(k, set()).add(t or "")
    rows = pieces.encoded(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert any(r["ids"] == public.encode(t) for t in text[r["doc_id"]])
        assert r["n_ids"] == len(r["ids"]) and r["decoded_same"]
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert multiset((r["doc_id"], r["text"]) for r in back) == multiset((k, t or "") for k, t in pairs(docs))


ODD = list("abcdefghinrst1é漢🙂") + [" ", "  ", "\n", " \n", "▁", "the ", " of", "tion", "   "]


def odd_texts(n, seed, most=60):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(ODD, int(rng.integers(1, most)))) for _ in range(n)]


def test_pieces_commit_early():
    """Ids are committed in stretches, and equal the public library's."""
    import sentencepiece

    public = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    e = pieces.Encoder(pieces.Model())
    text = "".join(np.random.default_rng(2).choice(list("abcdefghinrst1é漢🙂"), 5000))
    stretches = list(e.search(pieces.MARK + text))
    assert len(stretches) > 50 and max(map(len, stretches)) < 100
    assert [i for s in stretches for i in s] == e.encode(text) == public.encode(text)
    for n in (2, 14, 15, 16, 17, 31, 33, 500):
        for s in (" " * n, " " * n + "x", "a" + " " * n + "b\n"):
            assert e.encode(s) == public.encode(s), s
    for s in odd_texts(2000, 3):
        assert e.encode(s) == public.encode(s), s


def test_pieces_by_slices(monkeypatch):
    """Where a text is cut into slices does not matter."""
    e, small = (pieces.Encoder(pieces.Model()) for _ in range(2))
    for s in odd_texts(300, 4, 200):
        monkeypatch.setattr(pieces, "SLICE", 7)
        got = list(small.stretches(s))
        monkeypatch.setattr(pieces, "SLICE", 1 << 16)
        assert [i for g in got for i in g] == e.encode(s) and (len(s) < 40 or len(got) > 1 or " " not in s.strip())


def field(number, value):
    """A length-delimited, float or whole-number field of a protocol buffers message."""

    def varint(x):
        return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + varint(x >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    """The given vocabulary as a unigram model: some of its pieces, scored by length and rank in sixteenths."""
    base = pieces.Model()
    rng = np.random.default_rng(5)
    out = b""
    for i, p in enumerate(base.pieces):
        kind = 2 if i == 0 else 3 if i < 3 else 6 if i in base.byte_ids else 1
        if kind != 1 or p == "▁" or len(p) == 1 and p.isascii() or rng.random() < 0.7:
            out += field(1, field(1, p.encode()) + field(2, 0.0 if kind != 1 else -float(rng.integers(16 * (2 + i // 4000), 16 * (4 + i // 2000))) / 16) + field(3, kind))
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(out + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)))
    return str(path)


def test_unigram_pieces(unigram_file, table):
    import sentencepiece

    public = sentencepiece.SentencePieceProcessor(model_file=unigram_file)
    e = pieces.Encoder(pieces.Model(unigram_file))
    assert e.model.kind == pieces.UNIGRAM and not e.merging
    texts = odd_texts(1500, 6) + [t for _, t in pairs(table)][:60] + ["".join(np.random.default_rng(7).choice(list("abcdefghinrst1é漢"), 3000))]
    for s in texts:
        assert e.encode(s) == public.encode(s), s
        assert e.decode(e.encode(s)) == s.replace("▁", " ")
    assert len(list(e.search("abcdefghij" * 300))) > 10


def test_viterbi_finds_the_best_sum():
    """Against all paths of short strings, with scores alone."""
    e = pieces.Encoder(pieces.Model(), merging=False)
    ids, scores = e.model.ids, e.model.scores

    def best(s):
        return max((scores[ids[s[:i]]] + best(s[i:]) for i in range(1, len(s) + 1) if s[:i] in ids), default=0.0 if not s else -1e9)

    for w in ("▁internation", "abcdefgh", "▁the", "tionist", "nnnnnnn"):
        assert sum(scores[i] for i in e.unit(w)) == best(w)


def test_model_files_are_checked(tmp_path, unigram_file):
    data = open(unigram_file, "rb").read()
    for extra, why in ((field(2, field(3, 3)), "unigram and BPE"), (field(3, field(4, 1)), "normalise"), (field(1, field(1, b"own") + field(3, 4)), "kind")):
        (tmp_path / "m").write_bytes(data + extra)
        with pytest.raises(ValueError, match=why):
            pieces.Model(str(tmp_path / "m"))
    (tmp_path / "m").write_bytes(field(1, field(1, b"a")) + data[-40:])
    with pytest.raises((ValueError, IndexError, KeyError)):
        pieces.Model(str(tmp_path / "m"))


@pytest.mark.parametrize("which", ["table", "edge_docs", "no_docs"])
def test_mix(which, request):
    docs = request.getfixturevalue(which)
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    assert Counter(r["id"] for r in rows) == Counter(k for k, _ in pairs(docs))
    assert multiset(mixing.plan(docs).collect()) == multiset(rows)
    for r in rows:
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] <= 2 * r["source_size"]
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "mix_shard"]
    assert out.count() == sum(len(r["shards"]) for r in rows)


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["a", "b", "c", None][min(3, int(rng.exponential(1)))]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs).join(docs.select(F.col("doc_id").alias("id"), "source"), "id").groupBy("source").agg(F.sum("taken"), F.max("target"), F.max("source_size")).collect()
    for source, taken, target, size in got:
        assert abs(taken - target) <= 60, (source, taken, target, size)
    assert abs(sum(r[2] for r in got) - 1.5 * sum(r[3] for r in got)) < 1e-6 * sum(r[3] for r in got)
    # the splitting tree gives shards nearly equal numbers of blocks, and every draw to one shard
    out = mixing.mixed(docs).groupBy("mix_shard").count().collect()
    assert len(out) == mixing.Mix().shards


@pytest.mark.parametrize("per_range", [7, 100_000])
def test_splitting_tree(spark, monkeypatch, per_range):
    """Quotas add up exactly, shards are even, sources near their share, and no two draws are the same."""
    running = mixing.running
    monkeypatch.setattr(mixing, "running", lambda *a: running(*a, per_range=per_range))
    mix = mixing.Mix(shards=6)
    sizes = {"a": 300, "b": 120, "c": 30}
    rows = [(False, s, b, 1 + (s == "b"), True) for s, n in sizes.items() for b in range(n)]
    draws = spark.createDataFrame(rows, "src_null boolean, src string, block int, passes int, in_part boolean")
    dealt = mixing.deal(draws, mix).collect()
    total = {s: n * (3 if s == "b" else 2) for s, n in sizes.items()}
    # every draw went to one shard
    assert all(len(r["full"]) == r["passes"] and r["part"] is not None for r in dealt)
    held = Counter((r["src"], shard) for r in dealt for shard in [*r["full"], r["part"]])
    each = draws.select("src_null", "src", "block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass_no"))
    quotas = {(r["src"], r["shard"]): r["quota"] for r in mixing.split_quotas(each, mix).collect()}
    assert quotas == held
    n = sum(total.values())
    for shard in range(6):
        assert abs(sum(q for (_, k), q in quotas.items() if k == shard) - n / 6) <= 2
        for s, t in total.items():
            # six standard deviations of the hypergeometric law
            p, m = t / n, n / 6
            assert abs(quotas.get((s, shard), 0) - m * p) <= 6 * (m * p * (1 - p) * (n - m) / (n - 1)) ** 0.5 + 1


def test_mix_of_rows_without_ids(spark):
    """Rows without an id are drawn one by one; a column with the shard's name is replaced, or kept."""
    rows = [(None, f"{i} " + "w " * 9, "ab"[i % 2], 5) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_shard int")
    got = mixing.plan(docs).groupBy("target").agg(F.sum("taken")).collect()
    assert len(got) == 2 and all(abs(t - taken) <= 20 for t, taken in got)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).where("mix_shard = 5").count() < 600
    assert mixing.mixed(docs, shard=None).where("mix_shard <> 5").count() == 0


@pytest.mark.parametrize("which", ["table", "edge_docs", "no_docs"])
def test_next_and_edited(which, request):
    docs = request.getfixturevalue(which)
    rows = winnow.with_next(docs, extra=winnow.fingerprint).withColumn("edited", winnow.edited(F.col("text"), F.col("next_text"))).collect()
    code = {r["t"] or "": r["h"] for r in docs.select(F.col("text").alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((k is not None, k or 0, code[t or ""]), t or "") for k, t in pairs(docs))
    assert len(rows) == len(order)
    want = Counter()
    for i, (_, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        want[t, t[: len(t) - half] + following[:half]] += 1
    assert Counter((r["text"], r["edited"]) for r in rows) == want
    prints = defaultdict(set)
    for r in rows:
        prints[r["text"]].add(tuple(r["extra"]))
    assert all(len(p) == 1 for p in prints.values())


@pytest.mark.parametrize("per_bucket", [3, 50])
def test_order_of_shared_ids(spark, per_bucket):
    """An id that a third of all rows share, and null, are spread over buckets without changing the order."""
    rng = np.random.default_rng(13)
    rows = [([None, 7, -(1 << 63), (1 << 63) - 1, i][min(4, int(rng.integers(0, 7)))], f"text {rng.integers(0, 500)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    with_hash = [(r[0], r[1], r[2]) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    order = sorted(with_hash, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    got = winnow.with_next(docs, per_bucket=per_bucket).collect()
    assert Counter((r["id"], r["text"], r["next_text"]) for r in got) == Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    cuts = winnow.boundaries(docs.select(F.col("doc_id").alias("id")), per_bucket)
    sizes = docs.select(F.col("doc_id").alias("id"), "text").groupBy(winnow.bucket_of(winnow.place_of("id", "text"), cuts).alias("b")).count().agg(F.max("count")).first()[0]
    assert sizes <= max(60, 12 * per_bucket) and len(cuts) > 600 // per_bucket // 2


def test_winnowing_query(spark):
    """The whole query against plain versions of the edit, the fingerprints' law and the likeness."""
    from tessera.llm.queries import QUERIES

    docs = sorted(pairs(spark.read.parquet(f"{SF}/documents.parquet")))
    rows = {r["doc_id"]: r for r in QUERIES["op10_winnowing"](spark, SF).collect()}
    prints = lambda s: [x.split("@") for x in s.split()]
    for i, (k, t) in enumerate(docs):
        r, (k2, following) = rows[k], docs[(i + 1) % len(docs)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = ({h for h, _ in prints(x)} for x in (r["fingerprint"], r["edited_fingerprint"], rows[k2]["fingerprint"]))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert r["near_edited"] == pytest.approx(like(own, other)) and r["near_next"] == pytest.approx(like(own, after))
        tokens = [w for x in brute.words(t) for w in ([x] if len(x) <= 12 else list(x))]
        at = [int(p) for _, p in prints(r["fingerprint"])]
        assert at == sorted(at) and (not at or at[-1] <= max(0, len(tokens) - winnow.K))
        # every window of hashes holds an entry
        assert all(b - a <= winnow.WINDOW for a, b in zip([-1, *at], [*at, max(0, len(tokens) - winnow.K + 1)], strict=True))


def test_winnowing_rule(spark):
    """Every window's smallest hash, the rightmost of equal ones, is kept; shared runs are found."""
    rng = np.random.default_rng(8)
    run = " ".join(f"r{i}" for i in range(winnow.WINDOW + winnow.K - 1))
    some = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 40, n))
    texts = [(0, some(70) + " " + run + " " + some(9)), (1, "q " + run + " " + some(200)), (2, some(12)), (3, "a a a " * 60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = F.transform(F.split("text", " +"), lambda w: F.xxhash64(w))
    rows = df.select("doc_id", winnow.fingerprint(F.col("text")).alias("f"), winnow.gram_hashes(F.filter(words, lambda h: h != F.xxhash64(F.lit(""))), winnow.K).alias("g")).collect()
    for r in rows:
        g = [((x & winnow.HASH_MASK) >> winnow.POSITION_BITS, -i, x) for i, x in enumerate(r["g"])]
        windows = [min(g[i : i + winnow.WINDOW]) for i in range(max(1, len(g) - winnow.WINDOW + 1))]
        assert {tuple(x) for x in r["f"]} == {(h, -i) for _, i, h in windows}
    hashes = [{x["hash"] for x in r["f"]} for r in sorted(rows)]
    assert hashes[0] & hashes[1]


def test_winnowing_without_blanks(spark):
    """A passage of texts without blanks is found at any offset, and after an inserted character."""
    rng = np.random.default_rng(10)
    some = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))
    passage, least = some(400), winnow.WINDOW + winnow.K - 1
    texts = [some(100) + passage + some(50), some(101) + passage + some(70), some(30) + passage[:200] + "一" + passage[200:], some(57) + passage[90 : 90 + least] + some(20), some(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r[0]: set(r[1]) for r in df.select("doc_id", winnow.hashes(winnow.fingerprint(F.col("text")))).collect()}
    assert len(rows[0] & rows[1]) > 30 and len(rows[0] & rows[2]) > 30
    assert rows[0] & rows[3] and not rows[0] & rows[4]
    words = spark.range(1).select(F.regexp_extract_all(F.lit("ab twelveletter thirteenchars 🙂"), F.lit(winnow.PIECE), F.lit(0))).first()[0]
    assert words == ["ab", "twelveletter", *"thirteenchars", "🙂"]


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = classifier.scored(docs, classifier.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good = sorted(r["score"] for r in held if r["quality"] == 1)
    bad = sorted(r["score"] for r in held if r["quality"] == 0)
    auc = np.mean([[(g > b) + (g == b) / 2 for g in good] for b in bad])
    assert auc >= 0.93, auc


def test_classifier_against_a_plain_scorer():
    """Scores from features found one by one, hashed alone, and averaged."""
    from tessera.llm import wordbytes as wb

    rng = np.random.default_rng(3)
    model = classifier.Model(rng.normal(size=1 << 10).astype(np.float32), 0.1)
    texts = ["", " ", "é", "one", "one two  two\nthree", "日本 語🙂 ab", "x" * 40]

    def bucket(text, kind):
        """The bucket of one feature: the only one of its kind in a text that is no more than it."""
        c = wb.Chunk(*wb.text_bytes(pa.array([text])))
        (found,) = list(classifier.features(c, 1 << 10))[kind][0]
        return int(found)

    for t in texts:
        w = brute.words(t)
        found = [bucket(x, 0) for x in w] + [bucket(f"{a} {b}", 1) for a, b in zip(w, w[1:])]
        for kind, n in ((2, 3), (3, 5)):
            found += [bucket(t[i : i + n], kind if n == 3 or len(t) >= n else 2) for i in range(len(t) - n + 1)]
        want = 1 / (1 + np.exp(-(np.mean(model.table[found]) if found else 0.0) - 0.1))
        assert model.scores(*wb.text_bytes(pa.array([t])))[0] == pytest.approx(want, rel=1e-5), t


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, "good text here")] * 50 + [(2, "bad bad bad")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    seen = []
    keep = classifier.learned
    try:
        classifier.learned = lambda texts, y, s: seen.append(len(texts)) or keep(texts, y, s)
        classifier.fit(docs, labels)
    finally:
        classifier.learned = keep
    assert seen[0] <= 2


def test_classifier_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(0, 1), (3, 0), (8, None), (9, 1), (10, 0), (None, 1), (10, 1), (15, 1), (16, 0)], "doc_id long, quality int")
    model = classifier.fit(edge_docs, labels)
    rows = classifier.scored(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert classifier.scored(no_docs, classifier.fit(no_docs, labels)).count() == 0
    same = defaultdict(set)
    for (k, t), r in zip(pairs(edge_docs), rows, strict=True):
        same[t or ""].add(r["score"])
    assert all(len(s) == 1 for s in same.values())


def test_licences(edge_docs, no_docs, table):
    said = {"gpl": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4.0", "mit": "under the MIT License", "apache-2.0": "Apache License, Version 2.0"}
    text = dict(pairs(table))
    model = licences.fit(table)
    for r in licences.scanned(table, model).collect():
        assert r["families"] == sorted(f for f, s in said.items() if s in text[r["doc_id"]])
    rows = licences.scanned(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert [r["families"] for r in rows if r["doc_id"] == 15] == [["cc-by-nc"]]
    assert licences.scanned(no_docs, licences.fit(no_docs)).count() == 0
    unlike = pa.array(["Licensed plumbers work under general conditions of the public water act.", "Permission slips are due on Friday."])
    from tessera.llm import wordbytes as wb

    data, offsets = wb.text_bytes(unlike)
    assert all(licences.confirmed(t.as_py(), f, 0.7) == 0 for t in unlike for f in licences.FAMILIES)
    assert len(licences.Paragraphs(data, offsets, 1 << 14).starts) == 2


MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""


def test_wrapped_licences(spark, table):
    """Clauses that run over lines are found, and so are two families in one line; near relations are not."""
    two = "This project is licensed under the MIT License. Licensed under the Apache License, Version 2.0."
    sa = "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."
    prose = pairs(table)[0][1][:400].replace("\n", " ")
    want = {0: ["mit"], 1: ["bsd"], 2: ["gpl"], 3: ["apache-2.0", "mit"], 4: ["cc-by-sa"], 5: ["mit"], 6: []}
    texts = [MIT, BSD, GPL, two, sa, prose + "\n" + MIT + prose, "Permission is hereby granted\n\nto use, copy, modify, merge, publish"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.scanned(docs, licences.fit(table)).collect()}
    assert {k: r["families"] for k, r in rows.items()} == want
    assert rows[0]["n_paragraphs"] == 2 and rows[1]["n_confirmed"] == 2


@pytest.fixture(scope="module")
def licence_model(table):
    return licences.fit(table)


def test_look_alikes_and_denials(spark, licence_model):
    cases = {
        "Licensed under the GNU Affero General Public License, version 3.": ["agpl"],
        "Licensed under the GNU Lesser General Public License, version 3.": ["lgpl"],
        "Licensed under the GNU General Public License, version 3.": ["gpl"],
        "Licensed under CC BY-NC-SA 4.0.": ["cc-by-nc-sa"],
        "This file is not released under the MIT License.": [],
        "This file is not released under the MIT License.\n\nLicensed under the Apache License, Version 2.0.": ["apache-2.0"],
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["apache-2.0", "mit"],
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.scanned(docs, licence_model).collect()}
    assert got == dict(enumerate(cases.values()))
    assert 0 < licence_model.threshold < 1


def test_licence_precision_and_recall(spark, table, licence_model):
    """A held-out set: every clause, wrapped and between prose of other documents, and prose alone."""
    rng = np.random.default_rng(21)
    prose = " ".join(t for _, t in pairs(table) if t and "icense" not in t).split()
    some = lambda n: prose[(at := int(rng.integers(0, len(prose) - n))) : at + n]
    wrap = lambda words: "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    cases = [(f, wrap([*some(int(rng.integers(0, 60))), *c.split(), *some(int(rng.integers(0, 60)))])) for f in licences.FAMILIES for c in licences.TEMPLATES[f] for _ in range(2)]
    cases += [(None, wrap(some(int(rng.integers(5, 300))))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.scanned(docs, licence_model).collect()}
    for f in licences.FAMILIES:
        said = [i for i, (k, _) in enumerate(cases) if k == f]
        named = [i for i in got if f in got[i]]
        right = sum(f in got[i] for i in said)
        assert right >= 0.75 * len(said), (f, right, len(said), [cases[i][1] for i in said if f not in got[i]])
        assert sum(cases[i][0] == f for i in named) >= 0.9 * len(named), (f, [cases[i] for i in named if cases[i][0] != f])
    assert not any(got[i] for i, (k, _) in enumerate(cases) if k is None)
