"""Chat formatting and archives: edge cases, trees, round trips."""

import gzip
import hashlib
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import chat, warc

CHAT = "conv_id long, turn long, role string, text string, conv string, node string, dist string"


def shown(df):
    out = chat.formatted(df).withColumns({"turns": chat.read_back(F.col("formatted")), "learned": chat.masked_text(F.col("formatted"), F.col("loss"))})
    return out.collect()


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(3)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "|", ">", "[", "]", "\n", "é", "🙂", " ", "", "<|", "end|>", "$1", "s>", "/INST]"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole" + rng.choice(bits)]), text, "x", "y", "z"))
    rows.append((None, 0, "assistant", "no conversation", "x", "y", "z"))
    rows.append((None, None, None, None, None, None, None))
    got = {r["conv"]: r for r in shown(chat.chosen_paths(chat.chain_parents(spark.createDataFrame(rows, CHAT))))}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        want = [(r[2] or "", r[3] or "") for r in own]
        r = got[c]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["learned"] == "".join(t for role, t in want if role == "assistant")
        body = r["formatted"].replace(chat.BEGIN, "").replace(chat.END, "")
        assert not any(s in body for s in chat.CONTROL)
        assert r["formatted"].count(chat.BEGIN) == len(want)


def test_branches_by_score(spark):
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", -1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", "more", 0.5), ("t", 5, 3, "user", "less", 0.5), ("u", 1, 99, "user", "orphan", None)]
    nodes = spark.createDataFrame(tree, "conv string, node long, parent long, role string, text string, score double")
    best = {r["conv"]: [t["text"] for t in r["turns"]] for r in shown(chat.chosen_paths(nodes))}
    assert best == {"t": ["q", "good", "more"], "u": ["orphan"]}
    two = [[t["text"] for t in r["turns"]] for r in shown(chat.chosen_paths(nodes, branches=2)) if r["conv"] == "t"]
    assert sorted(two) == [["q", "good", "less"], ["q", "good", "more"]]
    paths = chat.leaf_paths(nodes.withColumn("c", F.col("conv")))
    assert paths.where("c = 't'").count() == 2 + 3 + 3


def test_mask_matches_the_output(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "é🙂 " * (i % 5) + "<s>" * (i % 3), "x", "y", "z") for i in range(40)]
    (r,) = shown(chat.chosen_paths(chat.chain_parents(spark.createDataFrame(rows, CHAT))))
    plain = lambda t: re.sub(r"(?s)\\(.)", r"\1", t)
    assert "".join(plain(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]) == r["learned"]
    assert [s["turn"] for s in r["loss"]] == list(range(1, 40, 2))


def test_formatting_is_linear_in_turns(spark):
    """Twice the turns take about twice the time, and a very long text passes; repeated turns are turns of their own."""
    took = {}
    for n in (2500, 20_000):
        paths = spark.range(n).select(F.lit(1).alias("conv"), F.lit(1).alias("leaf"), "id", (n - F.col("id")).alias("dist"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("five words in this turn").alias("text"))
        began = time.time()
        (r,) = chat.formatted(paths).select(F.length(chat.masked_text(F.col("formatted"), F.col("loss"))), F.size("loss")).collect()
        took[n] = time.time() - began
        assert tuple(r) == (n // 2 * 23, n // 2)
    assert took[20_000] < 8 * took[2500] + 8, took
    rows = [(1, 0, "user", "x" * 3_000_000, "", "", ""), (1, 1, "assistant", "a", "", "", ""), (1, 1, "assistant", "a", "", "", "")]
    (r,) = shown(chat.chosen_paths(chat.chain_parents(spark.createDataFrame(rows, CHAT))))
    assert len(r["turns"]) == 3 and r["learned"] == "aa" and len(r["turns"][0]["text"]) == 3_000_000


def test_long_chain_takes_few_rounds(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"t{i}", "x", "y", "z") for i in range(300)]
    (r,) = shown(chat.chosen_paths(chat.chain_parents(spark.createDataFrame(rows, CHAT))))
    assert [t["text"] for t in r["turns"]] == [f"t{i}" for i in range(300)]


def test_no_conversations(spark):
    assert shown(chat.chosen_paths(chat.chain_parents(spark.createDataFrame([], CHAT)))) == []


PAGES = "page_id long, url string, html string, digest string, kept string, id string"
BIG = "payload " * 30


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(3)


def test_archive_edges(spark):
    odd = "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 5 + "é\x00"
    rows = [(1, "http://a/", BIG), (2, "http://b/x y\r\nInjected: 1", BIG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", odd), (8, "u", odd), (9, "v", "z" * 400_000), (1, "http://a/", BIG), (None, "n", BIG), (None, "n", "only null " * 20)]
    got = warc.archived(pages(spark, rows)).collect()
    want = Counter()
    for i, (k, _, html) in enumerate(rows):
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        first = min(same) if same else None
        again = len(body) >= 100 and (k != first or i > [r[0] for r in rows].index(k) and k is not None)
        want[k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(tuple(r) for r in got) == want


def test_files_hold_plain_records(spark, tmp_path):
    path = warc.write_archives(pages(spark, [(i, f"http://h/{i}", BIG + str(i % 3)) for i in range(40)]), str(tmp_path / "w"), file_bytes=5_000)
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) > 1
    records = [r for f in files for r in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len(records) == 40
    assert sum(r[1] == "response" for r in records) == 3
    assert all(r[6] == b"" for r in records if r[1] == "revisit")
    assert warc.read_archives(spark, path).count() == 40
    plain = warc.write_archives(pages(spark, [(1, "u", BIG), (1, "u", BIG), (2, "u", BIG)]), str(tmp_path / "plain"), compression="none")
    texts = "".join(f.read_text() for f in (tmp_path / "plain").glob("part-*"))
    assert len(set(re.findall(r"WARC-Record-ID: (\S+)", texts))) == 3
    assert set(re.findall(r"WARC-Refers-To: (\S+)", texts)) <= set(re.findall(r"WARC-Record-ID: (\S+)", texts))
    assert warc.read_archives(spark, plain).count() == 3


def test_no_pages(spark):
    assert warc.archived(pages(spark, [])).collect() == []
