"""Golden results, generic jobs, sources and sinks."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import text as tx
from tessera.operators import mapreduce as mr
from tessera.operators import workloads as wl
from tessera.plans import catalog
from tessera.sinks.json_parts import default_output, write_json_objects, write_json_partitions
from tessera.sources.json_pairs import key_values
from tessera.sources.text import by_field_count, field, records, set_map_size, text_lines, whole_files

#: Lines whose results are known.
WOOD = "how much wood would a wood chuck chuck if a wood chuck could chuck wood"
WOOD_COUNTS = {"how": 1, "much": 1, "wood": 4, "would": 1, "a": 2, "chuck": 4, "could": 1, "if": 1}
GREP = [
    "Disestablishmentarianism refers to campaigns to sever links between church and state",
    "The word antidisestablishmentarianism is notable for its unusual length of 28 letters",
    "Congratulations is a fifteen letter word",
]


def folder(tmp_path, **files):
    d = tmp_path / "in"
    d.mkdir()
    for name, content in files.items():
        (d / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(d)


def test_word_count_golden(spark, tmp_path):
    lines = text_lines(spark, folder(tmp_path, a=WOOD + "\n"))
    assert {r["word"]: r["n"] for r in wl.word_count(lines, "value").collect()} == WOOD_COUNTS


def test_grep_golden(spark, tmp_path):
    lines = text_lines(spark, folder(tmp_path, a="\n".join(GREP) + "\nnothing here\n123456789012345\n"))
    got = {r["longest"]: r["lines"] for r in wl.grep_groups(lines, "value").collect()}
    assert got == {24: [GREP[0]], 28: [GREP[1]], 15: [GREP[2]], 0: ["123456789012345"]}


def test_long_words_are_unicode(spark):
    df = spark.createDataFrame([("étéétéétéétéété",), ("abcdefghijklmn",), ("under_score_1234",)], "line string")
    got = [(r[0], r[1]) for r in df.select(tx.has_long_word(F.col("line")), tx.longest_alpha_bytes(F.col("line"))).collect()]
    assert got == [(True, 25), (False, 14), (True, 5)]


def test_lines_and_text_rules(spark, tmp_path):
    d = folder(tmp_path, a="one\r\ntwo\rstill two\n\nlast", b="", _hidden="x")
    got = sorted(r["value"] for r in text_lines(spark, d).collect())
    assert got == ["", "last", "one", "two\rstill two"]
    assert [r["value"] for r in whole_files(spark, d).collect() if r["value"]] == ["one\r\ntwo\rstill two\n\nlast"]


def test_invalid_text_fails(spark, tmp_path):
    d = folder(tmp_path, a=b"good\nbad \xff\xfe\n")
    with pytest.raises(Exception, match="UTF"):
        text_lines(spark, d).collect()
    assert text_lines(spark, d, strict=False).count() == 2


def test_result_does_not_depend_on_split_size(spark, tmp_path):
    d = folder(tmp_path, a="\n".join(f"line {i} " + "word " * (i % 7) for i in range(40_000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        seen = []
        for n in (1_000_000, 64_000_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", n)
            seen.append(Counter(wl.word_count(text_lines(spark, d), "value").collect()))
        assert seen[0] == seen[1]
        set_map_size(spark, 2)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "2000000"
        with pytest.raises(ValueError, match="map size"):
            set_map_size(spark, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_records(spark):
    lines = spark.createDataFrame([('1,"Bad, The (1999)",A|B',), ("7,1,4.5,100",)], "value string")
    movies, ratings = by_field_count(lines, 3)
    assert [tuple(r) for r in movies.select(field(F.col("fields"), 0, "int"), F.col("fields")[1]).collect()] == [(1, "Bad, The (1999)")]
    assert [tuple(r) for r in ratings.select(field(F.col("fields"), 1, "int"), field(F.col("fields"), 2, "double")).collect()] == [(1, 4.5)]
    blank = records(spark.createDataFrame([("the  cat\t2001 5 2",)], "value string"), ["w1", "w2", "year"], split="blank")
    assert [tuple(r) for r in blank.collect()] == [("the", "cat", "2001")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        blank.select(field(F.array("w1"), 0, "int")).collect()


def test_ratings(spark):
    items = spark.createDataFrame([(1, "A (1999)", "x|y"), (2, "B (2000)", "y"), (3, "C (2001)", "y")], "item int, title string, genres string")
    ratings = spark.createDataFrame([(1, 4.0), (1, 2.0), (2, 5.0), (9, 1.0)], "item int, rating double")
    want = {(1, 3.0, 2), (2, 5.0, 1), (3, 0.0, 0)}
    for f in (wl.rating_aggregate, wl.rating_aggregate_tagged):
        assert {(r["item"], r["rating"], r["rating_count"]) for r in f(items, ratings, "item").collect()} == want


def test_best_per_genre(spark):
    rows = [("a", "x|y", 4.0, 101), ("b", "x", 4.0, 101), ("c", "x", 5.0, 100), ("d", "y", float("nan"), 500), ("e", "z", 0.0, 500), ("f", "y", 4.5, 102)]
    rated = spark.createDataFrame(rows, "title string, genres string, rating double, rating_count long")
    assert {tuple(r) for r in wl.best_per_genre(rated).collect()} == {("x", "a", 4.0), ("y", "f", 4.5)}


def test_values_by_year_keep_repeats(spark):
    rows = spark.createDataFrame([("T (1999)", 1.0), ("T (1999)", 1.0), ("U (2000)", 2.0)], "title string, r double")
    got = wl.values_by_year(rows, F.substring("title", -5, 4), "title", F.col("r")).collect()
    assert {(r["year"], r["title"], tuple(r["values"])) for r in got} == {(1999, "T (1999)", (1.0, 1.0)), (2000, "U (2000)", (2.0,))}


def test_alphabetic_buckets(spark):
    # worked out by hand: digits 0-9, a-z stand for 0..35, none for 0, others for 37, of 200 buckets
    want = {"": 0, "0": 0, "a": 54, "az": 58, "a!": 59, "z": 189, "zz": 193, "~": 200, "Az": 58, "éa": 200, "09": 1, "m0": 118}
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", tx.alpha_bucket(F.col("w"))).collect()}
    assert got == want


def test_numbers_as_text(spark):
    want = {3.0: "3", 0.5: "0.5", 12345678.0: "12345678", 1e-4: "0.0001", -1.25e-7: "-0.000000125", 1.5e20: "150000000000000000000", -98765432.125: "-98765432.125", 0.0: "0", 1e7: "10000000"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in want], "x double").select("x", tx.plain_number(F.col("x"))).collect()}
    assert got == want


def test_trim_is_unicode(spark):
    assert spark.createDataFrame([("\u3000\u00a0 a b\u2003\n",)], "t string").select(tx.trimmed(F.col("t"))).first()[0] == "a b"


def test_output_files_are_in_order(spark, tmp_path):
    words = [chr(97 + i % 26) + chr(97 + i * 7 % 26) for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("bucket", tx.alpha_bucket(F.col("w")))
    wl.ordered_parts(df, "bucket", "w", 5).write.json(str(tmp_path / "o"))
    files = sorted((tmp_path / "o").glob("part-*.json"))
    rows = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert len(files) > 1 and [(r["bucket"], r["w"]) for r in rows] == sorted((r["bucket"], r["w"]) for r in rows) and len(rows) == 300


def rows(spark, *values):
    return spark.createDataFrame([("p", v) for v in values], "path string, value string")


def test_map_and_reduce_calls(spark):
    half = lambda k, v: tx.first_letter_half(k)
    job = mr.JobSpec(lambda p, v: ((w, "test") for w in v.split()), lambda k, v: ["".join(v)], half)
    groups = mr.group_stage(job, mr.map_stage(job, rows(spark, "bar zar"))).collect()
    assert {(r["pid"], r["key"], tuple(r["values"])) for r in groups} == {(0, "bar", ("test",)), (1, "zar", ("test",))}
    given = spark.createDataFrame([(0, "foo", ["bar", "baz"])], "pid long, key string, values array<string>")
    assert [r["values"] for r in mr.reduce_stage(job, given).collect()] == [["barbaz"]]


def test_repeated_pairs_and_empty_groups(spark):
    job = mr.JobSpec(lambda p, v: [(1, 5), (1, 5), (2, 7)], lambda k, v: sorted(v) if k == 1 else [], mr.hash_partitioner(3), key_type="long", value_type="long", output_type="long")
    assert {(r["key"], tuple(r["values"])) for r in mr.run_job(job, rows(spark, "x")).collect()} == {(1, (5, 5)), (2, ())}


def test_partitioner_sees_the_value(spark):
    job = mr.JobSpec(lambda p, v: [("k", 1), ("k", 2), ("k", 3)], lambda k, v: [sum(v)], lambda k, v: v % 2, value_type="long", output_type="long")
    assert {(r["pid"], tuple(r["values"])) for r in mr.run_job(job, rows(spark, "x")).collect()} == {(1, (4,)), (0, (2,))}


def test_combiner_runs_for_groups_only(spark):
    def combine(key, values):
        if len(values) < 2:
            raise ValueError("a single value was combined")
        return [sum(values)]

    make = lambda c: mr.JobSpec(lambda p, v: ((w, 1) for w in v.split()), lambda k, v: [sum(v)], mr.hash_partitioner(15), c, value_type="long", output_type="long")
    texts = rows(spark, WOOD, WOOD, "once")
    got = [{r["key"]: r["values"][0] for r in mr.run_job(make(c), texts).collect()} for c in (None, combine)]
    assert got[0] == got[1] == {**{k: 2 * n for k, n in WOOD_COUNTS.items()}, "once": 1}
    assert make(combine).has_combiner and not make(None).has_combiner


def test_groups_travel_in_pieces(spark):
    """No row grows with its group, and a partitioner of keys runs for pieces instead of pairs."""
    half = lambda k, v: tx.first_letter_half(k)
    job = mr.JobSpec(lambda p, v: ((w, w + p) for w in v.split()), lambda k, v: [str(len(v))], half)
    n = 3 * mr.PIECE + 1
    groups = mr.group_stage(job, mr.map_stage(job, rows(spark, "bar " * n + "zar")))
    got = groups.collect()
    assert sorted((r["pid"], r["key"], len(r["values"])) for r in got) == sorted([(0, "bar", mr.PIECE)] * 3 + [(0, "bar", 1), (1, "zar", 1)])
    assert {(r["pid"], r["key"], r["values"][0]) for r in mr.reduce_stage(job, groups).collect()} == {(0, "bar", str(n)), (1, "zar", "1")}
    assert not {"collect_list", "explode"} & set(groups._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())


def test_combined_values_travel_in_pieces(spark):
    n = 2 * mr.PIECE + 5
    job = mr.JobSpec(lambda p, v: ((w, 1) for w in v.split()), lambda k, v: [sum(v)], mr.hash_partitioner(15), lambda k, v: [2 * x for x in v], value_type="long", output_type="long", streams=True)
    groups = mr.group_stage(job, mr.map_stage(job, rows(spark, "a " * n + "b")))
    assert sorted((r["key"], len(r["values"])) for r in groups.collect()) == [("a", 5), ("a", mr.PIECE), ("a", mr.PIECE), ("b", 1)]
    assert {r["key"]: r["values"] for r in mr.reduce_stage(job, groups).collect()} == {"a": [2 * n], "b": [1]}


def test_texts_travel_in_cuts(spark):
    """A batch of rows is bounded in bytes, and the mapper gets whole texts."""
    whole = ["", "a", "é" * mr.CUT, "x" * mr.CUT, "x" * (mr.CUT + 1), "€uro 😀 " * 5000, "tail " * 300_000, None]
    given = spark.createDataFrame([(str(i), v) for i, v in enumerate(whole)], "path string, value string")
    parts = mr.cut(given).collect()
    size = lambda v: len((v or "").encode())
    assert max(len(r["part"] or b"") for r in parts) == mr.CUT and len(parts) == sum(max(1, -(-size(v) // mr.CUT)) for v in whole)
    assert Counter(r["path"] for r in parts if not r["more"]) == Counter(map(str, range(len(whole))))
    digest = lambda v: "null" if v is None else f"{len(v)} {hashlib.md5(v.encode()).hexdigest()}"
    job = mr.JobSpec(lambda p, v: [(p, digest(v))], lambda k, v: v, mr.hash_partitioner(3))
    assert {r["key"]: r["values"] for r in mr.run_job(job, given).collect()} == {str(i): [digest(v)] for i, v in enumerate(whole)}
    bad = given.limit(1).select("path", F.unhex(F.lit("61FF")).cast("string").alias("value"))
    with pytest.raises(Exception, match="can't decode"):
        mr.run_job(job, bad).collect()


def test_pairs_of_one_text_are_combined_on_the_way(spark):
    n = 2 * mr.COMBINE_EVERY + 7
    job = mr.JobSpec(lambda p, v: (("a", 1) for _ in range(n)), lambda k, v: sorted(v), mr.hash_partitioner(3), lambda k, v: [len(v)], value_type="long", output_type="long")
    assert [r["values"] for r in mr.run_job(job, rows(spark, "x")).collect()] == [[7, mr.COMBINE_EVERY, mr.COMBINE_EVERY]]


def test_streaming_reducers(spark, monkeypatch):
    """With ``streams`` no list of a whole group is made; the registered jobs ask for it."""
    kind = lambda k, v: [type(v).__name__, str(sum(1 for _ in v))]
    n = 2 * mr.PIECE + 5
    make = lambda s: mr.JobSpec(lambda p, v: ((w, w) for w in v.split()), kind, mr.hash_partitioner(3), streams=s)
    got = [{r["key"]: r["values"] for r in mr.run_job(make(s), rows(spark, "a " * n + "b")).collect()} for s in (False, True)]
    assert got == [{"a": ["list", str(n)], "b": ["list", "1"]}, {"a": ["chain", str(n)], "b": ["chain", "1"]}]
    first = lambda k, v: [k, next(iter(v))]
    unread = mr.JobSpec(lambda p, v: ((w, w) for w in v.split()), first, mr.hash_partitioner(1), streams=True)
    assert {tuple(r["values"]) for r in mr.run_job(unread, rows(spark, "a " * n + "b")).collect()} == {("a", "a"), ("b", "b")}
    seen = []
    monkeypatch.setattr(mr, "run_job", lambda job, rows, run=mr.run_job: seen.append(job.streams) or run(job, rows))
    for name in ("word_count", "word_count_combined", "distinct_predecessors", "value_partitions"):
        catalog.QUERIES[f"generic_job_{name}"](spark, "/root/testdata/sf0.001")
    assert seen == [True] * 4


@pytest.mark.parametrize("by_value", [False, True])
def test_null_values_are_left_out_and_their_groups_stay(spark, by_value):
    big = 2**53 + 1
    part = (lambda k, v: v * 0) if by_value else (lambda k, v: k.try_cast("long") * 0)
    job = mr.JobSpec(lambda p, v: [("1", None), ("2", big), ("2", None), ("2", 3), ("3", big)], lambda k, v: sorted(v), part, value_type="long", output_type="long")
    got = Counter((r["pid"], r["key"], tuple(r["values"])) for r in mr.run_job(job, rows(spark, "x")).collect())
    null = None if by_value else 0
    assert got == Counter([(null, "1", ()), (0, "2", (3, big)), (0, "3", (big,))] + [(None, "2", ())] * by_value)


def test_incomplete_jobs(spark):
    for part in ("mapper", "reducer", "partitioner"):
        full = {"mapper": lambda p, v: [], "reducer": lambda k, v: [], "partitioner": mr.hash_partitioner(1)}
        del full[part]
        with pytest.raises(ValueError, match=part):
            mr.run_job(mr.JobSpec(**full), rows(spark, "x"))
    with pytest.raises(ValueError, match="one partition"):
        mr.hash_partitioner(0)


def test_failing_mapper_fails_the_job(spark):
    job = mr.JobSpec(lambda p, v: [(int(v), 1)], lambda k, v: v, mr.hash_partitioner(2), key_type="long", value_type="long", output_type="long")
    with pytest.raises(Exception, match="invalid literal"):
        mr.run_job(job, rows(spark, "foo")).collect()


def test_sinks(spark, tmp_path):
    groups = spark.createDataFrame([(0, 'a"b', [1, 2]), (0, "c", []), (3, "d\\", [4])], "pid long, key string, values array<long>")
    out = str(tmp_path / "objects")
    write_json_objects(groups, out)
    got = {}
    for part in (tmp_path / "objects").glob("pid=*"):
        (f,) = part.glob("part-*.txt")
        got[part.name] = json.loads(f.read_text())
    assert got == {"pid=0": {'a"b': [1, 2], "c": []}, "pid=3": {"d\\": [4]}}
    back = key_values(spark, out, "long").collect()
    assert {(r["key"], r["value"]) for r in back} == {('a"b', 1), ('a"b', 2), ("d\\", 4)}
    lines = str(tmp_path / "lines")
    write_json_partitions(groups, lines)
    assert sorted(p.name for p in (tmp_path / "lines").glob("pid=*")) == ["pid=0", "pid=3"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_json_partitions(groups, lines, mode="errorifexists")
    assert default_output("/tmp/input/") == default_output("/tmp/input") == "/tmp/input/output/"


def test_command_line_run(spark, tmp_path):
    d = folder(tmp_path, a=WOOD + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        out = cli.run(spark, "word-count", d)
        # the output lies inside the input folder and is not read as input
        again = cli.run(spark, "word-count", d, str(tmp_path / "again"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    for o in (out, again):
        assert {r["key"]: r["values"][0] for r in spark.read.json(o).collect()} == WOOD_COUNTS
