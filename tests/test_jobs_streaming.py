"""Job control and the streaming forms."""

import time

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.plans.jobs import Jobs, Status, ask_cancel, noted
from tessera.session import fair_pools
from tessera.streaming import counts


def test_job_states(spark):
    jobs = Jobs(spark)
    good = jobs.submit("count", lambda s: s.range(1000).count(), client="me", priority=10)
    bad = jobs.submit("fail", lambda s: s.sql("SELECT nothing FROM nowhere").count(), client="me")
    assert jobs.wait(good) is Status.DONE and jobs.jobs[good].result == 1000
    assert jobs.wait(bad) is Status.FAILED and "nowhere" in jobs.jobs[bad].error
    assert jobs.status("other") is Status.UNKNOWN
    assert [j.name for j in jobs.of_client("me")] == ["fail", "count"]
    assert not jobs.cancel(good) and not jobs.cancel(client="nobody")
    j = jobs.jobs[good]
    assert j.queued <= j.started <= j.done
    assert jobs.cluster()["waiting_jobs"] == 0


def test_cancel(spark):
    jobs = Jobs(spark)
    slow = jobs.submit("slow", lambda s: s.range(10**12).select(F.sum(F.xxhash64("id") % 7)).collect(), client="c")
    while jobs.status(slow) is Status.IN_QUEUE or not jobs.cluster()["running_stages"]:
        time.sleep(0.1)
    assert jobs.cancel(client="c")
    jobs.wait(slow, 60)
    assert jobs.status(slow) is Status.CANCELLED and not jobs.threads[slow].is_alive()


def test_priorities(spark):
    with pytest.raises(ValueError, match="1 to 10"):
        Jobs(spark).submit("x", lambda s: None, priority=11)
    assert '<pool name="priority-7"><schedulingMode>FAIR</schedulingMode><weight>7</weight></pool>' in fair_pools()


def test_pools_are_installed(spark):
    pool = spark.sparkContext._jsc.sc().getPoolForName("priority-7")
    assert pool.isDefined() and pool.get().weight() == 7


def test_states_in_files(spark, tmp_path):
    """Other processes see the states and may ask for a cancel; a job whose check fails is refused."""
    jobs = Jobs(spark, str(tmp_path / "jobs"))
    slow = jobs.submit("slow", lambda s: s.range(10**12).select(F.sum(F.xxhash64("id") % 7)).collect(), client="c")
    while noted(str(tmp_path / "jobs"), "c")[0]["status"] != "IN_PROGRESS":
        time.sleep(0.1)
    assert ask_cancel(str(tmp_path / "jobs"), client="c") == slow
    assert jobs.wait(slow, 60) is Status.CANCELLED
    assert ask_cancel(str(tmp_path / "jobs"), client="c") is None and ask_cancel(str(tmp_path / "jobs"), "other") is None

    def missing():
        raise FileNotFoundError("no input")

    with pytest.raises(FileNotFoundError, match="no input"):
        jobs.submit("x", lambda s: None, check=missing)


def test_command_line(spark, tmp_path, capsys):
    state = ["--state", str(tmp_path / "state")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('1,"Bad, The (1999)",A|B\n2,Good (2000),B\n' + "7,1,4.5,100\n" * 150 + "7,2,5,100\n" * 2)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        run = lambda name, source, out: cli.main([*state, "run", name, "--input", str(tmp_path / source), "--output", str(tmp_path / out)], spark)
        assert run("rating-aggregator", "in", "rated") == run("rating-by-genre", "rated", "best") == run("rating-by-year", "rated", "years") == run("concat", "in", "joined") == 0
        with pytest.raises(FileNotFoundError):
            run("grep", "nowhere", "x")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    values = lambda name: {(r["pid"], r["key"], tuple(r["values"])) for r in spark.read.json(str(tmp_path / name)).collect()}
    assert {v for _, _, v in values("rated")} == {('"Bad, The (1999)","A|B",4.5,150',), ('"Good (2000)","B",5,2',)}
    assert values("best") == {(0, "A", ("Bad, The (1999)", "4.5")), (0, "B", ("Bad, The (1999)", "4.5"))}
    assert values("years") == {(1999, "Bad, The (1999)", (4.5,)), (2000, "Good (2000)", (5.0,))}
    with pytest.raises(SystemExit):
        cli.main([*state, "run", "grep", "--input", "relative"], spark)
    capsys.readouterr()
    assert cli.main([*state, "status"]) == 0 and capsys.readouterr().out.count("DONE") == 4
    assert cli.main([*state, "cluster-status"]) == 0 and "DONE\t4" in capsys.readouterr().out
    assert cli.main([*state, "cancel"]) == 1


def test_streamed_windows_equal_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    batch = counts.event_counts(spark.read.parquet(f"{sf}/events.parquet"))
    counts.to_memory(counts.event_counts(counts.stream_table(spark, sf, "events")), "windows", "complete", str(tmp_path / "c"))
    flat = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert flat(spark.table("windows")) == flat(batch)


def test_streamed_words(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text("wood chuck\n" * (i + 1))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    counts.to_memory(counts.running_words(lines), "words", "complete", str(tmp_path / "c"))
    assert {r["word"]: r["n"] for r in spark.table("words").collect()} == {"wood": 6, "chuck": 6}
