"""Jumping scans against the folds that say the same, also with keys cut into many segments; sinks that fail half-way."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import detectors, folds, jumps
from tidewell.sources import sinks

SCHEMA = "k string, us long, n long, kind string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    out, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 1, 2, 50])
        out.append((rng.choice(["big"] * 8 + ["small", None, "x"]), t, i, rng.choice(["edit", "build", "fail", "revert", "other"])))
    return spark.createDataFrame(out + [("lone", 5, 9000, "edit")], SCHEMA).repartition(3).cache()


def same(a, b):
    return sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.select(a.columns).collect())))


@pytest.mark.parametrize("segment", [60, 200, 1 << 18])
@pytest.mark.parametrize(("most", "span"), [(7, 40), (50, 10_000), (1, 5), (20, 1)])
def test_windows_equal_the_fold(spark, rows, segment, most, span):
    known = rows.filter("k IS NOT NULL")
    got = jumps.count_or_time(known, "k", "us", ["us", "n"], most, span, segment=segment, ranges=7)
    assert same(folds.ordered_fold(known, "k", ["us", "n"], folds.count_or_time("us", most, span)), got)


@pytest.mark.parametrize("segment", [210, 1 << 18])
def test_cycles_equal_the_fold(spark, rows, segment):
    """The run of most rows is cut into ten segments."""
    known = rows.filter("k IS NOT NULL")
    got = jumps.thrash_cycles(known, "k", "kind", ["us", "n"], segment=segment, ranges=5)
    assert got.count() > 40 and same(folds.ordered_fold(known, "k", ["us", "n"], folds.thrash_cycles("kind")), got)


def test_odd_tables_of_jumps(spark, rows):
    assert jumps.count_or_time(rows.limit(0), "k", "us", ["us", "n"], 5, 5).count() == 0
    got = jumps.count_or_time(rows, "k", "us", ["us", "n"], 7, 40, segment=60, ranges=7)
    assert got.filter("k IS NULL").agg(F.sum("events")).first()[0] == rows.filter("k IS NULL").count()
    with pytest.raises(ValueError):
        jumps.count_or_time(rows, "k", "us", ["us", "n"], 100, 5, segment=60)


def test_a_handler_that_fails_once_writes_no_row_twice(spark, tmp_path):
    e = spark.range(20).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") + 5000).alias("ts"), F.lit("a.b.v1").alias("type"), F.lit("s").alias("source"), F.lit("{}").alias("raw"), F.when(F.col("id") == 19, "malformed_json").alias("failure_reason"), F.lit(None).cast("string").alias("detail"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    out, dead, failed = str(tmp_path / "out"), str(tmp_path / "dead"), []

    def once(df, batch):
        sinks.put(df.filter("failure_reason IS NULL"), out, batch, "type")
        if not failed:
            failed.append(batch)
            raise OSError("disk full")
        sinks.put(sinks.dead_letters(df.filter("failure_reason IS NOT NULL")), dead, batch)

    def run():
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["id"])
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(sinks.dispatch([(F.lit(True), once)])).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="disk full"):
        run()
    assert spark.read.parquet(out).count() == 19  # of the attempt that failed
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(map(str, range(19))) and spark.read.parquet(dead).count() == 1


def test_replays_by_rung_and_by_trigger(spark):
    assert [detectors.default_replay(r) for r in ("eliminate", "automate", "inform")] == ["pending", "pending", "not_applicable"]
    hits = [(i, "leak", s) for s, n in (("good", 3), ("mixed", 4), ("few", 1), ("twice", 4)) for i in [f"{s}{k}" for k in range(n)]]
    outcome = lambda i: (i, "abandoned" if i == "mixed0" else "landed", "2026-01-01")
    found = spark.createDataFrame(hits, "run_id string, detector string, signature string")
    runs = spark.createDataFrame([outcome(i) for i, _, _ in hits], "run_id string, outcome string, labeled_at string")
    roots = spark.createDataFrame([(f"twice{k}", "twice0") for k in range(3)], "run_id string, root string")
    got = {r.signature: (r.replay, r.runs_evaluated) for r in detectors.trigger_replay(found, runs, roots, "leak").collect()}
    assert got == {"good": ("passed", 3), "mixed": ("failed", 4), "few": ("insufficient_history", 1), "twice": ("passed", 2)}


def test_slow_builds_by_hand(spark):
    from tidewell.operators import rebuilds

    tree, home = "/x/projects/p/.claude/worktrees/agent-1", "/x/projects/p"
    e = lambda run, i, at, command, cwd=tree, project="p", closed=True: (run, i, at * 1_000_000, command, cwd, project, closed)
    rows = [
        e("a", 1, 0, "cargo build -p core"), e("a", 2, 10, "ls"), e("a", 3, 20, "cargo build -p core"), e("a", 4, 55, "cargo build"), e("a", 5, 65, "ls"), e("a", 6, 100, "cargo test --package core"),
        e("b", 1, 0, "cargo build -p core"), e("b", 2, 61, "ls"), e("c", 1, 0, "cargo build -p core", home), e("c", 2, 900, "ls"), e("d", 1, 0, "cargo build -p core", closed=False), e("d", 2, 900, "ls", closed=False),
        e("e", 1, 0, "cargo build -p solo", project="q"), e("e", 2, 59, "ls", project="q"), e("f", 1, 50, "cargo build -p core"), e("f", 2, 40, "ls"),
    ]
    d = spark.createDataFrame(rows, "run_id string, i long, us long, command string, cwd string, project string, closed boolean")
    got = {(r.project, r.crate): (r.slow_builds, r.runs, r.max_gap, r.baseline) for r in rebuilds.slow_builds(rebuilds.observations(d, F.col("command"), ["i"])).collect()}
    # gaps of p: 10, 35, 10, 61; median 22.5: only 61 is above the floor, and none above 67.5
    assert got == {("p", "core"): (1, 1, 61.0, 22.5)}


def test_waves_by_time_or_sequence(spark):
    from tidewell.operators import sessions

    rows = [("k", 1, 0), ("k", 2, 90), ("k", 3, 181), ("k", 5, None), ("k", 14, None), ("k", 15, 271), ("k", 16, 400), ("n", 1, None), ("n", 9, None), ("n", 18, None)]
    d = spark.createDataFrame(rows, "k string, seq long, t long")
    got = [(r.k, r.seq, r.wave) for r in sessions.waves(d, "k", "seq", "t", 90).orderBy("k", "seq").collect()]
    assert got == [("k", 1, 1), ("k", 2, 1), ("k", 3, 2), ("k", 5, 2), ("k", 14, 3), ("k", 15, 3), ("k", 16, 4), ("n", 1, 1), ("n", 9, 1), ("n", 18, 2)]
