"""The capped log as a source; patterns, partial rows and sketches; late rows."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import moments, patterns
from tidewell.sources import capped


def append(folder, first, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{first:020d}.jsonl", "a") as f:
        f.write("".join(f"{x}\n" for x in lines))


def read(spark, folder, name, checkpoint, **options):
    r = spark.readStream.format("capped_log").option("path", str(folder))
    for k, v in options.items():
        r = r.option(k, v)
    out = f"{checkpoint}-{name}"  # a folder of its own for what this start of the query reads
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    q = r.load().writeStream.foreachBatch(put).option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    batches = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    q.stop()
    rows = spark.read.parquet(out).collect() if os.path.exists(out) else []
    return sorted(((r.sequence, r.record, r.value, r.lost) for r in rows), key=str), batches


def test_groups_truncation_and_restart(spark, tmp_path):
    spark.dataSource.register(capped.CappedLog)
    log = f"{tmp_path}/log"
    append(log, 1, [f"a{i}" for i in range(1, 6)])
    append(log, 6, [f"a{i}" for i in range(6, 9)])
    slow, slow_batches = read(spark, log, "slow1", tmp_path / "slow", group="slow", perBatch=3)
    fast, fast_batches = read(spark, log, "fast1", tmp_path / "fast", group="fast")
    expected = [(i, "entry", f"a{i}", None) for i in range(1, 9)]
    assert slow == expected == fast and max(slow_batches) == 3 and max(fast_batches) == 8
    with open(f"{log}/{6:020d}.jsonl", "a") as f:
        f.write("a9\na10\nhalf a li")  # a line that is not there yet
    fast, _ = read(spark, log, "fast2", tmp_path / "fast", group="fast")
    assert sorted(fast) == [(9, "entry", "a9", None), (10, "entry", "a10", None)]  # goes on where it was
    append(log, 6, ["ne"])
    append(log, 12, [f"a{i}" for i in range(12, 15)])
    append(log, 15, ["a15"])
    os.remove(f"{log}/{1:020d}.jsonl")
    os.remove(f"{log}/{6:020d}.jsonl")  # the cap: 9 to 11 are gone for the slow group, 11 for the fast
    fast, _ = read(spark, log, "fast3", tmp_path / "fast", group="fast")
    assert sorted(fast, key=lambda r: r[0]) == [(11, "lost", None, 1), *[(i, "entry", f"a{i}", None) for i in range(12, 16)]]
    slow, _ = read(spark, log, "slow2", tmp_path / "slow", group="slow", perBatch=100)
    assert sorted(slow, key=lambda r: r[0]) == [(9, "lost", None, 3), *[(i, "entry", f"a{i}", None) for i in range(12, 16)]]
    again, _ = read(spark, log, "slow3", tmp_path / "other", group="slow")  # a new query of the group
    assert again == slow  # which reads the batch again that no later one has acknowledged
    with pytest.raises(ValueError):
        capped.CappedStream({"path": log, "perbatch": "5"})
    slow, _ = read(spark, log, "slow4", tmp_path / "slow", group="slow", perBatch=1)
    assert slow == []  # its checkpoint knows better
    late, _ = read(spark, log, "late", tmp_path / "late", start="latest")
    assert late == []
    batch = spark.read.format("capped_log").option("path", log)
    assert batch.load().count() == 4 and batch.option("from", 9).load().agg(F.sum("lost")).first()[0] == 3
    assert spark.read.format("capped_log").option("path", f"{tmp_path}/none").load().count() == 0
    assert [(type(p).__name__, p.start, p.end) for p in capped.shares(log, 13, 16, 1)] == [("Share", 13, 14), ("Share", 14, 15), ("Share", 15, 16)]


def glob(pattern, name):
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name, re.S)


def test_first_listed_pattern_of_ten_thousand(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc.") for _ in range(n))
    names = [word(rng.randrange(1, 14)) for _ in range(400)] + ["a\\Eb", "x*y", "", None, "line\nbreak"]
    listed = [rng.choice(["{}", "{}*", "*{}", "*{}*", "{}*{}"]).format(word(rng.randrange(1, 7)), word(2)) for _ in range(10_000)] + ["a\\E*", "*\n*", None, "x[y"]
    rng.shuffle(listed)
    got = patterns.first_match(spark.createDataFrame([(n, 1) for n in names], "name string, place int"), spark.createDataFrame(list(enumerate(listed)), "place long, pattern string"))
    expected = {}
    for n in {n for n in names if n is not None}:
        best = next(((i, p) for i, p in enumerate(listed) if p is not None and glob(p, n)), None)
        if best:
            expected[n] = best
    assert {r.name: (r.place, r.pattern) for r in got.collect()} == expected and len(expected) > 300
    everything = spark.createDataFrame([(5, "*"), (9, "a*")], "place long, pattern string")
    assert {r.name: r.place for r in patterns.first_match(spark.createDataFrame([("a",), ("b",)], "name string"), everything).collect()} == {"a": 5, "b": 5}
    assert patterns.first_match(spark.createDataFrame([], "name string"), everything).count() == 0
    assert patterns.first_match(spark.createDataFrame([("a",)], "name string"), everything.limit(0)).count() == 0


def test_first_listed_pattern_broadcasts_no_table(spark):
    n = spark.range(2000).select(F.concat(F.lit("s.n."), F.col("id").cast("string"), F.lit(".v1")).alias("name"))
    p = spark.range(4000).select(F.col("id").alias("place"), F.concat(F.lit("*."), (F.col("id") + 1000).cast("string"), F.when(F.col("id") % 2 == 0, ".v1").otherwise("*")).alias("pattern"))
    got = patterns.first_match(n, p)
    assert {r.name: r.place for r in got.collect()} == {f"s.n.{i}.v1": i - 1000 for i in range(1000, 2000)}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_merged_days_equal_one_pass(spark):
    rng = np.random.default_rng(2)
    values = (1e6 + rng.normal(size=4000)).tolist()  # a mean far from 0, where naive sums of squares fail
    rows = [("a", i % 9, v) for i, v in enumerate(values)] + [("b", 1, 3.0), ("b", 2, None), ("c", 1, None), (None, 1, 5.0)]
    d = spark.createDataFrame(rows, "k string, day int, v double")
    m = {r.k: r for r in moments.merged(moments.daily(d, ["k", "day"], "v"), ["k"]).collect()}
    a = np.array(values)
    assert m["a"].n == 4000 and m["a"].mean == pytest.approx(a.mean(), rel=1e-12) and m["a"].m2 == pytest.approx(((a - a.mean()) ** 2).sum(), rel=1e-9)
    assert (m["a"].low, m["a"].high) == (a.min(), a.max()) and (m["b"].n, m["b"].mean, m["b"].m2) == (1, 3.0, 0.0) and (m["c"].n, m["c"].mean) == (0, None) and m[None].n == 1
    est = moments.merged(moments.daily(d, ["k", "day"], "v"), ["k"]).filter("k = 'a'").select("k", F.lit(0.5).alias("q"), moments.quantile(F.col("sketch"), 0.5).alias("estimate"))
    assert moments.rank_error(d, ["k"], "v", est).first().error <= 0.02


def test_counters_never_fall_short(spark):
    d = spark.createDataFrame([(i % 3, f"u{i * i % 97}") for i in range(5000)] + [(0, None)], "day int, u string")
    counters = moments.merge_counters(moments.count_min(d, ["day"], "u", width=64), [])
    exact = d.filter("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("n"))
    for r in moments.estimates(exact, "u", counters, width=64).collect():
        assert r.n <= r.estimate <= r.n + 2.72 * 5000 / 64
    assert counters.count() <= moments.DEPTH * 64 and moments.estimates(spark.createDataFrame([("none",)], "u string"), "u", counters.limit(0)).first().estimate == 0
