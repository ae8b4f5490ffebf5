"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import folds
from tidewell.streaming import state

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{DIR}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    for i in range(3):  # files in order of time
        e.filter((F.col("event_id") >= i * 400) & (F.col("event_id") < (i + 1) * 400)).coalesce(1).write.mode("append").parquet(folder)
    return folder, e


def run(spark, df, name, tmp, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_fold_equals_batch(spark, source, tmp_path):
    folder, e = source
    fold = folds.count_or_time("us", 40, 86_400_000_000)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(spark, state.stateful_fold(stream, "event_type", ["us", "event_id"], fold), "windows", tmp_path)
    batch = folds.ordered_fold(e, "event_type", ["us", "event_id"], fold)
    last = batch.groupBy("event_type").agg(F.max("window").alias("window"))
    closed = batch.join(last, ["event_type", "window"], "left_anti").select(batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def test_a_silent_key_closes_and_its_state_goes(spark, tmp_path):
    minute = 60_000_000
    schema = "k string, n long, us long, ended boolean, ts timestamp"
    t = 1_000_000 * minute
    files = [[("quiet", 1, t), ("quiet", 2, t + minute), ("loud", 3, t + minute)], [("loud", 4, t + 300 * minute)], [("loud", 5, t + 301 * minute)], [("loud", 6, t + 302 * minute)]]
    for rows in files:
        d = spark.createDataFrame([(k, n, us, False) for k, n, us in rows], "k string, n long, us long, ended boolean")
        d.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    fold = folds.idle_sessions("us", "ended", 30 * minute)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute")
    got = run(spark, state.stateful_fold(stream, "k", ["us", "n"], fold, idle_ms=60 * 60_000), "silent", tmp_path / "c")
    rows = {(r.k, r.session, r.started, r.last, r.events, r.close_reason) for r in got.collect()}
    assert ("quiet", 1, t, t + minute, 2, "open") in rows  # closed by the watermark alone
    assert {r for r in rows if r[0] == "loud"} in ({("loud", 1, t + minute, t + minute, 1, "idle_timeout")}, {("loud", 1, t + minute, t + minute, 1, "open")})


def test_dedupe_and_rates(spark, source, tmp_path):
    folder, e = source
    stream = spark.readStream.schema(e.schema).parquet(folder)
    twice = stream.union(spark.readStream.schema(e.schema).parquet(folder))
    assert run(spark, state.once(twice, "ts", "event_id", "60 days"), "once", tmp_path / "a").count() == e.count()
    got = run(spark, state.rates(stream, "ts", "event_type", "1 day"), "rates", tmp_path / "b")
    batch = e.groupBy("event_type", F.window("ts", "1 day").alias("w")).count().select("event_type", F.col("w.start"), "count")
    late = got.exceptAll(batch)
    assert got.count() > 50 and late.count() == 0
