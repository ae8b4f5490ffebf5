"""Fixtures with known answers for the event engine."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import channels, stats, text
from tidewell.operators import deadletters, folds, graph, joins, keys, runs, sequences, sessions
from tidewell.plans import guard
from tidewell.sources import envelopes, logs, schemas, sinks

MIN = 60_000_000


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("pattern", "name", "match"),
    [("a.*.c", "a.b.c", True), ("a.*.c", "a.b.b.c", False), ("a.#", "a", True), ("a.#", "a.b.c", True), ("a.b", "a.b.c", False), ("#", "x", True), ("a.*", "a", False), ("a.b", "axb", False)],
)
def test_topic_glob(spark, pattern, name, match):
    assert one(spark, channels.matches_topic(F.lit(name), pattern)) is match


def test_prefix_variant_and_prefix_join(spark):
    assert one(spark, channels.matches_topic(F.lit("a.b.c"), "a.b", prefix_match=True))
    subs = spark.createDataFrame([(1, "bus.bead", "prefix"), (2, "bus.bead", "exact")], "consumer int, channel string, match_type string")
    names = spark.createDataFrame([("bus.bead.x",), ("bus.beadfoo",), ("bus.bead",)], "name string")
    assert rows(joins.match_subscriptions(subs, names, "channel", "match_type", "name"), "consumer", "name") == [(1, "bus.bead"), (1, "bus.bead.x"), (2, "bus.bead")]


def test_fingerprint_and_level(spark):
    fp = text.fingerprint(F.lit("2024-01-02T03:04:05Z Failed pid=12 at 10.0.0.1 0xDEADBEEF  x99"))
    assert one(spark, fp) == "{ts} failed pid={n} at {n}.{n}.{n}.{n} {hex} x{n}".replace("{n}.{n}.{n}.{n}", "{ip}").replace("pid={n}", "pid={n}")
    assert one(spark, text.level(F.lit("Out of memory, then an error"))) == "critical"
    assert one(spark, text.normal_command(F.lit("  grep 'a b' /tmp/x 42 | wc -l"))) == "grep '<s>' <path> <n>"
    assert one(spark, text.json_field(F.lit('{"file_path": "/a/b", "content": "cut of'), "file_path")) == "/a/b"


def test_deviation_needs_samples(spark):
    d = lambda n: one(spark, stats.deviation(F.lit(5.0), F.lit(n), F.lit(3.0), F.lit(2.0)))
    assert d(99) is None and d(100) == 1.0
    m = spark.createDataFrame([(x,) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x long").agg(*[c.alias(k) for k, c in stats.moments(F.col("x")).items()])
    assert m.select(stats.stddev_pop(F.col("n"), F.col("total"), F.col("squares")).alias("s")).first().s == 2.0


def test_sessions_gap_and_end(spark):
    e = [("k", 0, 1, False), ("k", 15 * MIN, 2, False), ("k", 31 * MIN, 3, True), ("k", 32 * MIN, 4, False)]
    df = spark.createDataFrame(e, "key string, us long, id long, ended boolean")
    got = sessions.idle_sessions(df, "key", "us", "id", 15 * MIN, F.col("ended"))
    assert rows(got, "id", "session") == [(1, 1), (2, 1), (3, 2), (4, 3)]
    fold = folds.ordered_fold(df, "key", ["us", "id"], folds.idle_sessions("us", "ended", 15 * MIN))
    assert rows(fold, "session", "events", "close_reason") == [(1, 2, "idle_timeout"), (2, 1, "ended"), (3, 1, "open")]


def test_count_or_time(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 20, 21)], "key string, us long")
    got = folds.ordered_fold(df, "key", ["us"], folds.count_or_time("us", 3, 10))
    assert rows(got, "window", "opened", "events") == [(1, 0, 3), (2, 3, 1), (3, 20, 2)]


def test_latch_and_calibration(spark):
    df = spark.createDataFrame([("g", t, lag) for t, lag in enumerate((5, 2000, 3000, 0, 1500))], "key string, us long, lag long")
    assert rows(folds.ordered_fold(df, "key", ["us"], folds.alert_latch("us", "lag")), "at", "alert") == [(1, "raised"), (3, "recovered"), (4, "raised")]
    v = spark.createDataFrame([("t", i, "reject" if i == 3 else "accept") for i in range(15)], "key string, i long, verdict string")
    assert rows(folds.ordered_fold(v, "key", ["i"], folds.calibration("verdict")), "accepts", "rejects", "last_reject", "auto_enabled") == [(14, 1, 4, True)]


def test_thrash_cycles_spans(spark):
    def cycle(a, b, c):
        return ["edit"] + ["x"] * (a - 1) + ["build"] + ["x"] * (b - 1) + ["fail"] + ["x"] * (c - 1) + ["revert"]

    data = {"fits": cycle(10, 20, 20), "build late": cycle(11, 1, 1), "fail late": cycle(1, 21, 1), "twice": cycle(1, 1, 1) * 2}
    df = spark.createDataFrame([(k, i, x) for k, ev in data.items() for i, x in enumerate(ev)], "key string, i long, kind string")
    got = folds.ordered_fold(df, "key", ["i"], folds.thrash_cycles("kind"))
    assert rows(got.groupBy("key").count(), "key", "count") == [("fits", 1), ("twice", 2)]


def test_chain_roots_with_cycles(spark):
    e = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 7), (7, 5), (8, 5), (9, 9)]
    assert rows(graph.chain_roots(spark.createDataFrame(e, "id long, parent long")), "id", "root") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 5), (8, 5), (9, 9)]


def test_long_chain(spark):
    e = spark.range(1, 3001).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"))
    assert rows(graph.chain_roots(e).groupBy("root").count(), "root", "count") == [(1, 3000)]


def test_pareto_equal_points_stay(spark):
    p = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, 5), (4, 2, 6)], "id int, cost int, score int")
    assert rows(joins.pareto(p, "cost", "score"), "id", "dominated") == [(1, False), (2, False), (3, True), (4, False)]


def test_fix_windows(spark):
    day = 24 * 60 * MIN
    fixes = spark.createDataFrame([("a", 10 * day)], "key string, at long")
    ev = spark.createDataFrame([("a", 3 * day), ("a", 10 * day - 1), ("a", 10 * day), ("a", 17 * day), ("a", 17 * day + 1), ("b", 10 * day)], "key string, us long")
    assert rows(joins.interval_effects(fixes, ev, "key", "at", "us"), "before", "after") == [(2, 2)]


def test_unlabeled_is_not_clean(spark):
    r = spark.createDataFrame([("r1", "clean", None), ("r2", None, 5), ("r3", "thrashed", 5)], "run_id string, outcome string, labeled_at long")
    assert rows(r.withColumn("l", runs.outcome_label()), "run_id", "l") == [("r1", "unlabeled"), ("r2", "unlabeled"), ("r3", "thrashed")]
    assert rows(runs.thrash_runs(r), "run_id") == [("r3",)]


def test_issue_first_insert_counts_one(spark):
    old = spark.createDataFrame([("s", 3, 1, 2)], "sig string, recurrence_count long, first_seen long, last_seen long")
    hits = spark.createDataFrame([("s", 2, 5, 6), ("t", 9, 5, 6)], "sig string, new_hits long, seen_from long, seen_to long")
    assert rows(keys.issue_update(old, hits, ["sig"]), "sig", "recurrence_count", "first_seen", "last_seen") == [("s", 5, 1, 6), ("t", 1, 5, 6)]


def test_decisions(spark):
    d = lambda **k: one(spark, runs.decision(**{n: F.lit(v) for n, v in ({"score": 0.4, "rung": "eliminate", "replay": "passed", "failures": 1, "clean": 0, "runs": 5} | k).items()}))
    assert d() == "propose_fix" and d(score=0.2) == "monitor" and d(runs=1) == "needs_more_data"
    assert d(clean=3) == "suppressed" and d(replay="failed") == "suppressed" and d(rung="inform", replay="not_applicable") == "monitor"


def test_dead_letters(spark):
    assert one(spark, deadletters.next_retry(F.lit(0), F.lit(0))) == 300 * 1_000_000 and one(spark, deadletters.next_retry(F.lit(0), F.lit(2))) is None
    empty = spark.createDataFrame([], "quarantined_at long, resolved_at long")
    assert rows(deadletters.counters(empty), "total", "quarantined", "retried_ok", "pending") == [(0, 0, 0, 0)]
    assert one(spark, deadletters.abandoned(F.lit("Unknown"), F.lit("{}"))) and one(spark, deadletters.abandoned(F.lit("a"), F.lit("{bad")))


def test_bigrams_phases_tail(spark):
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate("aabca")], "key string, i long, kind string")
    assert rows(sequences.phases(df, "key", ["i"], "kind"), "phase", "kind", "length") == [(1, "a", 2), (2, "b", 1), (3, "c", 1), (4, "a", 1)]
    assert rows(sequences.in_tail(df, "key", ["i"], F.col("kind") == "b"), "in_tail") == [(True,)]


def test_envelopes_schemas_and_sinks(spark, tmp_path):
    schema = {"type": "object", "required": ["ts", "event"], "properties": {"ts": {"type": "string"}, "event": {"enum": ["tool_call", "ended"]}, "n": {"type": "integer", "minimum": 0}}}
    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas" / "app.activity.v1.json").write_text(json.dumps(schema))
    line = lambda t, data, **k: json.dumps({"specversion": "1.0", "id": k.get("id", "1"), "source": "/a", "type": t, "time": "2024-01-01T00:00:00.123456789Z", "data": data})
    lines = [line("app.activity.v1", {"ts": "x", "event": "ended", "n": 1}), line("app.activity.v1", {"ts": "x", "event": "other"}, id="2"), line("app.activity.v1", {"event": "ended"}, id="3"),
             line("new.thing.v1", {}, id="4"), "{bad", json.dumps({"id": "6"}), line("app.activity.v1", {"ts": "x", "event": "ended", "n": "many"}, id="7")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines))
    registry = schemas.SchemaRegistry.load(spark, str(tmp_path / "schemas"))
    v = registry.validated(envelopes.read_log(spark, str(tmp_path / "log")))
    got = {(r.id, r.failure_reason, r.detail) for r in v.collect()}
    assert got == {("1", None, None), ("2", "schema_violation", "event: not allowed"), ("3", "schema_violation", "ts: required"), ("4", None, None), (None, "malformed_json", None), ("6", "missing_type", None), ("7", "schema_violation", "n: type")}
    assert rows(schemas.unknown_tally(v.filter("type is not null")), "type", "n") == [("new.thing.v1", 1)]
    assert rows(registry.typed(v.filter("failure_reason is null"), "app.activity.v1"), "event", "n") == [("ended", 1)]
    sinks.mirror(v, str(tmp_path / "out"), str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and spark.read.parquet(str(tmp_path / "dead")).count() == 5


def test_logs(spark):
    d = logs.docker(spark.createDataFrame([("web-1", "2024-01-01T00:00:00Z Failed to bind"), ("db", "ready")], "container string, value string"))
    assert rows(d, "service", "level", "message") == [("db", "info", "ready"), ("web", "error", "Failed to bind")]
    j = [json.dumps({"MESSAGE": "\x1b[31mred\x1b[0m", "PRIORITY": "3", "SYSLOG_IDENTIFIER": "u"}), json.dumps({"MESSAGE": [104, 105]}), json.dumps({"MESSAGE": ["a", "b"], "PRIORITY": "x"})]
    assert rows(logs.journal(spark.createDataFrame([(x,) for x in j], "value string")), "level", "message") == [("error", "red"), ("info", "<binary>"), ("info", "a b")]
    assert rows(logs.kernel(spark.createDataFrame([("11,1,2,-;oops",), ("warning only",)], "value string")), "level", "message") == [("error", "oops"), ("warn", "warning only")]


def test_guard():
    assert guard.check_select("select 1 -- x\n;") == "select 1"
    for bad in ("drop table x", "with a as (select 1) select * from a", "select 1; select 2"):
        with pytest.raises(ValueError):
            guard.check_select(bad)
