"""Functions that no query uses, on literal cases."""

import datetime
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewell.functions import channels, text, timeutil, wording
from tidewell.operators import detectors
from tidewell.sources import envelopes, sinks
from tidewell.streaming import state


def each(spark, function, cases, kind="string"):
    """The results of a function of one column over the cases, in order."""
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r.y for r in d.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_times(spark):
    at = lambda *a: datetime.datetime(*a)
    got = each(spark, lambda x: timeutil.parse_time(x).cast("timestamp_ntz"), ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.123456789Z", "2026-01-02T03:04:05.5+02:00", "2026-01-02T03:04:05", "2026-01-02 03:04:05.250", "yesterday", None, ""])
    assert got[:1] == [at(2026, 1, 2, 3, 4, 5)] and got[1] == at(2026, 1, 2, 3, 4, 5, 123456) and got[3] == at(2026, 1, 2, 3, 4, 5) and got[4] == at(2026, 1, 2, 3, 4, 5, 250000)
    assert got[5:] == [None, None, None]
    assert each(spark, timeutil.without_fraction, ["2026-01-02T03:04:05.123Z", "2026-01-02T03:04:05Z", None]) == ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05Z", None]


def test_names_and_globs(spark):
    assert each(spark, channels.valid_name, ["app.loop.start.v1", "a.b", "app", "App.x", "a..b", "", None]) == [True, True, False, False, False, False, None]
    pairs = each(spark, lambda x: F.struct(*channels.subscription_kind(x)), ["a.b.*", "a.b*", "a.b", "*"])
    assert [tuple(p) for p in pairs] == [("a.b", "prefix"), ("a.b", "prefix"), ("a.b", "exact"), ("", "prefix")]
    globs = lambda p: each(spark, lambda x: x.rlike(channels.shell_glob(p)), ["a.b", "a.bc", "x", ""])
    assert globs("a.*") == [True, True, False, False] and globs("a.?") == [True, False, False, False] and globs("") == [True] * 4


def test_text_forms(spark):
    assert [tuple(x) for x in each(spark, text.diff_summary, ["--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y\n+z\n same", "", "+"])] == [(2, 1), (0, 0), (1, 0)]
    assert each(spark, lambda x: text.json_field(x, "k"), ['{"k": "v"}', '{"a": 1, "k": "cut off', '{"k": 3}', "none", None]) == ["v", "cut off", "3", None, None]
    assert each(spark, sinks.sparkline, [[0, 4, 8], [0, 0], [5]], "array<int>") == ["▁▅█", "▁▁", "█"]
    lines = sinks.exposition(spark.createDataFrame([('a"b\\c', 3)], "name string, n int"), "events_total", "n", ["name"])
    assert [r.line for r in lines.collect()] == ['events_total{name="a\\"b\\\\c"} 3']
    assert each(spark, wording.rung_target, [*wording.RUNG_TARGETS, "other", None]) == [*wording.RUNG_TARGETS.values(), "doc", "doc"]


def test_envelopes(spark):
    d = spark.range(1).select(envelopes.envelope(F.lit("1"), F.lit("/app"), F.lit("a.b.v1"), F.lit("2026-01-02T00:00:00Z"), F.struct(F.lit(5).alias("n"))).alias("value"))
    e = envelopes.parse_lines(d).first()
    assert (e.id, e.source, e.type, e.specversion, json.loads(e.data), e.failure_reason) == ("1", "/app", "a.b.v1", "1.0", {"n": 5}, None)
    ids = [each(spark, lambda x: envelopes.deterministic_id(F.lit("k"), x), ["a", "b", "a", None])[i] for i in range(4)]
    assert ids[0] == ids[2] != ids[1] and all(len(i) == 26 and i == i.upper() for i in ids)
    rows = [("00-aa-1", "2026-01-02T00:00:02Z", "2"), ("00-aa-2", "2026-01-02T00:00:01Z", "1"), ("00-bb-1", "2026-01-02T00:00:00Z", "0"), (None, None, "n")]
    t = spark.createDataFrame(rows, "traceparent string, ts string, id string")
    assert [r.id for r in envelopes.trace(t, "aa").collect()] == ["1", "2"]


def test_routing(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 2.5), (3, 0.1), (4, None)], "i int, dev double")
    tiers = [("alert", F.col("dev") >= 3), ("warn", F.col("dev") >= 2)]
    assert [r.tier for r in sinks.route(d, tiers).orderBy("i").collect()] == ["alert", "warn", "log", "log"]
    known = spark.createDataFrame([(1, 9.0)], "i int, warn double")
    assert [r.warn for r in state.with_thresholds(d, known, "i", {"warn": 2.0}).orderBy("i").collect()] == [9.0, 2.0, 2.0, 2.0]
    facts = [Row(d=None, e=5, dense=False, peer=False), Row(d=0.5, e=1, dense=False, peer=False), Row(d=0.5, e=0, dense=False, peer=False), Row(d=-1.0, e=0, dense=False, peer=False), Row(d=0.1, e=0, dense=True, peer=False), Row(d=0.1, e=0, dense=False, peer=True)]
    f = spark.createDataFrame(facts, "d double, e int, dense boolean, peer boolean")
    assert [r.y for r in f.select(state.interesting(F.col("d"), F.col("e"), F.col("dense"), F.col("peer")).alias("y")).collect()] == [False, True, False, True, True, True]
    shop, any_ = detectors.Adapter("shop|desk"), detectors.Adapter("s.*")
    assert detectors.adapter_of("shop", [shop, any_]) is shop and detectors.adapter_of("sea", [shop, any_]) is any_ and detectors.adapter_of("x", [shop]).projects == ".*"
