"""Stateful operators on streams against their batch forms and by hand."""

import json
import random

import pytest

from tidewell.operators import alerts
from tidewell.streaming import processors as P

EVENT = "type string, data string, at long, id string"
RUN_EVENT = "run_key string, event_id string, at long, what string, body string"


@pytest.fixture(autouse=True)
def store(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    P.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each has state stores and workers of its own
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def land(spark, folder, parts, schema):
    """Files that arrive one after another."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def letter(at, reason="malformed_json"):
    return ("bus.dead_letter", json.dumps({"failure_reason": reason, "original_type": "x.y"}), at, f"l{at}")


def warn(at, stage="s", model="m", issue="slow"):
    return ("a.integrity.warn", json.dumps({"stage": stage, "model": model, "signal": issue}), at, f"w{at}")


def done(at, stage="s", model="m", ok=True):
    return ("a.stage.done", json.dumps({"stage": stage, "model": model, "ok": ok}), at, f"d{at}")


def changes(spark, events, reasons=("malformed_json",)):
    facts = alerts.alert_facts(spark.createDataFrame(events, EVENT), list(reasons))
    return [tuple(r) for r in alerts.alert_changes(facts).orderBy("kind", "at").collect()]


def test_alert_kinds_by_hand(spark):
    t = 1_000_000
    got = changes(spark, [warn(t), *[done(t + 10 + i) for i in range(3)], done(t + 20, ok=False), done(t + 21, model="other")])
    kind = '["integrity.warn","s","m","slow"]'
    # one failure: ratio 1; after three successes 1/4 < 0.30 within the silence: stabilizing; later 1/4 is still no dim ratio: active
    mine = [r for r in got if r[1] == kind]
    assert [(r[2] - t, r[3], r[4], r[5]) for r in mine] == [(0, "active", 1, 0), (12, "stabilizing", 1, 3), (601, "active", 1, 3)]
    assert mine[0][7:] == ("warn", "integrity slow @ s (m)")


def test_alert_resolves_regresses_and_is_remedied(spark):
    t = 1_000_000
    fixed = ("bus.remediation.applied", json.dumps({"targets_pathology": {"kind": ["integrity.warn", "s", "m", "slow"]}, "expected_resolution_window_s": 900}), t + 2000, "r")
    events = [warn(t), *[done(t + 1 + i) for i in range(20)], *[warn(t + 1000 + i) for i in range(12)], fixed, warn(t + 2001), warn(t + 4000)]
    mine = [(r[2] - t, r[3], r[6]) for r in changes(spark, events) if "integrity" in r[1]]
    assert (601, "resolved", False) in mine  # 1 of 21 and silent
    assert [s for a, s, _ in mine if 1000 <= a < 1012] == ["stabilizing", "regressed"] and all(g for a, _, g in mine if 1000 <= a < 1012)
    assert (2000, "regressed_fx", True) in mine  # the remedy's window is open
    assert mine[-1][1:] == ("regressed", True)  # and past


def test_any_event_is_a_success_for_dead_letters(spark):
    t = 1_000_000
    got = changes(spark, [letter(t), *[("x.y", "{}", t + 1, f"e{i}") for i in range(600)], letter(t + 2, "unknown")], ["malformed_json", "unknown"])
    first = [r for r in got if "malformed" in r[1]]
    assert [(r[2] - t, r[3], r[5]) for r in first] == [(0, "active", 0), (1, "stabilizing", 500), (601, "resolved", 500)]  # the ring holds 500
    assert [(r[3], r[5]) for r in got if '"unknown"' in r[1]][0] == ("active", 0)  # successes before a kind's first failure don't count


def test_alert_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    events, t = [], 1_000_000
    for _ in range(300):
        t += rng.choice([0, 1, 5, 60, 400, 2000])
        make = rng.choice([letter, warn, done, done, done])
        events.append(make(t, *([rng.choice(["malformed_json", "unknown"])] if make is letter else [rng.choice("ab"), "m"])))
        if rng.random() < 0.05:
            events.append(("bus.remediation.applied", json.dumps({"targets_pathology": {"kind": ["dlq", "unknown"]}}), t, f"r{t}"))
    cuts = [e[2] for e in events]
    parts = [[e for e in events if lo <= e[2] < hi] for lo, hi in zip([0, cuts[80], cuts[170], cuts[240]], [cuts[80], cuts[170], cuts[240], 1 << 60], strict=True)]
    land(spark, tmp_path / "in", parts, EVENT)
    reasons = ["malformed_json", "unknown"]
    batch = changes(spark, events, reasons)
    got = run(spark, P.alert_stream(alerts.alert_facts(stream(spark, tmp_path / "in", EVENT), reasons)), "alerts", tmp_path / "c")
    assert len(got) > 20 and set(got) <= set(batch)
    last = max(cuts)
    assert {r for r in batch if r not in set(got)} <= {r for r in batch if r[2] > last - 120}  # only what the watermark has not reached


def events_of(rng, keys, n):
    t, rows = 1_000_000, []
    for i in range(n):
        t += rng.choice([1, 5, 30, 200, 700])
        rows.append((rng.choice(keys), f"e{i:04d}", t, rng.choice(["Edit", "Bash", "Read", "Read", "session.ended"]), f"body {i}"))
    return rows


def test_runs_come_out_with_their_events(spark, tmp_path):
    rows = events_of(random.Random(2), ["a", "b", "c"], 200) + [("quiet", "q1", 1_000_000, "Edit", "x"), ("quiet", "q2", 1_000_010, "Read", "y")]
    rows.sort(key=lambda r: r[2])
    land(spark, tmp_path / "in", [rows[:70], rows[70:75], rows[75:]], RUN_EVENT)
    batch = {tuple(r) for r in P.recorded_batch(spark.createDataFrame(rows, RUN_EVENT), 900, ["session.ended"]).collect()}
    got = run(spark, P.recorded(stream(spark, tmp_path / "in", RUN_EVENT), 900, ["session.ended"]), "recorded", tmp_path / "c")
    closed = {r for r in batch if r[11] != "shutdown"}
    assert set(got) | {r for r in batch if r[11] == "shutdown"} >= batch and len(got) == len(set(got))
    quiet = [r for r in got if r[0] == "quiet"]  # closed by its timer, without a further event
    assert [(r[2], r[3], r[4], r[11]) for r in sorted(quiet, key=lambda r: r[3])] == [("event", 1, "q1", "idle_timeout"), ("event", 2, "q2", "idle_timeout"), ("run", 3, None, "idle_timeout")]
    assert set(got) - closed <= {(*r[:11], "idle_timeout", *r[12:]) for r in batch}
    hist = json.loads(next(r[7] for r in quiet if r[2] == "run"))
    assert hist == {"Edit": 1, "Read": 1}
    # what is still open at the end of the input, from the stored state
    flushed = {tuple(r) for r in P.open_runs(spark, str(tmp_path / "c")).collect()}
    seen = {r[1] for r in got}
    whole = {r for r in batch if r[1] not in seen}
    assert {(r[1], r[4], r[6], r[10], r[12]) for r in flushed} == {(r[1], r[4], r[6], r[10], r[12]) for r in whole} and whole
    chain = {r[1]: r[12] for r in batch if r[2] == "run" and r[0] == "a"}
    assert sum(v is None for v in chain.values()) == 1 and {v for v in chain.values() if v} < set(chain)


def test_windows_close_by_count_and_by_their_own_timer(spark, tmp_path):
    schema = "k string, at long, body string"
    parts = [[("a", 100, "1"), ("a", 101, "2"), ("b", 100, "x" * 30)], [("a", 102, "3"), ("c", 5000, "z")], [("c", 9000, "w")], [("c", 9001, "w")]]
    land(spark, tmp_path / "in", parts, schema)
    got = run(spark, P.count_or_time_stream(stream(spark, tmp_path / "in", schema), "k", 3, 60, longest=10), "batches", tmp_path / "c")
    assert ("a", 1, 100, 102, 3, ["1", "2", "3"]) in got  # by count, at once
    assert ("b", 1, 100, 100, 1, ["x" * 10]) in got  # by time, without a further row of b
    assert ("c", 1, 5000, 5000, 1, ["z"]) in got


def test_baselines_outlive_their_query(spark, tmp_path):
    schema = "k string, at long, value double"
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, rng.random() * 100) for i in range(400)]
    land(spark, tmp_path / "one", [rows[:100], rows[100:200]], schema)
    land(spark, tmp_path / "two", [rows[200:300], rows[300:]], schema)
    run(spark, P.baseline_stream(stream(spark, tmp_path / "one", schema), "k", ttl_ms=None), "first", tmp_path / "c1", "update")
    kept = P.stored_baselines(spark, str(tmp_path / "c1"), "k")
    kept.write.parquet(str(tmp_path / "kept"))
    got = run(spark, P.baseline_stream(stream(spark, tmp_path / "two", schema), "k", spark.read.parquet(str(tmp_path / "kept")), None), "second", tmp_path / "c2", "update")
    for k in "abc":
        values = [v for key, _, v in rows if key == k]
        expected = P.welford((0, 0.0, 0.0, float("inf"), float("-inf")), values)
        mine = max((r for r in got if r[0] == k), key=lambda r: r[1])
        assert mine[1] == len(values) and mine[1:] == pytest.approx(expected, rel=1e-12)


def test_no_rows(spark):
    assert alerts.alert_changes(alerts.alert_facts(spark.createDataFrame([], EVENT), ["r"])).count() == 0
    assert P.recorded_batch(spark.createDataFrame([], RUN_EVENT), 900, ["x"]).count() == 0
    odd = [(None, None, 5, None), ("bus.dead_letter", None, 6, "a"), ("bus.dead_letter", "no json", 7, "b"), ("x.integrity.warn", "[]", 8, "c")]
    assert len(changes(spark, odd, ["unknown"])) >= 2


def test_late_rows_are_placed_or_counted(spark, tmp_path):
    schema = "k string, at long"
    rng = random.Random(3)
    base = 1_000_000 * 60
    parts = [[("a", base + rng.randrange(600)) for _ in range(50)], [("a", base + 7200 + rng.randrange(60)) for _ in range(5)] + [("b", base)], [("a", base + 3700 + i) for i in range(9)] + [("a", base + 5)] * 4]
    land(spark, tmp_path / "in", parts, schema)
    got = run(spark, P.ring_counts(stream(spark, tmp_path / "in", schema), "k"), "ring", tmp_path / "c", "update")
    counts = {}
    for key, record, bucket, n in got:
        counts[(key, record, bucket)] = max(n, counts.get((key, record, bucket), 0))
    assert counts[("a", "late", None)] == 4 and counts[("a", "bucket", (base + 7200) // 60)] == 5
    assert sum(n for (k, r, b), n in counts.items() if k == "a" and r == "bucket" and (base + 3700) // 60 <= b <= (base + 3708) // 60) == 9  # late, but in the ring
    assert sum(n for (k, r, _), n in counts.items() if k == "a") == 68 and counts[("b", "bucket", base // 60)] == 1


def board_events():
    e = lambda at, channel, **data: (f"lab.{channel}.v1", json.dumps({"session_id": "s"} | data), at, f"{at:06d}")
    return [
        e(1, "iteration", iteration=0, status="start"), e(2, "phase", phase="eval", status="start"), e(3, "case.result", iteration=0, case_id="c1", verdict="OK", latency_ms=10), e(4, "case.result", iteration=0, case_id="c1", verdict="OK", latency_ms=99),
        e(5, "case.result", iteration=0, case_id="c2", verdict="ce", latency_ms="slow", generated_code="int main"), e(6, "sandbox", case_id="c2", status="complete", verdict="CE", exit_code=1), e(7, "phase", phase="eval", status="done"),
        e(8, "iteration", iteration=0, status="complete", aggregate_score=0.25, verdict_counts={"OK": 1}), e(9, "iteration.summary", iteration=0, num_cases=30), e(10, "improver", status="start", model="m", prompt_tokens=100), e(11, "improver", status="done", completion_tokens=7),
        e(12, "improver.prediction", iteration=0, confidence=0.8, predicted_score_delta=0.1), e(13, "iteration", iteration=1, status="start"), e(14, "improver.prediction.refuted_live", iteration=1, refutation_reason="worse"), e(15, "improver.prediction.verified", iteration=5, outcome_label="Confirmed", predicted={"confidence": "x"}),
        e(16, "failure_pattern", verdict="CE", prefix="int", sample_count=3), e(17, "failure_pattern", verdict="CE", sample_count=0), e(18, "improver.delta.diff", iteration=1, no_change=True), e(19, "improver.divergence", iteration=1, divergent=True, divergence_summary="x"), e(20, "improver.reasoning", parse_status="fallback", iteration=1),
        *[e(20 + i, "sandbox.stderr", verdict="RE", case_id=f"c{i}") for i in range(1, 8)], e(30, "iteration", iteration=1, status="complete", aggregate_score=0.5), e(31, "unknown.thing"), ("lab.case.result.v1", json.dumps({"case_id": "x", "verdict": "WA", "iteration": 2}), 32, "z"), ("lab.phase.v1", "no json", 33, "y"), ("other", None, 34, "w"),
    ]


def test_board_by_hand_and_as_a_stream(spark, tmp_path):
    from tidewell.operators import boards

    rows = board_events()
    batch = {(r.session, r.part): r.facts for r in boards.boards(boards.routed(spark.createDataFrame(rows, EVENT), "lab.")).collect()}
    part = lambda p, s="s": json.loads(batch[(s, p)])
    first = part("iteration/0")
    assert (first["done"], first["latencies"], first["live"], first["score"], first["expected"], first["phases"]) == (["c1", "c2"], [10.0], {"OK": 1, "ce": 1}, 0.25, 30, {})
    assert first["sandbox"] == {"c2": {"verdict": "CE", "latency_ms": None, "exit_code": 1}} and first["improver"]["completion_tokens"] == 7
    assert part("iteration/1")["before"] == 0.25 and part("iteration/1")["expected"] == 30
    assert part("prediction/0")["status"] == "refuted_live" and part("prediction/4") | {"changes": 0} == {"iteration": 4, "confidence": 0.0, "delta": 0.0, "changes": 0, "status": "confirmed", "at": 15, "actual_score_delta": 0.0, "score_delta_error": 0.0, "verdict_match_ratio": 0.0, "confidence_calibration": 0.0}
    assert [x["case"] for x in part("ring/stderr")["newest"]] == [f"c{i}" for i in range(3, 8)] and part("ribbon")["kind"] == "divergence"
    s = part("session")
    assert (s["scores"], s["prompt_tokens"], s["completion_tokens"], s["parse_status"], s["latest"]) == ([0.25, 0.5], 100, 7, "fallback", 1)
    assert part("pattern/CE/int")["samples"] == 3 and part("iteration/2", "?")["live"] == {"WA": 1} and len(boards.HANDLERS) == 14
    land(spark, tmp_path / "in", [rows[:6], rows[6:15], rows[15:]], EVENT)
    got = run(spark, P.board_stream(boards.routed(stream(spark, tmp_path / "in", EVENT), "lab.")), "boards", tmp_path / "c", "update")
    last = {}
    for session, p, facts in got:  # the memory sink keeps the order of micro-batches
        last[(session, p)] = facts
    assert last == batch
