"""Stateful operators with several named states and timers per key, on ``transformWithState``.

Each runs the logic of a batch operator, so that a stream gives what a batch gives. They need the
RocksDB state store (``use_rocksdb``). Later micro-batches must hold later events of a key; within
one they are put in order. Event-time timers fire when the stream's watermark has passed them, so a
silent key comes to its end without a further event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType

from tidewell.operators import alerts, boards

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


TEXT, LONG, DOUBLE = StringType(), LongType(), DoubleType()


def _fields(**types: DataType) -> StructType:
    """A schema made without a session, as tasks have none."""
    return StructType([StructField(k, v) for k, v in types.items()])


def _names(schema: str) -> list[str]:
    """The names in a schema of simple types."""
    return [c.split()[0] for c in schema.split(", ")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame.from_records(rows, columns=_names(schema)).astype(object)


def _sorted(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", na_position="first")


def _plain(value):
    """A pandas value as Python's own; missing ones as None."""
    if value is None or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


# --- alerts -----------------------------------------------------------------------------------

ALERTS = f"group string, {alerts.CHANGES}"


class AlertStates(StatefulProcessor):
    """A group's kinds: the plain facts of each in a map, its rings in two more, so that a success rewrites no failures."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getMapState("kinds", _fields(kind=TEXT), _fields(facts=TEXT))
        self.failures = handle.getMapState("failures", _fields(kind=TEXT), _fields(ring=ArrayType(LONG)))
        self.successes = handle.getMapState("successes", _fields(kind=TEXT), _fields(ring=ArrayType(_fields(at=LONG, n=LONG))))

    def _load(self) -> dict[str, dict]:
        out = {}
        for (kind,), (facts,) in self.kinds.iterator():
            failures, successes = self.failures.getValue((kind,)), self.successes.getValue((kind,))
            out[kind] = json.loads(facts) | {"failures": [int(t) for t in failures[0]] if failures else [], "successes": [[int(t), int(n)] for t, n in successes[0]] if successes else []}
        return out

    def _store(self, kinds: dict[str, dict], before: dict[str, str]) -> None:
        for kind, s in kinds.items():
            if json.dumps(s) != before.get(kind):
                self.kinds.updateValue((kind,), (json.dumps({k: v for k, v in s.items() if k not in ("failures", "successes")}),))
                self.failures.updateValue((kind,), (s["failures"],))
                self.successes.updateValue((kind,), ([tuple(x) for x in s["successes"]],))

    def _wake(self, kinds: dict[str, dict]) -> None:
        """One timer, for the silence that ends first."""
        due = min((s["due"] for s in kinds.values() if s["due"] is not None), default=None)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kinds = self._load()
        before, out = {k: json.dumps(s) for k, s in kinds.items()}, []
        facts = pd.concat(list(rows), ignore_index=True)
        good = facts["what"] == 2
        summed = facts[good].groupby("at", as_index=False)["n"].sum().assign(what=2)
        facts = pd.concat([facts[~good], summed], ignore_index=True).sort_values(list(alerts.ORDER), kind="stable", na_position="first")
        for row in facts[["kind", "at", "what", "n", "label", "severity", "until"]].astype(object).itertuples(index=False, name=None):
            kind, at, what, n, label, severity, until = map(_plain, row)
            out += alerts.group_step(kinds, (kind, int(at), int(what), int(n), label, severity, until if until is None else int(until)))
        self._store(kinds, before)
        self._wake(kinds)
        yield _frame([(key[0], *r) for r in out], ALERTS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kinds = self._load()
        before = {k: json.dumps(s) for k, s in kinds.items()}
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        out = [r for k in sorted(kinds) for r in alerts.Kind.silence(kinds[k], k, now + 1)]
        self._store(kinds, before)
        self._wake(kinds)
        yield _frame([(key[0], *r) for r in out], ALERTS)

    def close(self) -> None:
        pass


def alert_stream(facts: DataFrame, late: str = "1 minute") -> DataFrame:
    """``operators.alerts.alert_changes`` of a stream of facts."""
    timed = facts.withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)
    return timed.groupBy("group").transformWithStateInPandas(AlertStates(), ALERTS, "append", "eventTime")


# --- runs and their events --------------------------------------------------------------------

RECORDS = "run_key string, run_id string, record string, seq long, event_id string, at long, what string, body string, started long, ended long, events long, close_reason string, continues string"


def run_id(run_key: str, started: int, first: str) -> str:
    """The same in every run: from the key, the time and the first event's id."""
    return f"{run_key}@{started}#{first}"


class _Run:
    """The open run of a key as plain facts; closing makes the run's row and its events' rows."""

    @staticmethod
    def records(key: str, run: dict, children: list[tuple], reason: str) -> list[tuple]:
        of = run_id(key, run["started"], run["first"])
        whole = (run["started"], run["last"], len(children), reason, run["before"])
        rows = [(key, of, "event", i, c[0], c[1], c[2], c[3], *whole) for i, c in enumerate(children, 1)]
        return [*rows, (key, of, "run", len(children) + 1, None, run["last"], "run.closed", json.dumps(_histogram(children), sort_keys=True), *whole)]

    @staticmethod
    def step(key: str, run: dict | None, children: list[tuple], row: tuple, gap: int, ending: frozenset[str], before: str | None) -> tuple[dict | None, list[tuple], list[tuple], str | None]:
        """(open run, its events, records that come out, id of the last closed run) after an event (event_id, at, what, body)."""
        out, at = [], row[1]
        if run is not None and at - run["last"] > gap:
            out += _Run.records(key, run, children, "idle_timeout")
            before, run, children = run_id(key, run["started"], run["first"]), None, []
        if run is None:
            run, children = {"started": at, "first": row[0], "before": before}, []
        run["last"] = at
        children.append(row)
        if row[2] in ending:
            out += _Run.records(key, run, children, "ended")
            before, run, children = run_id(key, run["started"], run["first"]), None, []
        return run, children, out, before


def _histogram(children: list[tuple]) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in children:
        out[c[2]] = out.get(c[2], 0) + 1
    return out


class RunRecorder(StatefulProcessor):
    """Events wait in a list state until their run closes: by an ending event, a gap, or a timer where the key falls silent.
    What comes out is the run's events in order and a row of the run itself, in one micro-batch."""

    def __init__(self, gap: int, ending: frozenset[str]):
        self.gap, self.ending = gap, ending

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _fields(started=LONG, last=LONG, first=TEXT))
        self.before = handle.getValueState("before", _fields(run_id=TEXT))
        self.children = handle.getListState("children", _fields(event_id=TEXT, at=LONG, what=TEXT, body=TEXT))

    def _load(self) -> tuple[dict | None, str | None]:
        before = self.before.get()[0] if self.before.exists() else None
        if not self.open.exists():
            return None, before
        started, last, first = self.open.get()
        return {"started": int(started), "last": int(last), "first": first, "before": before}, before

    def _wake(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, before = self._load()
        had, out = run is not None, []
        children = [(e, int(t), w, b) for e, t, w, b in self.children.get()] if had else []
        stored = len(children)
        for row in _sorted(rows, ["at", "event_id"])[["event_id", "at", "what", "body"]].astype(object).itertuples(index=False, name=None):
            e, t, w, b = map(_plain, row)
            run, children, closed, before = _Run.step(key[0], run, children, (e, int(t), w, b), self.gap, self.ending, before)
            if closed:
                out += closed
                stored = 0
        if stored and not out:
            self.children.appendList(children[stored:])  # the same run goes on: only what is new is added
        elif children:
            self.children.put(children)
        elif had:
            self.children.clear()
        if run is None:
            self.open.clear()
        else:
            self.open.update((run["started"], run["last"], run["first"]))
        if before is not None:
            self.before.update((before,))
        self._wake(None if run is None else run["last"] + self.gap + 1)
        yield _frame(out, RECORDS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, before = self._load()
        if run is None or expiredTimerInfo.getExpiryTimeInMs() // 1000 <= run["last"] + self.gap:
            return
        children = [(e, int(t), w, b) for e, t, w, b in self.children.get()]
        self.children.clear()
        self.open.clear()
        self.before.update((run_id(key[0], run["started"], run["first"]),))
        yield _frame(_Run.records(key[0], run, children, "idle_timeout"), RECORDS)

    def close(self) -> None:
        pass


def recorded(stream: DataFrame, gap: int, ending: list[str], late: str = "1 minute") -> DataFrame:
    """Runs of (run_key, event_id, at in seconds, what, body) events with their events, as each run closes (``RECORDS``)."""
    timed = stream.select("run_key", "event_id", "at", "what", "body").withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)
    return timed.groupBy("run_key").transformWithStateInPandas(RunRecorder(gap, frozenset(ending)), RECORDS, "append", "eventTime")


def open_runs(spark: SparkSession, checkpoint: str, gap: int = 0) -> DataFrame:
    """The runs that are open at the end of the input, from the query's stored state, as ``recorded`` would give them at a shutdown.

    The state is read, not changed: a query that goes on with it later closes them in its own way."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    runs = read("open").load().select(F.col("key.run_key").alias("run_key"), "value.*")
    before = read("before").load().select(F.col("key.run_key").alias("k"), F.col("value.run_id").alias("continues"))
    children = read("children").option("flattenCollectionTypes", "true").load().select(F.col("key.run_key").alias("run_key"), "list_element.*")
    of = F.concat("run_key", F.lit("@"), F.col("started").cast("string"), F.lit("#"), "first")
    head = runs.join(before, F.col("run_key") == F.col("k"), "left").drop("k")
    head = head.select("run_key", of.alias("run_id"), "started", F.col("last").alias("ended"), F.lit("shutdown").alias("close_reason"), "continues")
    count = children.groupBy("run_key", "what").count().groupBy("run_key").agg(F.sum("count").alias("events"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("what", "count"))))).alias("body"))
    head = head.join(count, "run_key")
    none = F.lit(None).cast("string")
    names = _names(RECORDS)
    run = head.withColumns({"record": F.lit("run"), "seq": F.col("events") + 1, "event_id": none, "at": F.col("ended"), "what": F.lit("run.closed")})
    event = children.join(head.drop("body"), "run_key").withColumn("record", F.lit("event")).withColumn("seq", F.lit(None).cast("long"))
    return run.select(names).union(event.select(names))


def recorded_batch(events: DataFrame, gap: int, ending: list[str]) -> DataFrame:
    """The same of a bounded table, a key's events as a sorted stream; open runs close with reason ``shutdown``."""
    marks = frozenset(ending)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, children, before = None, None, [], None
        for b in batches:
            out = []
            for row in b.astype(object).itertuples(index=False, name=None):
                k, e, t, w, body = map(_plain, row)
                if k != key:
                    if now is not None:
                        out += _Run.records(key, now, children, "shutdown")
                    key, now, children, before = k, None, [], None
                now, children, closed, before = _Run.step(k, now, children, (e, int(t), w, body), gap, marks, before)
                out += closed
            yield _frame(out, RECORDS)
        if now is not None:
            yield _frame(_Run.records(key, now, children, "shutdown"), RECORDS)

    ordered = events.filter("run_key IS NOT NULL").repartition("run_key").sortWithinPartitions("run_key", "at", "event_id")
    return ordered.select("run_key", "event_id", "at", "what", "body").mapInPandas(run, RECORDS)


# --- count or time ----------------------------------------------------------------------------


class CountOrTime(StatefulProcessor):
    """Windows of a key's rows that close at ``most`` rows, or ``span`` seconds after their first by a timer of their own."""

    def __init__(self, most: int, span: int, schema: str):
        self.most, self.span, self.schema = most, span, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _fields(window=LONG, opened=LONG, last=LONG, rows=LONG))
        self.rows = handle.getListState("rows", _fields(body=TEXT))

    def _emit(self, key, window: int, opened: int, last: int, bodies: list[str]) -> tuple:
        return (key[0], window, opened, last, len(bodies), bodies)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window, opened, last, _ = map(int, self.head.get()) if self.head.exists() else (1, 0, 0, 0)
        bodies = [b for (b,) in self.rows.get()]
        out = []
        for at, body in _sorted(rows, ["at", "body"])[["at", "body"]].astype(object).itertuples(index=False, name=None):
            at = int(at)
            if bodies and (len(bodies) >= self.most or at - opened >= self.span):
                out.append(self._emit(key, window, opened, last, bodies))
                window, bodies = window + 1, []
            if not bodies:
                opened = at
            bodies, last = [*bodies, _plain(body)], at
        if len(bodies) >= self.most:  # full: nothing can join it
            out.append(self._emit(key, window, opened, last, bodies))
            window, bodies = window + 1, []
        self.rows.put([(b,) for b in bodies]) if bodies else self.rows.clear()
        self.head.update((window, opened, last, len(bodies)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if bodies:
            self.handle.registerTimer((opened + self.span) * 1000)
        yield _frame(out, self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bodies = [b for (b,) in self.rows.get()]
        if bodies:
            window, opened, last, _ = map(int, self.head.get())
            self.rows.clear()
            self.head.update((window + 1, opened, last, 0))
            yield _frame([self._emit(key, window, opened, last, bodies)], self.schema)

    def close(self) -> None:
        pass


def count_or_time_stream(stream: DataFrame, key: str, most: int, span: int, late: str = "1 minute", longest: int | None = None) -> DataFrame:
    """(key, window, opened, last, rows, bodies) of (key, at in seconds, body) rows. ``longest`` cuts bodies to so many characters, as a batched sink of log lines wants."""
    body = F.col("body") if longest is None else F.substring("body", 1, longest)
    kind = dict(stream.dtypes)[key]
    schema = f"{key} {kind}, window long, opened long, last long, rows long, bodies array<string>"
    timed = stream.select(key, "at", body.alias("body")).withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)
    return timed.groupBy(key).transformWithStateInPandas(CountOrTime(most, span, schema), schema, "append", "eventTime")


# --- baselines that outlive their query -------------------------------------------------------

BASELINE = "n long, mean double, m2 double, low double, high double"
TTL_MS = 30 * 24 * 3600 * 1000


def welford(s: tuple, values) -> tuple:
    """(n, mean, m2, min, max) with more values, in order."""
    n, mean, m2, low, high = s
    for v in values:
        n += 1
        d = v - mean
        mean += d / n
        m2 += d * (v - mean)
        low, high = min(low, v), max(high, v)
    return n, mean, m2, low, high


class Baselines(StatefulProcessor):
    """Running moments of a key; they start from another query's where it is given, and go after ``TTL_MS`` without an update."""

    def __init__(self, schema: str, ttl_ms: int | None = TTL_MS):
        self.schema, self.ttl = schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", _fields(n=LONG, mean=DOUBLE, m2=DOUBLE, low=DOUBLE, high=DOUBLE), self.ttl)

    def _now(self) -> tuple:
        s = self.state.get() if self.state.exists() else None
        return (int(s[0]), *map(float, s[1:])) if s else (0, 0.0, 0.0, float("inf"), float("-inf"))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        n, mean, m2, low, high = initialState[["n", "mean", "m2", "low", "high"]].iloc[0].tolist()
        self.state.update((int(n), float(mean), float(m2), float(low), float(high)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = welford(self._now(), _sorted(rows, ["at", "value"])["value"].astype(float).tolist())
        self.state.update(s)
        yield _frame([(key[0], *s)], self.schema)

    def close(self) -> None:
        pass


def baseline_stream(stream: DataFrame, key: str, initial: DataFrame | None = None, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(key, n, mean, m2, low, high) of (key, at, value) rows after each micro-batch. ``initial``: such rows, a key once, that it goes on from.

    States go after ``ttl_ms`` without an update; as that is time by the clock, the query then runs on with empty
    batches and an ``availableNow`` trigger does not end it. None: they stay, and it does."""
    schema = f"{key} {dict(stream.dtypes)[key]}, {BASELINE}"
    start = None if initial is None else initial.select(key, *_names(BASELINE)).groupBy(key)
    return stream.select(key, "at", "value").groupBy(key).transformWithStateInPandas(Baselines(schema, ttl_ms), schema, "update", "none" if ttl_ms is None else "processingTime", start)


def stored_baselines(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, n, mean, m2, low, high) out of a query's stored state, to start another one."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "baseline").load()
    value = "value.value.*" if "ttlExpirationMs" in found.schema["value"].dataType.names else "value.*"
    return found.select(F.col(f"key.{key}").alias(key), value)


# --- rings that count late rows ---------------------------------------------------------------

RING = "record string, bucket long, n long"


class RingCounts(StatefulProcessor):
    """Counts of the newest ``size`` buckets of a key. A late row counts in its own bucket while the ring holds it; what comes
    later still is counted as ``late``, so no row is lost without a number. No watermark drops rows before."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", _fields(bucket=LONG, late=LONG))
        self.ring = handle.getMapState("ring", _fields(slot=LONG), _fields(bucket=LONG, n=LONG))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for b in rows:
            for bucket, n in b.groupby("bucket").size().items():
                counts[int(bucket)] = counts.get(int(bucket), 0) + int(n)
        newest, late = map(int, self.newest.get()) if self.newest.exists() else (min(counts), 0)
        out, before = [], late
        newest = max(newest, *counts) if counts else newest
        for bucket, n in sorted(counts.items()):
            if bucket <= newest - self.size:
                late += n
                continue
            slot = (bucket % self.size,)
            held = self.ring.getValue(slot)  # of another bucket: one that has left the ring
            n += int(held[1]) if held and int(held[0]) == bucket else 0
            self.ring.updateValue(slot, (bucket, n))
            out.append((key[0], "bucket", bucket, n))
        self.newest.update((newest, late))
        if late != before:
            out.append((key[0], "late", None, late))
        yield pd.DataFrame.from_records(out, columns=["key", *_names(RING)]).astype(object)

    def close(self) -> None:
        pass


def ring_counts(stream: DataFrame, key: str, seconds: int = 60, size: int = 60) -> DataFrame:
    """(key, record, bucket, n) of (key, at in seconds) rows, in update mode: the counts that changed, and how many rows of the key came too late for its ring."""
    d = stream.select(F.col(key).cast("string").alias("key"), F.floor(F.col("at") / seconds).cast("long").alias("bucket"))
    return d.groupBy("key").transformWithStateInPandas(RingCounts(size), f"key string, {RING}", "update", "none")


# --- boards of sessions -----------------------------------------------------------------------


class _StoredParts(MutableMapping):
    """A session's parts in a map state: read when asked for, written back once if they changed."""

    def __init__(self, state):
        self.state, self.held, self.was = state, {}, {}

    def __getitem__(self, part: str) -> dict:
        if part not in self.held:
            found = self.state.getValue((part,)) if self.state.containsKey((part,)) else None
            if found is None:
                raise KeyError(part)
            self.was[part] = found[0]
            self.held[part] = json.loads(found[0])
        return self.held[part]

    def __setitem__(self, part: str, facts: dict) -> None:
        self.held[part] = facts

    def __delitem__(self, part: str) -> None:
        raise NotImplementedError("parts stay")

    def __iter__(self):
        stored = [p for (p,) in self.state.keys()]  # noqa: SIM118
        return iter(dict.fromkeys([*stored, *self.held]))

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def changed(self) -> list[tuple[str, str]]:
        out = []
        for part, facts in self.held.items():
            text = json.dumps(facts, sort_keys=True)
            if text != self.was.get(part):
                self.state.updateValue((part,), (text,))
                out.append((part, text))
        return out


class Boards(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", _fields(part=TEXT), _fields(facts=TEXT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = _StoredParts(self.parts)
        for channel, data, at in _sorted(rows, ["at", "id"])[["channel", "data", "at"]].itertuples(index=False, name=None):
            boards.apply(parts, channel, data, int(at))
        yield _frame([(key[0], *c) for c in parts.changed()], boards.PARTS)

    def close(self) -> None:
        pass


def board_stream(routed_events: DataFrame) -> DataFrame:
    """(session, part, facts) of each part that a micro-batch changed, in update mode."""
    return routed_events.groupBy("session").transformWithStateInPandas(Boards(), boards.PARTS, "update", "none")
