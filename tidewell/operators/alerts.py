"""Alerts by kind: failures and successes of an hour, regressions, remediations.

Events become facts of alert kinds first (``alert_facts``), Column expressions only. A kind's facts
in order of time then fold to its changes of status (``alert_changes``); ``tidewell.streaming.processors``
runs the same fold on a stream. Times are whole seconds; within one second failures come before
remediations and these before successes, so that the result does not depend on arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.folds import Fold, ordered_fold

#: Window of the rates and silence that resolves, in seconds; limits of the failure ratio; entries kept of a ring.
WINDOW, SILENCE, DIM, LOUD, RING = 3600, 600, 0.10, 0.30, 500
DEAD_LETTER, WARNING, DONE, REMEDIATION = "bus.dead_letter", "integrity.warn", "stage.done", "bus.remediation.applied"
FACTS = "group string, kind string, at long, what int, n long, label string, severity string, until long"
CHANGES = "kind string, at long, status string, failures long, successes long, regressed boolean, severity string, label string"


def _text(data: Column, *path: str) -> Column:
    """The first non-empty of some fields of a JSON text."""
    return F.coalesce(*[F.nullif(F.get_json_object(data, f"$.{p}"), F.lit("")) for p in path])


def kind_of(type_: Column, data: Column) -> Column:
    """(group, kind, label, severity) of an event that is an alert, else null. A kind is a JSON array; kinds of a
    group share their successes."""
    reason, original = F.coalesce(_text(data, "failure_reason"), F.lit("unknown")), F.coalesce(_text(data, "original_type"), F.lit("?"))
    letter = F.struct(F.to_json(F.array(F.lit("dlq"), reason)).alias("group"), F.to_json(F.array(F.lit("dlq"), reason)).alias("kind"), F.concat(F.lit("DLQ "), reason, F.lit(" ← "), original).alias("label"), F.lit("error").alias("severity"))
    issue = F.coalesce(_text(data, "issue", "signal", "kind", "metric"), F.lit("unknown"))
    stage, model = F.coalesce(_text(data, "stage"), F.lit("")), F.coalesce(_text(data, "model"), F.lit(""))
    group = F.to_json(F.array(F.lit(WARNING), stage, model))
    label = F.concat(F.lit("integrity "), issue, F.when(stage != "", F.concat(F.lit(" @ "), stage)).otherwise(""), F.when(model != "", F.concat(F.lit(" ("), model, F.lit(")"))).otherwise(""))
    warn = F.struct(group.alias("group"), F.to_json(F.array(F.lit(WARNING), stage, model, issue)).alias("kind"), label.alias("label"), F.lit("warn").alias("severity"))
    return F.when(type_ == DEAD_LETTER, letter).when(type_.endswith(WARNING), warn)


def alert_facts(events: DataFrame, reasons: list[str], type_: str = "type", data: str = "data", at: str = "at") -> DataFrame:
    """Facts (``FACTS``) of events with ``at`` in whole seconds: failures (what 0), remediations (1) and successes (2).

    Every event that is no alert is a success for dead letters of each of ``reasons``, a short closed
    list; tasks count these by second before they leave (``counted``). A finished stage is one for the
    warnings of its stage and model."""
    t, d = F.col(type_), F.col(data)
    e = events.select(t.alias("type"), d.alias("data"), F.col(at).alias("at")).withColumn("k", kind_of(F.col("type"), F.col("data")))
    none = F.lit(None).cast("string")
    fact = lambda group, kind, what, n=None, label=none, severity=none, until=None: F.struct(group.alias("group"), kind.alias("kind"), "at", F.lit(what).alias("what"), (F.lit(1) if n is None else n).cast("long").alias("n"), label.alias("label"), severity.alias("severity"), (F.lit(None) if until is None else until).cast("long").alias("until"))
    target = F.from_json(F.get_json_object("data", "$.targets_pathology.kind"), "array<string>")
    target = F.coalesce(target, F.array(F.get_json_object("data", "$.targets_pathology.kind")))
    applied = F.coalesce(F.unix_seconds(F.try_to_timestamp(F.get_json_object("data", "$.applied_at"))), F.col("at"))
    within = F.coalesce(F.nullif(F.get_json_object("data", "$.expected_resolution_window_s").cast("long"), F.lit(0)), F.lit(600))
    remedy = F.when((F.col("type") == REMEDIATION) & target[0].isNotNull(), fact(F.to_json(F.slice(target, 1, 3)), F.to_json(target), 1, applied, until=applied + within))
    is_done = F.col("type").endswith(DONE) & (F.coalesce(_text(F.col("data"), "ok"), F.lit("true")) != "false")
    stage = F.to_json(F.array(F.lit(WARNING), F.coalesce(_text(F.col("data"), "stage"), F.lit("")), F.coalesce(_text(F.col("data"), "model"), F.lit(""))))
    done = F.when(is_done, fact(stage, none, 2))
    failure = fact(F.col("k.group"), F.col("k.kind"), 0, label=F.col("k.label"), severity=F.col("k.severity"))
    other = [fact(F.to_json(F.array(F.lit("dlq"), F.lit(r))), none, 2) for r in reasons]
    every = F.when(F.col("k").isNotNull(), F.array(failure)).otherwise(F.filter(F.array(remedy, done, *other), lambda x: x.isNotNull()))
    return counted(e.select(F.explode(every).alias("f")).select("f.*"))


def counted(facts: DataFrame) -> DataFrame:
    """Facts with a task's equal successes in one row, without a shuffle, so that a group that all events touch gets a row a second and task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = b["what"] == 2
            yield b[~good]
            s = b[good].groupby(["group", "at"], as_index=False)["n"].sum()
            yield s.assign(kind=None, what=2, label=None, severity=None, until=None)[b.columns]

    return facts.mapInPandas(count, FACTS)


class Kind:
    """One kind's state as a plain dict, so that any store can keep it, and its steps."""

    @staticmethod
    def start(label: str, severity: str) -> dict:
        return {"failures": [], "successes": [], "last": None, "regressed": False, "applied": 0, "until": 0, "label": label, "severity": severity, "said": None, "due": None}

    @staticmethod
    def counts(s: dict, now: int) -> tuple[int, int]:
        return sum(t >= now - WINDOW for t in s["failures"]), sum(n for t, n in s["successes"] if t >= now - WINDOW)

    @staticmethod
    def ratio(s: dict, now: int) -> float:
        f, g = Kind.counts(s, now)
        return f / max(1, f + g)

    @staticmethod
    def status(s: dict, now: int) -> str:
        ratio, age = Kind.ratio(s, now), now - s["last"]
        mending = s["applied"] > 0 and now < s["until"]
        if ratio >= LOUD:
            return "regressed_fx" if mending else "regressed" if s["regressed"] else "active"
        if ratio < DIM and age > SILENCE:
            return "resolved"
        if age < SILENCE:
            return "stabilizing_fx" if mending else "stabilizing"
        return "active"

    @staticmethod
    def said(s: dict, kind: str, now: int) -> list[tuple]:
        """A change of status, if it is one."""
        status = Kind.status(s, now)
        if status == s["said"]:
            return []
        s["said"] = status
        f, g = Kind.counts(s, now)
        return [(kind, now, status, f, g, s["regressed"], s["severity"], s["label"])]

    @staticmethod
    def silence(s: dict, kind: str, now: int | None) -> list[tuple]:
        """The look at a kind that has been silent long enough, once ``now`` (None: the end) is past it."""
        if s["due"] is None or now is not None and now <= s["due"]:
            return []
        at, s["due"] = s["due"], None
        return Kind.said(s, kind, at)

    @staticmethod
    def failed(s: dict, kind: str, now: int, label: str) -> list[tuple]:
        out = Kind.silence(s, kind, now)
        if s["last"] is not None and Kind.status(s, now) == "resolved":
            s["regressed"] = True
        s["failures"] = [*s["failures"], now][-RING:]
        s |= {"last": now, "label": label, "due": now + SILENCE + 1}
        return out + Kind.said(s, kind, now)

    @staticmethod
    def succeeded(s: dict, kind: str, now: int, n: int) -> list[tuple]:
        out = Kind.silence(s, kind, now)
        ring, room = [], RING
        for t, m in [(now, n), *reversed(s["successes"])]:  # the newest fill the ring
            if room <= 0:
                break
            ring.append([t, min(m, room)])
            room -= m
        s["successes"] = ring[::-1]
        if s["regressed"] and Kind.ratio(s, now) < DIM:
            s["regressed"] = False
        return out + Kind.said(s, kind, now)

    @staticmethod
    def remedied(s: dict, kind: str, now: int, applied: int, until: int) -> list[tuple]:
        out = Kind.silence(s, kind, now)
        s |= {"applied": applied, "until": until}
        return out + Kind.said(s, kind, now)


def group_step(kinds: dict[str, dict], row: tuple) -> list[tuple]:
    """What a fact (kind, at, what, n, label, severity, until) does to the kinds of its group; ``CHANGES`` rows."""
    kind, at, what, n, label, severity, until = row
    if what == 0:
        return Kind.failed(kinds.setdefault(kind, Kind.start(label, severity)), kind, at, label)
    if what == 1:
        return Kind.remedied(kinds[kind], kind, at, n, until) if kind in kinds else []
    return [r for k in sorted(kinds) for r in Kind.succeeded(kinds[k], k, at, n)]


ORDER = ("at", "what", "kind", "label", "n")


def merged(facts: DataFrame) -> DataFrame:
    """Successes of one group and second as one fact; the others as they are."""
    s = facts.filter("what = 2").groupBy("group", "at").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return facts.filter("what < 2").union(s.select("group", none, "at", F.lit(2), "n", none, none, F.lit(None).cast("long")))


def alert_changes(facts: DataFrame) -> DataFrame:
    """(group, *CHANGES): every change of status of every kind, by a fold over its group's facts in order."""
    columns = ("kind", "at", "what", "n", "label", "severity", "until")
    none = lambda row: tuple(None if v is None or v != v else v for v in row)
    whole = lambda row: tuple(int(v) if i in (1, 2, 3, 6) and v is not None else v for i, v in enumerate(none(row)))
    fold = Fold(columns, CHANGES, dict, lambda s, row: group_step(s, whole(row)), lambda s: [r for k in sorted(s) for r in Kind.silence(s[k], k, None)])
    return ordered_fold(merged(facts), "group", list(ORDER), fold)
