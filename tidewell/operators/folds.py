"""Ordered folds: state machines over a key's events in order.

In batch a fold runs over sorted partitions as a stream of rows, with the state of one key at a
time, so a key of any length is folded in constant memory; ``tidewell.streaming.state`` runs the
same fold over a stream with its state kept by Spark. Use folds only where windows can't say it.
States are plain dicts of numbers, texts and lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Fold:
    """``columns`` of each event go to ``step(state, key, row)``, which changes the state and returns
    result rows without the key; ``finish(state, key)`` returns those at a key's end. ``schema``: of results."""

    columns: tuple[str, ...]
    schema: str
    start: Callable[[], dict]
    step: Callable[[dict, tuple], list[tuple]]
    finish: Callable[[dict], list[tuple]] = lambda state: []

    def result_schema(self, df: DataFrame, key: str) -> str:
        return f"{key} {dict(df.dtypes)[key]}, {self.schema}"


def ordered_fold(df: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    schema = fold.result_schema(df, key)
    names = [key, *StructType.fromDDL(fold.schema).names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        table = lambda rows: pd.DataFrame.from_records(rows, columns=names).astype(object)
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if row[0] != now:
                    if state is not None:
                        out += [(now, *r) for r in fold.finish(state)]
                    now, state = row[0], fold.start()
                out += [(now, *r) for r in fold.step(state, row[1:])]
            yield table(out)
        if state is not None:
            yield table([(now, *r) for r in fold.finish(state)])

    return df.repartition(key).sortWithinPartitions(key, *order).select(key, *fold.columns).mapInPandas(run, schema)


def count_or_time(time: str, most: int, span: int) -> Fold:
    """Windows that close at ``most`` events or at the first event ``span`` or more after their first,
    which then opens the next: (window, opened, last, events)."""

    def step(w: dict, row) -> list[tuple]:
        t, out = row[0], []
        if w["n"] and (w["n"] >= most or t - w["opened"] >= span):
            out.append((w["window"], w["opened"], w["last"], w["n"]))
            w |= {"window": w["window"] + 1, "n": 0}
        if not w["n"]:
            w["opened"] = t
        w |= {"n": w["n"] + 1, "last": t}
        return out

    return Fold((time,), "window long, opened long, last long, events long", lambda: {"window": 1, "n": 0}, step, lambda w: [(w["window"], w["opened"], w["last"], w["n"])])


def idle_sessions(time: str, ended: str, gap: int) -> Fold:
    """Sessions that close after more than ``gap`` or behind an event that ended one: (session, started, last, events, close_reason)."""

    def close(s: dict, why: str) -> list[tuple]:
        row = (s["session"], s["started"], s["last"], s["n"], why)
        s |= {"session": s["session"] + 1, "n": 0}
        return [row]

    def step(s: dict, row) -> list[tuple]:
        t, end = row
        out = close(s, "idle_timeout") if s["n"] and t - s["last"] > gap else []
        if not s["n"]:
            s["started"] = t
        s |= {"n": s["n"] + 1, "last": t}
        return out + (close(s, "ended") if end else [])

    return Fold((time, ended), "session long, started long, last long, events long, close_reason string", lambda: {"session": 1, "n": 0}, step, lambda s: close(s, "open") if s["n"] else [])


def adaptive_threshold(deviation: str, start: float = 3.0, floor: float = 1.5, keep: float = 0.95) -> Fold:
    """(updates, threshold): moved by each deviation in order, max(floor, keep x old + rest x |deviation|)."""

    def step(s: dict, row) -> list[tuple]:
        if row[0] is not None:
            s["x"], s["n"] = max(floor, s["x"] * keep + abs(row[0]) * (1 - keep)), s["n"] + 1
        return []

    return Fold((deviation,), "updates long, threshold double", lambda: {"x": start, "n": 0}, step, lambda s: [(s["n"], s["x"])])


def calibration(verdict: str, least: int = 15, rate: float = 0.70, clean: int = 3) -> Fold:
    """(accepts, rejects, last_reject, auto_enabled) after all verdicts in order.

    Enabled from ``least`` verdicts on, at ``rate`` accepted and with ``clean`` verdicts since the last reject."""

    def step(s: dict, row) -> list[tuple]:
        if row[0] == "accept":
            s["a"] += 1
        elif row[0] in ("reject", "modify"):
            s["r"] += 1
            s["at"] = s["a"] + s["r"]
        return []

    def finish(s: dict) -> list[tuple]:
        n = s["a"] + s["r"]
        return [(s["a"], s["r"], s["at"], n >= least and s["a"] / n >= rate and n - s["at"] >= clean)]

    return Fold((verdict,), "accepts long, rejects long, last_reject long, auto_enabled boolean", lambda: {"a": 0, "r": 0, "at": 0}, step, finish)


def alert_latch(time: str, lag: str, spike: int = 1000, stall: int = 300_000_000) -> Fold:
    """(at, alert): "raised" when the lag spikes or has not fallen for ``stall``, once until it is 0 again, then "recovered"."""

    def step(s: dict, row) -> list[tuple]:
        t, n = row
        if s["fell"] is None or n < s["lag"] or n == 0:
            s["fell"] = t
        bad = n > spike or (n > 0 and t - s["fell"] >= stall)
        s["lag"] = n
        if bad and not s["on"]:
            s["on"] = True
            return [(t, "raised")]
        if n == 0 and s["on"]:
            s["on"] = False
            return [(t, "recovered")]
        return []

    return Fold((time, lag), "at long, alert string", lambda: {"fell": None, "lag": 0, "on": False}, step)


def saga(time: str, kind: str, idle: int = 1_800_000_000) -> Fold:
    """Sagas from a "started" event over steps to "completed" or "failed", killed after ``idle`` without an event: (saga, steps, outcome)."""

    def step(s: dict, row) -> list[tuple]:
        t, what = row
        out = []
        if s["open"] and t - s["last"] > idle:
            out, s["open"] = [(s["saga"], s["steps"], "killed")], False
        if what == "started" and not s["open"]:
            s |= {"open": True, "saga": s["saga"] + 1, "steps": 0}
        elif s["open"] and what in ("completed", "failed"):
            out, s["open"] = [*out, (s["saga"], s["steps"], what)], False
        elif s["open"]:
            s["steps"] += 1
        s["last"] = t
        return out

    return Fold((time, kind), "saga long, steps long, outcome string", lambda: {"open": False, "saga": 0, "steps": 0, "last": 0}, step, lambda s: [(s["saga"], s["steps"], "open")] if s["open"] else [])


def thrash_cycles(kind: str, to_build: int = 10, to_fail: int = 20, to_revert: int = 20) -> Fold:
    """(edit, build, fail, revert): places of complete cycles, one after another, each resuming behind the last.

    ``kind``: edit, build, fail, revert or anything else. An edit needs a build within ``to_build``
    events, that a failure within ``to_fail``, that a revert within ``to_revert``; an edit whose cycle
    does not complete is passed over. Only the events still in reach are kept."""
    reach = to_build + to_fail + to_revert

    def find(s: dict, final: bool) -> list[tuple]:
        out, ev = [], s["ev"]
        while ev and (final or len(ev) > reach):
            drop = 1
            if ev[0] == "edit":
                seek = lambda what, a, n: next((j for j in range(a + 1, min(a + 1 + n, len(ev))) if ev[j] == what), None)
                b = seek("build", 0, to_build)
                f = seek("fail", b, to_fail) if b is not None else None
                r = seek("revert", f, to_revert) if f is not None else None
                if r is not None:
                    out.append(tuple(s["at"] + x for x in (0, b, f, r)))
                    drop = r + 1
            del ev[:drop]
            s["at"] += drop
        return out

    def step(s: dict, row) -> list[tuple]:
        s["ev"].append(row[0])
        return find(s, False)

    return Fold((kind,), "edit long, build long, fail long, revert long", lambda: {"ev": [], "at": 1}, step, lambda s: find(s, True))
