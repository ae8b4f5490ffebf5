"""What a board knows of each optimisation session: its parts, kept by one small function for each channel.

A session's parts are its iterations, predictions, failure patterns, rings of the newest failures, and one for the
session itself; each is a plain dict. A channel's handler reads and writes the parts that it needs and no
others. ``boards`` folds a bounded table, ``streaming.processors.board_stream`` the same on a stream, where
every part is an entry of a map state and only parts that an event touches are read and written.

Defined cases: events of other channels, without a session (but for ``case.result`` and ``sandbox.stderr``, which
then belong to "?") or with data that are no JSON object change nothing; numbers that are no numbers count as
0; a prediction's end that names none begins one; times are event times.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "session string, part string, facts string"
#: Newest entries of the rings, latencies kept for a mean, and cases expected before a summary says so.
STDERR, FAILURES, FAILING, LATENCIES, CASES = 5, 3, 256, 5, 20
COMPILED = {"CE", "RE", "TLE", "MLE"}
NO_SESSION = ("case.result", "sandbox.stderr")

Parts = MutableMapping[str, dict]


def _whole(x) -> int:
    try:
        return int(x or 0)
    except (TypeError, ValueError):
        return 0


def _real(x) -> float:
    try:
        return float(x or 0)
    except (TypeError, ValueError):
        return 0.0


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, sort_keys=True)


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _session(parts: Parts) -> dict:
    return parts.get("session") or {"latest": None, "scores": [], "cases": None, "prompt_tokens": 0, "completion_tokens": 0, "events": 0}


def _iteration(parts: Parts, number: int | None = None) -> dict:
    """One iteration's facts; without a number the latest, or 0. A new one becomes the latest if it is."""
    s = _session(parts)
    n = number if number is not None else s["latest"] if s["latest"] is not None else 0
    if (known := parts.get(f"iteration/{n}")) is not None:
        return known
    if s["latest"] is None or n > s["latest"]:
        parts["session"] = s | {"latest": n}
    return {"iteration": n, "status": None, "started": None, "completed": None, "done": [], "latencies": [], "live": {}, "verdicts": {}, "score": None, "before": None, "expected": CASES, "phases": {}, "sandbox": {}, "improver": {}}


def _keep(parts: Parts, it: dict) -> None:
    parts[f"iteration/{it['iteration']}"] = it


def iteration(parts: Parts, data: dict, at: int) -> None:
    it = _iteration(parts, _whole(data.get("iteration")))
    s, status = _session(parts), data.get("status", it["status"])
    if s["cases"] and it["expected"] == CASES:
        it["expected"] = s["cases"]
    if status == "start" and it["status"] != "start":
        it |= {"started": at, "done": [], "latencies": [], "live": {}}
    it["status"] = status
    if status == "complete":
        earlier = [int(p.split("/")[1]) for p in parts if p.startswith("iteration/") and int(p.split("/")[1]) < it["iteration"]]
        before = parts[f"iteration/{max(earlier)}"]["score"] if earlier else None
        it |= {"completed": at, "before": before, "score": data.get("aggregate_score"), "verdicts": _dict(data.get("verdict_counts"))}
        if it["score"] is not None:
            parts["session"] = s | {"scores": [*s["scores"], _real(it["score"])]}
    _keep(parts, it)


def phase(parts: Parts, data: dict, at: int) -> None:
    it, name = _iteration(parts), _text(data.get("phase") or "?")
    if data.get("status") == "start":
        it["phases"][name] = at
    else:
        it["phases"].pop(name, None)
    _keep(parts, it)


def sandbox(parts: Parts, data: dict, at: int) -> None:
    it = _iteration(parts)
    case = it["sandbox"].setdefault(_text(data.get("case_id") or "?"), {})
    case |= {k: data[k] for k in ("language", "sandbox_type") if k in data}
    if data.get("status") == "complete":
        case |= {k: data.get(k) for k in ("verdict", "latency_ms", "exit_code")}
    _keep(parts, it)


def improver(parts: Parts, data: dict, at: int) -> None:
    it, s = _iteration(parts), _session(parts)
    now = it["improver"]
    start = data.get("status") == "start"
    now |= {k: data[k] for k in (("model", "prompt_tokens") if start else ("model", "completion_tokens", "delta_summary")) if k in data}
    if not start:  # a call is counted when it ends
        parts["session"] = s | {"prompt_tokens": s["prompt_tokens"] + _whole(now.get("prompt_tokens")), "completion_tokens": s["completion_tokens"] + _whole(now.get("completion_tokens"))}
    _keep(parts, it)


def _ring(parts: Parts, name: str, entry: dict, most: int) -> None:
    kept = (parts.get(f"ring/{name}") or {"newest": []})["newest"]
    parts[f"ring/{name}"] = {"newest": [*kept, entry][-most:]}


def case_result(parts: Parts, data: dict, at: int) -> None:
    verdict, case, n = _text(data.get("verdict")), _text(data.get("case_id") or "?"), _whole(data.get("iteration"))
    code = _text(data.get("generated_code"))
    if verdict.upper() in COMPILED:
        _ring(parts, "failures", {"case": case, "verdict": verdict.upper(), "iteration": n, "score": _real(data.get("p_score")), "latency_ms": _real(data.get("latency_ms")), "code": code[:400]}, FAILURES)
    if verdict and verdict != "OK":
        _ring(parts, "failing", {"case": case, "verdict": verdict, "iteration": n}, FAILING)
    if data.get("iteration") is None and _session(parts)["latest"] is None:
        return
    it = _iteration(parts, None if data.get("iteration") is None else n)
    if case not in it["done"]:
        it["done"].append(case)
        latency = data.get("latency_ms")
        if isinstance(latency, (int, float)) and not isinstance(latency, bool) and latency >= 0:
            it["latencies"] = [*it["latencies"], float(latency)][-LATENCIES:]
        if verdict:
            it["live"][verdict] = it["live"].get(verdict, 0) + 1
    _keep(parts, it)


def iteration_summary(parts: Parts, data: dict, at: int) -> None:
    n, cases = _whole(data.get("iteration")), data.get("num_cases")
    it = _iteration(parts, n)
    if isinstance(cases, int) and cases > 0:
        it["expected"] = cases
        s = _session(parts) | {"cases": cases}
        parts["session"] = s
        if s["latest"] not in (None, n) and (now := parts.get(f"iteration/{s['latest']}")) and now["expected"] == CASES:
            _keep(parts, now | {"expected": cases})
    _keep(parts, it)
    verdicts = data.get("verdict_distribution") or data.get("verdict_counts")
    parts[f"summary/{n}"] = {"score": data.get("aggregate_score"), "verdicts": verdicts if isinstance(verdicts, dict) else dict(it["live"]), "cases": cases if isinstance(cases, int) else len(it["done"]), "at": at}


def failure_pattern(parts: Parts, data: dict, at: int) -> None:
    n = _whole(data.get("sample_count"))
    if _text(data.get("verdict")) and n > 0:
        parts[f"pattern/{_text(data.get('verdict'))}/{_text(data.get('prefix'))}"] = {"samples": n, "in_class": _whole(data.get("total_in_class")) or n, "iteration": _whole(data.get("iteration"))}


def _predicted(data: dict, n: int, at: int) -> dict:
    return {"iteration": n, "confidence": _real(data.get("confidence")), "delta": _real(data.get("predicted_score_delta")), "changes": _dict(data.get("predicted_verdict_class_changes")), "status": "pending", "at": at}


def prediction(parts: Parts, data: dict, at: int) -> None:
    n = _whole(data.get("iteration"))
    parts[f"prediction/{n}"] = _predicted(data, n, at)


def _ended(parts: Parts, data: dict, inner: str, at: int) -> dict:
    """The prediction that an event of the next iteration ends: that of the iteration before, else of its own, else a new one."""
    n = _whole(data.get("iteration"))
    for of in (n - 1, n):
        if (known := parts.get(f"prediction/{of}")) is not None:
            return known
    return _predicted(_dict(data.get(inner)), max(0, n - 1), at)


def refuted_live(parts: Parts, data: dict, at: int) -> None:
    p = _ended(parts, data, "prediction", at)
    if data.get("is_refuted", True):
        p |= {"status": "refuted_live", "reason": _text(data.get("refutation_reason"))}
    parts[f"prediction/{p['iteration']}"] = p | {"at": at}


def verified(parts: Parts, data: dict, at: int) -> None:
    p, label = _ended(parts, data, "predicted", at), _text(data.get("outcome_label") or "refuted").lower()
    p |= {k: _real(data.get(k)) for k in ("actual_score_delta", "score_delta_error", "verdict_match_ratio", "confidence_calibration")}
    parts[f"prediction/{p['iteration']}"] = p | {"status": label if label in ("confirmed", "partial") else "refuted", "at": at}


def delta_diff(parts: Parts, data: dict, at: int) -> None:
    parts["ribbon"] = {"kind": "delta", "iteration": _whole(data.get("iteration")), "prompt": _text(data.get("system_prompt_diff")), "tools": _text(data.get("tool_surface_diff")), "budget": _dict(data.get("budget_changes")), "no_change": bool(data.get("no_change", False)), "at": at}


def divergence(parts: Parts, data: dict, at: int) -> None:
    parts["ribbon"] = {"kind": "divergence", "iteration": _whole(data.get("iteration")), "divergent": bool(data.get("divergent", False)), "summary": _text(data.get("divergence_summary")), "at": at}


def reasoning(parts: Parts, data: dict, at: int) -> None:
    s, status, n, why = _session(parts), data.get("parse_status"), data.get("iteration"), data.get("fallback_reason")
    s |= {"parse_status": status} if isinstance(status, str) and status else {}
    s |= {"parse_iteration": n} if isinstance(n, int) else {}
    parts["session"] = s | {"fallback": why if isinstance(why, str) else None}


def sandbox_stderr(parts: Parts, data: dict, at: int) -> None:
    if verdict := _text(data.get("verdict")).strip():
        _ring(parts, "stderr", {"case": _text(data.get("case_id") or "?"), "verdict": verdict, "stderr": _text(data.get("stderr_excerpt")), "iteration": _whole(data.get("iteration")), "at": at}, STDERR)


#: Channels, behind a project's prefix and before their version.
HANDLERS: dict[str, Callable[[Parts, dict, int], None]] = {
    "iteration": iteration, "phase": phase, "sandbox": sandbox, "improver": improver, "case.result": case_result, "iteration.summary": iteration_summary, "failure_pattern": failure_pattern,
    "improver.prediction": prediction, "improver.prediction.refuted_live": refuted_live, "improver.prediction.verified": verified,
    "improver.delta.diff": delta_diff, "improver.divergence": divergence, "improver.reasoning": reasoning, "sandbox.stderr": sandbox_stderr,
}


def apply(parts: Parts, channel: str, data: str, at: int) -> None:
    try:
        d = json.loads(data)
    except (TypeError, ValueError):
        return
    if isinstance(d, dict):
        HANDLERS[channel](parts, d, at)
        s = _session(parts)
        parts["session"] = s | {"events": s["events"] + 1, "seen": at}


def routed(events: DataFrame, prefix: str) -> DataFrame:
    """(session, channel, data, at, id) of (type, data, at, id) events on a board's channels."""
    channel = F.regexp_replace(F.substring("type", len(prefix) + 1, 1 << 20), r"\.v\d+$", "")
    d = events.filter(F.startswith("type", F.lit(prefix))).withColumn("channel", channel).filter(F.col("channel").isin(*HANDLERS))
    own = F.nullif(F.get_json_object("data", "$.session_id"), F.lit(""))
    session = F.coalesce(own, F.when(F.col("channel").isin(*NO_SESSION), "?"))
    return d.select(session.alias("session"), "channel", "data", F.col("at").cast("long").alias("at"), F.col("id").cast("string").alias("id")).filter("session IS NOT NULL")


def boards(routed_events: DataFrame) -> DataFrame:
    """(session, part, facts) at the end of the events, each session a sorted stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = lambda s, parts: pd.DataFrame([(s, p, json.dumps(f, sort_keys=True)) for p, f in parts.items()], columns=["session", "part", "facts"])
        now, parts = None, {}
        for b in batches:
            for session, channel, data, at in b[["session", "channel", "data", "at"]].itertuples(index=False, name=None):
                if session != now:
                    if now is not None:
                        yield rows(now, parts)
                    now, parts = session, {}
                apply(parts, channel, data, int(at))
        if now is not None:
            yield rows(now, parts)

    return routed_events.repartition("session").sortWithinPartitions("session", "at", "id").mapInPandas(run, PARTS)
