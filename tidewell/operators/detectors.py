"""Detectors in a fixed order, their hits, and the pass that scores what they find.

A detector is a name, the rung of its remedy and a function from events to hits (run_id, signature).
A project may bring detectors and command classes of its own through an ``Adapter``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.commands import CLASSES, first_match
from tidewell.operators import runs


@dataclass(frozen=True)
class Detector:
    name: str
    rung: str
    find: Callable[[DataFrame], DataFrame]
    #: Whether a fix would have helped earlier runs, from the columns of an issue: passed, failed, pending, not_applicable or
    #: insufficient_history. None: ``default_replay`` of the rung.
    replay: Callable[[], Column] | None = None


#: Rungs whose fix could be replayed; a remedy that only informs has none.
MEASURABLE = ("eliminate", "automate")
#: Outcomes that confirm a merge, and what a replay by triggers must reach.
CONFIRMED = ("clean", "landed", "corrected")
REPLAY_RUNS, PREVENTED, FALSE_ALARMS = 2, 0.50, 0


def default_replay(rung: str) -> str:
    """Nothing passes without a replay of its own: one that is not written yet is pending."""
    return "pending" if rung in MEASURABLE else "not_applicable"


def trigger_replay(found: DataFrame, all_runs: DataFrame, roots: DataFrame, detector: str, least: int = REPLAY_RUNS, rate: float = PREVENTED, most_false: int = FALSE_ALARMS) -> DataFrame:
    """(signature, replay, runs_evaluated, prevented, false_alarms) of a detector whose fix acts when a run is labeled as merged.

    A logical run counts once for a signature, by its first hit (least run_id). ``roots``: (run_id, root), where a run is
    missing it is its own root; ``all_runs``: (run_id, outcome, labeled_at)."""
    h = found.filter(F.col("detector") == detector).select("run_id", "signature").join(all_runs.select("run_id", "outcome", "labeled_at"), "run_id")
    h = h.join(roots.select("run_id", "root"), "run_id", "left").withColumn("root", F.coalesce("root", "run_id"))
    trigger = F.col("labeled_at").isNotNull() & F.coalesce(F.col("outcome").isin(*CONFIRMED), F.lit(False))
    one = h.groupBy("signature", "root").agg(F.min_by(trigger, "run_id").alias("trigger"))
    g = one.groupBy("signature").agg(F.count("*").alias("runs_evaluated"), F.count_if("trigger").alias("prevented"), F.count_if(~F.col("trigger")).alias("false_alarms"))
    good = (F.col("prevented") / F.col("runs_evaluated") >= rate) & (F.col("false_alarms") <= most_false)
    return g.withColumn("replay", F.when(F.col("runs_evaluated") < least, "insufficient_history").when(good, "passed").otherwise("failed"))


@dataclass(frozen=True)
class Adapter:
    """What a project adds: to which projects it applies, command classes before the general ones, detectors behind them."""

    projects: str
    classes: list[tuple[str, str]] = field(default_factory=list)
    detectors: list[Detector] = field(default_factory=list)


def adapter_of(project: str, adapters: list[Adapter]) -> Adapter:
    """The first adapter whose pattern takes the project, else one that adds nothing."""
    return next((a for a in adapters if re.fullmatch(a.projects, project)), Adapter(".*"))


def command_class(command: Column, project: Column, adapters: list[Adapter]) -> Column:
    """The class of a command by its project's adapter, of which the first that applies counts."""
    own = functools.reduce(lambda w, a: w.when(project.rlike(f"^(?:{a.projects})$"), first_match(command, a.classes + CLASSES, "act")), adapters, F)
    general = first_match(command, CLASSES, "act")
    return own.otherwise(general) if adapters else general


def hits(detectors: list[Detector], events: DataFrame) -> DataFrame:
    """(run_id, detector, signature) of all detectors, each hit once."""
    one = lambda d: d.find(events).select("run_id", F.lit(d.name).alias("detector"), F.col("signature").cast("string").alias("signature"))
    return functools.reduce(DataFrame.unionByName, [one(d) for d in detectors]).distinct()


def with_novelty(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with ``novel``: not among the hits already recorded, so to be appended."""
    k = known.select("run_id", "detector", "signature").withColumn("_known", F.lit(True))
    return found.join(k, ["run_id", "detector", "signature"], "left").withColumn("novel", F.col("_known").isNull()).drop("_known")


def issues(detectors: list[Detector], found: DataFrame, all_runs: DataFrame, recency: Column) -> DataFrame:
    """One row per (project, detector, signature) with its hits, score and decision.

    ``found``: hits with ``novel``; ``all_runs``: (run_id, project, outcome, labeled_at)."""
    j = found.join(all_runs, "run_id")
    labeled = F.col("labeled_at").isNotNull()
    g = j.groupBy("project", "detector", "signature").agg(
        F.count("*").alias("hit_runs"), F.count_if("novel").alias("new_hits"), F.count_if(labeled & F.col("outcome").isin(*runs.THRASH)).alias("failures"), F.count_if(labeled & F.col("outcome").isin(*runs.CLEAN)).alias("clean"),
    )
    g = g.join(all_runs.groupBy("project").agg(F.count("*").alias("runs")), "project")
    by_name = lambda of: functools.reduce(lambda w, d: w.when(F.col("detector") == d.name, of(d)), detectors, F)
    g = g.withColumns({"rung": by_name(lambda d: F.lit(d.rung)).otherwise("inform"), "replay": by_name(lambda d: d.replay() if d.replay else F.lit(default_replay(d.rung))).otherwise("not_applicable"), "prevalence": F.col("hit_runs") / F.col("runs")})
    c = F.col
    g = g.withColumn("score", runs.issue_score(c("prevalence"), c("hit_runs"), c("rung"), runs.label_term(c("failures"), c("clean")), recency))
    return g.withColumn("decision", runs.decision(c("score"), c("rung"), c("replay"), c("failures"), c("clean"), c("runs")))
