"""Queries over runs, their hits and issues. A null outcome means "not labeled", never "clean"."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes of troubled runs, of failed plans and of good ends.
THRASH = ("thrashed", "abandoned", "reverted")
PLANNING = ("thrashed", "abandoned")
CLEAN = ("clean", "landed", "corrected")
#: Detectors by the failure that their hits stand for.
CONTEXT_HITS = ("reread_same_file", "directive_ground_truth_mismatch", "repeated_question")
VERIFICATION_HITS = ("unverified_completion", "edit_build_fail_revert")
PLANNING_HITS = ("red_baseline_dispatch", "inherited_rationalization")
LONG_RUN = 150


def labeled() -> Column:
    return F.col("labeled_at").isNotNull()


def select_runs(runs: DataFrame, *, project: str | None = None, outcome: str | None = None, since: int | None = None) -> DataFrame:
    """Runs of a project and outcome that started at ``since`` or later; outcome "unlabeled" is a filter of its own."""
    r = runs if project is None else runs.filter(F.col("project") == project)
    if outcome == "unlabeled":
        r = r.filter(~labeled())
    elif outcome is not None:
        r = r.filter(labeled() & (F.col("outcome") == outcome))
    return r if since is None else r.filter(F.col("started") >= since)


def thrash_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(labeled() & F.col("outcome").isin(*THRASH))


def outcome_label() -> Column:
    return F.when(labeled() & F.col("outcome").isNotNull(), F.col("outcome")).otherwise("unlabeled")


def project_stats(runs: DataFrame) -> DataFrame:
    """(project, runs, labeled, unlabeled, avg_events)."""
    avg = F.sum("event_count").cast("double") / F.count("event_count")
    return runs.groupBy("project").agg(F.count("*").alias("runs"), F.count("labeled_at").alias("labeled"), (F.count("*") - F.count("labeled_at")).alias("unlabeled"), avg.alias("avg_events"))


def read_write_ratio(histograms: DataFrame) -> DataFrame:
    """(project, ratio): mean of reads / writes over the runs that write."""
    return histograms.filter(F.col("writes") > 0).groupBy("project").agg((F.sum(F.col("reads") / F.col("writes")) / F.count("*")).alias("ratio"))


def prevalence(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """(project, detector, hit_runs, runs, rate): distinct runs hit against all of the project; may pass 1 where windows differ."""
    h = hits.groupBy("project", "detector").agg(F.countDistinct("run_id").alias("hit_runs"))
    total = runs.groupBy("project").agg(F.count("*").alias("runs"))
    return h.join(total, "project", "left").withColumn("rate", F.try_divide("hit_runs", "runs"))


def labeled_support(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """(detector, failures, clean, unlabeled) of the runs hit."""
    r = runs.join(hits.select("run_id", "detector").distinct(), "run_id")
    fail = labeled() & F.col("outcome").isin(*THRASH)
    good = labeled() & F.col("outcome").isin(*CLEAN)
    return r.groupBy("detector").agg(F.count_if(fail).alias("failures"), F.count_if(good).alias("clean"), F.count_if(~labeled()).alias("unlabeled"))


def label_term(failures: Column, clean: Column) -> Column:
    """0.30 x (failed share - 0.5) among labeled runs, 0 without any."""
    return F.when(failures + clean == 0, 0.0).otherwise(0.30 * (failures / (failures + clean) - 0.5))


#: Weights of an issue's score, of rungs, and the bars of a decision.
SCORE_WEIGHTS = {"prevalence": 0.35, "recurrence": 0.25, "rung": 0.25, "label": 0.08, "recency": 0.07}
RUNG_WEIGHTS = {"eliminate": 3.0, "automate": 2.0, "inform": 1.0}
ACT, INFORM_ACT, LEAST_RUNS, CLEAN_VOTES = 0.30, 0.55, 2, 3


def issue_score(prevalence_: Column, recurrence: Column, rung: Column, label: Column, recency_: Column, most: float = 20.0) -> Column:
    repeated = F.least(F.lit(1.0), F.log1p(recurrence) / F.log(F.lit(most + 1)))
    top = max(RUNG_WEIGHTS.values())
    weight = functools.reduce(lambda w, r: w.when(rung == r[0], r[1] / top), RUNG_WEIGHTS.items(), F).otherwise(1.0 / top)
    w = SCORE_WEIGHTS
    return w["prevalence"] * prevalence_ + w["recurrence"] * repeated + w["rung"] * weight + w["label"] * label + w["recency"] * recency_


def decision(score: Column, rung: Column, replay: Column, failures: Column, clean: Column, runs: Column) -> Column:
    """propose_fix, suppressed, needs_more_data or monitor; the first rule that holds."""
    return (
        F.when((runs < LEAST_RUNS) | (replay == "insufficient_history"), "needs_more_data")
        .when(replay == "pending", "monitor")
        .when(((clean > failures) & (clean >= CLEAN_VOTES)) | (replay == "failed"), "suppressed")
        .when((rung == "inform") & (score >= INFORM_ACT), "propose_fix")
        .when((rung != "inform") & (replay == "passed") & (score >= ACT), "propose_fix")
        .otherwise("monitor")
    )


def failure_buckets(hits: Column, outcome: Column, labeled_: Column, permissions: Column, events: Column) -> Column:
    """The failures that a run shows, or ["unclassified"]. ``hits``: names of the detectors that hit it."""
    any_of = lambda names: F.arrays_overlap(hits, F.array(*map(F.lit, names)))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    clean = is_(labeled_ & outcome.isin(*CLEAN))
    found = F.array_compact(
        F.array(
            F.when(any_of(CONTEXT_HITS), "context_failure"),
            F.when(permissions > 0, "constraint_failure"),
            F.when(any_of(VERIFICATION_HITS) | is_(labeled_ & (outcome == "reverted")), "verification_failure"),
            F.when(is_(labeled_ & outcome.isin(*PLANNING)) | any_of(PLANNING_HITS) | (~clean & (events >= LONG_RUN)), "planning_failure"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("unclassified"))).otherwise(found)


def inferred_outcome(loops: Column, bash: Column, bash_failed: Column, reread: Column, events: Column, committed: Column, edit_in_tail: Column, close_reason: Column) -> Column:
    """Outcome by behavior alone; null where the signs are too weak."""
    failing = (bash >= 10) & (bash_failed >= 0.30 * bash)
    thrashed = ((loops >= 3) | failing) & (reread >= 0.35)
    left = (close_reason == "idle_timeout") & (events >= 5) & ~committed & ~edit_in_tail & ((bash_failed > 0) | (events >= 10))
    return F.when(thrashed, "thrashed").when(left, "abandoned").when(committed | (edit_in_tail & (close_reason == "ended")), "clean")
