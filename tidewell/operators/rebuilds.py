"""Builds in worktrees that take long, as a cold cache makes them.

A build lasts until the next event of its run. It is slow above a fixed floor, or above a multiple of
its project's median; a project with one build has no median. Findings are by project and crate.

Defined cases: the last event of a run, null times and negative gaps give no observation; runs that are not
closed take no part; a build counts as in a worktree by its own folder or by its run's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import commands as C

#: Seconds above which every build is slow, and times a project's median.
FLOOR, TIMES = 60, 3


def observations(events: DataFrame, command: Column, order: list[str], time: str = "us", worktree: Column | None = None) -> DataFrame:
    """(run_id, project, crate, gap) of the builds in worktrees of (run_id, project, cwd, closed, ``time`` in microseconds) events."""
    w = Window.partitionBy("run_id").orderBy(*order)
    inside = C.in_worktree(F.col("cwd")) if worktree is None else C.in_worktree(F.col("cwd")) | C.in_worktree(worktree)
    e = events.filter("closed").withColumn("gap", (F.lead(time).over(w) - F.col(time)) / 1_000_000).withColumn("_command", F.coalesce(command, F.lit("")))
    builds = e.filter(C.has_word(F.col("_command"), C.CARGO_WORDS) & F.coalesce(inside, F.lit(False)) & (F.col("gap") >= 0))
    return builds.select("run_id", "project", C.crate(F.col("_command")).alias("crate"), "gap")


def slow_builds(seen: DataFrame, floor: float = FLOOR, times: float = TIMES) -> DataFrame:
    """(project, crate, slow_builds, runs, max_gap, baseline) of ``observations``: a finding for each crate with slow builds."""
    base = seen.groupBy(F.col("project").alias("p")).agg(F.when(F.count("*") > 1, F.percentile("gap", 0.5)).otherwise(0.0).alias("baseline"))
    slow = (F.col("gap") > floor) | ((F.col("baseline") > 0) & (F.col("gap") > F.col("baseline") * times))
    d = seen.join(base, F.col("project").eqNullSafe(F.col("p"))).filter(slow)
    return d.groupBy("project", "crate").agg(F.count("*").alias("slow_builds"), F.count_distinct("run_id").alias("runs"), F.max("gap").alias("max_gap"), F.first("baseline").alias("baseline"))
