"""Roots of parent chains, by pointer jumping: log(depth) joins, whatever the depth."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.runtime import stage


def chain_roots(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) from (id, parent): the end of each chain of parents.

    A null parent, or one that is no id, makes its child a root. The members of a cycle, and what
    hangs on it, have the cycle's smallest id as root. Each round doubles how far a pointer reaches
    and keeps the smallest id passed, so on a cycle that minimum is the whole cycle's at the end."""
    ids = edges.select(F.col("id").alias("_p"))
    e = edges.join(ids, F.col("parent") == F.col("_p"), "left").select("id", F.col("_p").alias("to"))
    # a root points nowhere; low: smallest id among the vertices from this one on, before ``to``
    step = stage(e.select("id", "to", F.col("id").alias("low"), F.when(F.col("to").isNull(), F.col("id")).alias("root")), "pointers")
    vertices, settled = step.count(), []
    for turn in range(rounds):
        open_ = step.filter(F.col("root").isNull())
        settled.append(step.filter(F.col("root").isNotNull()))  # written once, in the round that settles them
        if open_.isEmpty():
            return functools.reduce(DataFrame.union, settled).select("id", "root")
        state = functools.reduce(DataFrame.union, settled, open_)
        if 1 << turn > vertices:  # pointers have gone round any cycle: what is still open ends in one
            return _close_cycles(state)
        nxt = state.select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("root").alias("_root"))
        far = open_.join(nxt, F.col("to") == F.col("_i"))
        step = stage(far.select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), F.col("_root").alias("root")), "pointers")
    raise RuntimeError(f"chains longer than 2 to the {rounds}")


def _close_cycles(state: DataFrame) -> DataFrame:
    """Open pointers stand on their cycle after more steps than there are vertices; the cycle's own
    vertices have passed all of it, so the vertex pointed at knows the cycle's smallest id."""
    low = state.select(F.col("id").alias("_i"), F.col("low").alias("_low"))
    s = state.join(low, F.col("to") == F.col("_i"), "left")
    return s.select("id", F.coalesce("root", "_low").alias("root"))
