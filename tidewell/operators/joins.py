"""Theta, anti and interval joins; dominance; pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.timeutil import DAY
from tidewell.operators.prefix import running


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def both_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys with ``side``: "both", "left" only or "right" only."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, keys, "full").select(*keys, side.alias("side"))


def prefix_names(names: DataFrame, name: str) -> DataFrame:
    """(name, prefix): every name with each of its dotted prefixes and itself.

    A prefix join becomes an equality join on these, so no pair is tried that doesn't match."""
    parts = F.split(name, r"\.")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return names.select(F.col(name), F.explode(upto).alias("prefix"))


def match_subscriptions(subscriptions: DataFrame, names: DataFrame, channel: str, match_type: str, name: str) -> DataFrame:
    """Subscriptions with each name that they cover: equal, or for "prefix" beginning with the channel and a dot (or equal)."""
    p = prefix_names(names.select(name).distinct(), name)
    covers = (F.col(match_type) == "prefix") | (F.col(name) == F.col(channel))
    return subscriptions.join(p, F.col(channel) == F.col("prefix")).filter(covers).drop("prefix")


def paired(starts: DataFrame, ends: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Starts with the first end of the same key and the time between; null where there is none."""
    s = starts.groupBy(*keys).agg(F.min(start).alias(start))
    e = ends.groupBy(*keys).agg(F.min(end).alias(end))
    return s.join(e, keys, "left").withColumn("took", F.col(end) - F.col(start))


def interval_effects(fixes: DataFrame, events: DataFrame, key: str, fix_time: str, time: str, days: int = 7) -> DataFrame:
    """``fixes`` with the events of their key in the ``days`` before ([t - d, t)) and after ([t, t + d]).

    Events go to day buckets and fixes to the buckets that they reach, so that the join is on
    (key, day) and only near events meet a fix."""
    span = days * DAY
    near = fixes.withColumn("_day", F.explode(F.sequence(F.floor((F.col(fix_time) - span) / DAY), F.floor((F.col(fix_time) + span) / DAY))))
    e = events.select(key, F.col(time).alias("_t"), F.floor(F.col(time) / DAY).alias("_day"))
    j = near.join(e, [key, "_day"])
    before = F.count_if((F.col("_t") >= F.col(fix_time) - span) & (F.col("_t") < F.col(fix_time)))
    after = F.count_if((F.col("_t") >= F.col(fix_time)) & (F.col("_t") <= F.col(fix_time) + span))
    counts = j.groupBy(*fixes.columns).agg(before.alias("before"), after.alias("after"))
    return fixes.join(counts, fixes.columns, "left").fillna(0, ["before", "after"]).withColumn("drop", F.col("before") - F.col("after"))


def pareto(points: DataFrame, cost: str, score: str, group: str | None = None) -> DataFrame:
    """``points`` with ``dominated``: another point costs no more and scores no less, and is better in one.

    Equal points do not dominate each other. Points are reduced to the best score per cost first, so
    the ordered part has a row per distinct cost."""
    keys = [group] if group else []
    best = points.groupBy(*keys, cost).agg(F.max(score).alias("_best"))
    if group:
        best = best.withColumn("_cheaper", F.max("_best").over(Window.partitionBy(group).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        best = running(best, cost, {"_cheaper": ("max", "_best")}, itself=False)
    p = points.join(best, [*keys, cost])
    dominated = (F.col(score) < F.col("_best")) | F.coalesce(F.col(score) <= F.col("_cheaper"), F.lit(False))
    return p.withColumn("dominated", dominated).drop("_best", "_cheaper")


def prediction_status(predictions: DataFrame, results: DataFrame, session: str, iteration: str, shift: int = 1) -> DataFrame:
    """Predictions with the result of the iteration after theirs, else of their own: status "next", "same" or "open"."""
    r = results.select(F.col(session).alias("_s"), F.col(iteration).alias("_i"), F.col("actual").alias("_a"))
    nxt = r.select("_s", "_i", F.col("_a").alias("_next"))
    own = r.select(F.col("_s").alias("_s2"), F.col("_i").alias("_i2"), F.col("_a").alias("_own"))
    p = predictions.join(nxt, (F.col(session) == F.col("_s")) & (F.col(iteration) + shift == F.col("_i")), "left")
    p = p.join(own, (F.col(session) == F.col("_s2")) & (F.col(iteration) == F.col("_i2")), "left")
    status: Column = F.when(F.col("_next").isNotNull(), "next").when(F.col("_own").isNotNull(), "same").otherwise("open")
    return p.withColumns({"status": status, "actual": F.coalesce("_next", "_own")}).drop("_s", "_i", "_s2", "_i2", "_next", "_own")
