"""Aggregations behind panels: ledgers, clusters, leaderboards, slack and balanced lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.timeutil import DAY
from tidewell.operators.keys import per_key


def ledger(events: DataFrame, key: str, time: str, session: str, example: str, examples: int = 4) -> DataFrame:
    """(key, total, sessions, days, first_day, last_day, status, examples): status by the days since the last event of all."""
    day = F.floor(F.col(time) / DAY)
    g = events.groupBy(key).agg(F.count("*").alias("total"), F.countDistinct(session).alias("sessions"), F.countDistinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    latest = events.agg(F.max(day).alias("today"))
    shown = per_key(events, [key], [F.col(time), F.col(example)], examples).groupBy(key).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    gap = F.col("today") - F.col("last_day")
    status = F.when(gap <= 2, "open").when(gap <= 6, "dormant").otherwise("resolved")
    return g.crossJoin(F.broadcast(latest)).withColumn("status", status).drop("today").join(shown, key)


def failure_clusters(rows: DataFrame, verdict: str, message: str, case: str, chars: int = 20, least: int = 2) -> DataFrame:
    """(verdict, prefix, n, share, cases): failures that begin alike, with five of their cases."""
    prefix = F.substring(F.trim(F.lower(F.regexp_replace(message, r"\s+", " "))), 1, chars)
    r = rows.withColumn("prefix", prefix)
    g = r.groupBy(verdict, "prefix").agg(F.count("*").alias("n"))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(verdict))).filter(F.col("n") >= least)
    cases = per_key(r, [verdict, "prefix"], [F.col(case)], 5).groupBy(verdict, "prefix").agg(F.sort_array(F.collect_list(case)).alias("cases"))
    return g.join(cases, [verdict, "prefix"])


def primary(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, of equally frequent ones the first seen."""
    g = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = g.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("_b"))
    return best.select(key, f"_b.{value}", "_b.n")


def prediction_slack(predicted: DataFrame, actual: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, slack): the least of max(0, predicted - actual) over the labels predicted to grow; null without any."""
    p = predicted.filter(F.col("predicted") > 0).join(actual, [*keys, label], "left")
    return p.groupBy(*keys).agg(F.min(F.greatest(F.lit(0), F.col("predicted") - F.coalesce("actual", F.lit(0)))).alias("slack"))


def balanced(events: DataFrame, order: list[Column], minor: Column, slots: int = 30, minor_slots: int = 4) -> DataFrame:
    """The newest ``slots`` rows of which at most ``minor_slots`` are of the minor tier."""
    small = events.filter(minor).orderBy(*order).limit(minor_slots)
    return events.filter(~minor).orderBy(*order).limit(slots).unionByName(small).orderBy(*order).limit(slots)


def top_values(rows: DataFrame, keys: list[str], value: str, n: int = 5, longest: int = 64) -> DataFrame:
    """(keys, value, count, rank): the most frequent short texts of each window."""
    g = rows.filter(F.length(value) < longest).groupBy(*keys, value).agg(F.count("*").alias("count"))
    return per_key(g, keys, [F.desc("count"), F.col(value)], n)


def peers(windows: DataFrame, moment: str, channel: str, sigma: str, n: int = 10) -> DataFrame:
    """Each channel's ``n`` most deviating other channels of the same moment."""
    other = windows.select(moment, F.col(channel).alias("peer"), F.col(sigma).alias("peer_sigma")).filter(F.col("peer_sigma").isNotNull())
    j = windows.select(moment, channel).join(other, moment).filter(F.col(channel) != F.col("peer"))
    return per_key(j, [moment, channel], [F.desc(F.abs("peer_sigma")), F.col("peer")], n)


def rates_with_overflow(rows: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first ``n`` rows with ``more``, how many are left out."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.lit(0), F.col("_n") - n)).drop("_n")
