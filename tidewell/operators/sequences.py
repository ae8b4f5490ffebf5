"""Patterns in ordered events, said with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order)


def triples(events: DataFrame, key: str, order: list[str], first: Column, second: Column, third: Column) -> DataFrame:
    """(key, loops): how often three events in a row satisfy the three conditions."""
    w = _w(key, order)
    hit = F.coalesce(F.lag(first).over(w) & second & F.lead(third).over(w), F.lit(False))
    return events.withColumn("_hit", hit.cast("long")).groupBy(key).agg(F.sum("_hit").alias("loops"))


def followed_within(events: DataFrame, key: str, order: list[str], what: Column, by: Column, span: int) -> DataFrame:
    """(key, total, followed): events ``what``, and those with an event ``by`` among the next ``span``."""
    near = F.max(by.cast("int")).over(_w(key, order).rowsBetween(1, span))
    e = events.withColumn("_near", F.coalesce(near, F.lit(0)))
    return e.groupBy(key).agg(F.count_if(what).alias("total"), F.count_if(what & (F.col("_near") == 1)).alias("followed"))


def phases(events: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """(key, phase, kind, length): runs of equal kinds in order."""
    w = _w(key, order)
    new = F.coalesce(F.lag(kind).over(w) != F.col(kind), F.lit(True))
    e = events.withColumn("phase", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return e.groupBy(key, "phase", kind).agg(F.count("*").alias("length"))


def compressed_phases(runs: DataFrame, key: str, kind: str, top: int = 12) -> DataFrame:
    """Phases beyond the first ``top`` - 1 of a key that has more than ``top`` become one, of kind "…"."""
    n = F.max("phase").over(Window.partitionBy(key))
    long = (n > top) & (F.col("phase") >= top)
    r = runs.withColumns({"_long": long}).withColumns({"phase": F.when(F.col("_long"), top).otherwise(F.col("phase")).cast("long"), kind: F.when(F.col("_long"), F.lit("…")).otherwise(F.col(kind))})
    return r.groupBy(key, "phase", kind).agg(F.sum("length").alias("length"))


def bigrams(events: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """(bigram, n) over all keys."""
    e = events.withColumn("_next", F.lead(kind).over(_w(key, order))).filter(F.col("_next").isNotNull())
    return e.groupBy(F.concat(F.col(kind), F.lit("->"), F.col("_next")).alias("bigram")).agg(F.count("*").alias("n"))


def before_first(events: DataFrame, key: str, order: list[str], mark: Column, what: Column) -> DataFrame:
    """(key, n): events ``what`` before the key's first event ``mark``."""
    seen = F.sum(mark.cast("int")).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_seen", seen).groupBy(key).agg(F.count_if(what & (F.col("_seen") == 0)).alias("n"))


def in_tail(events: DataFrame, key: str, order: list[str], what: Column, least: int = 3, share: int = 5) -> DataFrame:
    """(key, in_tail): whether ``what`` is among the key's last max(least, n / share) events."""
    n = F.count("*").over(Window.partitionBy(key))
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    e = events.withColumns({"_n": n, "_back": back})
    tail = F.col("_back") <= F.greatest(F.lit(least), F.floor(F.col("_n") / share))
    return e.groupBy(key).agg(F.coalesce(F.max(what & tail), F.lit(False)).alias("in_tail"))


def last_before(events: DataFrame, key: str, order: list[str], mark: Column, value: Column, reach: int, alias: str) -> DataFrame:
    """As-of join of a sequence with itself: ``events`` with the value of the last ``mark`` among the ``reach`` events before."""
    w = _w(key, order).rowsBetween(-reach, -1)
    return events.withColumn(alias, F.last(F.when(mark, value), ignorenulls=True).over(w))


def churn(events: DataFrame, key: str, order: list[str], inside: Column, kind: str) -> DataFrame:
    """(key, pairs, flips): neighbours both ``inside``, and those of them of different kinds."""
    w = _w(key, order)
    pair = F.coalesce(F.lag(inside).over(w) & inside, F.lit(False))
    flip = pair & (F.lag(kind).over(w) != F.col(kind))
    e = events.withColumns({"_pair": pair, "_flip": flip})
    return e.groupBy(key).agg(F.count_if("_pair").alias("pairs"), F.count_if("_flip").alias("flips"))
