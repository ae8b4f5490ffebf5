"""Newest, last n and first per key; upserts and inserts; top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order, with their ``rank``. End ``order`` by a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return per_key(df, keys, order).drop("rank")


def newest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The columns of the row with the greatest ``order`` of each key, by aggregation and so without a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and those rows of ``old`` whose key it doesn't hold: the next version of a table."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to append: the first of each key that ``old`` doesn't hold."""
    return dedupe(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti")


def issue_update(old: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Recurrence counters after a pass: a new issue counts 1 whatever its hits, a known one gains a hit each.

    ``old``: keys, recurrence_count, first_seen, last_seen; ``hits``: keys, new_hits, seen_from, seen_to."""
    both = old.join(hits, keys, "full")
    count = F.when(F.col("recurrence_count").isNull(), F.lit(1)).otherwise(F.col("recurrence_count") + F.coalesce("new_hits", F.lit(0)))
    return both.select(*keys, count.cast("long").alias("recurrence_count"), F.least("first_seen", "seen_from").alias("first_seen"), F.greatest("last_seen", "seen_to").alias("last_seen"))


def ranked_limit(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
