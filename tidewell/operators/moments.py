"""Moments, quantiles and counts as rows that are stored by day and merged to any span.

A day's row holds n, mean, M2 (the sum of squares about the mean), minimum, maximum and a sketch of
quantiles; distinct sources have a theta sketch, counts by item a table of counters of several hash
functions (count-min). What is merged equals one pass over all rows: moments to rounding, sketches
within their error, which the queries in ``plans.measures`` report beside the exact figures.

Defined cases: null values take no part, so a group of nulls has n 0 and null moments; merging no
rows gives no rows; a null item or source is not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a quantile sketch (rank error about 1.3 % at 200), binary log of a theta sketch's entries (error about 1.6 %).
KLL, THETA = 400, 12
DEPTH, WIDTH = 5, 4096


def daily(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, m2, low, high, sketch) in one pass."""
    v = F.col(value).cast("double")
    n = F.count(v)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, KLL).alias("sketch"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The same columns of coarser keys. M2 grows by n times the squared distance of each part's mean from the whole mean."""
    n = F.col("n")
    mean = parts.groupBy(*keys).agg((F.sum(n * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}"))
    d = parts.alias("p").join(mean.alias("w"), same).select("p.*", "_mean")
    m2 = F.sum(F.col("m2") + n * F.pow(F.col("mean") - F.col("_mean"), 2))
    return d.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), m2.alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", KLL).alias("sketch"))


def deviation(n: Column, m2: Column) -> Column:
    """Of the population."""
    return F.sqrt(F.try_divide(m2, n))


def quantile(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def rank_error(df: DataFrame, keys: list[str], value: str, estimates: DataFrame) -> DataFrame:
    """(keys, q, estimate, error) of ``estimates`` (keys, q, estimate): how far q lies outside the exact share of values below or at the estimate."""
    v = F.col(value).cast("double")
    j = df.join(estimates, keys)
    g = j.groupBy(*keys, "q", "estimate").agg(F.count(v).alias("n"), F.count_if(v < F.col("estimate")).alias("below"), F.count_if(v <= F.col("estimate")).alias("upto"))
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("q"), F.col("q") - F.col("upto") / F.col("n"))
    return g.select(*keys, "q", "estimate", "n", off.alias("error"))


def sources(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, sources): a theta sketch each, which ``union_of`` merges and ``distinct_of`` reads."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(source, THETA).alias("sources"))


def union_of(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sources", THETA).alias("sources"))


def distinct_of(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def _cells(item: Column, depth: int, width: int) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("row"), F.pmod(F.xxhash64(F.lit(d), item), F.lit(width)).cast("int").alias("cell")) for d in range(depth)])


def count_min(df: DataFrame, keys: list[str], item: str, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(keys, row, cell, n): the counters that are not 0, depth x width at most for each key. Tasks sum up before they send."""
    d = df.filter(F.col(item).isNotNull()).select(*keys, F.explode(_cells(F.col(item), depth, width)).alias("c"))
    return d.groupBy(*keys, F.col("c.row").alias("row"), F.col("c.cell").alias("cell")).agg(F.count("*").alias("n"))


def merge_counters(counters: DataFrame, keys: list[str]) -> DataFrame:
    return counters.groupBy(*keys, "row", "cell").agg(F.sum("n").alias("n"))


def estimates(items: DataFrame, item: str, counters: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """``items`` with ``estimate``, never below the true count: the least of their counters; 0 where one is missing."""
    at = items.select(item).distinct().select(item, F.explode(_cells(F.col(item), depth, width)).alias("c")).select(item, "c.*")
    e = at.join(counters.select("row", "cell", "n"), ["row", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
    return items.join(e, item)
