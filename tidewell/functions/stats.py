"""Baselines, percentile rules and distances between distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.prefix import running


def moments(x: Column) -> dict[str, Column]:
    """Exact sums of a decimal or whole column: n, total and squares, from which mean and deviation follow."""
    return {"n": F.count(x), "total": F.sum(x), "squares": F.sum(x * x)}


def mean(n: Column, total: Column) -> Column:
    return F.try_divide(total.cast("double"), n.cast("double"))


def stddev_pop(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from exact sums; null without rows."""
    m = mean(n, total)
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(squares.cast("double"), n.cast("double")) - m * m))


def deviation(value: Column, n: Column, avg: Column, sd: Column, least: int = 100, flat: float = 0.001) -> Column:
    """How many deviations a value lies from its baseline; null below ``least`` samples or on a flat one."""
    return F.when((n >= least) & (sd >= flat), (value - avg) / sd)


def ranked_percentiles(df: DataFrame, key: str, value: Column, rules: list[str]) -> DataFrame:
    """One row per key with a column per rule, by counting ranks over distinct values.

    Values are counted first, so a key's rows are never held together; the distinct values of a key
    are sorted by a window."""
    counts = df.groupBy(F.col(key), value.alias("v")).agg(F.count("*").alias("c")).filter(F.col("v").isNotNull())
    w = Window.partitionBy(key).orderBy("v")
    counts = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    n = F.col("n")
    at = {
        "upper_median": F.floor(n / 2) + 1, "p95_floor": F.least(F.floor(n * 95 / 100) + 1, n), "p95_nearest": F.ceil(n * 95 / 100),
        "p95_below": F.greatest(F.floor(n * 95 / 100), F.lit(1)), "p95_rounded": F.greatest(F.floor((n * 95 + 50) / 100), F.lit(1)),
    }
    pick = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    out = []
    for r in rules:
        if r == "median":
            out.append(((pick(F.floor((n + 1) / 2)) + pick(F.floor(n / 2) + 1)) / 2).alias(r))
        else:
            out.append(pick(at[r]).alias(r))
    return counts.groupBy(key).agg(F.max("n").alias("n"), *out)


def js_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of two tables (label, n): one row, ``js``."""
    share = lambda d, name: d.crossJoin(F.broadcast(d.agg(F.sum("n").alias("t")))).select("label", (F.col("n") / F.col("t")).alias(name))
    both = share(p, "p").join(share(q, "q"), "label", "full").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / m)).otherwise(0.0)
    return both.agg((0.5 * F.sum(kl("p")) + 0.5 * F.sum(kl("q"))).alias("js"))


def ks_distance(values: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance of the values ``v`` of sides 0 and 1 in ``side``: one row, ``ks``.

    Values are counted before they are put in order, so the ordered part has a row per distinct value."""
    side = lambda s: F.sum((F.col("side") == s).cast("long"))
    points = values.groupBy("v").agg(side(0).alias("x"), side(1).alias("y"))
    total = points.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    points = running(points, "v", {"cx": ("sum", "x"), "cy": ("sum", "y")}).crossJoin(F.broadcast(total))
    gap = F.abs(F.try_divide(F.col("cx"), F.col("nx")) - F.try_divide(F.col("cy"), F.col("ny")))
    return points.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))
