"""Running sums and maxima over one global order, without a task that holds all rows.

Rows are cut into ranges of the ordered column by approximate quantiles; each range sums up by
itself, and the totals of the ranges before it, one row each, are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def running(df: DataFrame, column: str, totals: dict[str, tuple[str, str]], *, itself: bool = True, ranges: int = RANGES) -> DataFrame:
    """``df`` with running values: name -> ("sum" or "max", column), over all rows before and, with ``itself``,
    the row too. Values of ``column`` must be distinct; a maximum over nothing is null, a sum 0."""
    v = F.col(column).cast("double")
    cuts = df.select(F.percentile_approx(v, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []  # ranges - 1 numbers
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    d = df.withColumn("_range", F.size(F.filter(bounds, lambda c: c < v)))
    fold = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``ranges`` rows
    sums = d.groupBy("_range").agg(*[fold[how](c).alias(f"_t_{name}") for name, (how, c) in totals.items()])
    sums = sums.select("_range", *[fold[how](f"_t_{name}").over(before).alias(f"_b_{name}") for name, (how, _) in totals.items()])
    d = d.withColumns({f"_i_{name}": fold[how](c).over(inside) for name, (how, c) in totals.items()}).join(F.broadcast(sums), "_range")
    both = {name: (F.greatest(f"_b_{name}", f"_i_{name}") if how == "max" else F.coalesce(f"_b_{name}", F.lit(0)) + F.coalesce(f"_i_{name}", F.lit(0))) for name, (how, _) in totals.items()}
    return d.withColumns(both).drop("_range", *[f"_{x}_{name}" for x in "bi" for name in totals])
