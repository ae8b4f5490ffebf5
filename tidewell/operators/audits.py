"""Audits of dead letters, schemas, channels and evaluations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import wording
from tidewell.functions.channels import shell_glob
from tidewell.runtime import stage


def with_fallbacks(letters: DataFrame) -> DataFrame:
    """Letters whose old field names (reason, channel) stand in for missing new ones (failure_reason, original_type)."""
    return letters.withColumns({"failure_reason": F.coalesce("failure_reason", "reason"), "original_type": F.coalesce("original_type", "channel")})


def letter_groups(letters: DataFrame) -> DataFrame:
    """(original_type, field, value, n, first_seen, last_seen): what fails in the same way."""
    field, value = wording.violation(F.col("detail"))
    g = letters.withColumns({"field": field, "value": value})
    return g.groupBy("original_type", "field", "value").agg(F.count("*").alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def first_handler(type_: Column, handlers: list[tuple[str, str]]) -> Column:
    """The handler of the first pattern that takes the type: equal to it, or with ".*" its beginning or a part of it."""
    takes = lambda p: F.contains(type_, F.lit(p[:-2])) if p.endswith(".*") else type_ == p
    return functools.reduce(lambda w, h: w.when(takes(h[0]), h[1]), handlers, F).otherwise(F.lit(None).cast("string"))


def patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """(pattern) of a list file's lines: comments from "#" on and empty lines are left out."""
    p = F.trim(F.split(F.col(column), "#")[0])
    return lines.select(p.alias("pattern")).filter("pattern <> ''").distinct()


def not_allowed(names: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The names that no shell pattern of the list takes."""
    ok = functools.reduce(lambda a, b: a | b, [F.col(column).rlike(shell_glob(p)) for p in allowed], F.lit(False))
    return names.filter(~ok)


def enum_patches(groups: DataFrame) -> DataFrame:
    """(original_type, field, add, n): values to add to a schema so that its violations end."""
    g = groups.filter(F.col("value").isNotNull()).groupBy("original_type").agg(F.array_sort(F.collect_set("value")).alias("add"), F.sum("n").alias("n"))
    return g.withColumn("add", F.array_join("add", ","))


def stale(groups: DataFrame, namespace: str, as_of: int, span: int) -> DataFrame:
    """(original_type, n, last_seen, stale) of a namespace's types: stale ones had no letter for ``span``."""
    g = groups.filter(F.col("original_type").startswith(namespace)).groupBy("original_type").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))
    return g.withColumn("stale", F.lit(as_of) - F.col("last_seen") > span)


def changed_evaluations(evaluations: DataFrame, key: str, order: list[str], facts: list[str], tolerance: float = 0.05) -> DataFrame:
    """The evaluations to be written: of each key the first, and those whose facts differ from the one before or
    whose score moved by more than the tolerance."""
    w = Window.partitionBy(key).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    same = functools.reduce(lambda a, b: a & b, [before(c).eqNullSafe(F.col(c)) for c in facts]) & (F.abs(before("score") - F.col("score")) <= tolerance)
    return evaluations.withColumn("_same", F.coalesce(same, F.lit(False)) & (F.row_number().over(w) > 1)).filter("NOT _same").drop("_same")


#: Names of a class in a piece, about; pieces of two classes meet whole.
PIECE = 256


def overlapping(fields: DataFrame, name: str, field: str, least: int) -> DataFrame:
    """(a, b, shared): names that share ``least`` fields or more.

    Names with the same fields are one class, and classes are compared, not names. Fields are put in order, rare
    ones first. Two classes that share ``least`` fields share one among the first n - least + 1 of each, so only
    these prefixes meet, and fields that most names have hardly ever do. Pairs of names are made last, from pieces
    of the two classes, and no shuffle holds them."""
    f = fields.filter(F.col(name).isNotNull() & F.col(field).isNotNull()).select(F.col(name).alias("n"), F.col(field).alias("f")).distinct()
    often = f.groupBy("f").agg(F.count("*").alias("names"))
    sets = f.join(often, "f").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("names", "f"))).alias("s")).filter(F.size("s") >= least)
    sets = stage(sets.select("n", F.transform("s", lambda x: x["f"]).alias("s")), "sets")  # a name's own fields
    classes = stage(sets.groupBy("s").agg(F.count("*").alias("size"), F.min("n").alias("c")), "classes")
    first = classes.select("c", F.explode(F.slice("s", F.lit(1), F.size("s") - least + 1)).alias("f"))
    a, b = first.select(F.col("c").alias("a"), "f"), first.select(F.col("c").alias("b"), "f")
    pairs = a.join(b.hint("merge"), "f").filter("a < b").select("a", "b").distinct()
    left, right = classes.select(F.col("c").alias("a"), F.col("s").alias("sa")), classes.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    pairs = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", shared.alias("shared")).filter(F.col("shared") >= least)
    pairs = pairs.unionByName(classes.filter("size > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), F.size("s").cast("long").alias("shared")))

    piece = F.pmod(F.xxhash64("n"), F.ceil(F.col("size") / PIECE)).alias("piece")
    pieces = sets.join(classes.hint("merge"), "s").select("c", piece, "n").groupBy("c", "piece").agg(F.collect_list("n").alias("ns"))
    of = lambda k: pieces.select(F.col("c").alias(k), F.col("piece").alias(f"p{k}"), F.col("ns").alias(f"n{k}"))
    met = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").filter("a < b OR pa <= pb")
    x = met.select("shared", (F.col("a") == F.col("b")).alias("same"), (F.col("pa") == F.col("pb")).alias("one"), "nb", F.explode("na").alias("x"))
    x = x.select("shared", (F.col("same") & F.col("one")).alias("once"), "x", F.explode("nb").alias("y")).filter("NOT once OR x < y")
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")
