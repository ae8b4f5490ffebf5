"""Names against long lists of patterns, the first listed pattern wins; lists are tables, not code.

In a pattern ``*`` stands for any text. A pattern without one meets names by equality. Any other must
hold its longest literal piece, so it meets only the names that share that piece's rarest gram (the
whole piece, where that is shorter), and is checked on those. So a list of many thousands of patterns
joins by equality and no name meets all patterns. Grams have ``GRAM`` characters, and one more for
every tenfold of names beyond that: names a gram stay as many while names and patterns grow. Joins are
merges: Spark would judge both sides by the size of the files, from which many more rows are made, and
broadcast them through the driver.

Defined cases: null names and patterns match nothing; a pattern of stars only matches every name; of
equal patterns the first place counts; of equal places the smaller pattern; repeated names are one
name; empty tables give no rows; columns other than those named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _regex(pattern: Column) -> Column:
    """A Java expression for the pattern: its pieces quoted, stars as any text."""
    quoted = F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?s)^\\Q"), F.replace(quoted, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))


def _longest(pattern: Column) -> Column:
    """The longest piece between stars, the first of equal ones."""
    pieces = F.split(pattern, r"\*")
    return F.aggregate(pieces, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct pieces of ``size`` characters of a text that is not shorter."""
    size = size if isinstance(size, Column) else F.lit(size)
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def first_match(names: DataFrame, patterns: DataFrame, gram: int | None = None) -> DataFrame:
    """(name, place, pattern) of every name that a pattern takes. ``names``: (name); ``patterns``: (pattern, place);
    ``gram``: characters of a gram, by the number of names where it is not given."""
    n = names.filter("name IS NOT NULL").select("name").distinct()
    p = patterns.filter("pattern IS NOT NULL").groupBy("pattern").agg(F.min("place").alias("place"))
    gram = gram or max(GRAM, math.ceil(math.log10(max(1, n.count()))))
    first = F.min(F.struct("place", "pattern")).alias("m")
    whole = n.join(p.filter(~F.contains("pattern", F.lit("*"))).hint("merge"), F.col("name") == F.col("pattern"))
    starred = p.filter(F.contains("pattern", F.lit("*"))).withColumn("piece", _longest(F.col("pattern")))
    every = starred.filter("piece = ''").agg(first)  # one row

    size = F.least(F.length("piece"), F.lit(gram))
    sizes = sorted(r[0] for r in starred.filter("piece <> ''").select(size).distinct().collect())  # ``gram`` numbers at most
    grams = F.flatten(F.array(*[_grams(F.col("name"), k) for k in sizes])) if sizes else F.array().cast("array<string>")
    held = n.select("name", F.explode(grams).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("names"))
    mine = starred.filter("piece <> ''").withColumn("gram", F.explode(_grams(F.col("piece"), size)))
    mine = mine.join(often.hint("merge"), "gram", "left").groupBy("pattern", "place").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("rare"))
    mine = mine.filter("rare.names > 0").select("pattern", "place", F.col("rare.gram").alias("gram"))  # a gram that no name has: no match
    found = held.join(mine.hint("merge"), "gram").filter(F.rlike(F.col("name"), _regex(F.col("pattern"))))
    best = whole.select("name", "place", "pattern").union(found.select("name", "place", "pattern"))
    best = best.groupBy("name").agg(first)
    out = n.join(best.hint("merge"), "name", "left").crossJoin(F.broadcast(every.withColumnRenamed("m", "all")))  # with a single row
    return out.select("name", F.least("m", "all").alias("m")).filter("m IS NOT NULL").select("name", "m.*")
