"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources share all words by weight; a source gives at most ``max_epochs`` times its size,
and what it can't give is shared again by weight among the others. In closed form a source's
target is min(cap, level x weight), where the level is found by one pass over the sources sorted
by cap / weight.

Selection: a source gives whole epochs first, then a weighted sample without replacement: each
document has the key -ln(u) / quality, and the smallest keys whose sizes sum up to the rest are
taken. The prefix sum is counted over buckets of the key first; only the bucket in which the
budget ends is sorted, so a source that holds most rows is no single group. The one document left
whose size comes nearest to what is then missing closes the gap.

Rows equal in id and text have one key; they are counted as one group, of which as many are taken as the
rest allows, told apart by a number that each row gets when the keys are written.

Defined cases: null source is a source of its own and last; null or empty texts have size 0 and
are taken 0 words; a key is drawn from id and text together, so null or repeated ids are nothing
special; equal rows are taken one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.text import n_words
from tidewell.runtime import stage, table

WEIGHTS = (5, 2, 1)
BUCKETS = 4096
#: Up to so many sources their plan (one row each) is broadcast, else joined by shuffle.
BROADCAST_SOURCES = 100_000


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 48 bits of a digest of id and text: the same in every run."""
    what = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(what), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def prose_quality(text: Column, words: Column) -> Column:
    """The default weight, 0.05 to 1: the share of characters that are no symbols of markup, times how
    near the characters for each word come to those of prose (4 to 10). Null or empty texts: 1."""
    long = F.length(text)
    plain = F.try_divide(F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")), long)
    per_word = F.try_divide(long, words)
    near = F.least(F.lit(1.0), per_word / 4, 10 / per_word)
    return F.greatest(F.lit(0.05), F.coalesce(plain * near, F.lit(1.0)))


def weight(quality) -> Column:
    """``quality``: a function of the text and its number of words, or the name of a column (null: 1)."""
    return quality(F.col("text"), F.col("_size")) if callable(quality) else F.greatest(F.lit(0.05), F.coalesce(F.col(quality).cast("double"), F.lit(1.0)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source. Works on the per-source sums only."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    caps, ws = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - caps) / (F.sum("w").over(everything) - ws))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    s = s.withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("w")).alias("target"))


def keyed(docs: DataFrame, seed: str = "mix-1", quality=prose_quality, *more: Column) -> DataFrame:
    """(doc_id, source) and ``more`` of ``docs`` with _size (words), _pick (what orders a source's documents), _bucket (of the key) and _row (a number, once written)."""
    given = [] if callable(quality) else [F.col(quality).alias("_quality")]
    d = docs.select("doc_id", "source", "text", n_words(F.col("text")).alias("_size"), *given, *more)
    key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / weight(quality if callable(quality) else "_quality")
    d = d.withColumn("_key", key).drop("text", "_quality")
    d = d.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    return d.withColumn("_pick", F.struct(F.col("_key").alias("key"), "doc_id", F.col("_size").alias("size"))).drop("_key").withColumn("_row", F.monotonically_increasing_id())


def _with_plan(d: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row with its source's plan, by broadcast while the plan (a row per source) is short."""
    plan = plan.withColumnRenamed("source", "_s")
    few = plan.count() <= BROADCAST_SOURCES
    return d.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mixing_plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """A row per source: source_size, target, whole epochs, and what else is taken once: all of the
    buckets below ``edge``, in that bucket what is ordered up to ``cut``; of the equal rows ``tie`` those
    numbered up to ``tie_row``; and one row more, ``last`` numbered ``last_row``. ``shared``: whether
    equal rows are told apart by their numbers.

    ``slim``: (source, _size, _bucket, _pick, _row), written."""
    by_bucket = stage(slim.groupBy("source", "_bucket").agg(F.sum("_size").alias("words")), "buckets")
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    targets = stage(targets, "targets")

    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = _with_plan(edge, targets.select("source", "rest")).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edge = edge.groupBy(F.col("source").alias("s")).agg(F.min("_bucket").alias("edge"), F.min_by("before", "_bucket").alias("before"))
    plan = targets.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = stage(plan.withColumns({"edge": F.coalesce("edge", F.lit(BUCKETS)), "before": F.coalesce("before", F.lit(0))}), "edges")

    # in the bucket where the budget ends, equal rows are one group each before they are put in order
    inside = _with_plan(slim.filter(F.col("_size") > 0), plan.select("source", "edge")).filter(F.col("_bucket") == F.col("edge"))
    inside = _with_plan(inside.groupBy("source", "_pick").agg(F.count("*").alias("rows")), plan.select("source", "before", "rest"))
    words, order = F.col("_pick.size") * F.col("rows"), Window.partitionBy("source").orderBy("_pick")
    inside = inside.withColumn("upto", F.col("before") + F.sum(words).over(order)).withColumn("over", F.col("upto") - words)
    inside = stage(inside.filter(F.col("over") <= F.col("rest")), "inside")
    cut = inside.filter(F.col("upto") <= F.col("rest")).groupBy(F.col("source").alias("s")).agg(F.max("_pick").alias("cut"), F.max("upto").alias("got"))
    some = F.floor((F.col("rest") - F.col("over")) / F.col("_pick.size")).cast("long")
    tie = inside.filter((F.col("upto") > F.col("rest")) & (F.col("rows") > 1)).withColumn("some", some).filter("some > 0")
    tie = _numbered(slim, tie.select("source", F.col("_pick").alias("tie"), "some", (F.col("some") * F.col("_pick.size")).alias("part")))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.join(tie.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.withColumn("gap", F.col("rest") - F.coalesce("got", "before") - F.coalesce("part", F.lit(0)))
    plan = stage(plan.drop("got", "before", "rest", "part", "some"), "cuts")

    # what is missing up to the target goes to the one row left that comes nearest to it
    left = _with_plan(slim.filter(F.col("_size") > 0), plan.select("source", "edge", "cut", "tie", "tie_row", "gap")).filter(~_taken_once())
    off = F.abs(F.col("_size") - F.col("gap"))
    last = left.filter(off < F.col("gap")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct(off.alias("off"), "_pick", "_row")).alias("last"))
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = stage(plan.withColumn("last_row", F.col("last._row")).withColumn("last", F.col("last._pick")).drop("gap"), "lasts")
    same = _with_plan(slim, plan.select("source", "last")).filter(F.col("_pick") == F.col("last")).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("alike"))
    plan = plan.join(same, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return stage(plan.withColumn("shared", F.col("tie").isNotNull() | (F.coalesce("alike", F.lit(0)) > 1)).drop("alike"), "plan")


def _numbered(slim: DataFrame, tie: DataFrame) -> DataFrame:
    """``tie`` (source, tie, some, part) with ``tie_row``: the number of the ``some``-th of its equal rows.

    Numbers rise by the task that wrote the row, so counts by task say which task's rows hold it; only those are put in order."""
    tie = stage(tie, "ties")
    rows = _with_plan(slim, tie.select("source", "tie", "some")).filter(F.col("_pick") == F.col("tie")).select("source", "some", F.shiftright("_row", 33).alias("task"), "_row")
    counts = rows.groupBy("source", "some", "task").agg(F.count("*").alias("n"))  # a row a source and task
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    holds = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter((F.col("before") < F.col("some")) & (F.col("before") + F.col("n") >= F.col("some")))
    holds = stage(holds.select(F.col("source").alias("s"), F.col("task").alias("t"), (F.col("some") - F.col("before")).alias("nth")), "holders")
    mine = rows.join(F.broadcast(holds) if holds.count() <= BROADCAST_SOURCES else holds, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t")))
    mine = mine.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("_row"))).filter(F.col("i") == F.col("nth")).select("s", F.col("_row").alias("tie_row"))
    return tie.join(mine, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _taken_once() -> Column:
    upto = (F.col("_bucket") == F.col("edge")) & F.coalesce(F.col("_pick") <= F.col("cut"), F.lit(False))
    return (F.col("_bucket") < F.col("edge")) | upto | F.coalesce((F.col("_pick") == F.col("tie")) & (F.col("_row") <= F.col("tie_row")), F.lit(False))


def mixed(keyed_docs: DataFrame, plan: DataFrame, numbered: bool = True) -> DataFrame:
    """``keyed_docs`` with source_size, target and ``epochs``, how often the mix takes the row. ``numbered``: whether their _row is that of the plan."""
    d = _with_plan(keyed_docs, plan)
    last = (F.col("_pick") == F.col("last")) & ((F.col("_row") == F.col("last_row")) if numbered else F.lit(True))
    once = _taken_once() | F.coalesce(last, F.lit(False))
    d = d.withColumn("epochs", F.when(F.col("_size") > 0, F.col("whole") + once.cast("long")).otherwise(0).cast("long"))
    return d.drop("whole", "edge", "cut", "tie", "tie_row", "last", "last_row", "shared")


SLIM = ("source", "_size", "_bucket", "_pick", "_row")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix-1", quality=prose_quality) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for every row of ``docs``."""
    slim = stage(keyed(docs, seed, quality), "keys")
    d = mixed(slim, mixing_plan(slim, weights, max_epochs))
    return d.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "epochs", (F.col("epochs") * F.col("_size")).alias("taken"))


def take(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "mix-1", quality=prose_quality) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it. Texts are not shuffled; whole
    rows are written once more only where equal rows must be told apart."""
    d = keyed(docs, seed, quality, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    plan = mixing_plan(stage(d.select(*SLIM), "keys"), weights, max_epochs)
    shared = plan.filter("shared").limit(1).count() > 0
    if shared:
        d = stage(d, "rows")
        plan = mixing_plan(d.select(*SLIM), weights, max_epochs)
    d = mixed(d, plan, shared).filter("epochs > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))))
    return d.select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
