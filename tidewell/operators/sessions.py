"""Sessions, windows and gaps over ordered events of a key. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.timeutil import SECOND


def ordered(key: str | list[str], *order: str):
    return Window.partitionBy(key).orderBy(*order)


def idle_sessions(events: DataFrame, key: str, time: str, tie: str, gap: int, ended: Column | None = None) -> DataFrame:
    """``events`` with ``session`` (from 1): a new one after more than ``gap`` or after an event that ended one."""
    w = ordered(key, time, tie)
    before = F.lag(time).over(w)
    cut = before.isNull() | (F.col(time) - before > gap)
    if ended is not None:
        cut = cut | F.coalesce(F.lag(ended).over(w), F.lit(False))
    return events.withColumn("session", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def session_rows(sessions: DataFrame, key: str, time: str, ended: Column, gap: int, as_of: int) -> DataFrame:
    """One row per session with its bounds, size and why it closed ("open": not yet at ``as_of``)."""
    s = sessions.groupBy(key, "session").agg(F.min(time).alias("started"), F.max(time).alias("last"), F.count("*").alias("events"), F.max(ended).alias("ended"))
    reason = F.when(F.col("ended"), "ended").when(F.lit(as_of) - F.col("last") > gap, "idle_timeout").otherwise("open")
    return s.withColumn("close_reason", reason).drop("ended")


def continuation(sessions: DataFrame, key: str) -> DataFrame:
    """Each session with the one of the same key before it as ``continues``."""
    return sessions.withColumn("continues", F.lag("session").over(ordered(key, "session")))


def with_gap(events: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """``events`` with ``gap``, the time to the key's next event (null for the last)."""
    return events.withColumn("gap", F.lead(time).over(ordered(key, time, tie)) - F.col(time))


def cohorts(events: DataFrame, key: str, time: str, tie: str, window: int, newest_first: bool = False) -> DataFrame:
    """``events`` with ``cohort`` (from 1): a new one where the last event lies more than ``window`` away."""
    order = (F.desc(time), F.desc(tie)) if newest_first else (F.col(time), F.col(tie))
    w = Window.partitionBy(key).orderBy(*order)
    far = F.coalesce(F.abs(F.col(time) - F.lag(time).over(w)) > window, F.lit(True))
    return events.withColumn("cohort", F.sum(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def waves(events: DataFrame, key: str, seq: str, time: str, window: int, jump: int = 8) -> DataFrame:
    """``events`` with ``wave`` (from 1) in order of ``seq``: a new one where the time lies more than ``window`` behind the last known
    one; where either is missing, where ``seq`` has grown by more than ``jump``."""
    w = Window.partitionBy(key).orderBy(seq)
    known = F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag(seq).over(w)
    by_time = F.col(time).isNotNull() & known.isNotNull()
    new = F.when(before.isNull(), True).when(by_time, F.col(time) - known > window).otherwise(F.col(seq) - before > jump)
    return events.withColumn("_new", new.cast("int")).withColumn("wave", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def bucket_counts(events: DataFrame, key: str, time: str, bucket: int, last: int, as_of: int) -> DataFrame:
    """Counts of each key in the ``last`` buckets before ``as_of``, zero where there is no event."""
    start = as_of - last * bucket
    slots = events.select(key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(last - 1))))
    counts = events.filter((F.col(time) >= start) & (F.col(time) < as_of)).groupBy(key, F.floor((F.col(time) - start) / bucket).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return slots.join(counts, [key, "slot"], "left").select(key, "slot", F.coalesce("n", F.lit(0)).alias("n"))


def rolling_count(events: DataFrame, key: str, time: str, span: int, alias: str = "n", what: Column | None = None) -> DataFrame:
    """``events`` with how many (or the sum of ``what``) lie within ``span`` before each, itself included.

    Time is cut into slices of ``span``; an event also goes to the slice behind its own, so that a
    slice knows all that its events look back at, and no key's events are held together."""
    own = F.floor(F.col(time) / span)
    e = events.withColumn("_own", own).withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_slice").orderBy(time).rangeBetween(-span, 0)
    return e.withColumn(alias, (F.count("*") if what is None else F.sum(what)).over(w)).filter("_own = _slice").drop("_own", "_slice")


def rate_per_minute(count: Column, first: Column, last: Column) -> Column:
    """Events a minute over at least one second."""
    return count * 60.0 / (F.greatest(last - first, F.lit(SECOND)) / float(SECOND))
