"""Dead letters: what is due, when it is tried again, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.timeutil import SECOND

#: Waits before each retry, in seconds, and reasons that are never tried again.
BACKOFF = (30, 300, 1800)
TERMINAL = ("schema_violation", "malformed_json", "missing_type", "missing_required_field")


def due(letters: DataFrame, as_of: int) -> DataFrame:
    """Unresolved letters of a reason that may be tried again, whose time has come, with tries left."""
    ok = F.col("resolved_at").isNull() & ~F.col("failure_reason").isin(*TERMINAL) & (F.col("next_retry_at") <= as_of) & (F.col("retry_count") < len(BACKOFF))
    return letters.filter(ok)


def next_retry(failed_at: Column, retry_count: Column) -> Column:
    """When a letter that failed again is tried next; null after the last wait."""
    wait = F.try_element_at(F.array(*map(F.lit, BACKOFF)), (retry_count + 2).cast("int"))
    return failed_at + wait * SECOND


def abandoned(event_type: Column, payload: Column) -> Column:
    """Letters that must not be published again: of unknown type, or no JSON."""
    return (F.upper(F.trim(event_type)) == "UNKNOWN") | F.try_parse_json(F.coalesce(payload, F.lit("{"))).isNull()


def counters(letters: DataFrame) -> DataFrame:
    """One row (total, quarantined, retried_ok, pending); zeros for an empty table."""
    c = F.col
    return letters.agg(
        F.count("*").alias("total"), F.count_if(c("quarantined_at").isNotNull()).alias("quarantined"),
        F.count_if(c("resolved_at").isNotNull() & c("quarantined_at").isNull()).alias("retried_ok"), F.count_if(c("resolved_at").isNull()).alias("pending"),
    )
