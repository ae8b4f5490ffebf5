"""Times as microseconds since 1970, free of session time zones, and a fixed "now" for every query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
#: 2024-01-31 00:00:00, the moment that queries over the event table are asked at.
AS_OF = 1_706_659_200 * SECOND


def micros(ts: Column) -> Column:
    """A timestamp without zone as microseconds; null for null."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def parse_time(text: Column) -> Column:
    """RFC 3339 or one of the common log layouts as a timestamp; null where none fits. Nanoseconds are cut."""
    t = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    layouts = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(x)) for x in layouts], F.try_to_timestamp(t))


def without_fraction(text: Column) -> Column:
    """An RFC 3339 text without fractional seconds."""
    return F.regexp_replace(text, r"\.\d+", "")


def recency(last_us: Column, as_of: int = AS_OF, half_life_days: float = 14.0) -> Column:
    """1 now, 0.5 one half-life ago, 0.5 for an unknown time; the future counts as now."""
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - last_us) / float(DAY))
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) * age / half_life_days), F.lit(0.5))
