"""Landed host logs as one kind of entry: log_source, service, level, message, raw, parsed_fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import level

#: Syslog priorities as levels.
PRIORITIES = ["critical", "critical", "critical", "error", "warn", "info", "info", "debug"]
CUT = 2000


def _priority(p):
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, PRIORITIES)), (p + 1).cast("int")), F.lit("info"))


def _entry(d: DataFrame, source: str, service, lev, message, raw, fields) -> DataFrame:
    return d.select(F.lit(source).alias("log_source"), service.alias("service"), lev.alias("level"), F.substring(message, 1, CUT).alias("message"), F.substring(raw, 1, CUT).alias("raw"), fields.alias("parsed_fields"))


def docker(lines: DataFrame) -> DataFrame:
    """From (container, value): an optional leading timestamp goes to the fields; "-1" and the like go from the name."""
    stamp = r"^(\d{4}-\d{2}-\d{2}T\S+)\s+(.*)$"
    has = F.col("value").rlike(stamp)
    message = F.when(has, F.regexp_extract("value", stamp, 2)).otherwise(F.col("value"))
    fields = F.when(has, F.create_map(F.lit("timestamp"), F.regexp_extract("value", stamp, 1))).otherwise(F.create_map().cast("map<string,string>"))
    return _entry(lines, "docker", F.regexp_replace("container", r"[-_]\d+$", ""), level(message), message, F.col("value"), fields)


def journal(lines: DataFrame) -> DataFrame:
    """From JSON ``value``: list messages are joined, terminal colours go, bytes written as numbers become "<binary>"."""
    j = lambda k: F.get_json_object("value", f"$.{k}")
    m = j("MESSAGE")
    parts = F.from_json(m, "array<string>")
    binary = F.size(parts) > 0
    numbers = binary & F.forall(parts, lambda x: x.rlike(r"^\d{1,3}$"))
    text = F.when(numbers, F.lit("<binary>")).when(binary, F.array_join(parts, " ")).otherwise(F.coalesce(m, F.lit("")))
    text = F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")
    pri = F.try_to_number(j("PRIORITY"), F.lit("9")).cast("int")
    service = F.coalesce(j("SYSLOG_IDENTIFIER"), j("_SYSTEMD_UNIT"), F.lit("unknown"))
    lev = F.when(pri.isNotNull(), _priority(pri)).otherwise(level(text))
    return _entry(lines, "journal", service, lev, text, F.col("value"), F.map_filter(F.create_map(F.lit("unit"), j("_SYSTEMD_UNIT"), F.lit("pid"), j("_PID")), lambda k, v: v.isNotNull()))


def kernel(lines: DataFrame) -> DataFrame:
    """From ``value`` "prio,seq,time,flags;message"; the level is in the priority's lowest three bits."""
    head, message = F.split("value", ";", 2)[0], F.try_element_at(F.split("value", ";", 2), F.lit(2))
    pri = F.try_to_number(F.split(head, ",")[0], F.lit("9999")).cast("int")
    lev = F.when(pri.isNotNull() & message.isNotNull(), _priority(pri.bitwiseAND(7))).otherwise(level(F.col("value")))
    return _entry(lines, "kernel", F.lit("kernel"), lev, F.coalesce(message, F.col("value")), F.col("value"), F.create_map().cast("map<string,string>"))


def slow_log(rows: DataFrame, least_us: int = 10_000) -> DataFrame:
    """From (id, duration in microseconds, command): statements of ``least_us`` or more."""
    slow = rows.filter(F.col("duration") >= least_us)
    ms = F.format_string("%.1f", F.col("duration") / 1000.0)
    message = F.concat(F.lit("slow command "), F.substring("command", 1, 200), F.lit(" took "), ms, F.lit(" ms"))
    lev = F.when(F.col("duration") >= 100 * least_us, "error").otherwise("warn")
    return _entry(slow, "store", F.lit("store"), lev, message, F.col("command"), F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("duration_us"), F.col("duration").cast("string")))


def app(lines: DataFrame) -> DataFrame:
    """From (path, value): the file's name without ending is the service."""
    return _entry(lines, "app", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), level(F.col("value")), F.col("value"), F.col("value"), F.create_map(F.lit("path"), F.col("path")))


def excluding(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """Entries that none of the patterns, without regard to case, finds in the message."""
    for p in patterns:
        entries = entries.filter(~F.col("message").rlike(f"(?i){p}"))
    return entries
