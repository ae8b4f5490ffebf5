"""Event envelopes: schema, readers of event logs and the flattened form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.timeutil import parse_time

_TEXTS = ("specversion", "id", "source", "type", "subject", "time", "datacontenttype", "traceparent", "data")
#: One JSON line of an event log; ``data`` stays raw JSON, to be parsed by channel.
ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in _TEXTS])
BAD = "_corrupt_record"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes of JSON lines; ``raw`` is the line, ``malformed`` marks what is no JSON object with a type."""
    e = F.from_json(F.col(column), ENVELOPE)
    d = lines.withColumn("_e", e).select(F.col(column).alias("raw"), *[F.col(f"_e.{n}").alias(n) for n in _TEXTS])
    reason = F.when(F.try_parse_json("raw").isNull(), "malformed_json").when(F.coalesce("type", F.lit("")) == "", "missing_type")
    return d.withColumn("failure_reason", reason).withColumn("ts", parse_time(F.col("time")))


def read_log(spark: SparkSession, path: str, since: str | None = None, excluded: list[str] = (), aliases: dict[str, str] | None = None) -> DataFrame:
    """A bounded read of a log: excluded channels left out, aliases resolved, old events skipped; times that can't be parsed stay."""
    d = unwrapped(parse_lines(spark.read.text(path)))
    if aliases:
        d = d.withColumn("type", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.col("type")), F.col("type")))
    if excluded:
        d = d.filter(~F.coalesce(F.col("type").isin(*excluded), F.lit(False)))
    if since:
        d = d.filter(F.col("ts").isNull() | (F.col("ts") >= F.lit(since).cast("timestamp")))
    return d


def stream_log(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The segments of a log as a stream. Producers close a segment and begin a new file; the query's checkpoint is the position."""
    reader = spark.readStream.schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_lines(reader.text(folder))


def unwrapped(envelopes: DataFrame, prefix: str = "") -> DataFrame:
    """Envelopes whose data is an envelope again (of a type with ``prefix``) replaced by the inner one."""
    inner = F.get_json_object("data", "$.type")
    nested = inner.isNotNull() & inner.startswith(prefix) & F.get_json_object("data", "$.data").isNotNull()
    return envelopes.withColumns({"type": F.when(nested, inner).otherwise(F.col("type")), "data": F.when(nested, F.get_json_object("data", "$.data")).otherwise(F.col("data"))})


def flattened(envelopes: DataFrame) -> DataFrame:
    """event_id, type, source, timestamp and ``fields``: the data's keys, strings as they are, other values as JSON."""
    return envelopes.select(F.col("id").alias("event_id"), "type", "source", F.col("time").alias("timestamp"), F.from_json("data", "map<string,string>").alias("fields"), "raw")


def envelope(id_: Column, source: Column, type_: Column, time: Column, data: Column) -> Column:
    """A JSON line from its parts; ``data`` is a struct or map."""
    return F.to_json(F.struct(F.lit("1.0").alias("specversion"), id_.alias("id"), source.alias("source"), type_.alias("type"), time.alias("time"), F.lit("application/json").alias("datacontenttype"), data.alias("data")))


def trace(envelopes: DataFrame, trace_id: str) -> DataFrame:
    """All events of one trace in order of time."""
    return envelopes.filter(F.contains("traceparent", F.lit(trace_id))).orderBy("ts", "id")


def deterministic_id(*parts: Column) -> Column:
    """An id that is the same in every run, from what identifies the event."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 26))
