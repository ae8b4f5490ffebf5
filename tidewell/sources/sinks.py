"""Where events go: channel tables, dead letters, drafts, and text forms of small results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.keys import per_key


def mirror(validated: DataFrame, table_path: str, dead_path: str, batch: int | None = None) -> None:
    """Valid events to a table partitioned by channel, the others to dead letters. ``batch``: see ``put``."""
    good = validated.filter(F.col("failure_reason").isNull())
    put(good, table_path, batch, "type")
    put(dead_letters(validated.filter(F.col("failure_reason").isNotNull())), dead_path, batch)


def put(rows: DataFrame, path: str, batch: int | None = None, *partitions: str) -> None:
    """Appends rows; or, with the number of a micro-batch, writes that batch's folder anew.

    A batch that failed half-way is tried again with the same rows and number, so what its first attempt
    wrote is replaced and every row is there once. Readers see the number as the column ``batch``."""
    where = path if batch is None else f"{path}/batch={batch}"
    rows.write.mode("append" if batch is None else "overwrite").partitionBy(*partitions).parquet(where)


def dead_letters(failed: DataFrame, excerpt: int = 500) -> DataFrame:
    """(id, event_type, source, failure_reason, schema_violation_detail, original_payload); events without an id get one from their text."""
    id_ = F.coalesce(F.nullif("id", F.lit("")), F.sha2("raw", 256))
    return failed.select(id_.alias("id"), F.coalesce("type", F.lit("UNKNOWN")).alias("event_type"), "source", "failure_reason", F.col("detail").alias("schema_violation_detail"), F.substring("raw", 1, excerpt).alias("original_payload"))


def mirror_stream(validated: DataFrame, table_path: str, dead_path: str, checkpoint: str, within: str = "10 minutes"):
    """The same as a stream: events of one id within the time are written once, also where a
    batch fails and is tried again. Returns the writer, to be started."""
    once = validated.withWatermark("ts", within).dropDuplicatesWithinWatermark(["id"])
    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(dispatch([(F.lit(True), lambda df, batch: mirror(df, table_path, dead_path, batch))]))


def route(signals: DataFrame, tiers: list[tuple[str, Column]], default: str = "log") -> DataFrame:
    """``signals`` with the ``tier`` of the first condition that holds."""
    tier = F.coalesce(*[F.when(c, t) for t, c in tiers], F.lit(default))
    return signals.withColumn("tier", tier)


def dispatch(handlers: list[tuple[Column, Callable[[DataFrame, int], None]]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each handler the rows of its condition and the batch's number.

    An error fails the batch, which is then tried again with all its handlers: they write by the number (``put``)."""

    def run(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for condition, handler in handlers:
                handler(df.filter(condition), batch)
        finally:
            df.unpersist()

    return run


def retained(events: DataFrame, per_channel: int = 256) -> DataFrame:
    """The newest events of every channel, for late subscribers."""
    return per_key(events, ["type"], [F.desc("ts"), F.col("id")], per_channel)


def exposition(metrics: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """Lines ``name{label="value"} number`` of a small result."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    return metrics.select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def sparkline(values: Column) -> Column:
    """Eight levels of blocks for an array of numbers."""
    top = F.greatest(F.array_max(values), F.lit(1))
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit("▁▂▃▄▅▆▇█"), F.least(F.floor(v * 8 / top) + 1, F.lit(8)).cast("int"), F.lit(1))), "")
