"""The folds of ``tidewell.operators.folds`` over streams, with their state kept by Spark; windows and dedupe."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidewell.operators.folds import Fold


def stateful_fold(stream: DataFrame, key: str, order: list[str], fold: Fold, every_state: bool = False, idle_ms: int | None = None) -> DataFrame:
    """Results of a fold as they come. Events of a micro-batch are put in order; later batches must hold later events.

    ``every_state``: also what ``finish`` would say of each key touched, for running totals (update mode).
    ``idle_ms``: a key of which the stream's watermark has seen no event for so long is finished: what
    ``finish`` says comes out and its state is dropped, without a further event of the key. The stream
    needs a watermark. Without ``idle_ms`` states stay for ever."""
    names = [key, *StructType.fromDDL(fold.schema).names]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else fold.start()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame.from_records([(k[0], *r) for r in fold.finish(now)], columns=names)
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order)
        out = [r for row in rows[list(fold.columns)].astype(object).itertuples(index=False, name=None) for r in fold.step(now, row)]
        state.update((json.dumps(now),))
        if idle_ms is not None:
            last = int(rows["_event_ms"].max())
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        if every_state:
            out += fold.finish(json.loads(json.dumps(now)))
        yield pd.DataFrame.from_records([(k[0], *r) for r in out], columns=names)

    timed = stream if idle_ms is None else stream.withColumn("_event_ms", F.unix_millis(_event_time(stream)))
    needed = dict.fromkeys([key, *order, *fold.columns] + (["_event_ms", _event_time_name(stream)] if idle_ms is not None else []))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    grouped = timed.select(*needed).groupBy(key)
    return grouped.applyInPandasWithState(run, fold.result_schema(stream, key), "state string", "update" if every_state else "append", timeout)


def _event_time_name(stream: DataFrame) -> str:
    """The column that carries the stream's watermark."""
    found = [f.name for f in stream.schema if "spark.watermarkDelayMs" in f.metadata]
    if not found:
        raise ValueError("idle_ms needs a stream with a watermark")
    return found[0]


def _event_time(stream: DataFrame) -> Column:
    return F.col(_event_time_name(stream))


def rates(stream: DataFrame, time: str, key: str, bucket: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts of each key and window; rows later than the watermark are dropped, which batch reads of the same rows don't do."""
    return stream.withWatermark(time, late).groupBy(F.window(time, bucket), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Idle sessions without an ending event, by Spark's own session windows."""
    s = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("events"))
    return s.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("until"), "events")


def once(stream: DataFrame, time: str, id_: str = "id", within: str = "10 minutes") -> DataFrame:
    """The first event of each id within the time."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([id_])


def with_thresholds(stream: DataFrame, thresholds: DataFrame, key: str, defaults: dict[str, float]) -> DataFrame:
    """Stream-static lookup with defaults for keys that have no thresholds."""
    j = stream.join(thresholds, key, "left")
    return j.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()})


def interesting(deviation: Column, errors: Column, dense: Column, peer: Column) -> Column:
    """Whether a closed window is passed on: a known deviation of 1 or more or with errors, or a dense or elevated neighbourhood."""
    own = deviation.isNotNull() & ((F.abs(deviation) >= 1) | (errors > 0))
    return own | dense | peer
