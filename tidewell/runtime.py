"""Session-level helpers: table loading and written intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewell-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset and the master is local, a temporary one.

    On a cluster a machine-local folder would lose rows without an error, so there is none."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a reader of it.

    This cuts the lineage: what follows restarts from these files if executors are lost, and reads
    them column by column. The folder's owner removes them with the application's other files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean_stage(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for large shuffles: those of this write leave the disk as soon as it is done, not when
    the driver happens to collect its garbage, so steps don't add up."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return stage(df, name)
    finally:
        conf.set(key, before)


def literal_table(spark: SparkSession, rows_json: str, schema: str) -> DataFrame:
    """A small table of known bound from JSON text, as a plain projection."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows_json), f"array<struct<{schema}>>")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, although ``body`` may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)
