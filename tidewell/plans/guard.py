"""Read-only SQL over registered views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def check_select(sql: str) -> str:
    """The statement without comments and final semicolon; an error unless it is a single SELECT."""
    text = re.sub(r"--[^\n]*", "", sql).strip().rstrip(";").strip()
    if ";" in text:
        raise ValueError("one statement only")
    if not re.match(r"(?i)select\b", text):
        raise ValueError("only SELECT is allowed")
    return text


def query_sql(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(check_select(sql))


def catalogue(views: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(view, column, type, comment) of every view."""
    return [(v, f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for v, df in views.items() for f in df.schema.fields]
