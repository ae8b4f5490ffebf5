"""Channel schemas: JSON Schema files as Spark types and as checks said with columns."""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.runtime import let
from tidewell.sources import schema_checks

_SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def spark_type(schema: dict) -> T.DataType:
    """The Spark type of a JSON Schema. Open objects of one kind of value are maps; unions of several kinds are raw JSON text."""
    kind = schema.get("type")
    kinds = [k for k in (kind if isinstance(kind, list) else [kind]) if k not in (None, "null")]
    if len(kinds) != 1:
        return T.StringType()
    if kinds[0] == "array":
        return T.ArrayType(spark_type(schema.get("items") or {}))
    if kinds[0] == "object":
        if props := schema.get("properties"):
            return T.StructType([T.StructField(k, spark_type(v), metadata={"comment": v.get("description", "")}) for k, v in props.items()])
        more = schema.get("additionalProperties")
        return T.MapType(T.StringType(), spark_type(more) if isinstance(more, dict) else T.StringType())
    return _SIMPLE.get(kinds[0], T.StringType())


@dataclass
class SchemaRegistry:
    """Schemas by channel name, from folders of which later ones win; channels without a schema pass."""

    schemas: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, *folders: str) -> SchemaRegistry:
        """Reads ``<channel>.json`` files through Spark, whatever the store. Schemas are few and small: one per channel."""
        found: dict[str, dict] = {}
        for folder in folders:
            for r in spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect():
                found[re.sub(r"\.json$", "", r.name)] = json.loads(r.value)
        return cls(found)

    def whole_envelope(self, channel: str) -> bool:
        """True where the schema describes the envelope and not only its data."""
        return "specversion" in (self.schemas[channel].get("required") or [])

    def struct(self, channel: str) -> T.StructType:
        return spark_type(self.schemas[channel])

    def typed(self, envelopes: DataFrame, channel: str) -> DataFrame:
        """The events of one channel with their data as columns."""
        subject = "raw" if self.whole_envelope(channel) else "data"
        d = envelopes.filter(F.col("type") == channel).withColumn("_d", F.from_json(subject, self.struct(channel)))
        return d.select("id", "source", "ts", F.col("_d.data.*" if self.whole_envelope(channel) else "_d.*"))

    def violation(self) -> Column:
        """The first rule that an envelope breaks, or null; null too for channels without a schema, or with one that can't be compiled.

        An envelope is parsed once, by its own channel's branch; missing data count as an empty object."""

        def first(channel: str) -> Column:
            subject = F.col("raw") if self.whole_envelope(channel) else F.coalesce("data", F.lit("{}"))
            try:
                return let(F.try_parse_json(subject), lambda v: schema_checks.violation(self.schemas[channel], v))
            except schema_checks.UnknownRule:
                return F.lit(None).cast("string")

        return functools.reduce(lambda w, c: w.when(F.col("type") == c, first(c)), sorted(self.schemas), F.when(F.lit(False), F.lit(None).cast("string")))

    def outcome(self) -> Column:
        """(outcome, detail) of an envelope's ``raw`` text: one of ``schema_checks.OUTCOMES``."""
        return schema_checks.outcome(self.schemas, F.col("type"), F.col("raw"), lambda s: "specversion" in (s.get("required") or []))

    def known(self) -> Column:
        return F.col("type").isin(*sorted(self.schemas)) if self.schemas else F.lit(False)

    def validated(self, envelopes: DataFrame) -> DataFrame:
        """``envelopes`` with ``failure_reason`` and ``detail`` where they fail, and ``unknown_channel``."""
        v = F.when(F.col("failure_reason").isNull(), self.violation())
        return envelopes.withColumn("detail", v).withColumns({"failure_reason": F.coalesce("failure_reason", F.when(F.col("detail").isNotNull(), "schema_violation")), "unknown_channel": ~F.coalesce(self.known(), F.lit(False))})


def unknown_tally(validated: DataFrame) -> DataFrame:
    return validated.filter("unknown_channel").groupBy("type").agg(F.count("*").alias("n"))
