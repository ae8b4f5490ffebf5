"""Short texts and marks for people: durations, amounts, bands, verdicts, summaries of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an issue's rung asks for.
RUNG_TARGETS = {"eliminate": "env", "automate": "rule", "inform": "doc"}


def duration(seconds: Column) -> Column:
    """42s, 8m24s or 1h03m; "-" for null."""
    s = F.greatest(F.round(seconds).cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s"))
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), two(F.floor(s % 3600 / 60)), F.lit("m"))
    return F.when(seconds.isNull(), "-").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def band(deviation: Column, watch: float = 0.25, critical: float = 0.50) -> Column:
    return F.when(deviation >= critical, "critical").when(deviation >= watch, "watch").otherwise("normal")


def verdict(status: Column, delta: Column) -> Column:
    """pending, running, complete, improved, regressed or flat, of the latest iteration."""
    return F.when(status.isNull(), "pending").when(status == "start", "running").when(delta.isNull(), "complete").when(delta > 1e-9, "improved").when(delta < -1e-9, "regressed").otherwise("flat")


def first_informative(fields: dict[str, Column], most: int = 3, width: int = 30) -> Column:
    """name=value of the first fields that are filled, each value cut at ``width``."""
    said = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.substring(v.cast("string"), 1, width))) for k, v in fields.items()]
    return F.array_join(F.slice(F.array_compact(F.array(*said)), 1, most), " ")


def violation(detail: Column) -> tuple[Column, Column]:
    """(field, value) of a schema violation's text; nulls for other texts."""
    value = F.nullif(F.regexp_extract(detail, r"^'([^']+)' is not one of \[\s*.+?\s*\]", 1), F.lit(""))
    missing = F.nullif(F.regexp_extract(detail, r"missing required property '([^']+)'", 1), F.lit(""))
    return F.coalesce(value, F.concat(F.lit("(required: "), missing, F.lit(")"))), value


def json_array(text: Column) -> Column:
    """The first JSON array in a text, fenced or not; null without one that parses."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.from_json(F.nullif(found, F.lit("")), "array<string>")


def rung_target(rung: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RUNG_TARGETS.items() for x in kv]), rung), F.lit("doc"))


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Dollars of a call by its rates for a million tokens."""
    return tokens_in / 1_000_000 * rate_in + tokens_out / 1_000_000 * rate_out


def run_line(outcome: Column, kind: Column, events: Column, closed: Column, loops: Column, fail_rate: Column, commit: Column, tools: Column) -> Column:
    """A run on one line; ``tools`` is an array of struct(name, n), most used first. What a run lacks is left out."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    has = lambda name, c, when: F.when(when, F.concat(F.lit(f"{name}="), c.cast("string")))
    top = F.array_join(F.transform(F.slice(tools, 1, 4), lambda t: F.concat(t["name"], F.lit(":"), t["n"].cast("string"))), ",")
    parts = [F.concat(F.lit("outcome="), said(outcome)), F.concat(F.lit("agent_kind="), said(kind)), F.concat(F.lit("events="), said(events)), F.concat(F.lit("close_reason="), said(closed))]
    parts += [has("thrash_loops", loops, loops > 0), has("bash_fail_rate", F.format_string("%.2f", fail_rate), fail_rate.isNotNull()), F.when(commit, "has_commit=yes"), has("top_tools", top, F.size(tools) > 0)]
    return F.concat(F.lit("  "), F.array_join(F.array_compact(F.array(*parts)), "  "))
