"""Channel names: globs, prefixes, families, versions and projects."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_filter(channel: Column, prefixes: list[str]) -> Column:
    """True where the name begins with any prefix; no prefix matches nothing."""
    return functools.reduce(operator.or_, [channel.startswith(p) for p in prefixes], F.lit(False))


def topic_glob(pattern: str, prefix_match: bool = False) -> str:
    """A routing pattern as a regular expression: ``*`` is one segment, ``#`` any suffix.

    ``prefix_match``: a pattern without ``#`` also matches longer names that continue it."""
    out, parts = "", pattern.split(".")
    for i, part in enumerate(parts):
        dot = r"\." if i else ""
        if part == "#":
            return f"^{out}({dot}.*)?$" if i else "^.*$"
        out += dot + ("[^.]+" if part == "*" else re.escape(part))
    return f"^{out}(\\..*)?$" if prefix_match else f"^{out}$"


def matches_topic(channel: Column, pattern: str, prefix_match: bool = False) -> Column:
    return channel.rlike(topic_glob(pattern, prefix_match))


def shell_glob(pattern: str) -> str:
    """A shell pattern as a regular expression; an empty one matches all."""
    if not pattern:
        return "^.*$"
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def family(channel: Column, prefixes: list[str]) -> Column:
    """The first prefix that the name begins with, else the name itself."""
    out = functools.reduce(lambda w, p: w.when(channel.startswith(p), p), prefixes, F)
    return out.otherwise(channel)


def cluster(channel: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The cluster of the first rule (regular expression, cluster) that the name satisfies."""
    out = functools.reduce(lambda w, r: w.when(channel.rlike(r[0]), r[1]), rules, F)
    return out.otherwise(F.lit(default))


def without_version(channel: Column) -> Column:
    return F.regexp_replace(channel, r"\.v\d+$", "")


def valid_name(channel: Column) -> Column:
    """project.subsystem.event with an optional version: lower-case segments joined by dots."""
    return channel.rlike(r"^[a-z][a-z0-9_-]*(\.[a-z0-9_-]+)+(\.v\d+)?$")


def project_of_source(source: Column) -> Column:
    """The first segment of a source path, or "unknown"."""
    first = F.split(F.btrim(source, F.lit("/")), "/")[0]
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("unknown"))


def subscription_kind(raw: Column) -> tuple[Column, Column]:
    """(name, "exact" or "prefix") of a subscribed name, a prefix where it ends with a star."""
    star = raw.endswith("*")
    return F.when(star, F.regexp_replace(raw, r"\.?\*$", "")).otherwise(raw), F.when(star, "prefix").otherwise("exact")


#: Events and seconds that close a window, of logs and of other channels.
LOG_TRIGGER, BUS_TRIGGER = (100, 300.0), (50, 900.0)


def triggers(channel: Column, overrides: list[tuple[str, int, float]]) -> Column:
    """struct(count, seconds) that close a channel's window: of the first prefix listed that it begins with, else by its kind."""
    one = lambda x: F.struct(F.lit(x[0]).alias("count"), F.lit(float(x[1])).alias("seconds"))
    out = functools.reduce(lambda w, o: w.when(channel.startswith(o[0]), one(o[1:])), overrides, F)
    return out.when(channel.startswith("log:"), one(LOG_TRIGGER)).otherwise(one(BUS_TRIGGER))


def project_of_pane(pane: Column, known: list[str], other: str) -> Column:
    """The project of a terminal pane (kind:name:number): the name, of a container the known project in it or ``other``; "?" without a pane."""
    name = F.split(pane, ":")
    second = F.try_element_at(name, F.lit(2))
    of_container = functools.reduce(lambda w, p: w.when(F.contains(second, F.lit(p)), p), known, F).otherwise(other) if known else F.lit(other)
    named = second.isNotNull()
    return F.when(F.coalesce(pane, F.lit("")) == "", "?").when(named & (name[0] == "docker"), of_container).when(named & name[0].isin("zellij", "host"), second).otherwise(name[0])


def project_label(project: Column, source: Column) -> Column:
    """An event's project unless empty or "unknown", else the first segment of its source, else "?"."""
    first = F.split(F.ltrim(F.coalesce(source, F.lit("")), F.lit("/")), "/")[0]
    return F.coalesce(F.nullif(F.nullif(project, F.lit("")), F.lit("unknown")), F.nullif(first, F.lit("")), F.lit("?"))


def live(state: Column, agent_type: Column, states: tuple[str, ...]) -> Column:
    return state.isin(*states) & (F.trim(F.coalesce(agent_type, F.lit(""))) != "")


def kernel_kind(type_: Column, domain: Column, kinds: dict[str, str], shared: dict[str, str], reserved: str) -> Column:
    """domain/kind of a kernel's event, by old (<domain>.<event>.v1) and new (kernel.<event>.v1) names; null
    for others and for all of the namespace ``reserved`` but the ``shared`` types, whose domain is not known."""
    body = F.regexp_replace(type_, r"\.v1$", "")
    head, rest = F.regexp_extract(body, r"^([^.]*)", 1), F.regexp_extract(body, r"^[^.]*\.(.*)$", 1)
    kind = functools.reduce(lambda w, k: w.when(rest == k[0], k[1]), kinds.items(), F)
    owner = F.when(head == "kernel", F.coalesce(F.nullif(domain, F.lit("")), F.lit("?"))).when(head != reserved, head)
    known = functools.reduce(lambda w, s: w.when(type_ == s[0], f"?/{s[1]}"), shared.items(), F)
    return known.when(type_.endswith(".v1"), F.concat(owner, F.lit("/"), kind))


def legacy_kernel_type(type_: Column, domain: Column, own: str, events: list[str]) -> Column:
    """The old name of an event of the domain ``own``, whichever name it has; null for other domains."""
    ours = F.coalesce(domain, F.lit(own)) == own
    renamed = functools.reduce(lambda w, e: w.when((type_ == f"kernel.{e}.v1") & ours, f"{own}.{e}.v1"), events, F.when(type_.startswith(f"{own}."), type_))
    return renamed
