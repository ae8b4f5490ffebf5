"""Scans of a key's rows that jump, without a task that holds a key.

At a row such a scan may find something (a window that begins there, a pattern) and goes on at some later
row, at most ``ahead`` rows on. So where it goes on depends on a bounded number of rows, and all jumps
of a stretch can be made at once. A key's rows are cut into segments; a segment sees the ``ahead`` rows
behind it too. The scan enters a segment at one of its first ``ahead`` + 1 rows: for each of them a task says
where the scan leaves and how much it finds on the way. These transfer functions are short tables;
put one after another they give the row at which each segment is entered in truth, and a last pass
over the segments yields what is found. Keys of one segment need no tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.runtime import stage

#: Rows of a segment, and ranges that the order of all rows is cut into.
SEGMENT, RANGES = 1 << 18, 64

#: (a key's columns from some row on, with the rows ahead; own rows) -> (row to go on at, whether something is found) for each own row.
Jump = Callable[[dict[str, np.ndarray], int], tuple[np.ndarray, np.ndarray]]


def numbered(df: DataFrame, key: str, order: list[str], columns: list[str], ranges: int = RANGES) -> DataFrame:
    """(key, *columns, _i): ``_i`` is a row's place among its key's, from 0. Ranges of the whole order are counted apart, so no task holds a key."""
    d = df.select(key, *order, *[c for c in columns if c not in order])
    names = list(d.columns)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = object(), 0
        for b in batches:
            if len(b):
                place = b.groupby(key, sort=False, dropna=False).cumcount()
                same = b[key].isna() if pd.isna(b[key].iloc[0]) else b[key] == b[key].iloc[0]
                if b[key].iloc[0] == last or pd.isna(b[key].iloc[0]) and pd.isna(last):
                    place = place + np.where(same, n, 0)
                last, n = b[key].iloc[-1], int(place.iloc[-1]) + 1
                yield b.assign(_local=place)

    schema = ", ".join(f"`{n}` {t}" for n, t in d.dtypes) + ", _range int, _local long"
    cut = d.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order).withColumn("_range", F.spark_partition_id())
    rows = stage(cut.mapInPandas(count, schema), "ranges")
    per = rows.groupBy(key, "_range").agg(F.count("*").alias("n"))
    wide = per.groupBy(key).agg(F.count("*").alias("parts")).filter("parts > 1").select(F.col(key).alias("_k"))  # fewer than ranges
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.join(F.broadcast(wide), F.col(key).eqNullSafe(F.col("_k"))).drop("_k").withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), "_before")
    out = rows.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")), "left")
    return out.select(*names, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("_i"))


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The groups of a sorted stream, one at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        for c in by:
            v = b[c]
            change[1:] |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()[1:]
        cuts = [0, *np.flatnonzero(change).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = b.iloc[lo:hi]
            head = lambda p: tuple(None if pd.isna(p[c].iloc[0]) else p[c].iloc[0] for c in by)
            if held and (lo > 0 or head(held[0]) != head(part)):
                yield head(held[0]), pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield tuple(None if pd.isna(held[0][c].iloc[0]) else held[0][c].iloc[0] for c in by), pd.concat(held)


def _walk(go: np.ndarray, hit: np.ndarray, at: int) -> Iterator[int]:
    """The rows at which a scan that begins at ``at`` finds something; ends behind the own rows."""
    n = len(go)
    while at < n:
        if hit[at]:
            yield at
        at = int(go[at])


def _table(go: np.ndarray, hit: np.ndarray, ahead: int) -> tuple[list[int], list[int]]:
    """For every entry row from 0 to ``ahead``: the row behind the segment at which the scan leaves, and how often it finds something."""
    n = len(go)
    out, found = np.arange(n + ahead + 1), np.zeros(n + ahead + 1, np.int64)
    for i in range(n - 1, -1, -1):
        out[i], found[i] = out[go[i]], found[go[i]] + hit[i]
    return (out[: ahead + 1] - n).tolist(), found[: ahead + 1].tolist()


def jump_scan(df: DataFrame, key: str, order: list[str], columns: list[str], ahead: int, jump: Jump, emit: Callable[[dict[str, np.ndarray], int, int, int], tuple], schema: str, segment: int = SEGMENT, ranges: int = RANGES) -> DataFrame:
    """(key, nth, *schema) of all that the scan finds; ``nth`` counts from 1 in a key.

    ``emit(columns, row, next row, first place)`` makes a result's columns; its rows count within the segment,
    whose first row is at that place of the key."""
    if segment < ahead:
        raise ValueError("a segment must be longer than what a row looks ahead")
    rows = stage(numbered(df, key, order, columns, ranges), "numbered")
    of = (F.col("_i") / segment).cast("long")
    near = F.when((F.col("_i") % segment < ahead) & (of > 0), F.array(of, of - 1)).otherwise(F.array(of))
    cut = rows.withColumn("_seg", F.explode(near))
    names, kind = list(dict.fromkeys(columns)), dict(df.dtypes)[key]

    def own(group: tuple, g: pd.DataFrame) -> tuple[dict[str, np.ndarray], int, np.ndarray, np.ndarray]:
        first = int(group[1]) * segment
        n = int((g["_i"] < first + segment).sum())
        values = {c: g[c].to_numpy() for c in names}
        go, hit = jump(values, n)
        return values, n, go, hit

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, g in _groups(batches, [key, "_seg"]):
            _, n, go, hit = own(group, g)
            if n:
                leave, found = _table(go, hit, ahead)
                yield pd.DataFrame({key: [group[0]], "_seg": [group[1]], "leave": [leave], "found": [found]}).astype(object)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entry, found = object(), 0, 0
        for b in batches:
            rows_ = []
            for k, seg, leave, some in b[[key, "_seg", "leave", "found"]].itertuples(index=False, name=None):
                if seg == 0 or k != now:
                    now, entry, found = k, 0, 0
                rows_.append((k, seg, entry, found))
                found += int(some[entry])
                entry = int(leave[entry])
            yield pd.DataFrame(rows_, columns=[key, "_seg", "entry", "before"]).astype(object)

    long = rows.groupBy(key).agg(F.max("_i").alias("most")).filter(F.col("most") >= segment).select(F.col(key).alias("_k"))
    some = cut.join(long, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    arranged = lambda d: d.repartition(key, "_seg").sortWithinPartitions(key, "_seg", "_i")
    functions = arranged(some).mapInPandas(tables, f"`{key}` {kind}, _seg long, leave array<long>, found array<long>")
    entries = functions.repartition(key).sortWithinPartitions(key, "_seg").mapInPandas(chain, f"`{key}` {kind}, _seg long, entry long, before long")
    entries = stage(entries, "entries").select(F.col(key).alias("_k"), F.col("_seg").alias("_s"), "entry", "before")
    cut = cut.join(entries, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_seg") == F.col("_s")), "left").drop("_k", "_s")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        titles = [key, "nth", *_names(schema)]
        out: list[tuple] = []
        for group, g in _groups(batches, [key, "_seg"]):
            values, n, go, hit = own(group, g)
            entry, before = (0 if pd.isna(v) else int(v) for v in (g["entry"].iloc[0], g["before"].iloc[0]))
            for nth, i in enumerate(_walk(go[:n], hit, entry), before + 1):
                out.append((group[0], nth, *emit(values, i, int(go[i]), int(group[1]) * segment)))
            if len(out) > 10_000:
                yield pd.DataFrame.from_records(out, columns=titles).astype(object)
                out = []
        yield pd.DataFrame.from_records(out, columns=titles).astype(object)

    return arranged(cut).mapInPandas(scan, f"`{key}` {kind}, nth long, {schema}")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def count_or_time(df: DataFrame, key: str, time: str, order: list[str], most: int, span: int, **sizes) -> DataFrame:
    """(key, window, opened, last, events): windows that close at ``most`` events or before the first event ``span`` or more after their
    first, which opens the next; as the fold of that name, but a key is spread over tasks."""

    def jump(values: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        t = values[time].astype(np.int64)
        late = np.searchsorted(t, t[:n] + span, "left") if span > 0 else np.arange(1, n + 1)
        return np.minimum(np.minimum(np.arange(n) + most, late), len(t)), np.ones(n, bool)

    def emit(values: dict[str, np.ndarray], i: int, after: int, first: int) -> tuple:
        return int(values[time][i]), int(values[time][after - 1]), after - i

    found = jump_scan(df, key, order, [time], most, jump, emit, "opened long, last long, events long", **sizes)
    return found.withColumnRenamed("nth", "window")


def thrash_cycles(df: DataFrame, key: str, kind: str, order: list[str], to_build: int = 10, to_fail: int = 20, to_revert: int = 20, **sizes) -> DataFrame:
    """(key, cycle, edit, build, fail, revert): places from 1 of complete cycles one after another, as the fold of that name.

    A state of the pattern is a place to go on from: an edit whose cycle completes jumps behind its revert, any other row to the next."""

    def jump(values: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        what, size = values[kind], len(values[kind])
        steps = _steps(what, n, (to_build, to_fail, to_revert))
        hit = (what[:n] == "edit") & (steps[2] >= 0)
        return np.where(hit, steps[2] + 1, np.minimum(np.arange(n) + 1, size)), hit

    def emit(values: dict[str, np.ndarray], i: int, after: int, first: int) -> tuple:
        place, out = i, [first + i + 1]
        for name, reach in (("build", to_build), ("fail", to_fail), ("revert", to_revert)):
            place = place + 1 + int(np.flatnonzero(values[kind][place + 1 : place + 1 + reach] == name)[0])
            out.append(first + place + 1)
        return tuple(out)

    found = jump_scan(df, key, order, [kind], to_build + to_fail + to_revert + 1, jump, emit, "edit long, build long, fail long, revert long", **sizes)
    return found.withColumnRenamed("nth", "cycle")


def _steps(what: np.ndarray, n: int, reach: tuple[int, int, int]) -> list[np.ndarray]:
    """For every own row the places of the build, fail and revert that follow it in reach, one behind the other; -1 where one is missing."""
    at, out = np.arange(n), []
    for name, most in zip(("build", "fail", "revert"), reach, strict=True):
        places = np.append(np.flatnonzero(what == name), 4 * len(what) + 4 * most)  # the last stands for none
        found = places[np.searchsorted(places[:-1], at, "right")]
        at = np.where((at >= 0) & (found - at <= most), found, -1)
        out.append(at)
    return out
