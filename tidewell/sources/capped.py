"""A capped log as a stream source: groups read it each at their own speed, and what was cut away is counted.

The log is a folder of segments ``<sequence>.jsonl``; a segment is named by the sequence number of its
first line and only grows until the next begins. Whoever writes it may remove the oldest segments at
any time (the cap). A position is the sequence number to read next, so that a removed range is known:
a reader that finds the log beginning after its position gets one row ``lost`` with the number of
entries it will never see, and goes on with what is left.

A query's checkpoint is its position. Beside it a named ``group`` keeps its position in the folder
``cursors`` (written aside and moved into place), from which a new query of that group goes on. A batch
is acknowledged there when Spark commits it, which is when the next one begins, so a new query of the group reads the
last batch again: at least once. The folder must be one that driver and executors share and open by path.

    spark.dataSource.register(CappedLog)
    spark.readStream.format("capped_log").option("path", folder).option("group", "audit").option("perBatch", 1000).load()

Options: ``path``; ``group`` (none: no cursor); ``start`` where there is no cursor, ``earliest`` (default)
or ``latest``; ``perBatch`` entries at most, with a group only (none: all there are). A last line without its line end is not
there yet. An empty or missing folder is an empty log at 1.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "sequence long, record string, value string, lost long"
#: Entries of one task's share of a segment.
SHARE = 100_000


def segments(folder: str) -> list[tuple[int, str]]:
    """(first sequence, path) of the segments there are, in order."""
    try:
        names = os.listdir(folder)
    except FileNotFoundError:
        return []
    return sorted((int(n[:-6]), os.path.join(folder, n)) for n in names if n.endswith(".jsonl") and n[:-6].isdigit())


def _lines(path: str) -> int:
    """Whole lines of a file; 0 where it has gone meanwhile."""
    n = 0
    try:
        with open(path, "rb") as f:
            while chunk := f.read(1 << 20):
                n += chunk.count(b"\n")
    except FileNotFoundError:
        return 0
    return n


def bounds(folder: str) -> tuple[int, int]:
    """(first sequence there is, sequence behind the last)."""
    found = segments(folder)
    return (found[0][0], found[-1][0] + _lines(found[-1][1])) if found else (1, 1)


def _entries(path: str, first: int, start: int, end: int) -> Iterator[tuple]:
    """The entries from start to before end that a segment holds; a segment that has gone meanwhile counts as lost."""
    try:
        f = open(path, "rb")  # noqa: SIM115
    except FileNotFoundError:
        yield start, "lost", None, end - start
        return
    with f:
        for sequence, line in enumerate(f, first):
            if sequence >= end:
                return
            if sequence >= start:
                yield sequence, "entry", line.decode("utf-8", "replace").rstrip("\r\n"), None


@dataclass
class Share(InputPartition):
    path: str
    first: int
    start: int
    end: int


@dataclass
class Gap(InputPartition):
    start: int
    end: int


def shares(folder: str, start: int, end: int, share: int = SHARE) -> list[InputPartition]:
    """What tasks read of the range: pieces of segments, and gaps where none holds it."""
    out: list[InputPartition] = []
    found, at = segments(folder), start
    for i, (first, path) in enumerate(found):
        behind = found[i + 1][0] if i + 1 < len(found) else end
        lo, hi = max(at, first), min(end, behind)
        if lo >= hi:
            continue
        if lo > at:
            out.append(Gap(at, lo))
        out += [Share(path, first, a, min(hi, a + share)) for a in range(lo, hi, share)]
        at = hi
    return [*out, Gap(at, end)] if at < end else out


def read_share(part: InputPartition) -> Iterator[tuple]:
    if isinstance(part, Gap):
        yield part.start, "lost", None, part.end - part.start
    else:
        yield from _entries(part.path, part.first, part.start, part.end)


class Cursor:
    """A position of a group in a file of its own."""

    def __init__(self, folder: str, group: str | None, kind: str = "json"):
        self.path = group and os.path.join(folder, "cursors", f"{group}.{kind}")

    def read(self) -> int | None:
        if not self.path or not os.path.exists(self.path):
            return None
        with open(self.path) as f:
            return int(json.load(f)["next"])

    def write(self, at: int) -> None:
        if not self.path or (self.read() or 0) >= at:
            return
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        aside = f"{self.path}.{os.getpid()}.tmp"
        with open(aside, "w") as f:
            json.dump({"next": at}, f)
        os.replace(aside, self.path)


class CappedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.most = int(options["perbatch"]) if "perbatch" in options else None
        self.from_end = options.get("start", "earliest") == "latest"
        self.cursor = Cursor(self.folder, options.get("group"))
        self.planned = Cursor(self.folder, options.get("group"), "planned")  # ends of batches that were begun: never asked for less
        self.at: int | None = None
        if self.most is not None and not self.cursor.path:
            raise ValueError("perBatch needs a group, whose position outlives a restart")

    def initialOffset(self) -> dict:
        first, end = bounds(self.folder)
        at = self.cursor.read()
        self.at = at if at is not None else end if self.from_end else first
        return {"next": self.at}

    def latestOffset(self) -> dict:
        first, end = bounds(self.folder)
        if self.at is None:  # after a restart
            self.at = self.planned.read() or self.cursor.read() or first
        target = max(end, self.at)
        if self.most is not None:
            target = min(target, max(self.at, first if self.at < first else self.at) + self.most)
        self.at = target
        return {"next": target}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["next"])
        self.planned.write(end["next"])
        return shares(self.folder, start["next"], end["next"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_share(partition)

    def commit(self, end: dict) -> None:
        self.cursor.write(end["next"])


class CappedBatch(DataSourceReader):
    """A bounded read of what there is, from ``from`` on; the same rows a stream gives."""

    def __init__(self, options: dict):
        self.folder, self.start = options["path"], options.get("from")

    def partitions(self) -> list[InputPartition]:
        first, end = bounds(self.folder)
        return shares(self.folder, int(self.start) if self.start is not None else first, end) or [Gap(end, end)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(()) if isinstance(partition, Gap) and partition.start == partition.end else read_share(partition)


class CappedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capped_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CappedBatch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CappedStream({k.lower(): v for k, v in self.options.items()})
