"""Packing token sequences by minimum bin slack.

Documents are tokenized and closed by an end token; those longer than a sequence are cut into
whole sequences and a rest. What remains is a count of pieces per length: at most ``size`` numbers,
whatever the corpus, and all that reaches the driver. There, bin by bin, the longest length left is
placed first and a subset-sum search over bit sets finds the fullest combination of the lengths
available, which is removed as often as the counts allow. The result is a list of patterns
("lengths 1000, 700, 348, 40 times"); pieces find their place from their rank among the pieces of
their length, so no group of equal lengths is ever held together.

Defined cases: null or empty texts are the end token alone; repeated rows are packed as often as
they occur; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.batches import by_size
from tidewell.llm.tokens import WordTokens
from tidewell.runtime import literal_table, stage, table

SIZE = 2048
#: Pieces of one length that are ranked together, about; more where that would make over PARTS parts in all.
PART, PARTS = 1_000, 65_536


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, at most as often as counted, whose sum is as near to ``room`` from below as can be."""
    items = []  # counts by powers of two, so that every multiple up to the count can be made
    for length in sorted(counts, reverse=True):
        n, k = min(counts[length], room // length), 1
        while n > 0:
            items.append((length, min(k, n)))
            n -= k
            k *= 2
    mask, reach = (1 << (room + 1)) - 1, [1]
    for length, k in items:
        reach.append(reach[-1] | (reach[-1] << (length * k)) & mask)
        if reach[-1] >> room & 1:
            break
    at, out = reach[-1].bit_length() - 1, []
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> at & 1:
            length, k = items[i - 1]
            out += [length] * k
            at -= length * k
    return out


def patterns(counts: dict[int, int], size: int = SIZE) -> Iterator[tuple[list[int], int]]:
    """(lengths, times) until no piece is left."""
    left = {x: n for x, n in counts.items() if n > 0}
    while left:
        first = max(left)
        left[first] -= 1
        rest = fullest({x: n for x, n in left.items() if n and x <= size - first}, size - first)
        left[first] += 1
        pattern = sorted([first, *rest], reverse=True)
        need = {x: pattern.count(x) for x in set(pattern)}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        yield pattern, times


def ranges(counts: dict[int, int], size: int = SIZE) -> list[dict]:
    """For every length the ranges of ranks with their pattern: rank r goes to sequence seq0 + (r - r0) // per."""
    used, seq, out = dict.fromkeys(counts, 0), 0, []
    for pattern, times in patterns(counts, size):
        at = 0
        for x in sorted(set(pattern), reverse=True):
            per = pattern.count(x)
            out.append({"length": x, "r0": used[x], "r1": used[x] + per * times, "per": per, "seq0": seq, "at": at})
            used[x] += per * times
            at += per * x
        seq += times
    return out


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, closed by ``end_id``."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary)
        for batch in by_size(batches, 1):
            ids, rows = batch.column(0), ([], [], [], [], [])
            for i, data in enumerate(tokens.encode(batch.column(1).to_pylist())):
                data += end
                for p in range(-(-len(data) // (4 * size))):
                    part = data[4 * size * p : 4 * size * (p + 1)]
                    for col, v in zip(rows, (i, p, p * size, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.record_batch([ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def by_cells(found: list[dict], counts: dict[int, int]) -> tuple[list[dict], dict[int, int]]:
    """The ranges of each length cut at the borders of cells of equal width, as many as it has ranges, so
    that a rank finds its range by equality on (length, cell); and the width for each length."""
    many = Counter(r["length"] for r in found)
    width = {x: -(-n // many[x]) for x, n in counts.items()}
    return [r | {"cell": c} for r in found for c in range(r["r0"] // width[r["length"]], (r["r1"] - 1) // width[r["length"]] + 1)], width


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    cut = stage(pieces(docs, vocabulary, size), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``size`` rows at most
    # patterns: each uses a length up, or leaves less of it than it takes; a bound set by ``size``
    plan, width = by_cells(ranges(counts, size), counts)
    plan = literal_table(docs.sparkSession, json.dumps(plan), "length long, cell long, r0 long, r1 long, per long, seq0 long, at long")
    part = max(PART, -(-sum(counts.values()) // PARTS))
    lengths = [{"length": x, "parts": -(-n // part), "width": width[x]} for x, n in counts.items()]
    lengths = literal_table(docs.sparkSession, json.dumps(lengths), "length long, parts long, width long")
    d = cut.join(F.broadcast(lengths), "length").withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")))
    before = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("length", "sub").agg(F.count("*").alias("n"))
    starts = starts.select("length", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "sub").orderBy("doc_id", "piece", "ids_crc32")
    d = d.withColumn("rn", F.row_number().over(within) - 1)
    d = d.join(F.broadcast(starts), ["length", "sub"])  # size + PARTS rows at most
    d = d.withColumn("rank", F.col("first") + F.col("rn")).withColumn("cell", F.floor(F.col("rank") / F.col("width")))
    d = d.join(F.broadcast(plan), ["length", "cell"]).filter((F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    k = F.col("rank") - F.col("r0")
    return d.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq0") + F.floor(k / F.col("per"))).alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("length")).alias("offset"),
    )


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.tokens import vocabulary_path

    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
