"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2**32 positions; a key belongs to the next point
clockwise. A shard takes at most its capacity; what overflows an arc goes on clockwise to the next
shard with room. Rows are never collected: only the counts per arc (shards x vnodes of them, a
bound set by the parameters) reach the driver, which turns them into ranges "rows r0 to r1 of arc
a go to shard s from slot t on"; a row finds its range by its rank in its arc.

With ``load_factor`` 1.0 capacities are as tight as can be, so the counts of any two shards differ
by one at most. Larger factors move fewer rows when shards are added.

Defined cases: a null key hashes like a value of its own; null or empty texts have size 1; equal
rows are told apart by rank, so repeated rows spread like others; an empty table gives no rows;
columns of the input other than key and text are not read, so their names can't clash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.text import utf8_bytes
from tidewell.runtime import literal_table, stage, table

RING = 1 << 32
CELLS = 4096


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in clockwise order."""
    points = spark.range(shards * vnodes).select(
        F.pmod(F.xxhash64(F.lit("node"), F.floor(F.col("id") / vnodes), F.col("id") % vnodes), F.lit(RING)).alias("at"),
        F.floor(F.col("id") / vnodes).cast("int").alias("shard"),
    )
    return sorted((r.at, r.shard) for r in points.collect())


def ring_cells(points: list[tuple[int, int]]) -> list[dict]:
    """Each arc cut at the borders of CELLS equal cells, so that a key finds its arc by equality on the cell."""
    width, out, lo = RING // CELLS, [], 0
    for arc, at in [(i, p[0]) for i, p in enumerate(points)] + [(0, RING - 1)]:  # beyond the last point: the first arc
        for cell in range(lo // width, at // width + 1):
            a, b = max(lo, cell * width), min(at, cell * width + width - 1)
            if a <= b:
                out.append({"cell": cell, "a": a, "b": b, "arc": arc})
        lo = at + 1
    return out


def capacities(total: int, shards: int, load_factor: float) -> list[int]:
    if load_factor <= 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil(load_factor * total / shards)] * shards


def place(points: list[tuple[int, int]], counts: dict[int, int], shards: int, load_factor: float) -> list[dict]:
    """Ranges of each arc's rows with their shard and first slot. Own rows first, then the overflow clockwise."""
    room, used, out, left = capacities(sum(counts.values()), shards, load_factor), [0] * shards, [], []

    def take(arc: int, first: int, n: int, shard: int) -> int:
        if k := min(n, room[shard]):
            out.append({"arc": arc, "r0": first, "r1": first + k, "shard": shard, "slot0": used[shard]})
            room[shard] -= k
            used[shard] += k
        return k

    for arc, (_, shard) in enumerate(points):
        if n := counts.get(arc, 0):
            k = take(arc, 0, n, shard)
            if k < n:
                left.append((arc, k, n - k))
    for arc, first, n in left:
        step = arc
        while n:
            step = (step + 1) % len(points)
            k = take(arc, first, n, points[step][1])
            first, n = first + k, n - k
    return out


def shard_rows(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text", vnodes: int = 64, load_factor: float = 1.25, fine: int = 64) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row. ``fine``: sub-buckets of an arc in which ranks are counted."""
    spark = docs.sparkSession
    pos = F.pmod(F.xxhash64(F.lit("key"), F.col(key)), F.lit(RING))
    slim = docs.select(
        F.col(key).alias("key"),
        (utf8_bytes(F.col(text)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        pos.alias("pos"),
    )
    points = ring_points(spark, shards, vnodes)
    cells = literal_table(spark, json.dumps(ring_cells(points)), "cell int, a long, b long, arc int")
    slim = slim.withColumn("cell", F.floor(F.col("pos") / (RING // CELLS)).cast("int"))
    # at most CELLS + shards x vnodes rows: a bound set by the parameters
    slim = slim.join(F.broadcast(cells), "cell").filter(F.col("pos").between(F.col("a"), F.col("b")))
    # the second hash also takes what tells repeated keys apart, so that one key's rows spread
    slim = slim.withColumn("sub", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(fine)).cast("int"))
    slim = stage(slim.select("key", "size", "text_crc32", "pos", "arc", "sub"), "ring")

    subs = stage(slim.groupBy("arc", "sub").agg(F.count("*").alias("n")), "subs")
    counts = {r.arc: r.n for r in subs.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    ranges = place(points, counts, shards, load_factor)
    ranges = literal_table(spark, json.dumps(ranges), "arc int, r0 long, r1 long, shard int, slot0 long")
    before = Window.partitionBy("arc").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = subs.select("arc", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    within = Window.partitionBy("arc", "sub").orderBy("pos", "key", "text_crc32", "size")
    ranked = slim.withColumn("rn", F.row_number().over(within) - 1).join(F.broadcast(starts), ["arc", "sub"])  # arcs x fine rows at most
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rn"))
    # an arc's rows go to few shards: at most arcs + shards + vnodes ranges in all
    placed = ranked.join(F.broadcast(ranges), "arc").filter((F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("r0")).alias("slot"))


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), 16, load_factor=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
