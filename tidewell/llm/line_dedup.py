"""Reversible line dedup: sharded cuckoo filters before exact reference counts.

State: ``postings`` (doc_id, key) for every long line of every document; ``filters`` (shard, filter),
one cuckoo filter a shard, a multiset with one fingerprint for each live key that was new to the
filter; ``counts`` (key, n_docs, holder, own), the exact number of documents and the largest doc_id
of every key that was seen again, and whether the key has a fingerprint of its own.

Inserting a batch sums its postings up by key and takes what the exact table knows from there. Every
other key asks its shard's filter. A key that the filter doesn't know, from one document, is a first
sight: its fingerprint is added and it goes no further, so the exact table never hears of lines that
don't repeat. A key that the filter knows is looked up in the earlier postings and moves to the
exact table together with its first sight. A key without earlier postings was known by chance: it
has no fingerprint of its own (``own`` is false) and is found through the exact table from then on,
so that removing the other key's fingerprint never hides it.

Deleting documents takes their postings out, counts the keys concerned again from what is left, and
removes the own fingerprint of each key without documents, so that a deletion restores what inserting
had changed. Documents must be deleted before they are inserted again.

A key is a digest (128 bits) of the line without white space at both ends and with A-Z lowered.
Keys are summed up by document and by task before any shuffle puts a key's rows together, so a line
that a third of all documents hold is one row per task there.

Defined cases: null or empty texts are one empty line; lines below ``min_chars`` are never
dropped; a line repeated in a document counts once for it; rows with the same doc_id are one
document, null is an id of its own and the smallest; an empty table gives no rows; columns other
than doc_id and text are passed on by ``clean`` and ``dedup`` and not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.batches import by_size
from tidewell.llm.cuckoo import SLOTS, CuckooFilter
from tidewell.llm.text import STRIP, free_name
from tidewell.runtime import stage, table

NO_ID = -(1 << 63)
#: Keys of a filter when a state is made: sets the number of shards, so that a shard's work stays small.
SHARD_KEYS = 12_288
#: Buckets of a new filter: three of four slots are in use when a shard has SHARD_KEYS keys.
BUCKETS = SHARD_KEYS * 4 // 3 // SLOTS
#: Turns in which a whole table is inserted, so that the first ones' filters decide for the later ones.
TURNS = 4
#: Keys or ids broadcast up to this many (16 bytes each and what Spark adds), else shuffled.
BROADCAST = 500_000


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """One digest per line; None for lines below ``min_chars``."""
    out = []
    for line in (text or "").split("\n"):
        if len(line) < min_chars or len(line := line.strip(STRIP)) < min_chars:
            out.append(None)
        else:
            out.append(hashlib.blake2b(line.encode().lower(), digest_size=16).digest())  # of bytes: A-Z only
    return out


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


@dataclass(frozen=True)
class LineState:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int


def few(df: DataFrame) -> DataFrame:
    """To be broadcast if its rows are few; ``df`` is written."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key), one row each, written."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            keys = [{k for k in line_keys(t, min_chars) if k} for t in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
            yield pa.record_batch([ids, pa.array([k for ks in keys for k in ks], pa.binary())], names=["doc_id", "key"])

    d = docs.select(doc_key(F.col("doc_id")).alias("doc_id"), "text")
    p = stage(d.mapInArrow(post, "doc_id long, key binary"), "postings")
    several = stage(d.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    if not several.limit(1).count():
        return p
    again = few(several)  # rows of one id are one document
    return stage(p.join(again, "doc_id", "left_anti").unionByName(p.join(again, "doc_id", "left_semi").distinct()), "postings")


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _ask(filters: DataFrame, keys: DataFrame, shards: int, change: str) -> tuple[DataFrame, DataFrame]:
    """Keys (key, n_docs, holder) go through their shards' filters: those that are seen again, with
    ``seen``, and the changed filters (shard, filter). ``change``: add those not seen, or remove all."""

    def one(shard: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        f = CuckooFilter.load(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(BUCKETS)
        rows, hits = [], []
        for row, (key, n) in enumerate(zip(new.column("key").to_pylist(), new.column("n_docs").to_pylist(), strict=True)):
            if change == "remove":
                f.remove(key)
                continue
            seen = key in f
            if not seen:
                f.add(key)
            if seen or n > 1:
                rows.append(row)
                hits.append(seen)
        again = new.select(["key", "n_docs", "holder"]).take(pa.array(rows, pa.int64()))
        out = {"shard": pa.array([None] * len(rows) + [shard[0].as_py()], pa.int32()), "filter": pa.array([None] * len(rows) + [f.dump()], pa.binary())}
        for name in ("key", "n_docs", "holder"):
            out[name] = pa.chunked_array([*again.column(name).chunks, pa.array([None], again.column(name).type)])
        return pa.table(out | {"seen": pa.array([*hits, None], pa.bool_())})

    keys = keys.select(_shard(F.col("key"), shards).alias("shard"), "key", "n_docs", "holder")
    got = filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(one, "shard int, filter binary, key binary, n_docs long, holder long, seen boolean")
    got = stage(got, "asked")
    return got.filter("key IS NOT NULL").select("key", "n_docs", "holder", "seen"), got.filter("filter IS NOT NULL").select("shard", "filter")


def empty_state(spark: SparkSession, shards: int, min_chars: int = 40) -> LineState:
    return LineState(
        spark.createDataFrame([], "doc_id long, key binary"), spark.createDataFrame([], "key binary, n_docs long, holder long, own boolean"),
        spark.createDataFrame([], "shard int, filter binary"), shards, min_chars,
    )


def _insert(state: LineState, new: DataFrame) -> LineState:
    batch = new.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
    old = state.counts.select("key", F.col("n_docs").alias("n0"), F.col("holder").alias("h0"), "own")
    batch = stage(batch.join(old, "key", "left"), "batch")
    again, filters = _ask(state.filters, batch.filter("n0 IS NULL"), state.shards, "add")

    seen = stage(again.filter("seen").select("key"), "seen")
    first = state.postings.join(few(seen), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n0"), F.max("doc_id").alias("h0"))
    met = again.join(first, "key", "left")  # seen without an earlier posting: the fingerprint is another key's
    met = met.select("key", "n_docs", "holder", "n0", "h0", (~F.col("seen") | F.col("n0").isNotNull()).alias("own"))
    known = batch.filter("n0 IS NOT NULL").unionByName(met)
    known = known.select("key", (F.col("n_docs") + F.coalesce("n0", F.lit(0))).alias("n_docs"), F.greatest("holder", "h0").alias("holder"), "own")
    kept = state.counts.join(batch.filter("n0 IS NOT NULL").select("key"), "key", "left_anti")
    return LineState(state.postings.unionByName(new), stage(kept.unionByName(known), "counts"), filters, state.shards, state.min_chars)


def insert(state: LineState | None, docs: DataFrame, min_chars: int = 40, turns: int = 1) -> LineState:
    """The state with the documents added, in ``turns`` by a digest of their ids; None: a new state, with
    shards for as many keys as the documents have."""
    new = _postings(docs, state.min_chars if state else min_chars)
    state = state or empty_state(docs.sparkSession, 1 + new.count() // SHARD_KEYS, min_chars)
    for turn in range(turns):
        state = _insert(state, new.filter(F.pmod(F.xxhash64("doc_id"), F.lit(turns)) == turn) if turns > 1 else new)
    return state


def delete(state: LineState, docs: DataFrame) -> LineState:
    """The state without the documents (doc_id, text as inserted); documents that it doesn't hold change nothing."""
    gone = _postings(docs, state.min_chars)
    touched = stage(state.postings.join(gone, ["doc_id", "key"], "left_semi").select("key").distinct(), "touched")
    left = stage(state.postings.join(gone, ["doc_id", "key"], "left_anti"), "postings")
    own = touched.join(state.counts.select("key", "own"), "key", "left")
    again = left.join(few(touched), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
    again = stage(own.join(again, "key", "left"), "again")
    dead = again.filter("n_docs IS NULL AND coalesce(own, true)").select("key", F.lit(0).cast("long").alias("n_docs"), "holder")
    _, filters = _ask(state.filters, dead, state.shards, "remove")
    kept = state.counts.join(touched, "key", "left_anti")
    counts = kept.unionByName(again.filter("n_docs IS NOT NULL AND own IS NOT NULL").select("key", "n_docs", "holder", "own"))
    return LineState(left, stage(counts, "counts"), filters, state.shards, state.min_chars)


def _cut(texts: list[str | None], doomed, min_chars: int) -> tuple[list, list, list]:
    """(kept text, lines, dropped lines) of every text; ``doomed``: the keys to drop of each text."""
    kept, n, dropped = [], [], []
    for text, gone in zip(texts, doomed, strict=True):
        lines = (text or "").split("\n")
        stay = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in gone] if gone else lines
        kept.append(text if len(stay) == len(lines) else "\n".join(stay))
        n.append(len(lines))
        dropped.append(len(lines) - len(stay))
    return kept, n, dropped


def cleaned(state: LineState, docs: DataFrame, least_docs: int = 5) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): ``row`` has the other columns of ``docs``.

    Lines of keys in ``least_docs`` documents or more go, except in the holder. While such keys are
    few, tasks hold them as a sorted array and texts stay where they are; else each document's doomed
    keys are joined to it."""
    min_chars = state.min_chars
    common = stage(state.counts.filter(F.col("n_docs") >= least_docs).select("key", "holder"), "common")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    d = docs.select(doc_key(F.col("doc_id")).alias("id"), "text", rest.alias("row"))
    if common.count() <= BROADCAST:
        got = common.toArrow()  # BROADCAST rows at most
        keys, holders = np.array(got.column("key").to_pylist(), "S16"), got.column("holder").to_numpy()
        order = np.argsort(keys, kind="stable")
        sent = docs.sparkSession.sparkContext.broadcast((keys[order], holders[order]))

        def gone_of(batch: pa.RecordBatch) -> Iterator[set]:
            keys, holders = sent.value
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list({k for k in line_keys(text, min_chars) if k}) if len(keys) else []
                asked = np.array(own, "S16")
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1) if own else np.zeros(0, int)
                gone = (keys[at] == asked) & (holders[at] != doc)  # as arrays: a single S16 value loses the zero bytes at its end
                yield {k for k, g in zip(own, gone, strict=True) if g}
    else:
        doomed = state.postings.join(common, "key").filter(F.col("doc_id") != F.col("holder"))
        doomed = doomed.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("doomed"))  # at most the document's own lines
        d = d.join(doomed, F.col("id") == F.col("of"), "left").select("id", "text", "row", "doomed")

        def gone_of(batch: pa.RecordBatch) -> Iterator[set]:
            return (set(k or ()) for k in batch.column(3).to_pylist())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            kept, n, dropped = _cut(batch.column(1).to_pylist(), gone_of(batch), min_chars)
            yield pa.record_batch([batch.column(2), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "kept_text", "n_lines", "n_dropped"])

    made = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return d.mapInArrow(cut, T.StructType([d.schema["row"], *made]))


def clean(state: LineState, docs: DataFrame, least_docs: int = 5) -> DataFrame:
    """``docs`` with ``kept_text`` in place of the text, ``n_lines`` and ``n_dropped``, under these names or
    the first that are free in ``docs`` with underscores behind them."""
    rest = [c for c in docs.columns if c != "text"]
    return cleaned(state, docs, least_docs).select(*[F.col("row")[c].alias(c) for c in rest], *[F.col(c).alias(free_name(c, rest)) for c in ("kept_text", "n_lines", "n_dropped")])


def dedup(docs: DataFrame, least_docs: int = 5) -> DataFrame:
    """``docs`` with the kept text as ``text``; all other columns as they are."""
    out = cleaned(insert(None, docs, turns=TURNS), docs, least_docs)
    return out.select(*[(F.col("kept_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = clean(insert(None, docs, turns=TURNS), docs, 5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
