"""Substring dedup by prefix-partitioned suffix trees.

Every word starts a suffix. Suffixes are split by prefixes of variable length into groups that fit
a task: a first pass counts them by their first word and by their first three words; a suffix goes
by its first word alone where that group is small, by three words where that suffices, and by its
whole first ``size`` words otherwise. In a group the suffixes are sorted by the path of ``size``
words from the root; leaves with the same path hang below one internal node. A deep node with leaves
from two documents or more is a repeat; its leaves from other documents than the smallest mark their
words, and marks that follow each other join to maximal repeats.

The tree is cut at ``size`` words, and of a path only a digest of 64 bits is sent: the words of every
suffix would be twelve times the input. Where groups go by whole paths, which on large corpora is the
rule, the group is chosen by a second, independent digest of the path, so that two paths are taken
for one only if 64 bits and the group agree (about 89 bits at 32 million groups of 500,000 suffixes).

A task sends at most one document per path: where its batch has a path in several documents, the
smallest one decides for the others at once. So a passage that a third of all documents share is
one leaf per batch, and groups stay small.

Defined cases: null texts have no words; texts shorter than ``size`` words keep them all; rows
with the same doc_id are one owner, so they take nothing from each other, and where their texts
differ each keeps its own marks, told apart by a digest of the text (``tagged``); null ids count as
the smallest; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.batches import by_size
from tidewell.llm.hashing import run_hashes, word_hashes
from tidewell.runtime import stage, table

SIZE = 13
CELLS = 4096
#: Suffixes of a group, about.
GROUP = 500_000
#: Bytes of text in which a task settles repeats by itself before it sends suffixes.
BATCH = 6 << 20
#: Ids with several texts, broadcast up to this many; beyond, every text gets its digest.
BROADCAST_IDS = 500_000
NO_ID = -(1 << 63)


def _squeeze(a: np.ndarray) -> bytes:
    """Rising numbers as differences, compressed."""
    return zstandard.compress(np.diff(a.astype("<i8"), prepend=0).astype("<i4").tobytes(), 1)


def _expand(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(b), "<i4").astype(np.int64))


def _owners(docs: bytes, n: bytes) -> np.ndarray:
    """The document of each suffix of a row."""
    ids = np.cumsum(np.frombuffer(zstandard.decompress(docs), "<i8"))
    return np.repeat(ids, np.frombuffer(zstandard.decompress(n), "<u4"))


def _tags(tags: bytes | None, n: bytes) -> np.ndarray:
    """The tag of each suffix of a row; None: all 0."""
    n = np.frombuffer(zstandard.decompress(n), "<u4")
    return np.zeros(n.sum(), np.int64) if tags is None else np.repeat(np.frombuffer(zstandard.decompress(tags), "<i8"), n)


def _suffixes(batch: pa.RecordBatch, size: int):
    """(order of the rows by doc_id, doc_ids, doc of each suffix, place in its document, first-word, three-word, whole-path and second whole-path digests), by rising doc_id."""
    ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
    order = np.argsort(ids, kind="stable")
    texts = batch.column(1).to_pylist()
    h, counts = word_hashes([(texts[i] or "").encode() for i in order])
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    pos = (np.arange(len(h)) - first[doc]).astype(np.int32)
    whole = pos + size <= counts[doc]
    path = run_hashes(h, size)
    whole[len(path) :] = False
    at = np.flatnonzero(whole)
    three = run_hashes(h, 3) if len(at) else h[:0]
    return order, ids[order], doc[at], pos[at], h[at], three[at], path[at], _second(three, at, size)


def _second(three: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Another digest of the paths that start at ``at``, from digests of three words that cover them."""
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, size - 3, 3), size - 3]:
        out = (out ^ three[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, owner, tag): ``tag`` is a digest of the text where the doc_id has several texts, else 0."""
    d = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("owner"))
    digest = F.xxhash64("text")
    known = d.filter("text IS NOT NULL AND doc_id IS NOT NULL")  # null ids are never marked
    several = known.select("owner", digest.alias("h")).groupBy("owner").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi")
    several = stage(several.select(F.col("owner").alias("of")), "several")
    n = several.count()
    if not n:
        return d.withColumn("tag", F.lit(0).cast("long"))
    if n > BROADCAST_IDS:
        return d.withColumn("tag", digest)
    d = d.join(F.broadcast(several), F.col("owner") == F.col("of"), "left")
    return d.select("doc_id", "text", "owner", F.when(F.col("of").isNotNull(), digest).otherwise(0).alias("tag"))


def _cells(one: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (one % np.uint64(CELLS)).astype(np.int64), (three % np.uint64(CELLS)).astype(np.int64)


def prefix_counts(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """Suffixes by cell of their first word (row 0) and of their first three words (row 1): 2 x CELLS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int64)
        for batch in by_size(batches, 1):
            _, _, _, _, one, three, _, _ = _suffixes(batch, size)
            for row, cells in zip(total, _cells(one, three), strict=True):
                row += np.bincount(cells, minlength=CELLS)
        level, cell = np.nonzero(total)
        yield pa.record_batch([pa.array(level, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[level, cell], pa.int64())], names=["level", "cell", "n"])

    sums = docs.mapInArrow(count, "level int, cell int, n long").groupBy("level", "cell").agg(F.sum("n").alias("n"))
    out = np.zeros((2, CELLS), np.int64)
    for r in sums.collect():  # 2 x CELLS rows at most
        out[r.level, r.cell] = r.n
    return out


def _fill(sizes: np.ndarray, group: int, base: int) -> tuple[np.ndarray, int]:
    """Group of every cell that fits into one, filled one after another from ``base``, -1 for larger cells; and the next free group."""
    of, used, room = np.full(len(sizes), -1, np.int64), base, group
    for cell, n in enumerate(sizes):
        if n <= group:
            if n > room:
                used, room = used + 1, group
            room -= n
            of[cell] = used
    return of, used + 1


def partition_plan(counts: np.ndarray, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(groups by first word, groups by three words, number of both, number of groups by whole path)."""
    one_of, used = _fill(counts[0], group, 0)
    longer = counts[0][one_of < 0].sum() / max(1, counts[0].sum())  # the share of suffixes that need a longer prefix
    three_of, used = _fill(counts[1] * longer, group, used)
    return one_of, three_of, used, 1 + int(counts[1][three_of < 0].sum() * longer / group)


def _send(plan, size: int):
    one_of, three_of, light, heavy = plan

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(by_size(batches, 1, BATCH)):
            rows, ids, doc, pos, one, three, path, second = _suffixes(batch, size)
            tags = batch.column(2).to_numpy()[rows].astype("<i8")
            if not len(path):
                continue
            order = np.argsort(path, kind="stable")  # documents rise within equal paths
            sorted_path, sorted_id = path[order], ids[doc[order]]
            head = np.concatenate([[True], sorted_path[1:] != sorted_path[:-1]])
            smallest = sorted_id[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(path), bool)
            later[order] = sorted_id != smallest
            cell1, cell3 = _cells(one, three)
            group = np.where(one_of[cell1] >= 0, one_of[cell1], three_of[cell3])
            group = np.where(group >= 0, group, light + (second >> np.uint64(8)).astype(np.int64) % heavy)
            group[later] = (int(ids[0]) + turn) % (light + heavy)  # decided: only passes through
            for is_later in (False, True):
                some = np.flatnonzero(later == is_later)
                some = some[np.argsort(group[some], kind="stable")]
                if not len(some):
                    continue
                cuts = np.flatnonzero(np.diff(group[some])) + 1
                cols = ([], [], [], [], [], [])
                for part in np.split(some, cuts):
                    docs, n = np.unique(doc[part], return_counts=True)
                    row = (int(group[part[0]]), zstandard.compress(np.diff(ids[docs].astype("<i8"), prepend=0).tobytes(), 1), zstandard.compress(n.astype("<u4").tobytes(), 1), _squeeze(pos[part]), None if is_later else path[part].astype("<u8").tobytes(), zstandard.compress(tags[docs].tobytes(), 1) if tags[docs].any() else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.record_batch([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "docs", "n", "pos", "path", "tags"])

    return send


def _subtree(t: pa.Table) -> pa.Table:
    """(doc_id, tag, pos) marks of one group: leaves whose deep node has a leaf of a smaller document."""
    owners, kinds, places, paths, marked, of, at = [], [], [], [], [], [], []
    rows = zip(*(t.column(c).to_pylist() for c in ("docs", "n", "pos", "path", "tags")), strict=True)
    for docs, n, pos, path, tags in rows:
        owner = _owners(docs, n)
        tag = _tags(tags, n)
        if path is None:
            marked.append(owner)
            of.append(tag)
            at.append(_expand(pos))
        else:
            owners.append(owner)
            kinds.append(tag)
            places.append(_expand(pos))
            paths.append(np.frombuffer(path, "<u8"))
    if paths:
        owner, tag, pos, path = np.concatenate(owners), np.concatenate(kinds), np.concatenate(places), np.concatenate(paths)
        order = np.lexsort((owner, path))
        path, owner, tag, pos = path[order], owner[order], tag[order], pos[order]
        head = np.concatenate([[True], path[1:] != path[:-1]])
        hit = owner != owner[np.flatnonzero(head)][np.cumsum(head) - 1]
        marked.append(owner[hit])
        of.append(tag[hit])
        at.append(pos[hit])
    join = lambda a, kind: np.concatenate(a).astype(kind) if a else np.empty(0, kind)
    return pa.table({"doc_id": pa.array(join(marked, np.int64)), "tag": pa.array(join(of, np.int64)), "pos": pa.array(join(at, np.int32))})


def repeat_marks(docs: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """(doc_id, tag, marks) of ``tagged`` documents: for those with repeats, the starts of their repeated windows."""
    plan = partition_plan(prefix_counts(docs.select("doc_id", "text"), size), group)
    sent = docs.select("doc_id", "text", "tag").mapInArrow(_send(plan, size), "part int, docs binary, n binary, pos binary, path binary, tags binary")
    marks = sent.groupBy("part").applyInArrow(_subtree, "doc_id long, tag long, pos int")
    return marks.groupBy("doc_id", "tag").agg(F.collect_list("pos").alias("marks"))  # at most a document's own words, once for each equal row


def covered(marks: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """True for each word that lies in a window that starts at a mark."""
    step = np.bincount(marks, minlength=n_words + 1) - np.bincount(marks + size, minlength=n_words + 1)
    return np.cumsum(step[:n_words]) > 0


def maximal_spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every maximal run of removed words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): ``spans`` are the removed maximal repeats in words of the input."""
    t = tagged(docs)
    marks = repeat_marks(t, size, group).withColumnRenamed("doc_id", "owner")
    d = t.join(marks, ["owner", "tag"], "left").select("doc_id", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            n, gone, spans, kept = [], [], [], []
            for text, m in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text or "").encode().split()
                runs = maximal_spans(covered(m.values.to_numpy().astype(np.int64), len(words), size)) if m.is_valid else []
                left, at = [], 0
                for a, b in runs:
                    left += words[at:a]
                    at = b
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b" ".join(left).decode())
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return d.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string")


def op8_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
