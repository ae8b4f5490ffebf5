"""Benchmark decontamination by training suffix arrays.

Documents are cut into shards by bytes; a task makes one suffix array for a shard at a time: places
sorted by the words from there on, to the depth of the longest item. Words that no item has end a
suffix, so only places of the items' words are sorted, first by three words in one number, then by
doubling where these leave ties. Every suffix of every item is binary-searched in every shard. The
neighbours of its place give its longest verbatim match and where it is; where that reaches a whole
window (``size`` words, or a shorter item as one window), a second search gives the interval of all
its occurrences, whose words are hit. A document lies in one shard, so nothing is shuffled.

Items go to the tasks in slices of ``SLICE`` bytes of text, each collected and sent by itself, and
at most ``PASS`` bytes in one pass over the documents; larger benchmarks take several passes, whose
hits (of hit documents only) are joined by row number.

Defined cases: null texts have no words; items without words match nothing; rows of items with the
same id are one item; null item ids are one item named by an empty string; equal documents are rows of
their own; null doc_ids stay null; empty tables give no rows, or rows without hits; columns other
than those named pass on whole in ``decontaminated`` and are not read elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.batches import by_size
from tidewell.llm.text import free_name
from tidewell.runtime import stage, table

SIZE = 10
#: Bytes of document text in a shard; of item text in a slice, and in all slices of a pass.
SHARD, SLICE, PASS = 4 << 20, 4 << 20, 16 << 20
#: Bits of a word code in a number that holds three.
BITS = 21
#: Lower-cases A-Z and makes white space of what is no word: bytes below 128 that are neither digit nor letter.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).isalpha() and chr(b).islower() else b + 32 if b < 0x80 and chr(b).isupper() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Items:
    """A slice of benchmark items: their words as codes from 1, their suffixes, and the windows that start there."""

    def __init__(self, rows: Iterable[tuple[str, list[bytes]]], size: int):
        self.known: dict[bytes, int] = {}
        self.names, codes, starts, lengths = [], [], [], []
        for name, item in rows:
            starts.append(len(codes))
            lengths.append(len(item))
            self.names.append(name)
            codes += [self.known.setdefault(w, len(self.known) + 1) for w in item]
        if len(self.known) >= 1 << BITS:
            raise ValueError("too many different words in a slice of items")
        n = np.array(lengths, np.int64)
        self.depth = int(n.max(initial=0))
        self.item = np.repeat(np.arange(len(n)), n)
        self.start = np.arange(len(codes)) - np.repeat(np.array(starts, np.int64), n)
        self.left = n[self.item] - self.start  # words from here to the item's end
        width = np.minimum(size, n)[self.item]
        self.window = np.where(self.left >= width, width, 0)  # of the window that starts here
        self.codes = np.concatenate([np.array(codes, np.int64), np.zeros(3, np.int64)])
        self.key = _three(self.codes, self.left)


def _three(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first three codes from each place as one number, zeros from a suffix's end on."""
    n = len(left)
    a, b, c = codes[:n], np.where(left > 1, codes[1 : n + 1], 0), np.where(left > 2, codes[2 : n + 2], 0)
    return (a << 2 * BITS) | (b << BITS) | np.where(b > 0, c, 0)


class Shard:
    """The suffix array of many documents: places of known words by up to ``depth`` words, which end before an unknown word (0)."""

    def __init__(self, codes: np.ndarray, depth: int):
        """``codes``: every document's, each with a 0 behind it."""
        n = len(codes)
        self.codes = np.concatenate([codes, np.zeros(3, np.int64)])
        at = np.flatnonzero(codes)
        b, c = self.codes[at + 1], self.codes[at + 2]
        key = (codes[at] << 2 * BITS) | (b << BITS) | np.where(b > 0, c, 0)
        by = np.argsort(key, kind="stable")
        self.order, self.key = at[by], key[by]
        head = np.ones(len(at), bool)
        head[1:] = self.key[1:] != self.key[:-1]
        rank = np.full(n + 1, -1, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        width, open_ = 3, np.flatnonzero(~(head & np.append(head[1:], True)) & (self.key & ((1 << BITS) - 1) > 0))
        while len(open_) and width < depth:
            p = self.order[open_]
            second = rank[np.minimum(p + width, n)]
            pair = rank[p] * (len(at) + 1) + second + 1
            by = np.argsort(pair, kind="stable")
            self.order[open_], pair, second = p[by], pair[by], second[by]
            head[open_[1:]] |= pair[1:] != pair[:-1]
            new = np.maximum.accumulate(np.where(head[open_], open_, 0))
            rank = rank.copy()
            rank[self.order[open_]] = new
            alone = head[open_] & np.append(head, True)[open_ + 1]
            open_ = open_[~alone & (second >= 0)]  # suffixes that end here are equal for good
            width *= 2

    def _match(self, items: Items, which: np.ndarray, places: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words, at most ``most``, of the items' suffixes ``which`` and the shard's ``places``."""
        out, go, step = np.zeros(len(which), np.int64), np.flatnonzero(most > 0), 0
        while len(go):
            same = items.codes[which[go] + step] == self.codes[places[go] + step]
            go = go[same]
            step += 1
            out[go] = step
            go = go[most[go] > step]
        return out

    def _bound(self, items: Items, which: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
        """Binary search in [low, high) for the first place whose suffix is not below (``after``: is above) the first ``most`` words of the item's."""
        low, high = low.copy(), high.copy()
        go = np.flatnonzero(low < high)
        while len(go):
            mid = (low[go] + high[go]) // 2
            n = self._match(items, which[go], self.order[mid], most[go])
            ended = n == most[go]  # the whole prefix is there
            below = np.where(ended, after, self.codes[np.minimum(self.order[mid] + n, len(self.codes) - 1)] < items.codes[np.minimum(which[go] + n, len(items.codes) - 1)])
            low[go], high[go] = np.where(below, mid + 1, low[go]), np.where(below, high[go], mid)
            go = go[low[go] < high[go]]
        return low

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every suffix of the items: (words of its longest match, where, and the interval of its window's occurrences)."""
        every, size = np.arange(len(items.key)), len(self.order)
        low = np.searchsorted(self.key, items.key, "left")
        high = np.searchsorted(self.key, items.key, "right")
        # a longer suffix may stand behind a short one; its place among those with the same three words
        place = self._bound(items, every, low, high, items.left, False)
        longest, where = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        for near in (place - 1, place):
            some = np.flatnonzero((near >= 0) & (near < size))
            got = self._match(items, some, self.order[near[some]], items.left[some])
            better = got > longest[some]
            longest[some[better]], where[some[better]] = got[better], self.order[near[some[better]]]
        first, last = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        some = np.flatnonzero((items.window > 0) & (longest >= items.window))
        all_ = np.full(len(some), size)
        first[some] = self._bound(items, some, np.zeros(len(some), np.int64), all_, items.window[some], False)
        last[some] = self._bound(items, some, first[some], all_, items.window[some], True)
        return longest, where, first, last


def _hits(shard: Shard, items: Items, ends: np.ndarray, covered: np.ndarray, found: list[dict[str, tuple[int, int, int]]]) -> None:
    """Marks what the items' windows hit: ``covered`` counts the windows that begin less those that end, ``found`` gets by
    document and item the longest match (words, start in the item, start in the document)."""
    longest, where, first, last = shard.search(items)
    starts = np.concatenate([[0], ends])
    for i in np.flatnonzero(last > first).tolist():
        places = shard.order[first[i] : last[i]]
        covered[places] += 1  # each place once: an interval holds no place twice
        covered[places + items.window[i]] -= 1
        name, start = items.names[items.item[i]], int(items.start[i])
        docs, at = np.unique(np.searchsorted(ends, places, "right"), return_index=True)
        for d, p in zip(docs.tolist(), places[at].tolist(), strict=True):
            n = int(longest[i]) if starts[d] <= where[i] < ends[d] else int(items.window[i])
            p = int(where[i]) if n > items.window[i] else p
            if found[d].get(name, (0,))[0] < n:
                found[d][name] = (n, start, p - int(starts[d]))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ITEM = pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("item_start", pa.int64()), ("start", pa.int64())])
_FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<struct<item_id: string, n_words: long, item_start: long, start: long>>"


def _spans(covered: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (covered > 0).astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _search(slices: list[list[tuple[str, str]]], size: int, shard_bytes: int):
    """The task: (key, text) batches to (key, n_words, spans, items) rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Items([(name, words(text)) for name, text in rows], size) for rows in slices]
        for batch in by_size(batches, 1, shard_bytes):
            texts = [words(t) for t in batch.column(1).to_pylist()]
            counts = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(counts + 1)
            covered, found = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64), [{} for _ in texts]
            for some in items:
                of = some.known.get
                codes = np.fromiter((of(w, 0) for t in texts for w in (*t, b"")), np.int64, int(counts.sum()) + len(texts))
                _hits(Shard(codes, some.depth), some, ends, covered, found)
            covered = np.cumsum(covered)
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(counts), pa.array([_spans(covered[end - n - 1 : end - 1]) for n, end in zip(counts.tolist(), ends.tolist(), strict=True)], pa.list_(_SPAN)),
                    pa.array([[{"item_id": k, "n_words": n, "item_start": i, "start": p} for k, (n, i, p) in sorted(f.items())] for f in found], pa.list_(_ITEM)),
                ],
                names=["key", "n_words", "spans", "items"],
            )

    return find


def _slices(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> tuple[DataFrame, int]:
    """The items, each row once, with the number of their slice by a digest, and how many slices there are."""
    b = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = b.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = -(-2 * total // slice_bytes) if total > slice_bytes else 1  # twice as many as would do, as their sizes differ
    return b.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), n


def _passes(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int, pass_bytes: int) -> Iterator[list[list[tuple[str, str]]]]:
    """The slices that go together in one pass; what is on the driver is bounded by a pass and one item."""
    b, n = _slices(benchmark, id_col, text_col, slice_bytes)
    b = stage(b.select("slice", "item_id", "text"), "items") if n > 1 else b
    held, room = [], pass_bytes
    for k in range(n):
        rows = [(r.item_id, r.text) for r in b.filter(F.col("slice") == k).select("item_id", "text").collect()]
        size = sum(len(t.encode()) for _, t in rows)
        if held and size > room:
            yield held
            held, room = [], pass_bytes
        held.append(rows)
        room -= size
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, shard_bytes: int = SHARD, slice_bytes: int = SLICE, pass_bytes: int = PASS) -> DataFrame:
    """(key, n_words, spans, items) for every row of ``docs``: ``key`` is its id, ``spans`` are the hit words, ``items`` the items
    whose windows occur, by id as a string, each with a longest verbatim match (words, start in the item, start in the document)."""
    kind = docs.schema[id_col].dataType.simpleString()
    passes = _passes(benchmark, item_col, item_text, slice_bytes, pass_bytes)
    first, second = next(passes), next(passes, None)
    d = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    if second is None:
        return d.mapInArrow(_search(first, size, shard_bytes), f"key {kind}, {_FOUND}")
    d = stage(d.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found, counts = None, None
    for slices in (p for group in ([first, second], passes) for p in group):
        got = stage(d.select("row", "text").mapInArrow(_search(slices, size, shard_bytes), f"key long, {_FOUND}"), "found")
        counts = counts if counts is not None else got.select("key", "n_words")
        some = got.filter(F.size("items") > 0).select("key", "spans", "items")
        found = some if found is None else found.union(some)
    merged = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # at most the words of a document for each pass
    out = d.select("row", F.col("key").alias("id")).join(counts, F.col("row") == F.col("key")).drop("key").join(merged, F.col("row") == F.col("key"), "left")
    return out.select("id", "n_words", "spans", "items").mapInArrow(_merge, f"key {kind}, {_FOUND}")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several passes joined where they meet, and one entry for each item."""
    for batch in batches:
        spans, items = [], []
        for n, s, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            covered = np.zeros(n + 1, np.int64)
            for x in s or []:
                covered[x["start"]] += 1
                covered[x["end"]] -= 1
            spans.append(_spans(np.cumsum(covered)[:n]))
            best: dict[str, dict] = {}
            for x in i or []:
                if x["item_id"] not in best or best[x["item_id"]]["n_words"] < x["n_words"]:
                    best[x["item_id"]] = x
            items.append([best[k] for k in sorted(best)])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(_ITEM))], names=["key", "n_words", "spans", "items"])


def longest_matches(found: DataFrame) -> DataFrame:
    """(item_id, n_words, item_start, key, start): of the rows of ``contamination``, every hit item's longest verbatim match; the smallest key of equal ones."""
    x = found.select("key", F.explode("items").alias("i")).select("key", "i.*")
    order = F.struct(-F.col("n_words"), F.col("key").isNull(), "key", "start")  # a minimum by item: tasks sum up before rows meet
    return x.groupBy("item_id").agg(F.min_by(F.struct("n_words", "item_start", "key", "start"), order).alias("m")).select("item_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", least_words: int = 1, **options) -> DataFrame:
    """``docs`` without the rows of which items hit ``least_words`` words or more."""
    name = free_name("row", docs.columns)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name), F.col(f"`{text_col}`").alias("text" if name != "text" else "text_"))
    found = contamination(row, benchmark, id_col=name, text_col=row.columns[1], **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.filter(hit < least_words).select("key.*")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of the rows of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_join(F.transform("items", lambda i: i["item_id"]), ",")
    return found.select(F.col("key").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op13_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
