"""Periodic run detection by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``least`` words and ``cubes`` times q
long, that cannot be longer with that period. Texts are taken whole, many at once in a task:

1. Suffixes of all texts are sorted by prefix doubling. The ranks of round k are the classes of the
   blocks of 2**k words, and a block's class is an interval of the suffix array.
2. For every dyadic length b, the blocks that start at multiples of b ask a wavelet tree over the
   suffix array (range successor) for their next occurrences in the neighbouring window, b to 2b - 1
   words on. A run with a period p in [b, 2b) has such a block among its first words, and the block
   occurs again p words on. Periods up to the least b come from the block's next occurrence itself.
3. Occurrences less than b / 2 apart form a progression: the block has that difference as its own
   period. The block's stretch of that period and the progression's must end, or must begin, p words
   apart; so a progression gives two candidates, and a window at most two progressions.
4. A candidate (block, p) is checked and widened to its maximal stretch by comparing dyadic blocks
   forth and back, exact, in log(n) steps.

Texts in which no run can be are left out first: in a run of at least ``least`` words and three
periods, ``least`` - ``least`` // 3 words stand twice. A digest finds those texts; it only lets more through.

Memory follows the largest text in words (about 80 bytes a word for each round of doubling that its
longest repeat takes, at most log2(n)); a slice of texts is cut by bytes.

Defined cases: null texts have no words and no run; texts shorter than ``least`` have no run; equal
rows are rows of their own; null ids stay null; an empty table gives no rows; columns other than
the two named are not read, or pass on whole in ``collapsed``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.batches import by_size
from tidewell.llm.hashing import mix, run_hashes
from tidewell.llm.suffixes import DyadicSuffixes, WaveletTree
from tidewell.runtime import table

LEAST, CUBES = 24, 3
#: Bytes of text whose suffixes are sorted together.
SLICE = 1 << 20

Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def _candidates(s: DyadicSuffixes, base: int, cubes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of blocks, periods) that hold every run's period at a place inside the run; ``base``: the least dyadic exponent."""
    n = len(s.order)
    often = s.ranks[min(base, len(s.ranks) - 1)][s.order]
    twice = np.zeros(n, bool)
    same = often[1:] == often[:-1]
    twice[1:] = same
    twice[:-1] |= same
    places = np.flatnonzero(twice)  # of suffixes whose first block occurs again; only these can answer
    if not len(places):
        return
    to_place = np.concatenate([[0], np.cumsum(twice)])
    kept = np.sort(s.order[places])
    tree = WaveletTree(np.searchsorted(kept, s.order[places]))
    kept = np.append(kept, 4 * n)

    def successor(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        return kept[tree.successor(left, right, np.searchsorted(kept[:-1], least))]

    length = s.end - np.concatenate([[0], s.end])[np.searchsorted(s.end, s.end, "left")] if n else s.end
    for k in range(base, len(s.ranks)):
        b = 1 << k
        at = np.arange(0, n, b)
        at = at[(at + b <= s.end[at]) & (cubes * (b if k > base else 1) <= length[at])]
        left, right = s.interval(k, at)
        some = np.flatnonzero(right - left > 1)
        at, left, right = at[some], to_place[left[some]], to_place[right[some]]
        if not len(at):
            continue
        if k == base:
            j = successor(left, right, at + 1)
            near = j - at <= b
            yield at[near], (j - at)[near]
        now = successor(left, right, at + b)
        while True:
            some = np.flatnonzero(now < at + 2 * b)
            if not len(some):
                break
            at, left, right, now = at[some], left[some], right[some], now[some]
            yield at, now - at
            after = successor(left, right, now + 1)
            own = after - now
            in_row = np.flatnonzero(own <= b // 2)
            if len(in_row):
                q, i, j = own[in_row], at[in_row], now[in_row]
                end_j = j + q + s.same_after(j, j + q)
                end_i, start_i = i + q + s.same_after(i, i + q), i - s.same_before(i, i + q)
                yield i, end_j - end_i
                yield i, (j - s.same_before(j, j + q)) - start_i
                last = j + (end_j - b - j) // q * q  # of this progression
                after[in_row] = successor(left[in_row], right[in_row], last + 1)
            now = after


def find_runs(codes: np.ndarray, ends: np.ndarray, least: int = LEAST, cubes: int = CUBES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, length, period) of every run, by text, start and period."""
    none = (np.empty(0, np.int64),) * 4
    if not len(codes):
        return none
    base = ((least + 1) // 3).bit_length() - 1  # with b = 2**base: 2b - 1 + p <= least for every p <= b
    s = DyadicSuffixes(codes, ends)
    if len(s.ranks) <= base:
        return none
    found = []
    for at, p in _candidates(s, base, cubes):
        good = p > 0
        at, p = at[good], p[good]
        pair = np.unique(at * (len(codes) + 1) + p)
        at, p = pair // (len(codes) + 1), pair % (len(codes) + 1)
        inside = at + p < s.end[at]
        at, p = at[inside], p[inside]
        start = at - s.same_before(at, at + p)
        length = at + p + s.same_after(at, at + p) - start
        run = np.flatnonzero((length >= least) & (length >= cubes * p))
        found.append(np.stack([start[run], length[run], p[run]], 1))
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # a stretch's smallest period is its first; multiples give the same stretch
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    text = s.text[rows[:, 0]]
    start = rows[:, 0] - np.concatenate([[0], np.asarray(ends)])[text]
    by = np.lexsort((rows[:, 2], start, text))
    return text[by], start[by], rows[by, 1], rows[by, 2]


def _suspects(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Which texts hold some ``n`` words twice, and perhaps a few others."""
    text = np.repeat(np.arange(len(counts)), counts)
    h = run_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), n)
    whole = text[: len(h)] == text[n - 1 :] if len(h) else np.empty(0, bool)
    h = (h ^ mix(text[: len(h)].astype(np.uint64) + np.uint64(77)))[whole]
    of = text[: len(whole)][whole]
    by = np.argsort(h)
    h, of = h[by], of[by]
    out = np.zeros(len(counts), bool)
    out[of[1:][h[1:] == h[:-1]]] = True
    return out


def text_runs(texts: list[list[bytes]], least: int = LEAST, cubes: int = CUBES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period."""
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sum(map(len, texts)))
    counts = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = _suspects(codes, counts, least - least // 3)
    which = np.flatnonzero(some)
    if len(which):
        found = find_runs(codes[np.repeat(some, counts)], np.cumsum(counts[some]), least, cubes)
        for t, start, length, period in zip(*(a.tolist() for a in found), strict=True):
            out[which[t]].append((start, length, period))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, compared exactly; the first of equal ones."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside every run and in its first period."""
    out, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        out += words[at : max(a, at)]
        at = max(at, b)
    return out + words[at:]


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, cubes: int = CUBES, prepare: Prepare | None = None) -> DataFrame:
    """(id, n_words, runs, kept_text) for every row: ``runs`` are (start, length, period) in words, ``kept_text`` the words outside repeated periods.

    ``prepare`` may change a text's words first, by its id."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, SLICE):
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            if prepare:
                texts = [prepare(i, t) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            found = text_runs(texts, least, cubes)
            yield pa.record_batch(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], pa.list_(run)), pa.array([b" ".join(_kept(t, f)).decode() for t, f in zip(texts, found, strict=True)], pa.string())],
                names=["id", "n_words", "runs", "kept_text"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string")


def run_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prepare: Prepare | None = None) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every row; the four are those of the strongest run."""
    found = runs(docs, id_col=id_col, text_col=text_col, prepare=prepare)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2):
            lists = [[(r["start"], r["length"], r["period"]) for r in f] for f in batch.column(1).to_pylist()]
            best = [strongest(f) for f in lists]
            of = lambda i: pa.array([b and b[i] for b in best], pa.int64())  # noqa: B023, E731
            sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
            yield pa.record_batch(
                [batch.column(0), pa.array([len(f) for f in lists], pa.int64()), of(0), of(1), of(2), pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()), sha("".join(f"{a},{n},{p}\n" for a, n, p in f).encode() for f in lists), sha(t.encode() for t in batch.column(2).to_pylist())],
                names=["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    return found.select("id", "runs", "kept_text").mapInArrow(digest, f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def collapsed(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every text of a run replaced by its words outside repeated periods; other texts stay as they are, white space included."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = runs(row, id_col="id")
    text = F.when(F.size("runs") > 0, F.col("kept_text")).otherwise(F.col("id")[text_col])
    return found.select(*[(text if c == text_col else F.col("id")[c]).alias(c) for c in docs.columns])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: where crc32 of the id ends in 0, words repeat from a place to the end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return (words[:a] + period * ((n - a) // len(period) + 1))[:n]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_digests(table(spark, sf_dir, "documents"), prepare=planted)
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
