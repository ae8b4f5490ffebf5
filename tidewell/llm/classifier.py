"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: the hashed frequencies of its words, and statistics of its form (length,
repetition, symbols, letter case, lines). The machine adds a weight per feature and a low-rank
weight per pair of features; the sum over pairs is taken in linear time as half of (sum of v x)
squared minus the sum of (v x) squared, factor by factor. It is fitted to at most ``max_rows``
labelled rows, chosen by a digest of their ids: that bound is the only sample, and only of the
fit. Every document is scored, on its whole text, by tasks that hold nothing but the weights.

Labels, language, source and doc_id are no inputs of a score.

Defined cases: null and empty texts get the score of a text without words; null labels and labels
of null ids are not learned from; without labelled rows of both classes every score is their share
of ones, 0.5 without any; repeated rows get equal scores; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.batches import by_size
from tidewell.llm.hashing import run_hashes, word_hashes
from tidewell.llm.text import free_name
from tidewell.runtime import table

HASHED = 1024
#: Bytes of text in a slice whose features are held at a time, 256 rows of them at most.
FEATURE_SLICE = 1 << 20
FACTORS = 6
#: Bound of the labelled rows that the machine is fitted to.
MAX_ROWS = 6_000
SYMBOLS, DIGITS, CAPITALS, STOPS = b"#*$%&|<>{}[]=_~^\\@", b"0123456789", bytes(range(65, 91)), b".!?,;:"


def form(text: bytes, h: np.ndarray, pairs: np.ndarray) -> list[float]:
    """Statistics of one text with its words' and word pairs' digests."""
    n, w = max(1, len(text)), max(1, len(h))
    without = lambda letters: len(text) - len(text.translate(None, letters))
    _, counts = np.unique(h, return_counts=True)
    lines = text.split(b"\n")
    return [
        np.log1p(len(h)), len(text) / w, len(counts) / w, (counts.max() if len(counts) else 0) / w,
        len(np.unique(pairs)) / max(1, len(pairs)), np.sqrt(without(SYMBOLS) / w), without(DIGITS) / n, without(CAPITALS) / w,
        without(STOPS) / w, np.log1p(w / len(lines)), len(set(lines)) / len(lines), np.log1p(text.count(b"|") + text.count(b"*")),
    ]


N_FORM = 12


def features(texts: list[str | None]) -> np.ndarray:
    """One row of HASHED + N_FORM numbers per text."""
    data = [(t or "").encode() for t in texts]
    h, counts = word_hashes(data)
    end = np.cumsum(counts)
    pairs = run_hashes(h, 2)
    out = np.zeros((len(data), HASHED + N_FORM), np.float32)
    for i, (stop, k) in enumerate(zip(end.tolist(), counts.tolist(), strict=True)):
        own = h[stop - k : stop]
        x = np.log1p(np.bincount((own & np.uint64(HASHED - 1)).astype(np.int64), minlength=HASHED))
        out[i, :HASHED] = x / max(1e-9, float(np.sqrt(x @ x)))
        out[i, HASHED:] = form(data[i], own, pairs[stop - k : max(stop - k, stop - 1)])
    return out


@dataclass(frozen=True)
class FactorMachine:
    """score = 1 / (1 + exp(-(bias + w x + sum over pairs of <v_i, v_j> x_i x_j)))"""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, HASHED:] = np.clip((x[:, HASHED:] - self.mean) / self.scale, -5, 5)
        return x

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s).sum(1) - ((x * x) @ (self.v * self.v)).sum(1))

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.raw(self.scaled(features(texts))).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, factors: int = FACTORS, epochs: int = 40, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorMachine:
    """Gradient steps on the logistic loss with moments of their own per weight; the classes weigh alike in it."""
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x[:, HASHED:].mean(0), x[:, HASHED:].std(0) + 1e-3) if len(y) else (np.zeros(N_FORM), np.ones(N_FORM))
    rng = np.random.default_rng(seed)
    d = HASHED + N_FORM
    p = {"b": np.zeros(1), "w": np.zeros(d), "v": rng.normal(0, 0.02, (d, factors))}
    if share in (0.0, 1.0) or not len(y):
        odds = np.log(np.clip(share, 1e-12, 1 - 1e-12) / np.clip(1 - share, 1e-12, 1))
        return FactorMachine(float(odds), p["w"], p["v"] * 0, mean, scale)
    x = FactorMachine(0.0, p["w"], p["v"], mean, scale).scaled(x).astype(np.float64)
    m, s, t = {k: a * 0 for k, a in p.items()}, {k: a * 0 for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            i = order[at : at + batch]
            xi, yi = x[i], y[i]
            sv = xi @ p["v"]
            z = p["b"][0] + xi @ p["w"] + 0.5 * ((sv * sv).sum(1) - ((xi * xi) @ (p["v"] ** 2)).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - yi) * np.where(yi > 0, 0.5 / share, 0.5 / (1 - share)) / len(i)
            grads = {"b": np.array([g.sum()]), "w": xi.T @ g + decay * p["w"], "v": xi.T @ (g[:, None] * sv) - p["v"] * ((xi * xi).T @ g)[:, None] + decay * p["v"]}
            t += 1
            for k, a in grads.items():
                m[k] += 0.1 * (a - m[k])
                s[k] += 0.001 * (a * a - s[k])
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    f32 = np.float32
    return FactorMachine(float(p["b"][0]), p["w"].astype(f32), p["v"].astype(f32), mean.astype(f32), scale.astype(f32))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null ids: of an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` documents outside the held-out third."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1, FEATURE_SLICE):
            x = [r.astype("<f4").tobytes() for r in features(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(x, pa.binary()), b.column(2)], names=["doc_id", "x", "y"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(make, "doc_id long, x binary, y int").orderBy("doc_id", "x", "y").limit(max_rows).collect()
    x = np.array([np.frombuffer(r.x, "<f4") for r in rows]).reshape(len(rows), HASHED + N_FORM)
    return x, np.array([r.y for r in rows], np.float64)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorMachine:
    return fit(*labelled(docs, labels, max_rows))


def scored(docs: DataFrame, machine: FactorMachine) -> DataFrame:
    """``docs`` with a column ``score``, the last one, under the first free name; all columns pass through."""
    name, at = free_name("score", docs.columns), docs.columns.index("text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, at, FEATURE_SLICE):
            texts = b.column(at)
            score = np.concatenate([machine.score(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]) if len(texts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(put, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op9_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
