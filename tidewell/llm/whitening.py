"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are made whole numbers first, and each distinct one counts once in the fit (``fit_list``).
Their covariance V is never built: what the method needs of it is V Q for a block Q of a few columns,
and a pass over the written fit list gives that as the sum of Xc'(Xc Q)/n over tasks, Xc being the
rows less their mean. A pass sends dim x columns numbers per task, which Spark sums.

A round is: Rayleigh-Ritz in the block (its Ritz values and vectors, with residuals); a Chebyshev
polynomial of V on the block, by its three-term recurrence, a pass a degree, scaled so that it keeps
within [-1, 1] on the unwanted part of the spectrum and grows fast above it; QR of what comes out.
The unwanted part reaches from a lower bound of the spectrum to the block's smallest Ritz value. The
bound comes from a Lanczos process whose one vector rides along in the passes of the first rounds.
The rounds end when the residuals of all wanted pairs certify them: |V q - e q| <= ``tol`` times the
largest eigenvalue, where ``tol`` is near the rounding of a pass; a pass cannot give less, so a residual
below 50 times that which no round lowers any more ends them too. What has not settled after ``rounds``
raises an error. The block holds ``GUARD`` more columns than are wanted and starts from seeded random
numbers, so that no wanted direction is missed; the start does not depend on rows or partitions.

Defined cases: vectors that are null or hold a null or non-finite component take no part and get no
row; a shorter vector counts as ending in zeros (an empty one is all zeros); components beyond the
range of a long stop at its ends; repeated rows get a row each; null ids stay null; a covariance of
rank r gives r components at most (one vector only: none, and so no row); a deviation beyond a long
is null; equal eigenvalues give some orthonormal basis of their space; an empty table gives no rows;
columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.runtime import stage, table

SCALE, COMPONENTS = 256, 4
#: Columns of the block beyond the wanted ones.
GUARD = 16
#: Residual that certifies an eigenpair, by the largest eigenvalue.
TOLERANCE = 1e-14
ROUNDS, LANCZOS = 200, 14
#: Growth of the largest eigenvalue in one round: more would drown the other columns in rounding.
GROWTH = 1e10
#: Eigenvalues below this share of the largest are those of a deficient rank.
RANK = 1e-11
#: Bytes of doubles worked on at once in a task.
SLICE = 8 << 20


def whole_numbers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * component) as longs, for the rows that take part."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    v = vectors.select(F.col(id_col).alias("vec_id"), F.transform(column, lambda c: c.cast("double")).alias("e"))
    v = v.filter(F.col("e").isNotNull() & ~F.exists("e", bad))
    return v.select("vec_id", F.transform("e", lambda c: F.floor(scale * c)).alias("x"))


def dimension(x: DataFrame) -> int:
    return x.agg(F.max(F.size("x"))).first()[0] or 0


def padded(x: DataFrame, dim: int) -> DataFrame:
    return x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))))


def fit_list(x: DataFrame, dim: int) -> DataFrame:
    """(x) each distinct vector once, written. Equal rows of a task meet there before the shuffle."""
    return stage(padded(x, dim).select("x").distinct(), "fit_list")


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as rows of longs."""
    rows = max(1, SLICE // (8 * dim))
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            yield part, part.column(column).flatten().to_numpy().reshape(len(part), dim)


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each component, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for _, x in _matrices(batches, 0, dim):
            n += len(x)
            safe = max(int(x.max(initial=0)), -int(x.min(initial=0))) * len(x) < 1 << 62
            total = [a + int(b) for a, b in zip(total, (x if safe else x.astype(object)).sum(0), strict=True)]
        if n:
            # in three parts of 42 bits, so that Spark's sums of longs stay exact
            parts = [[(t >> s) & ((1 << 42) - 1) if s < 84 else t >> 84 for t in total] for s in (0, 42, 84)]
            yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), *[pa.array(p, pa.int64()) for p in parts]], names=["i", "n", "a", "b", "c"])

    sums = fit.mapInArrow(add, "i int, n long, a long, b long, c long").groupBy("i").agg(*[F.sum(c).alias(c) for c in "nabc"]).collect()  # dim rows
    s = {r.i: r.a + (r.b << 42) + (r.c << 84) for r in sums}
    return (sums[0].n if sums else 0), [s.get(i, 0) for i in range(dim)]


def _summed(fit: DataFrame, dim: int, rows: int, columns: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of ``part``: a rows x columns array of each slice of vectors."""
    names = [f"c{j}" for j in range(columns)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for _, x in _matrices(batches, 0, dim):
            total += part(x)
        yield pa.record_batch([pa.array(range(rows), pa.int32()), *map(pa.array, np.ascontiguousarray(total.T))], names=["i", *names])

    schema = "i int, " + ", ".join(f"{c} double" for c in names)
    out = np.zeros((rows, columns))
    for r in fit.mapInArrow(add, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # ``rows`` rows
        out[r[0]] = r[1:]
    return out


@dataclass(frozen=True)
class Whitening:
    """What a fit found. ``basis`` has a component a column, ``values`` their eigenvalues, ``residuals`` certify both."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


class _Lanczos:
    """Lower bound of a spectrum from the tridiagonal matrix that products with one growing basis give."""

    def __init__(self, dim: int, rng: np.random.Generator):
        v = rng.normal(size=dim)
        self.basis, self.alpha, self.beta, self.ended = [v / np.linalg.norm(v)], [], [], False

    @property
    def asks(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def take(self, product: np.ndarray) -> None:
        b = np.array(self.basis)
        self.alpha.append(float(b[-1] @ product))
        for _ in range(2):  # against all earlier vectors, twice: rounding
            product = product - b.T @ (b @ product)
        self.beta.append(float(np.linalg.norm(product)))
        self.ended = len(self.alpha) >= LANCZOS or self.beta[-1] <= 1e-12 * abs(self.alpha[0])
        self.basis.append(product / max(self.beta[-1], 1e-300))

    def low(self) -> float:
        """No eigenvalue is expected below: the smallest Ritz value less the norm of the last residual."""
        if not self.alpha:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beta[-1])


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Ritz values, falling; their vectors; V times these) in the block ``q``."""
    h = q.T @ vq
    theta, u = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], q @ u[:, ::-1], vq @ u[:, ::-1]


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` that is small on [low, high], of V on ``q``, by about its value at ``top``."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (product(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def _degree(low: float, high: float, top: float) -> int:
    centre, half = (high + low) / 2, (high - low) / 2
    return int(min(12, max(3, math.log(GROWTH) / math.acosh(max(1 + 1e-9, (top - centre) / half)))))


def fit(x: DataFrame, dim: int, *, components: int = COMPONENTS, tol: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 7) -> Whitening | None:
    """Fits to a written fit list (``x``: equally long vectors of longs, each once); None where it is empty."""
    n, sums = _exact_sums(x, dim) if dim else (0, [])
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    passes, rng = 0, np.random.default_rng(seed)
    watch = _Lanczos(dim, rng)

    def centred(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            c = m - mean
            return c.T @ (c @ q)

        return _summed(x, dim, dim, q.shape[1], part) / n

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        if watch.ended:
            return centred(q)
        out = centred(np.hstack([q, watch.asks]))
        watch.take(out[:, -1])
        return out[:, :-1]

    squares = _summed(x, dim, 1, dim, lambda m: ((m - mean) ** 2).sum(0, keepdims=True))[0] / n
    trace = float(squares.sum())
    block, wanted, last = min(dim, components + GUARD), min(dim, components), math.inf
    q = np.linalg.qr(rng.normal(size=(dim, block)))[0]
    vq = product(q)
    for _ in range(rounds):
        theta, q, vq = _ritz(q, vq)
        if theta[0] <= RANK * max(1.0, float(np.abs(mean).max()) ** 2):  # all vectors are one
            theta = np.zeros(block)
        real = int((theta[:wanted] > RANK * theta[0]).sum())
        off = np.linalg.norm(vq - q * theta, axis=0)[:wanted]
        worst = float(off[:real].max(initial=0)) / max(theta[0], 1e-300)
        if not real or worst <= tol or worst <= 50 * tol and worst > last / 2:
            break
        last = worst
        if block < dim:
            high = max(theta[-1], theta[0] * 1e-6)
            low = watch.low() if watch.low() < high else 0.0
            q = filtered(product, q, vq, low, high, theta[0] * (1 + 1e-9), _degree(low, high, theta[0]))
        q = np.linalg.qr(q)[0]
        vq = product(q)
    else:
        raise RuntimeError(f"not certified after {rounds} rounds: residual {worst:.2g} of the largest eigenvalue")
    basis, values = q[:, :real], theta[:real]
    error = _identity_error(x, dim, n, mean, basis / np.sqrt(values)) if real else 0.0
    return Whitening(n, tuple(sums), basis, values, trace, off[:real], error, passes)


def _identity_error(x: DataFrame, dim: int, n: int, mean: np.ndarray, white: np.ndarray) -> float:
    """Largest absolute entry of the covariance of whitened vectors less the identity: two passes, the mean first."""
    r = white.shape[1]
    centre = _summed(x, dim, 1, r, lambda m: ((m - mean) @ white).sum(0, keepdims=True))[0] / n

    def part(m: np.ndarray) -> np.ndarray:
        w = (m - mean) @ white - centre
        return w.T @ w

    return float(np.abs(_summed(x, dim, r, r, part) / n - np.eye(r)).max())


def whitened(x: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) of (vec_id, x) vectors, a row for each component."""
    dim, n, sums, r = model.dim, model.n, model.sums, len(model.values)
    mean, white, share = model.mean, model.basis / np.sqrt(model.values), model.values / model.trace
    certified, error = model.residuals / model.values, model.identity_error
    most = max(map(abs, sums), default=0)

    def deviations(m: np.ndarray) -> list[int | None] | np.ndarray:
        reach = n * max(int(m.max(initial=0)), -int(m.min(initial=0))) + most
        if dim * reach * reach < 1 << 63:
            d = n * m - np.array(sums, np.int64)
            return (d * d).sum(1)
        d = n * m.astype(object) - np.array(sums, object)
        return [v if v < 1 << 63 else None for v in map(int, (d * d).sum(1))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _matrices(batches, 1, dim):
            k = len(part)
            if not k or not r:
                continue
            ids = part.column(0).take(pa.array(np.repeat(np.arange(k), r)))
            deviation = pa.array(deviations(m), pa.int64()).take(pa.array(np.repeat(np.arange(k), r)))
            yield pa.record_batch(
                [ids, pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), k)), pa.array(np.full(k * r, n)), deviation, pa.array(((m - mean) @ white).ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * r, error)), pa.array(np.tile(certified, k))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
            )

    kind = x.schema["vec_id"].dataType.simpleString()
    return padded(x, dim).select("vec_id", "x").mapInArrow(rows, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Fits to ``vectors`` and whitens them: the rows of ``whitened``."""
    x = whole_numbers(vectors, scale, id_col, column)
    dim = dimension(x)
    model = fit(fit_list(x, dim), dim, components=components) if dim else None
    if model is None:
        kind = x.schema["vec_id"].dataType.simpleString()
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")
    return whitened(x, model)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))
