"""Exact top-k search by inner product with paged M-trees.

Inner products become distances by one more coordinate: with M the largest norm of a candidate x,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest
points have the highest products, and the triangle inequality holds.

The tree is built from the top, a level at a time. Its first level are at most ``ROUTERS`` routing
objects, candidates chosen by a digest of their ids (a bounded sample; it changes the speed and no
result); every candidate belongs below its nearest one. A cell of more than a page is split again
among at most ``FANOUT`` of its own members, in slices of bounded size, until cells fit in a page;
one whose vectors are all equal is dealt to pages by hash instead. Levels below the first are
tables, so no node list grows on the driver. A page holds a tree of nodes with covering radii and
with distances to their parents. A query first goes down to the nearest page and searches it, best
node first; its k-th score then rules out cells by their covering radii at every level, and in the
pages that are left every node and vector whose bound, from stored distances and the triangle
inequality, can't reach that score is left out without computing its distance. Queries meet nodes
and pages in slices of bounded size. Scores are exact integers; bounds have a margin above their
rounding errors.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a
shorter vector counts as ending in zeros; rows with the query's vec_id are its own; of repeated
query ids one row asks (the first in order of its components); other rows are candidates one by one; null ids are
candidates with the smallest id and never queries; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.runtime import stage, table

ROUTERS = 256
PAGE = 2048
LEAF, FAN = 256, 8
#: Cells that one cell is split into, levels of cells at most, and members routed by one task's group.
FANOUT, DEPTH, SLICE = 64, 12, 16384
#: Queries that go down a tree together.
BLOCK = 1024
NO_ID = -(1 << 63)


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x): components as whole numbers; rows that can't take part are left out."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    v = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.transform("embedding", lambda e: e.cast("double")).alias("e"))
    v = v.filter((F.size("e") > 0) & ~F.exists("e", bad))
    return v.select("vec_id", F.transform("e", lambda e: F.floor(scale * e).cast("double")).alias("x"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out, at = np.zeros((len(sizes), dim)), 0
    for row, n in zip(out, sizes, strict=True):
        row[:n] = flat[at : at + n]
        at += n
    return out


class MTree:
    """A tree over one page: nodes hold a router, a covering radius and the distance to their parent's router."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, top: float):
        self.x, self.ids, self.top = x, ids, top  # top: M^2
        self.extra = np.sqrt(np.maximum(0, top - (x * x).sum(1)))
        self.slack = 1e-9 * (top + 1)
        self.root = self._node(np.arange(len(x)), 0)

    def _far(self, rows: np.ndarray, r: int) -> np.ndarray:
        product = self.x[rows] @ self.x[r] + self.extra[rows] * self.extra[r]
        norms = (self.x[rows] ** 2).sum(1) + self.extra[rows] ** 2
        own = self.x[r] @ self.x[r] + self.extra[r] ** 2
        return np.sqrt(np.maximum(0, norms + own - 2 * product))

    def _node(self, rows: np.ndarray, router: int) -> dict:
        d = self._far(rows, router)
        node = {"router": router, "radius": float(d.max(initial=0)), "rows": None, "below": None}
        if len(rows) <= LEAF:
            return node | {"rows": rows, "far": d}
        centres = [int(rows[np.argmin(d)])]
        nearest, which = self._far(rows, centres[0]), np.zeros(len(rows), np.int64)
        while len(centres) < FAN and nearest.max() > 0:
            centres.append(int(rows[np.argmax(nearest)]))
            new = self._far(rows, centres[-1])
            which[new < nearest] = len(centres) - 1
            nearest = np.minimum(nearest, new)
        groups = [rows[which == i] for i in range(len(centres))]
        if max(map(len, groups)) > len(rows) - FAN:  # hardly apart: by halves, each under the nearest router
            half = rows[np.argsort(d, kind="stable")]
            groups = [half[: len(half) // 2], half[len(half) // 2 :]]
            centres = [int(g[0]) for g in groups]
        below = [self._node(g, c) for g, c in zip(groups, centres, strict=True) if len(g)]
        to_parent = self._far(np.array([b["router"] for b in below]), router)
        return node | {"below": below, "to_parent": to_parent, "radii": np.array([b["radius"] for b in below]), "routers": np.array([b["router"] for b in below])}

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the k best of every query, ties to smaller ids; none below its ``least``.

        Queries go down the tree together, so that a node's distances to those that still need it are
        one product of matrices; each then takes its leaves best first, one a round."""
        reach = (queries * queries).sum(1) + self.top
        kth = least.astype(np.float64).copy()
        bound = lambda low, of: (reach[of] - np.maximum(0, low - self.slack) ** 2) / 2 + 1e-6 + 1e-9 * reach[of]
        far = lambda of, rows: np.sqrt(np.maximum(0, reach[of][:, None] - 2 * (queries[of] @ self.x[rows].T)))
        every = np.arange(len(queries))
        d = far(every, np.array([self.root["router"]]))[:, 0]
        open_, leaves, waiting = [(self.root, every, d)], [], []
        while open_:
            node, of, d = open_.pop()
            alive = bound(d - node["radius"], of) >= kth[of]
            of, d = of[alive], d[alive]
            if not len(of):
                continue
            if node["rows"] is not None:
                waiting.append((bound(d - node["radius"], of), of, np.full(len(of), len(leaves)), d))
                leaves.append(node)
                continue
            for child, up, radius in zip(node["below"], node["to_parent"], node["radii"], strict=True):
                near = bound(np.abs(d - up) - radius, of) >= kth[of]  # before any distance to the child
                if near.any():
                    open_.append((child, of[near], far(of[near], np.array([child["router"]]))[:, 0]))
        found = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        if waiting:
            best, of, leaf, d = (np.concatenate(c) for c in zip(*waiting, strict=True))
            order = np.lexsort((-best, of))
            best, of, leaf, d = best[order], of[order], leaf[order], d[order]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            turn = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
            for t in range(int(turn.max()) + 1):
                now = np.flatnonzero((turn == t) & (best >= kth[of]))
                got = [found]
                for i in np.unique(leaf[now]):
                    got.append(self._visit(leaves[i], queries, of[now[leaf[now] == i]], d[now[leaf[now] == i]], own, kth, bound))
                found, kth = _keep(got, k, kth)
        return found

    def _visit(self, leaf: dict, queries, of, d, own, kth, bound):
        """Candidates of a leaf; its vectors that no query here can need, by their distance to the leaf's router, are passed over."""
        low = np.maximum(leaf["far"] - d.max(), d.min() - leaf["far"])
        widest = of[np.argmax(bound(np.zeros(len(of)), of) - kth[of])]
        rows = leaf["rows"][bound(np.maximum(0, low), np.full(len(low), widest)) >= kth[widest]]
        s = queries[of] @ self.x[rows].T
        q, r = np.nonzero((s >= kth[of][:, None]) & (own[of][:, None] != self.ids[rows][None, :]))
        return of[q], s[q, r], self.ids[rows][r]


def _keep(got: list, k: int, kth: np.ndarray):
    """The k best of each query among (query, score, id) columns, and every query's k-th score."""
    q, s, i = (np.concatenate(c) for c in zip(*got, strict=True))
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    last = rank == k - 1
    kth = kth.copy()
    kth[q[last]] = np.maximum(kth[q[last]], s[last])
    return (q[rank < k], s[rank < k], i[rank < k]), kth


def _search_pages(asked: DataFrame, pages: DataFrame, dim: int, top: float, k: int, slices: int) -> DataFrame:
    """(query_id, vec_id, score): each query's best in the pages that it asks, if they reach its ``least``."""

    def one(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        tree = MTree(_matrix(right.column("x").combine_chunks(), dim), right.column("vec_id").to_numpy(), top)
        queries, own = _matrix(left.column("x").combine_chunks(), dim), left.column("query_id").to_numpy()
        least = np.nan_to_num(left.column("least").to_numpy(), nan=-np.inf)
        parts = [tree.search(queries[i : i + BLOCK], own[i : i + BLOCK], k, least[i : i + BLOCK]) for i in range(0, len(own), BLOCK)]
        q = np.concatenate([own[i * BLOCK :][p[0]] for i, p in enumerate(parts)])
        s, ids = (np.concatenate([p[j] for p in parts]) for j in (1, 2))
        return pa.table([pa.array(q), pa.array(ids), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

    asked = asked.select("cell", "part", _slice(slices), "query_id", "x", "least")
    wanted = asked.select("cell", "part", "slice").distinct()
    keys = "cell", "part", "slice"
    pages = _own(pages.join(wanted, ["cell", "part"]), *keys, "vec_id", "x")
    return asked.groupBy(*keys).cogroup(pages.groupBy(*keys)).applyInArrow(one, "query_id long, vec_id long, score long")


def _own(df: DataFrame, *names: str) -> DataFrame:
    """Columns that Spark doesn't take for those of the table from which the other side of a cogroup comes."""
    return df.select(*[F.col(c).alias(c) for c in names])


def _slice(slices: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _to_routers(x: np.ndarray, base: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Every candidate's nearest router and its distance."""
    up, extra = (np.sqrt(np.maximum(0, top - (v * v).sum(1))) for v in (x, base))
    d2 = 2 * top - 2 * (x @ base.T + up[:, None] * extra)
    r = d2.argmin(1)
    return r, np.sqrt(np.maximum(0, d2[np.arange(len(r)), r]))


MEMBERS = "cell string, vec_id long, x array<double>, d double"


def _first_level(c: DataFrame, base: np.ndarray, dim: int, top: float) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, d = _to_routers(_matrix(b.column(1), dim), base, top)
            yield pa.record_batch([pa.array(r.astype(str)), b.column(0), b.column(1), pa.array(d)], names=["cell", "vec_id", "x", "d"])

    return stage(c.select("vec_id", "x").mapInArrow(route, MEMBERS), "level0")


def _split(members: DataFrame, routers: DataFrame, dim: int, top: float) -> DataFrame:
    """``members`` (cell, slice, vec_id, x) below the nearest of their cell's routers (cell, slice, i, x)."""

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.float64())], names=["cell", "vec_id", "x", "d"])
        x = left.column("x").combine_chunks()
        i = right.column("i").to_numpy()
        r, d = _to_routers(_matrix(x, dim), _matrix(right.column("x").combine_chunks(), dim), top)
        cells = np.array([f"{key[0].as_py()}.{n}" for n in i])
        return pa.table([pa.array(cells[r]), left.column("vec_id").combine_chunks(), x, pa.array(d)], names=["cell", "vec_id", "x", "d"])

    keys = "cell", "slice"
    return members.groupBy(*keys).cogroup(routers.groupBy(*keys)).applyInArrow(one, MEMBERS)


def _tree(level: DataFrame, dim: int, top: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pages (cell, part, vec_id, x), the first level's cells, and for each further one its nodes (parent, cell, x, radius, open, many)."""
    leaves, nodes, first, routers = [], [], None, None
    for depth in range(DEPTH):
        n, parts = F.col("n"), F.ceil(F.col("n") / PAGE)
        cells = level.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n"))
        # different vectors of whole numbers are at least 1 apart
        can = F.lit(depth < DEPTH - 1) & (n > PAGE) & (F.col("radius") >= 0.5)
        cells = stage(cells.select("cell", "radius", "n", can.alias("open"), F.when(can, 1).otherwise(parts).cast("int").alias("many")), f"cells{depth}")
        if first is None:
            first = cells
        else:
            below = routers.select(F.col("cell").alias("parent"), F.concat_ws(".", "cell", "i").alias("cell"), "x")
            nodes.append(stage(below.join(cells.drop("n"), "cell"), f"nodes{depth}"))
        placed = level.join(cells, "cell")
        leaves.append(placed.filter(~F.col("open")).select("cell", F.pmod(F.xxhash64("vec_id", "x"), F.col("many")).cast("int").alias("part"), "vec_id", "x"))
        if cells.filter("open").isEmpty():
            break
        members = placed.filter("open").select("cell", "vec_id", "x", "n")
        turn = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("vec_id", F.lit(depth)), "vec_id", "x"))
        routers = members.withColumn("i", turn).filter((F.col("i") <= FANOUT) & (F.col("i") <= F.greatest(F.lit(2), F.ceil(2 * n / PAGE))))
        routers = stage(routers.select("cell", "i", "x", "n"), f"routers{depth}")
        slices = F.ceil(n / SLICE).cast("int")
        sliced = members.select("cell", F.pmod(F.xxhash64("x", "vec_id"), slices).cast("int").alias("slice"), "vec_id", "x")
        each = routers.select("cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "i", "x")
        level = stage(_split(sliced, each, dim, top), f"level{depth + 1}")
    pages = leaves[0]
    for more in leaves[1:]:
        pages = pages.unionByName(more)
    return stage(pages, "pages"), first, nodes


ASKED = "query_id long, x array<double>, least double, home string, cell string, open boolean, many int"


def _choose(b, x: np.ndarray, routers: np.ndarray, radius: np.ndarray, top: float, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) to go on with: the nearest node, or every one whose bound reaches the query's ``least``."""
    reach = (x * x).sum(1)[:, None] + top
    d = np.sqrt(np.maximum(0, reach - 2 * x @ routers.T))
    if nearest:
        return np.arange(len(x)), d.argmin(1)
    least = np.nan_to_num(b.column("least").to_numpy(zero_copy_only=False), nan=-np.inf)
    low = np.maximum(0, d - radius * (1 + 1e-9) - 1e-6)
    return np.nonzero((reach - low**2) / 2 + 1e-6 + 1e-9 * reach >= least[:, None])


def _go_on(b, at: np.ndarray, cells: pa.Array, open_: pa.Array, many: pa.Array, to: np.ndarray) -> list:
    rows, to = b.select(["query_id", "x", "least", "home"]).take(pa.array(at)), pa.array(to)
    return [*rows.columns, cells.take(to), open_.take(to), many.take(to)]


def _descend(asked: DataFrame, first: list, base: np.ndarray, nodes: list[DataFrame], dim: int, top: float, slices: int, nearest: bool) -> DataFrame:
    """The leaf cells that each of ``asked`` (query_id, x, least, home) goes to, a level at a time."""
    routers, radius = base[[int(r.cell) for r in first]], np.array([r.radius for r in first])
    cells, open_, many = (pa.array([r[c] for r in first], t) for c, t in (("cell", pa.string()), ("open", pa.bool_()), ("many", pa.int32())))
    names = ["query_id", "x", "least", "home", "cell", "open", "many"]

    def top_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), dim)
            at, to = _choose(b, x, routers, radius, top, nearest)
            for i in range(0, len(at), BLOCK):
                yield pa.record_batch(_go_on(b, at[i : i + BLOCK], cells, open_, many, to[i : i + BLOCK]), names=names)

    def one(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.int32())], names=names)
        left, right = left.combine_chunks(), right.combine_chunks()
        x, r = (_matrix(t.column("x").combine_chunks(), dim) for t in (left, right))
        at, to = _choose(left, x, r, right.column("radius").to_numpy(), top, nearest)
        return pa.table(_go_on(left, at, *(right.column(c) for c in ("cell", "open", "many")), to), names=names)

    level, done = stage(asked.select("query_id", "x", "least", "home").mapInArrow(top_level, ASKED), "asked"), []
    for below in nodes:
        done.append(level.filter(~F.col("open")))
        go = level.filter("open").select("query_id", "x", "least", "home", "cell", _slice(slices))
        wanted = go.select(F.col("cell").alias("parent"), "slice").distinct()
        below = _own(below.join(wanted, "parent"), "parent", "slice", "cell", "x", "radius", "open", "many")
        level = stage(go.groupBy("cell", "slice").cogroup(below.groupBy("parent", "slice")).applyInArrow(one, ASKED), "asked")
    for more in done:
        level = level.unionByName(more)
    return level


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (query_id, x) against ``candidates`` (vec_id, x)."""
    c = stage(candidates, "candidates")
    q = stage(queries.groupBy("query_id").agg(F.min("x").alias("x")), "queries")
    norm = F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e)
    asking, widest = q.agg(F.count("*"), F.max(F.size("x"))).first()
    n, top, dim = c.agg(F.count("*"), F.max(norm), F.max(F.size("x"))).first()
    dim, top = max(dim or 1, widest or 1), float(top or 0)
    slices = -(-asking // max(64, (64 << 20) // (8 * dim * FANOUT))) or 1  # of 64 MB, should each go to every child
    routers = min(ROUTERS, max(1, 2 * n // PAGE))
    sample = c.orderBy(F.xxhash64("vec_id"), "vec_id", "x").select("x").limit(routers).collect()  # ROUTERS rows at most
    base = np.zeros((max(1, len(sample)), dim))
    for row, r in zip(base, sample, strict=False):
        row[: len(r.x)] = r.x
    pages, cells, nodes = _tree(_first_level(c, base, dim, top), dim, top)
    first = cells.orderBy("cell").collect()  # ROUTERS rows at most
    if not first:
        return _ranked(q.select("query_id", F.col("query_id").alias("vec_id"), F.col("query_id").alias("score")).filter("false"), k)

    unknown = q.select("query_id", "x", F.lit(None).cast("double").alias("least"), F.lit(None).cast("string").alias("home"))
    at_home = _descend(unknown, first, base, nodes, dim, top, slices, True)
    at_home = stage(at_home.withColumn("part", F.pmod("query_id", F.col("many")).cast("int")), "asked")
    home = stage(_search_pages(at_home, pages, dim, top, k, slices), "home")
    kth = home.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("least"))
    homes = at_home.select("query_id", "x", F.concat_ws("#", "cell", "part").alias("home"))
    others = _descend(homes.join(kth, "query_id", "left"), first, base, nodes, dim, top, slices, False)
    others = others.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    others = stage(others.filter(F.concat_ws("#", "cell", "part") != F.col("home")), "asked")
    return _ranked(home.unionByName(_search_pages(others, pages, dim, top, k, slices)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return _best(found, k).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def op2_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantized(table(spark, sf_dir, "embeddings"))
    queries = v.filter((F.col("vec_id") % 20 == 0) & (F.col("vec_id") != NO_ID)).withColumnRenamed("vec_id", "query_id")
    return top_k(queries, v, 20)
