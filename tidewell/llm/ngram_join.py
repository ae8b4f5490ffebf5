"""Similarity join of documents by the Jaccard index of their word n-gram sets, with prefix trees.

All n-grams are 64-bit digests in one global order, that of their numbers. Two sets whose index is
``t`` or more (here 3/4) miss at most a quarter of either, so in the first third of each set's
n-grams they share at least ``least_shared`` of them. This gives, without any loss:

1. one representative per set: documents with equal sets are one class from the start;
2. each representative's first third of n-grams, and how often each occurs in other classes;
3. only representatives with enough occurring n-grams can have a partner; of these n-grams, the
   rarest suffice for candidates, so passages that many documents share are passed over;
4. lists of representatives by such an n-gram. First the members of a few of these lists are tried
   in a star with one member each; lists whose members are then all in one component are done. Of
   the others, short ones are tried pair by pair. Members of long ones, most of which have but a
   passage in common, are listed again by the rarest quarter of their whole sets: a set of which
   others hold less than 3/4 is in no list then. Of these lists again short ones are tried pair by
   pair; long ones, of large groups of near copies, are joined to blocks, whose members meet in
   chunks of bounded size;
5. the trial: the candidates' whole sets form a prefix tree, which one or many documents walk
   together; sets with a common beginning share its overlap, and a subtree is left by those that
   can't reach the index any more with what remains of it and of them. Of a block only as many links
   come back as connect its members, never its pairs;
6. connected components of the links, in rounds of joins.

Only links between different components can be passed over (pairs in one component already need no
trial), so components are exact. Sets of copies never meet as pairs.

Defined cases: null texts and texts without words have the empty set, linked with nothing; texts
with fewer words than ``n`` have one n-gram, all their words; sets are joined whatever the ids of
their documents, so repeated ids do no harm, and null ids count as the smallest and are returned as
null; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.batches import by_size
from tidewell.llm.components import connected_components
from tidewell.llm.hashing import run_hashes, word_hashes
from tidewell.runtime import lean_stage as stage
from tidewell.runtime import table

N = 5
#: Lists up to this length are tried pair by pair, longer ones in blocks.
SHORT = 16
#: Shared n-grams that are asked of a pair before it is tried, where its sets are large enough to promise them.
MEET = 6
#: Bounds of a chunk of a block: sets, and n-grams in them.
CHUNK_SETS, CHUNK_GRAMS = 400, 60_000
#: N-grams of each set that the first round of stars goes by.
FIRST_TRY = 8
#: Ids of documents that may have a partner, broadcast up to this many, else shuffled.
BROADCAST_IDS = 500_000
#: N-grams of the sets in one group of trials, about: 4 MB.
GROUP_GRAMS = 500_000
#: Members of a list that are tried with one of them; longer lists get more such middles.
STAR = 4096
NO_ID = -(1 << 63)


def need(a: int, b: int) -> int:
    """The least overlap of sets of these sizes with an index of 3/4."""
    return -(-3 * (a + b) // 7)


def shingle_sets(texts: list[str | None], n: int = N) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-gram digests; A-Z count as a-z."""
    h, counts = word_hashes([(t or "").encode().lower() for t in texts])
    runs, end = run_hashes(h, n), np.cumsum(counts)
    for stop, k in zip(end.tolist(), counts.tolist(), strict=True):
        if k >= n:
            yield np.unique(runs[stop - k : stop - n + 1])
        elif k:
            yield np.array([int.from_bytes(hashlib.blake2b(h[stop - k : stop].tobytes(), digest_size=8).digest(), "little")], np.uint64)
        else:
            yield h[:0]


def first_part(n: Column | int):
    """How many n-grams of a set of ``n`` make candidates: a third, and one at least."""
    return n // 3 + 1 if isinstance(n, int) else F.floor(n / 3) + 1


def least_shared(n: Column | int):
    """The least overlap of the first parts of a set of ``n`` and of any partner: a partner has 3/4 n
    elements at least, and of the m // 3 + 1 first ones of a set of m at most m // 4 are missing."""
    return (-(-3 * n // 4)) // 12 + 1 if isinstance(n, int) else F.floor(F.ceil(3 * n / 4) / 12) + 1


def least_alike(n: Column):
    """The least overlap of a set of ``n`` and of any partner."""
    return F.ceil(3 * n / 4)


def least_met(n: Column):
    """In how many lists similar sets meet at least."""
    return F.least(least_shared(n), F.lit(MEET))


def node_of(s: np.ndarray) -> tuple[int, int]:
    """A set's digest of 128 bits, in two halves."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, node, check) and the columns after the text: ``node`` and ``check`` are a digest of the whole set (null: empty)."""
    more = docs.columns[2:]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            sizes, nodes = [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else (None, None))
            halves = [pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *halves, *batch.columns[2:]], names=["doc_id", "n_shingles", "node", "check", *more])

    return docs.mapInArrow(sign, ", ".join(["doc_id long, n_shingles long, node long, check long", *[f"{c} long" for c in more]]))


def _clashes(signed: DataFrame) -> DataFrame | None:
    """The nodes that different sets share by chance, if any."""
    c = signed.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo < hi")
    c = stage(c.select(F.col("node").alias("clash")), "clashes")
    return c if c.limit(1).count() else None


def _told_apart(d: DataFrame, clashes: DataFrame | None, node: str = "node") -> DataFrame:
    """``d`` with another number for each set whose node another set has too; without ``check``."""
    if clashes is None:
        return d.drop("check")
    d = d.join(_few(clashes), F.col(node) == F.col("clash"), "left")
    return d.withColumn(node, F.when(F.col("clash").isNotNull(), F.xxhash64(node, "check")).otherwise(F.col(node))).drop("check", "clash")


def first_posts(docs: DataFrame, n: int = N) -> DataFrame:
    """(rep, check, n, token): the first third of each set's n-grams, with the set's digest in two halves."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 0):
            sets = [s for s in shingle_sets(batch.column(0).to_pylist(), n) if len(s)]
            firsts = [s[: first_part(len(s))] for s in sets]
            many = np.array([len(f) for f in firsts], np.int64)
            halves = np.array([node_of(s) for s in sets], np.int64).reshape(-1, 2)
            token = np.concatenate(firsts).view(np.int64) if firsts else np.empty(0, np.int64)
            size = np.array([len(s) for s in sets], np.int32)
            yield pa.record_batch([*[pa.array(np.repeat(x, many)) for x in (halves[:, 0], halves[:, 1], size)], pa.array(token)], names=["rep", "check", "n", "token"])

    return docs.select("text").mapInArrow(post, "rep long, check long, n int, token long")


def whole_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """(rep, check, set): the sets' digests in two halves and their sorted n-grams as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 0):
            sets = list(shingle_sets(batch.column(0).to_pylist(), n))
            nodes = [node_of(s) for s in sets]
            yield pa.record_batch([*[pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)], pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "check", "set"])

    return docs.select("text").mapInArrow(make, "rep long, check long, set binary")


def all_posts(sets: DataFrame) -> DataFrame:
    """(rep, n, token): every n-gram of (rep, set)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            grams = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            many = np.array([len(g) for g in grams], np.int64)
            token = np.concatenate(grams) if grams else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(np.repeat(x, many)) for x in (batch.column(0).to_numpy(), many.astype(np.int32))] + [pa.array(token)], names=["rep", "n", "token"])

    return sets.select("rep", "set").mapInArrow(post, "rep long, n int, token long")


class PrefixTree:
    """Sets as paths of rising numbers; a node holds the stretch that all sets below it share."""

    __slots__ = ("key", "stretch", "below", "ends", "small", "deep")

    def __init__(self, stretch: np.ndarray):
        self.stretch, self.below, self.ends = stretch, {}, []
        self.small, self.deep = 1 << 60, 0  # smallest whole set below; most elements of a set below the stretch

    def add(self, s: np.ndarray, name: int, size: int) -> None:
        node = self
        while True:
            node.small = min(node.small, size)
            k = len(node.stretch)
            same = node.stretch[: len(s)] == s[:k]
            cut = len(same) if same.all() else int(np.argmin(same))
            if cut < k:  # split: what is below moves down
                low = PrefixTree(node.stretch[cut:])
                low.below, low.ends, low.small, low.deep = node.below, node.ends, node.small, node.deep
                low.small = min([x.small for x in low.below.values()] + [e[1] for e in low.ends])
                node.deep += k - cut
                node.stretch, node.below, node.ends = node.stretch[:cut], {int(low.stretch[0]): low}, []
            s = s[cut:]
            node.deep = max(node.deep, len(s))
            if not len(s):
                node.ends.append((name, size))
                return
            nxt = node.below.get(int(s[0]))
            if nxt is None:
                nxt = node.below[int(s[0])] = PrefixTree(s)
                nxt.small = size
                nxt.ends.append((name, size))
                return
            node = nxt

    def search(self, queries: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(number of the query, name of the set) with an index of 3/4 or more.

        All queries walk the tree together: a node adds what its stretch shares with each of them, and
        only those go on that can still reach the index with what is left."""
        sizes = np.array([len(q) for q in queries])
        known, flat = np.unique(np.concatenate(queries), return_inverse=True)
        holds = np.zeros((len(known), len(queries)), bool)
        holds[flat, np.repeat(np.arange(len(queries)), sizes)] = True
        stack = [(self, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while stack:
            node, of, overlap = stack.pop()
            if len(node.stretch) and len(known):
                place = np.minimum(np.searchsorted(known, node.stretch), len(known) - 1)
                place = place[known[place] == node.stretch]
                overlap = overlap + holds[np.ix_(place, of)].sum(0)
            alive = overlap + np.minimum(node.deep, sizes[of] - overlap) >= need(sizes[of], node.small)
            of, overlap = of[alive], overlap[alive]
            if not len(of):
                continue
            for name, size in node.ends:
                for q in of[overlap >= need(sizes[of], size)].tolist():
                    yield q, name
            stack += [(x, of, overlap) for x in node.below.values()]


def _tree(names, sets) -> PrefixTree:
    tree = PrefixTree(np.empty(0, np.uint64))
    for name, s in zip(names, sets, strict=True):
        tree.add(s, name, len(s))
    return tree


def _sets_of(t: pa.Table) -> dict[int, np.ndarray]:
    return {rep: np.frombuffer(s, np.uint64) for rep, s in zip(t.column("rep").to_pylist(), t.column("set").to_pylist(), strict=True)}


def _links(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _try(_: tuple, sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links (a, b) among the pairs of a group, whose sets come once each."""
    of, out, candidates = _sets_of(sets), ([], []), {}
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        candidates.setdefault(a, []).append(b)
    for a, some in candidates.items():
        for _, b in _tree(some, [of[x] for x in some]).search([of[a]]):
            out[0].append(a)
            out[1].append(b)
    return _links(*out)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, nb) that are similar. A document with many candidates is tried in chunks of
    them; a group of trials has about GROUP_GRAMS n-grams, and each set once."""
    p = stage(pairs, "pairs")
    grams = p.agg(F.sum("nb")).first()[0] or 0
    busy = p.groupBy("a").agg((1 + F.floor(F.sum("nb") / GROUP_GRAMS)).alias("chunks")).filter("chunks > 1")
    p = p.join(busy, "a", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")), F.lit(0)))
    p = p.select(F.pmod(F.xxhash64("a", "chunk"), F.lit(1 + grams // GROUP_GRAMS)).alias("part"), "a", "b")
    of = p.select("part", F.col("a").alias("rep")).union(p.select("part", F.col("b").alias("rep"))).distinct().join(sets, "rep").select(*[F.col(c).alias(c) for c in ("part", "rep", "set")])
    return stage(of.groupBy("part").cogroup(p.groupBy("part")).applyInArrow(_try, "a long, b long"), "links")


def _near_sizes(a: Column, b: Column) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def candidate_lists(posts: DataFrame, once: bool = False, part: Callable = first_part, least: Callable = least_shared) -> DataFrame:
    """(token, rep, n, at, df): representatives by the n-grams that make them candidates, from the rarest (at = 0) on.

    ``posts`` has ``part`` of each set, of which a partner shares ``least`` or more; so similar sets meet in
    ``least_met`` of these lists or more. ``once``: no post comes twice. The counts are written before
    posts are made again and meet them, so that both are never on disk together."""
    often = stage(posts.groupBy("token").count().filter("count > 1").withColumnRenamed("count", "df"), "often")
    shared = posts.join(often, "token")
    if not once:
        shared = shared.dropDuplicates(["token", "rep", "n", "df"])
    shared = shared.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))  # at most a set's own n-grams
    # in order of rarity a set's lone n-grams come first; of its part all but the last least - least_met make candidates
    lone = part(F.col("n")) - F.size("shared")
    rarest = (part(F.col("n")) - least(F.col("n")) + least_met(F.col("n")) - lone).cast("int")
    shared = shared.filter(rarest >= least_met(F.col("n"))).select("rep", "n", F.posexplode(F.slice("shared", F.lit(1), rarest)).alias("at", "x"))
    return stage(shared.select("x.token", "rep", "n", "at", "x.df"), "lists")


def _few(df: DataFrame) -> DataFrame:
    """To be broadcast if its rows are few; ``df`` is written."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _apart(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists whose members are in more than one component, with the members' components ``c``."""
    parts = lists.select("token", "rep", "n", "df").join(_few(found), "rep", "left").select("token", "rep", "n", "df", F.coalesce("component", "rep").alias("c"))
    mixed = parts.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("many")).filter("c0 < c1").select("token", "many")
    return stage(parts.join(mixed, "token"), "apart")


def _star(lists: DataFrame) -> DataFrame:
    """(a, b, na, nb): one member of each list with every other member. A list of more than STAR is cut
    into parts of about that size, each with a middle of its own, and the middles are a list again."""
    lists = lists.select("token", F.pmod(F.xxhash64("rep"), 1 + F.floor(F.col("df") / STAR)).alias("cut"), "rep", "n")
    first = F.min(F.struct(F.xxhash64("rep").alias("o"), "rep", "n"))
    middle = stage(lists.groupBy("token", "cut").agg(first.alias("m"), F.count("*").alias("many")), "middles")
    top = middle.groupBy("token").agg(F.min("m").alias("t"), F.count("*").alias("cuts")).filter("cuts > 1")
    star = lists.join(middle.filter("many > 1").select("token", "cut", "m"), ["token", "cut"])
    among = middle.join(top, "token").select("t", F.col("m.rep").alias("rep"), F.col("m.n").alias("n"))
    star = star.select(F.col("m").alias("t"), "rep", "n").union(among).filter(F.col("t.rep") != F.col("rep"))
    return star.select(F.col("t.rep").alias("a"), F.col("rep").alias("b"), F.col("t.n").alias("na"), F.col("n").alias("nb")).distinct()


def _forest(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the two sides of each meeting of a group, reduced to as many as connect what they connect."""
    out = ([], [])

    def meetings(t: pa.Table) -> dict[int, list[int]]:
        rows = {}
        for i, m in enumerate(t.column("meeting").to_pylist()):
            rows.setdefault(m, []).append(i)
        return rows

    others = meetings(right)
    for meeting, rows in meetings(left).items():
        if meeting not in others:
            continue
        mine, its = left.take(rows), right.take(others[meeting])
        a, b = mine.column("rep").to_pylist(), its.column("rep").to_pylist()
        root = {x: x for x in a + b}

        def find(x: int, root: dict = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        arrays = lambda t: [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
        for q, name in _tree(b, arrays(its)).search(arrays(mine)):
            x, y = find(a[q]), find(name)
            if x != y:
                root[x] = y
                out[0].append(a[q])
                out[1].append(name)
    return _links(*out)


def _met(left: DataFrame, right: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links between the members (meeting, rep) of both sides of each meeting; meetings are dealt to ``parts`` groups."""
    with_sets = lambda d: d.join(sets, "rep").select(F.pmod(F.xxhash64("meeting"), F.lit(parts)).alias("part"), *[F.col(c).alias(c) for c in ("meeting", "rep", "set")])
    return stage(with_sets(left).groupBy("part").cogroup(with_sets(right).groupBy("part")).applyInArrow(_forest, "a long, b long"), "links")


def linked_between(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among pairs (ca, cb, a, b) of members of two components.

    The members of a pair of components meet at once, in chunks of bounded size, so that a set is
    sent once for each other component and not for each of its members."""
    p = stage(pairs, "pairs")

    def chunked(me: str, n: str) -> DataFrame:
        d = p.select("ca", "cb", F.col(me).alias("rep"), F.col(n).alias("n")).distinct()
        room = d.groupBy("ca", "cb").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_GRAMS)).alias(f"k{me}"))
        return stage(d.join(room, ["ca", "cb"]).select("ca", "cb", "rep", f"k{me}", "n", F.pmod(F.xxhash64("rep"), F.col(f"k{me}")).alias(f"chunk{me}")), f"side_{me}")

    a, b = chunked("a", "na"), chunked("b", "nb")

    def meeting(d: DataFrame, other: DataFrame, me: str, its: str) -> DataFrame:
        rooms = other.select("ca", "cb", f"k{its}").distinct()
        d = d.join(rooms, ["ca", "cb"]).withColumn(f"chunk{its}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"k{its}").cast("long") - 1)))
        return d.select(F.xxhash64("ca", "cb", F.col("chunka").cast("long"), F.col("chunkb").cast("long")).alias("meeting"), "rep")

    grams = sum(d.agg(F.sum("n")).first()[0] or 0 for d in (a, b))
    return _met(meeting(a, b, "a", "b"), meeting(b, a, "b", "a"), sets, 1 + grams // GROUP_GRAMS)


def linked_blocks(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among all members of each list, for lists too long for pairs.

    Lists that share members are one block; its members go to chunks of bounded size by bands of set
    size, of which only the same and neighbouring ones can be similar, and chunk meets chunk."""
    spread = _star(lists).select("a", "b")
    block = connected_components(spread).withColumnRenamed("v", "rep")
    member = lists.select("rep", "n").distinct().join(_few(block), "rep").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))))
    room = member.groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_GRAMS)).alias("chunks"))
    member = stage(member.join(room, ["component", "band"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))).select("component", "band", "chunk", "rep"), "members")
    chunks = member.select("component", "band", "chunk").distinct()
    other = chunks.select("component", F.col("band").alias("band2"), F.col("chunk").alias("chunk2"))
    meet = chunks.join(other, "component").filter(((F.col("band") == F.col("band2")) & (F.col("chunk") <= F.col("chunk2"))) | (F.col("band") + 1 == F.col("band2")))
    meet = stage(meet.withColumn("meeting", F.xxhash64("component", "band", "chunk", "band2", "chunk2")), "meetings")
    left = member.join(meet.select("component", "band", "chunk", "meeting"), ["component", "band", "chunk"]).select("meeting", "rep")
    right = member.join(meet.select("component", F.col("band2").alias("band"), F.col("chunk2").alias("chunk"), "meeting"), ["component", "band", "chunk"]).select("meeting", "rep")
    return _met(left, right, sets, 1 + meet.count())


def _pairs(lists: DataFrame) -> DataFrame:
    """(ca, cb, a, b, na, nb): members of different components that meet often enough; first counted for components, then for members."""
    met = least_met(F.col("n"))
    of = stage(lists.groupBy("token", "c").agg(F.min(met).alias("met")), "by_component")
    other = of.select("token", F.col("c").alias("cb"), F.col("met").alias("mb"))
    near = of.withColumnRenamed("c", "ca").join(other, "token").filter(F.col("ca") < F.col("cb"))
    near = stage(near.groupBy("ca", "cb").agg(F.count("*").alias("common"), F.min(F.least("met", "mb")).alias("least")).filter(F.col("common") >= F.col("least")).select("ca", "cb"), "near")
    left = lists.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca")).join(near, "ca")
    right = lists.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    pairs = left.join(right, ["token", "cb"]).filter(_near_sizes(F.col("na"), F.col("nb")))
    pairs = pairs.groupBy("ca", "cb", "a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return pairs.filter(F.col("common") >= F.least(least_met(F.col("na")), least_met(F.col("nb")))).drop("common")


def _owned(docs: DataFrame, signed: DataFrame, reps: DataFrame) -> tuple[DataFrame, bool]:
    """The documents of those ids that own a set, and whether they hold each set just once.

    Texts stay where they are while either these ids or the others are few."""
    mine = reps.select(F.col("owner").alias("doc_id")).distinct()
    with_words = signed.filter("n_shingles > 0").select("doc_id")
    others = stage(with_words.join(mine, "doc_id", "left_anti").distinct(), "others")
    once = with_words.join(mine, "doc_id", "left_semi").count() == reps.count()
    if others.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(others), "doc_id", "left_anti"), once
    return _of_owners(docs, reps), once


def _of_owners(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The documents of the owners in (rep, owner)."""
    return docs.join(_few(stage(reps.select(F.col("owner").alias("doc_id")).distinct(), "owners")), "doc_id", "left_semi")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def similar_components(docs: DataFrame, n: int = N, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) and ``more`` numbers of all documents, and (rep, component) of the nodes that have links."""
    d = docs.select(_id().alias("doc_id"), "text")
    signed = stage(signatures(docs.select(_id().alias("doc_id"), "text", *more), n), "signatures")
    clashes = _clashes(signed)
    signed = _told_apart(signed, clashes)
    reps = stage(signed.filter("n_shingles > 0").groupBy(F.col("node").alias("rep")).agg(F.min("doc_id").alias("owner")), "reps")
    owned, once = _owned(d, signed, reps)
    lists = candidate_lists(_told_apart(first_posts(owned, n), clashes, "rep"), once)
    ids = stage(reps.join(lists.select("rep").distinct(), "rep", "left_semi"), "ids")
    sets = _told_apart(whole_sets(_of_owners(d, ids), n), clashes, "rep")
    sets = stage(sets if once else sets.dropDuplicates(["rep"]), "sets")

    # copies share most of their n-grams: a few of each set link most of what is alike
    star = _star(lists.filter(F.col("at") < FIRST_TRY)).filter(_near_sizes(F.col("na"), F.col("nb"))).select("a", "b", "nb")
    first = linked(star, sets)
    found = connected_components(first).withColumnRenamed("v", "rep")
    parts = _apart(lists, found)
    # many documents with one passage share few n-grams else: those in long lists meet again by the rarest quarter of their whole sets
    busy = stage(parts.filter(F.col("many") > SHORT).select("rep").distinct(), "busy")
    again = _apart(candidate_lists(all_posts(sets.join(_few(busy), "rep", "left_semi")), True, lambda n: n, least_alike), found)
    blocks = linked_blocks(again.filter(F.col("many") > SHORT), sets)
    pairs = _pairs(parts.filter(F.col("many") <= SHORT)).unionByName(_pairs(again.filter(F.col("many") <= SHORT))).distinct()
    links = first.unionByName(blocks).unionByName(linked_between(pairs, sets))
    return signed, connected_components(links).withColumnRenamed("v", "rep")


def jaccard_join(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every document; equal ``node``: equal sets."""
    signed, found = similar_components(docs, n)
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(found.withColumnRenamed("rep", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(smallest, "component").select("node", "component_id")
    out = signed.join(nodes, "node", "left")
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(known(F.col("doc_id")).alias("doc_id"), "n_shingles", "node", known(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null first), of that the smallest digest of a row.

    Rows are told apart by doc_id and a digest of all their columns, so what becomes of a row doesn't
    hang on other rows of its doc_id. Of rows that are equal in all columns one is put back. Rows
    without words are in no component and stay."""
    digest = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    d = docs.select(_id().alias("id"), digest.alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    signed, found = similar_components(docs, n, digest.alias("row_digest"))
    signed = signed.filter("n_shingles > 0")
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc_id", "row_digest")).alias("first"), F.count("*").alias("many"))
    nodes = nodes.join(found.withColumnRenamed("rep", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = nodes.groupBy("component").agg(F.min("first").alias("best"), F.sum("many").alias("many")).filter("many > 1")
    members = signed.join(nodes.select("node", "component").join(best.select("component", "best"), "component"), "node")
    stays = (F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.row_digest") == F.col("row_digest"))
    rows = members.groupBy(F.col("doc_id").alias("id"), F.col("row_digest").alias("digest")).agg(F.bool_or(stays).alias("stays"), F.count("*").alias("many"))
    gone = stage(rows.filter("NOT stays OR many > 1"), "gone")
    out = d.join(_few(gone.select("id", "digest")), ["id", "digest"], "left_anti").select("row")
    equal = gone.filter("stays").select("id", "digest")
    if equal.limit(1).count():
        out = out.unionByName(d.join(_few(equal), ["id", "digest"]).groupBy("id", "digest").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")


def op7_ngram_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
