"""Periodic runs, whitening and decontamination against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewell.llm import decontamination, mixing, periodic_runs, whitening
from tidewell.llm.suffixes import DyadicSuffixes, WaveletTree

DIR = "/root/testdata/sf0.001"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_by_hand(w, least=24, cubes=3):
    out = {}
    for p in range(1, len(w) // cubes + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, cubes * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((a, n, p) for (a, n), p in out.items())


def periodic_text(rng):
    t = []
    for _ in range(rng.randrange(1, 6)):
        letters, q = rng.choice([1, 2, 3, 5]), rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 40, 64])
        base = [rng.randrange(letters) for _ in range(q)]
        if rng.random() < 0.4 and q > 3:  # a period that is nearly periodic itself
            base = [base[i % rng.randrange(1, 4)] for i in range(q - 1)] + [rng.randrange(9)]
        n = int(q * rng.choice([2.5, 3, 3.2, 4, 6])) + rng.randrange(3)
        t += (base * (n // q + 1))[:n] + [rng.randrange(30) for _ in range(rng.choice([0, 0, 5]))]
    return [b"%d" % x for x in t]


@pytest.mark.parametrize("seed", range(4))
def test_runs_by_hand(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 4))]
        assert periodic_runs.text_runs(texts) == [runs_by_hand(t) for t in texts]


def test_runs_of_long_periodic_texts():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 2000:
        a, b = b, b + a
    for t in ([b"x"] * 30_000, [b"%d" % (i % 997) for i in range(30_000)], b):
        got = periodic_runs.text_runs([t])[0]
        assert got == (runs_by_hand(t) if len(t) < 5000 else [(0, 30_000, 1 if t[0] == t[1] else 997)])


def test_suffixes_and_wavelet_tree():
    rng = np.random.default_rng(1)
    codes, ends = rng.integers(0, 3, 200), np.array([0, 50, 50, 199, 200])
    s = DyadicSuffixes(codes, ends)
    own = lambda i: (int(s.text[i]), *codes[i : s.end[i]].tolist())
    assert [own(i) for i in s.order] == sorted(own(i) for i in range(200))
    for k in range(len(s.ranks)):
        left, right = s.interval(k, np.arange(200))
        for i in range(0, 200, 7):
            assert {int(x) for x in s.order[left[i] : right[i]]} == {j for j in range(200) if own(j)[: 1 + 2**k] == own(i)[: 1 + 2**k]}
    values = rng.permutation(77)
    tree = WaveletTree(values)
    a, b, x = rng.integers(0, 78, 500), rng.integers(0, 78, 500), rng.integers(0, 90, 500)
    a, b = np.minimum(a, b), np.maximum(a, b)
    assert tree.successor(a, b, x).tolist() == [min((v for v in values[i:j] if v >= y), default=77) for i, j, y in zip(a, b, x, strict=True)]


def test_runs_query_on_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "x " * 23, "x " * 24, "a b\nc " * 9, *[b" ".join(periodic_text(rng)).decode() for _ in range(25)], "long " * 5000]
    ids = [None, None, *range(len(texts) - 2)]
    rows = list(zip(ids, texts, range(len(texts)), strict=True)) + [(7, texts[9], 99)]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    expected = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        r = runs_by_hand(w) if n < 4000 else [(0, n, 1)]
        gone = {k for s, m, q in r for k in range(s + q, s + m)}
        best = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        expected.append((i, len(r), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % x for x in r).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = periodic_runs.run_digests(d, prepare=periodic_runs.planted)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert periodic_runs.run_digests(d.limit(0)).count() == 0
    whole = {(r.doc_id, r.runs): r.text for r in periodic_runs.collapsed(d).collect()}
    assert whole[(None, 0)] is None and whole[(2, 4)] == "x " * 23 and whole[(3, 5)] == "x" and len(whole) == len(rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, [1], 2) for i, v in rows], "vec_id long, embedding array<float>, x array<int>, component int")


@pytest.mark.parametrize("dim", [1, 3, 40])
def test_whitening_by_hand(spark, dim):
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(300, dim)) * np.linspace(3, 1, dim)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[0].tolist()) for i in range(50)] + [(None, x[1].tolist()), (2005, None), (2006, [float("nan")] * dim), (2007, [None] + [1.0] * (dim - 1)), (2008, [float("inf")] * dim), (2009, [])]
    d = vectors(spark, rows)
    good = [(i, np.floor(256 * np.array(v + [0.0] * (dim - len(v)), np.float64))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([v for _, v in good]), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    got = whitening.whiten(d).collect()
    k = min(4, dim)
    assert len(got) == len(good) * k
    sign = None
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for i, v in good:
        for c in range(1, k + 1):
            r = by[(i, c)][0]
            assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
            exact = (v - s / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
            assert abs(abs(r.whitened) - abs(exact)) < 1e-8
            assert abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-10 and r.identity_error < 1e-10
    for c in range(1, k + 1):  # one sign for all rows
        sign = {np.sign(by[(i, c)][0].whitened * ((v - s / n) @ q[:, c - 1])) for i, v in good if abs((v - s / n) @ q[:, c - 1]) > 1}
        assert len(sign) == 1


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one vector: no direction
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 20 and flat[0].identity_error < 1e-9  # rank one
    huge = whitening.whiten(vectors(spark, [(i, [1e30 * (i % 2), float(i)]) for i in range(8)])).collect()
    assert {r.vec_id for r in huge} == set(range(8)) and any(r.deviation is None for r in huge)


def test_chebyshev_filter_damps_and_lifts():
    v = np.diag([10.0, 9.0, 3.0, 2.0, 1.0])
    q = np.ones((5, 1))
    y = np.abs(whitening.filtered(lambda z: v @ z, q, v @ q, 0.5, 3.5, 10.0, 6)[:, 0])
    assert abs(y[0] - 1) < 1e-9 and y[1] > 0.2 and (y[2:] < 1e-3).all()


def leaks_by_hand(docs, items, size=10):
    windows = {}
    for name, t in items:
        w = ITEM_WORD.findall((t or "").encode().lower().decode())
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if name is None else str(name))
    out = []
    for i, t in docs:
        w = ITEM_WORD.findall((t or "").encode().lower().decode())
        hit, names = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j : j + k])) in windows:
                    names |= windows[x]
                    hit |= set(range(j, j + k))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 300, "pass_bytes": 700, "shard_bytes": 200}])
def test_leaks_by_hand(spark, options):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "ö", "x1", "É", "zz"]) + str(rng.randrange(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 9, 10, 11, 12, 30, 30])] + [(None, "null-id item"), (3, None), (4, "lone"), (4, "lone")]
    docs = [(i, random.Random(i).choice([" ", "-", ", "]).join(word() for _ in range(60)) + " " + " ".join(t or "" for _, t in rng.sample(items, 2))) for i in range(30)]
    docs += [(None, None), (5, ""), (5, items[8][1]), (5, items[8][1]), (None, "NULL id! item"), (77, " ".join([items[9][1]] * 40))]
    d = spark.createDataFrame([(i, t, [1], 2) for i, t in docs], "doc_id long, text string, items array<int>, row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(d, b, **options)
    assert sorted(map(str, map(tuple, decontamination.digests(found).collect()))) == leaks_by_hand(docs, items)
    best = {r.item_id: r.n_words for r in decontamination.longest_matches(found).collect()}
    assert best["8"] == 30 and best["9"] == 30 and best[""] == 3
    clean = decontamination.decontaminated(d, b, **options)
    assert clean.columns == d.columns and clean.count() == sum(x.endswith("False)") for x in leaks_by_hand(docs, items))
    assert decontamination.contamination(d.limit(0), b).count() == 0
    assert decontamination.digests(decontamination.contamination(d, b.limit(0))).filter("contaminated").count() == 0


def test_shard_finds_longest_matches():
    rng = random.Random(9)
    for _ in range(60):
        item = [b"%d" % rng.randrange(4) for _ in range(20)]
        docs = [[b"%d" % rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(4)]
        items = decontamination.Items([("i", item)], 3)
        codes = np.array([items.known.get(w, 0) for t in docs for w in [*t, b""]], np.int64)
        longest, where, first, last = decontamination.Shard(codes, 20).search(items)
        for j in range(20):
            most = max((k for k in range(1, 21 - j) for t in docs for a in range(len(t) - k + 1) if t[a : a + k] == item[j : j + k]), default=0)
            assert longest[j] == most
            if most:
                assert codes[where[j] : where[j] + most].tolist() == items.codes[j : j + most].tolist()
            assert last[j] - first[j] == (sum(t[a : a + 3] == item[j : j + 3] for t in docs for a in range(len(t) - 2)) if j <= 17 else 0)


def test_given_tables(spark):
    docs, items = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    got = decontamination.op13_suffix_array_decontamination(spark, DIR)
    assert sorted(map(str, map(tuple, got.collect()))) == leaks_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert whitening.op11_chebyshev_whitening(spark, DIR).count() == 4 * spark.read.parquet(f"{DIR}/embeddings.parquet").count()


@pytest.mark.parametrize("third", [lambda i: (None, "w " * 100), lambda i: (7, "w " * 100), lambda i: (None, f"{i} " * 100), lambda i: (7, f"{i} " * 100)])
def test_mix_of_equal_and_null_ids_keeps_targets(spark, third):
    """A third of all rows with no id or one id, of equal or of different texts: taken words stay within a row of the target."""
    rows = [(i, f"{i} " * 100, "ab"[i % 2]) for i in range(400)] + [(*third(i), "c") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for s in mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("epochs").alias("most"), F.count("*").alias("n")).collect():
        assert abs(s.taken - s.target) <= 50 and s.most <= 3 and s.n == 200
    taken = {r.source: r["count"] * 100 for r in mixing.take(d).groupBy("source").count().collect()}
    for s in mixing.mix(d).select("source", "target").distinct().collect():
        assert abs(taken[s.source] - s.target) <= 50
