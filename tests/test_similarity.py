"""Similarity and novelty of items against the reference's definitions, by brute force."""

import math
import re
from collections import Counter

from tidewell.functions import text
from tidewell.plans import texts

ITEMS = ["The quick brown fox jumps over the lazy dog", "A quick brown fox, and a lazy dog!", "Sum of an array of n integers", "sum of integers", "abc", None, "Größe_1 über 42 x", "größe_1 42 the quick"]


def vectors(items):
    terms = []
    for t in items:
        w = [x for x in re.findall(r"\b\w\w+\b", (t or "").lower()) if x not in text.STOP_WORDS]
        terms.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    n, df = len(items), Counter(x for t in terms for x in t)
    for t in terms:
        v = {x: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[x])) + 1) for x, k in t.items() if df[x] <= 0.95 * n}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        yield {x: y / length for x, y in v.items()}


def fivegram(a, b):
    a, b = ({s[i : i + 5] for i in range(len(s) - 4)} for s in (re.sub(r"\s+", " ", (t or "").lower()) for t in (a, b)))
    return len(a & b) / len(a | b) if a | b else 0.0


def test_similarities_are_the_references(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    v, n = list(vectors(ITEMS)), len(ITEMS)
    t = {(i, j): sum(v[i][x] * v[j].get(x, 0) for x in v[i]) for i in range(n) for j in range(n) if i != j}
    c = {(i, j): 0.55 * s + 0.35 * fivegram(ITEMS[i], ITEMS[j]) for (i, j), s in t.items()}
    got = {(r.a, r.b): r.cosine for r in texts.tfidf_cosine_pairs(spark, str(tmp_path)).collect()}
    assert got == {k: round(s, 6) for k, s in t.items() if s and k[0] < k[1]}
    got = {(r.a, r.b): r.composite for r in texts.composite_similarity(spark, str(tmp_path)).collect()}
    assert got == {k: round(s, 6) for k, s in c.items() if s and k[0] < k[1]}
    rows = texts.novelty_composite(spark, str(tmp_path)).collect()
    want = [1 - sum(c[i, j] for j in range(n) if j != i) / (n - 1) for i in range(n)]
    assert all(abs(r.novelty - want[r.item_id]) < 1e-8 for r in rows) and sorted(r.item_id for r in rows) == list(range(n))
    assert [r.novelty for r in rows] == sorted(r.novelty for r in rows)


def test_one_item_has_no_novelty(spark, tmp_path):
    spark.createDataFrame([(1, "alone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert texts.novelty_composite(spark, str(tmp_path)).count() == 0
