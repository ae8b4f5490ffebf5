"""The numbered operators against brute force, and on odd rows."""

import array
import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat_format, classifier, line_dedup, metric_search, mixing, ngram_join, packing, quality_rules, queries, sharding, substring_dedup
from tidewell.llm.cuckoo import CuckooFilter
from tidewell.llm.tokens import WordTokens, vocabulary_path

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string, shard int, rank int, part int"
ONE_LINE = "this is a line of more than forty characters, shared"


def documents(spark, rows):
    """(doc_id, text[, source]) with further columns whose names clash with those that operators make."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 9.0, 7, "k", 3, 1, 2) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    random.seed(3)
    word = lambda: random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(random.randrange(40))
    base = [word() for _ in range(120)]
    near = [" ".join(w if random.random() > 0.01 else word() for w in base) for _ in range(12)]
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", "   \n\t ", "x", "one two", "one\ttwo ", "ÄÖ é ß ﬁ \x85   x", "a b", ONE_LINE, *[f"{i}\n{ONE_LINE.upper()}  \n{ONE_LINE}" for i in range(6)], " ".join(base), " ".join(base), *near, long, long[:-40],
             "### $$$ %% " * 40, "same same same " * 40, "y" * 5000, "<|endoftext|> ♦ text", *[" ".join(base[:60]) + f" tail{i} " + " ".join(base[60:]) for i in range(5)]]
    rows = [(i, t, [None, "a", "b", "Z"][i % 4]) for i, t in enumerate(texts)]
    return rows


def docs_of(rows):
    return [(r[0], r[1]) for r in rows]


def both(spark, odd):
    """The odd rows and a given table as (rows, DataFrame)."""
    given = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source").collect()]
    return [(odd, documents(spark, odd)), (given, documents(spark, given))]


def test_empty_tables(spark):
    empty = documents(spark, []).limit(0)
    assert sharding.shard_rows(empty).count() == 0
    assert quality_rules.judge(empty).count() == 0
    assert line_dedup.clean(line_dedup.insert(None, empty), empty).count() == 0
    assert packing.pack(empty, vocabulary_path()).count() == 0
    assert ngram_join.jaccard_join(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.scored(empty.drop("score"), classifier.train(empty, labels)).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = metric_search.quantized(v)
    assert metric_search.top_k(q.withColumnRenamed("vec_id", "query_id"), q).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.conversation_digests(chat_format.format_turns(turns)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (5, None), (None, None)]
    d = documents(spark, rows)
    n = len(rows)
    assert sharding.shard_rows(d, 4, load_factor=1.0).select("shard", "slot").distinct().count() == n
    assert quality_rules.judge(d).count() == line_dedup.clean(line_dedup.insert(None, d), d).count() == n
    assert packing.pack(d, vocabulary_path()).count() == substring_dedup.remove_repeats(d).count() == mixing.mix(d).count() == n
    j = ngram_join.jaccard_join(d).collect()
    assert Counter(r.component_id for r in j) == Counter({None: 5, 5: 1})
    m = classifier.fit(np.zeros((0, classifier.HASHED + classifier.N_FORM)), np.zeros(0))
    assert {r.score_ for r in classifier.scored(d, m).collect()} == {0.5}


# 1


@pytest.mark.parametrize("factor", [1.0, 1.25])
def test_sharding(spark, odd, factor):
    for rows, d in both(spark, odd):
        got = sharding.shard_rows(d, 16, load_factor=factor).collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1 if factor == 1.0 else max(sizes) <= math.ceil(factor * len(rows) / 16)
        text = {i: (t or "").encode() for i, t, *_ in rows}
        assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)


@pytest.mark.parametrize("factor", [1.0, 1.25])
def test_sharding_against_a_plain_ring(spark, odd, factor):
    """Every row's shard and slot by walking the ring in plain Python: own rows of each arc first, then overflow clockwise."""
    for rows, d in both(spark, odd):
        points = sharding.ring_points(spark, 16, 64)
        slim = d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), F.pmod(F.xxhash64(F.lit("key"), "doc_id"), F.lit(1 << 32)).alias("pos"))
        arcs = defaultdict(list)
        for r in slim.withColumn("sub", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(64))).collect():
            arcs[bisect.bisect_left(points, (r.pos, -1)) % len(points)].append((r.sub, r.pos, r.doc_id, r.crc, r["size"]))
        n = len(rows)
        room = [n // 16 + (s < n % 16) for s in range(16)] if factor == 1.0 else [math.ceil(factor * n / 16)] * 16
        shards, left = [[] for _ in range(16)], []
        for arc, (_, shard) in enumerate(points):
            own = sorted(arcs[arc])
            free = room[shard] - len(shards[shard])
            shards[shard] += own[:free]
            left += [(arc, x) for x in own[free:]]
        for arc, x in left:
            step = arc + 1
            while len(shards[points[step % len(points)][1]]) >= room[points[step % len(points)][1]]:
                step += 1
            shards[points[step % len(points)][1]].append(x)
        want = {(x[2], s, slot) for s, own in enumerate(shards) for slot, x in enumerate(own)}
        got = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(d, 16, load_factor=factor).collect()}
        assert got == want


def test_sharding_moves_few_keys(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = (sharding.shard_rows(d, n, load_factor=1.25).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (16, 17))
    moved = a.join(b, "doc_id").filter("s16 <> s17").count()
    assert moved < 20_000 * 3 / 17  # a modulo would move 16 of 17


# 2


@pytest.mark.parametrize("kind", ["random", "equal", "deep", "odd"])
def test_metric_search(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    if kind == "deep":  # levels of small cells; a third of all vectors are equal
        for name, value in {"PAGE": 40, "ROUTERS": 3, "FANOUT": 4, "SLICE": 300}.items():
            monkeypatch.setattr(metric_search, name, value)
        rows = [(i, [0.5, 0.25, 0.0, 1.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(2400)]
    elif kind == "random":
        rows = [(i, rng.normal(size=8).tolist()) for i in range(7000)]
    elif kind == "equal":
        rows = [(i, [0.5, 0.25] if i % 3 else rng.normal(size=2).tolist()) for i in range(6000)]
    else:
        rows = [(0, [1.0, 2.0]), (20, None), (40, [float("nan"), 1.0]), (60, [1.0, None]), (1, [3.0]), (2, [float("inf"), 0.0]), (80, [-1.0, 0.0, 5.0]), (None, [9.0, 9.0]), (3, []), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = metric_search.quantized(df)
    asked = v.filter("vec_id % 20 = 0 and vec_id >= 0").withColumnRenamed("vec_id", "query_id")
    got = defaultdict(list)
    for r in sorted(metric_search.top_k(asked, v, 20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    fine = [(i, x) for i, x in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    dim = max(len(x) for _, x in fine)
    x = np.array([[math.floor(64 * c) for c in v] + [0] * (dim - len(v)) for _, v in fine])
    ids = np.array([-(1 << 63) if i is None else i for i, _ in fine])
    for i, q in zip(ids.tolist(), x, strict=True):
        if i >= 0 and i % 20 == 0:
            s = x @ q
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:20]
            assert got[i] == [(None if ids[k] == -(1 << 63) else int(ids[k]), int(s[k])) for k in order], i


# 3


def test_quality_measures(spark, odd):
    for rows, d in both(spark, odd):
        got = {r.doc_id: r.asDict() for r in quality_rules.judge(d).collect()}
        for i, t, *_ in rows:
            want = brute.measures(t)
            assert {k: got[i][k] for k in want if k in got[i]} == {k: v for k, v in want.items() if k in got[i]}, i
            assert not (got[i]["kept"] and want["base_failed"])


def test_bad_host_is_refused(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 else "short", "good") for i in range(200)] + [(1000 + i, "short" if i < 95 else good, "bad") for i in range(100)]
    got = quality_rules.judge(documents(spark, rows))
    refused = {(r.host, r.host_refused) for r in got.select("host", "host_refused").distinct().collect()}
    assert refused == {("good", False), ("bad", True)}
    assert got.filter("host = 'bad' and kept").count() == 0 and got.filter("host = 'good' and kept").count() == 180


def test_repeats_with_shared_upper_bits(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_LOW", 56)  # eight bits are left, so different windows clash
    d = documents(spark, [(1, " ".join(f"w{i % 200}" for i in range(500))), (2, " ".join(f"v{i}" for i in range(600)) + " v1 v2 v3 v4")])
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(d).collect()}
    assert got == {i: brute.measures(t)["n_repeat_words"] for i, t in docs_of([(1, " ".join(f"w{i % 200}" for i in range(500))), (2, " ".join(f"v{i}" for i in range(600)) + " v1 v2 v3 v4")])}


# 4


def test_line_dedup(spark, odd):
    for rows, d in both(spark, odd):
        got = line_dedup.clean(line_dedup.insert(None, d), d)
        got = {(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in got.collect()}
        assert got == set(brute.line_dedup(docs_of(rows)))


def dropped_by(state, d):
    return {(r.doc_id, r.n_dropped) for r in line_dedup.clean(state, d, 2).collect() if r.n_dropped}


def test_line_dedup_is_reversible(spark, odd):
    d = documents(spark, odd)
    first, second = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1")
    a = line_dedup.insert(None, first)
    ab = line_dedup.insert(a, second)
    back = line_dedup.delete(ab, second)
    counts = lambda s: sorted((bytes(r.key), r.n_docs, r.holder) for r in s.counts.collect() if r.n_docs > 1)
    assert counts(back) == counts(a) and dropped_by(back, first) == dropped_by(a, first)
    whole = line_dedup.insert(None, d, turns=3)
    assert counts(ab) == counts(whole) == counts(line_dedup.insert(back, second))
    kept = {bytes(r.key) for r in a.postings.collect()}
    gone = {bytes(r.key) for r in ab.postings.collect()} - kept
    (f,) = [CuckooFilter.load(r.filter) for r in back.filters.collect()]  # few keys: one shard
    assert all(k in f for k in kept) and sum(k in f for k in gone) <= 1
    assert counts(line_dedup.delete(a, second)) == counts(a)  # not held: nothing changes


def test_only_repeated_lines_reach_the_exact_table(spark):
    rows = [(i, "\n".join([f"line {i} {k} " + "x" * 40 for k in range(5)] + [f"shared {i // 2} " + "y" * 40])) for i in range(40)]
    state = line_dedup.insert(None, documents(spark, rows), turns=4)
    assert state.postings.count() == 240 and {r.n_docs for r in state.counts.filter("n_docs > 1").collect()} == {2}
    assert state.counts.filter("n_docs > 1").count() == 20 and state.counts.count() <= 22


def test_line_dedup_goes_through_the_filters(spark, monkeypatch):
    """Filters that forget what they hold change the result: repeats in later turns are then taken as first sights."""
    d = documents(spark, [(i, ONE_LINE) for i in range(12)])
    assert len(dropped_by(line_dedup.insert(None, d, turns=4), d)) == 11
    ask = line_dedup._ask
    monkeypatch.setattr(line_dedup, "_ask", lambda filters, *rest: ask(filters.limit(0), *rest))
    one_each = [(i, ONE_LINE) for i in range(4)]
    state = None
    for row in one_each:
        state = line_dedup.insert(state, documents(spark, [row]))
    assert dropped_by(state, documents(spark, one_each)) == set()


def test_deletion_does_not_hide_a_line_of_the_same_fingerprint(spark):
    places, f = {}, CuckooFilter(line_dedup.BUCKETS)
    for i in range(400_000):
        line = f"a line of forty characters and more, {i:08d}"
        key = line_dedup.line_keys(line, 40)[0]
        mark, a, b = f._places(key)
        if other := places.get(at := (mark, min(a, b), max(a, b))):
            break
        places[at] = line
    rows = lambda text, ids: documents(spark, [(i, text) for i in ids])
    state = line_dedup.insert(None, rows(other, [1]))
    state = line_dedup.insert(state, rows(line, [2]))
    assert [r.own for r in state.counts.collect()] == [False]
    state = line_dedup.delete(state, rows(other, [1]))
    state = line_dedup.insert(state, rows(line, [5, 6]))
    assert [(r.n_docs, r.holder) for r in state.counts.collect()] == [(3, 6)]
    state = line_dedup.delete(state, rows(line, [2, 5, 6]))
    assert state.counts.count() == state.postings.count() == 0
    state = line_dedup.insert(line_dedup.insert(state, rows(line, [7])), rows(line, [8]))
    assert [(r.n_docs, r.holder) for r in state.counts.collect()] == [(2, 8)]


@pytest.mark.parametrize("zeros", [1, 2])
def test_line_dedup_of_keys_that_end_in_zero_bytes(spark, zeros):
    line = next(x for n in range(10_000_000) if line_dedup.line_keys(x := f"{ONE_LINE} {n}", 40)[0].endswith(bytes(zeros)))
    rows = [(n, f"{n}\n{line}\n{ONE_LINE}") for n in range(6)]
    d = documents(spark, rows)
    got = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.clean(line_dedup.insert(None, d), d).collect()}
    assert got == {(n, str(n), 3, 2) for n in range(5)} | {(5, rows[5][1], 3, 0)}


def test_line_dedup_passes_columns_on(spark):
    names = ["row", "id", "kept_text", "n_lines", "n_dropped", "holder", "doomed", "of", "_doc", "_doomed"]
    d = documents(spark, [(i, f"{i}\n{ONE_LINE}") for i in range(6)]).withColumns({c: F.lit(777) for c in names})
    out = line_dedup.dedup(d)
    assert out.columns == d.columns and {r[c] for r in out.collect() for c in names} == {777}
    assert {r[c] for r in line_dedup.clean(line_dedup.insert(None, d), d).collect() for c in names} == {777}


def test_line_dedup_beyond_the_broadcast_bound(spark, odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST", 0)
    d = documents(spark, odd)
    got = line_dedup.clean(line_dedup.insert(None, d, turns=2), d)
    assert {(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in got.collect()} == set(brute.line_dedup(docs_of(odd)))


def test_cuckoo_filter():
    rng = random.Random(1)
    keys = [rng.randbytes(16) for _ in range(30_000)]
    f = CuckooFilter(2000)
    for k in keys:
        f.add(k)
    f = CuckooFilter.load(f.dump())
    assert all(k in f for k in keys) and len(f.tables) > 1
    for k in keys[:15_000]:
        assert f.remove(k)
    assert all(k in f for k in keys[15_000:])
    assert sum(rng.randbytes(16) in f for _ in range(20_000)) < 60


# 5


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "<\\|turn|> <\\\\|end|> [\\INST] \\", "a\nb", "", None, "<<SYS>> <\\<SYS>>", "[INST[INST]]", "😀é"]
    rows = [(c, t, ["user", "assistant", "<|end|>"][(c + t) % 3], texts[(c * 5 + t) % len(texts)]) for c in range(6) for t in range(7)] + [(None, None, None, None), (9, 1, "assistant", "x"), (9, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit(1), "mask": F.lit(2)})
    formatted = chat_format.format_turns(df)
    got = {r.conv_id: r for r in chat_format.conversation_digests(formatted).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    for r in formatted.collect():
        assert r.piece.count("<|turn|>") == 1 and r.piece.count("<|end|>") == 1 and "[INST]" not in r.piece and "</s>" not in r.piece


def test_typed_parts(spark):
    part = lambda kind, **k: {"kind": kind, "text": k.get("text"), "ref": k.get("ref"), "width": k.get("width"), "height": k.get("height"), "seconds": k.get("seconds"), "pages": k.get("pages")}
    parts = [part("text", text="see <|im"), part("text", text="age|> "), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=1.5), part("text", text="end"), part("document", ref="c.pdf", pages=2), part("odd", ref="d")]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = sorted(chat_format.format_turns(df).collect(), key=lambda r: r.turn)
    assert [(a.kind, a.ref, a.tokens) for a in r[0].attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("document", "d", 256)]
    assert all(r[0].piece[a["at"] :].startswith(chat_format.PLACEHOLDERS[a.kind]) for a in r[0].attachments)
    assert r[0].piece.count("<|image|>") == 1 and chat_format.read_turn(r[0].piece)[1] == "see <|image|> <|image|><|audio|>end<|document|><|document|>"
    assert [x.piece for x in r[1:]] == ["<|turn|>user<|text|><|end|>\n"] * 2


# 6


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    for rows, d in both(spark, odd):
        ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in rows}
        got = packing.pack(d, vocabulary_path()).collect()
        sequences, seen = defaultdict(list), defaultdict(list)
        for r in got:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(array.array("I", part).tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
            sequences[r.sequence_id].append((r.offset, r.length))
            seen[r.doc_id].append(r.length)
        assert {i: sum(x) for i, x in seen.items()} == {i: len(x) for i, x in ids.items()}
        for s in sequences.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_fullest_is_the_best_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(6)}
        room = rng.randrange(1, 90)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(sums) and all(Counter(got)[x] <= counts[x] for x in got)


def test_tokens_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    t, w, rng = Tokenizer.from_file(vocabulary_path()), WordTokens(vocabulary_path()), random.Random(4)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x180), 0x300, 0x3A3, 0x130, 0x1F600, 0x2028, 0x3000, 9, 10, 0x1C, 0x85]] + ["'s", "'LL ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(120)) for _ in range(400)]
    assert [list(array.array("I", x)) for x in w.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# 7


def test_ngram_join(spark, odd):
    for rows, d in both(spark, odd):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(d).collect()}
        assert got == set(brute.jaccard_components(docs_of(rows)))


def test_ngram_join_chains_and_bounds(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join([*words[i : i + 60 + i % 7], f"x{i}"])) for i in range(0, 300, 3)]
    rows += [(1000 + i, " ".join(words[:100][: 20 + i] + [f"y{i}"] * (i % 5))) for i in range(60)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(documents(spark, rows)).collect()}
    assert got == set(brute.jaccard_components(rows))


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for chunk in (400, 20):
        monkeypatch.setattr(ngram_join, "CHUNK_SETS", chunk)
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(documents(spark, rows)).collect()}
        assert got == set(brute.jaccard_components(rows))


def test_prefix_tree_finds_all():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = np.sort(rng.choice(10**6, 60, replace=False)).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(30, 61)], rng.choice(10**6, rng.integers(0, 25)).astype(np.uint64)])) for _ in range(25)] + [base, base.copy()]
        tree = ngram_join.PrefixTree(base[:0])
        for i, s in enumerate(sets):
            tree.add(s, i, len(s))
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, base)) >= 75 * len(np.union1d(s, base))]
        assert sorted(x for _, x in tree.search([base])) == want


def test_first_parts_share_enough():
    for n in range(1, 400):
        for m in range(math.ceil(0.75 * n), math.floor(n / 0.75) + 1):
            o = ngram_join.need(n, m)
            shared = min(ngram_join.first_part(n) - (n - o), ngram_join.first_part(m) - (m - o))
            assert shared >= ngram_join.least_shared(n) and shared >= ngram_join.least_shared(m), (n, m)


# 8


@pytest.mark.parametrize("group", [500_000, 40])
def test_substring_dedup(spark, odd, group):
    for rows, d in both(spark, odd):
        got = {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(d, group=group).collect()}
        assert got == set(brute.window_dedup(docs_of(rows)))


def test_spans_are_maximal(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    d = documents(spark, [(1, f"a b {passage} c"), (2, f"x {passage} y {passage} z")])
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring_dedup.remove_repeats(d).collect()}
    assert got == {1: [], 2: [(1, 31), (32, 62)]}


# 9


def test_factor_machine_identity():
    rng = np.random.default_rng(1)
    m = classifier.FactorMachine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)), np.zeros(1), np.ones(1))
    x = rng.normal(size=(4, 6))
    want = [0.3 + r @ m.w + sum(m.v[i] @ m.v[j] * r[i] * r[j] for i in range(6) for j in range(i + 1, 6)) for r in x]
    assert np.allclose(m.raw(x), want)


def test_classifier_learns_what_is_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.queries()["op9_factor_machine"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    right = got.filter("predicted = quality").count() / got.count()
    assert right > 0.97
    flags = queries.queries()["op9_factor_machine"](spark, DIR).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in flags)


# 10


def test_mixing(spark, odd):
    for rows, d in both(spark, odd):
        got = mixing.mix(d).collect()
        size, taken = defaultdict(int), defaultdict(int)
        words = {i: len(brute.words(t)) for i, t, _ in rows}
        source = {i: s for i, _, s in rows}
        for r in got:
            assert r["size"] == words[r.doc_id] and r.taken <= 3 * r["size"] and r.taken == r.epochs * r["size"]
            size[source[r.doc_id]] += r["size"]
            taken[source[r.doc_id]] += r.taken
        targets = brute.targets(size)
        for r in got:
            assert r.source_size == size[source[r.doc_id]] and math.isclose(r.target, targets[source[r.doc_id]], rel_tol=1e-9)
        largest = {s: max(words[i] for i in words if source[i] == s) for s in size}
        assert all(abs(taken[s] - targets[s]) <= largest[s] for s in size)
        again = {(r.doc_id, r.taken) for r in mixing.mix(d.repartition(7)).collect()}
        assert again == {(r.doc_id, r.taken) for r in got}
        whole = mixing.take(d)
        assert whole.columns == d.columns and whole.count() == sum(r.epochs for r in got)
        # epochs before fractions: within a source, numbers of times differ by one at most
        per = defaultdict(set)
        for r in got:
            if r["size"]:
                per[source[r.doc_id]].add(r.epochs)
        assert all(max(x) - min(x) <= 1 for x in per.values())


def test_schema_types(spark):
    want = {
        "op1": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op2": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op6": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op10": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    }
    for name, f in queries.queries().items():
        if (n := name.split("_")[0]) in want:
            assert dict(f(spark, DIR).dtypes) == want[n]
