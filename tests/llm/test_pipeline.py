"""Each stage of the corpus pipeline against brute force on its own input."""

import math
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import ngram_join
from tidewell.runtime import stage, table

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage, written in between."""
    docs, out = table(spark, DIR, "documents"), {}
    for name, step in corpus_pipeline.STAGES:
        result = stage(step(spark, docs, DIR), "out")
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name


def test_classifier_stage(spark, stages):
    before, after = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in table(spark, DIR, "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert {i for i in labels if labels[i] == 1} <= kept
    assert sum(i in kept for i in labels if labels[i] == 0) <= 0.03 * len(labels)
    assert kept <= {r.doc_id for r in before.collect()}


def test_line_stage(stages):
    before, after = stages["line dedup"]
    want = {(i, sha) for i, _, _, sha in brute.line_dedup(rows(before))}
    got = {(r.doc_id, r.s) for r in after.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")).collect()}
    assert got == want


def test_near_stage(stages):
    before, after = stages["n-gram Jaccard join"]
    groups = {c for _, _, c in brute.jaccard_components(rows(before))}
    assert sorted(i for i, _ in rows(after)) == sorted(groups)


def test_mix_stage(stages):
    before, after = stages["mixing sources to target weights"]
    words = {r.doc_id: len(brute.words(r.text)) for r in before.collect()}
    source = {r.doc_id: r.source for r in before.collect()}
    times = Counter(i for i, _ in rows(after))
    size, taken = defaultdict(int), defaultdict(int)
    for i, n in words.items():
        size[source[i]] += n
        taken[source[i]] += n * times[i]
    targets = brute.targets(size)
    assert max(times.values()) <= 3
    for s in size:
        assert math.fabs(taken[s] - targets[s]) <= max(n for i, n in words.items() if source[i] == s)
    texts = dict(rows(before))
    assert all(texts[i] == t for i, t in rows(after))


def test_pack_stage(stages):
    before, after = stages["best-fit packing"]
    pieces = after.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(i for i, _ in rows(before))
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in pieces) // 2048) + 1


def test_odd_documents_pass_every_stage(spark, tmp_path):
    schema = table(spark, DIR, "documents").schema
    good = " ".join(f"w{i}" for i in range(60))
    odd = [(None, good, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, good, "en", "a", 5), (3, good, "en", "a", 5), (4, good + " x", "en", None, 5)]
    docs = spark.createDataFrame(odd, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert ngram_join.jaccard_join(docs).count() == len(odd)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("sequence_id").distinct().count() == 1


def test_foreign_columns_pass_every_stage(spark, stages):
    """Columns with the names that operators make come out of each stage as they went in."""
    names = ["row", "id", "digest", "score", "gone", "gone_digest", "target", "last", "whole", "edge", "cut", "source_size", "epochs", "turn", "_size", "_pick", "_bucket", "_key", "_s", "s",
             "_doc", "_doomed", "kept_text", "n_lines", "n_dropped", "node", "component", "check", "stays", "many", "n_shingles", "row_digest", "rep", "length", "sequence_id", "w", "cap", "level"]
    docs = table(spark, DIR, "documents").limit(300).withColumns({c: F.lit(777) for c in names})
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert out.select(*[F.count_if(F.col(c) != 777).alias(c) for c in names]).first().asDict() == dict.fromkeys(names, 0), name
    assert corpus_pipeline.pack(spark, docs, DIR).count() >= 300


def test_empty_tables_pass_every_stage(spark, tmp_path):
    table(spark, DIR, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, DIR, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
