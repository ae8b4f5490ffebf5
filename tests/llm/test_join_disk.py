"""The n-gram join keeps what it has on disk at once in proportion to its input."""

import random
import time
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from tidewell.llm import ngram_join
from tidewell.runtime import lean_stage


def rows_of(join):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in join.collect()}


def test_a_common_passage_makes_no_block(spark, monkeypatch):
    """Documents that share a passage and nothing else meet in long lists; their whole sets tell them apart before any is sent."""
    rng = random.Random(4)
    own = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage = own(30)
    rows = [(i, " ".join([*own(50), *passage, *own(i % 9)])) for i in range(60)]
    rows += [(100 + i, " ".join([*passage, *own(i % 3)])) for i in range(9)]  # these are similar
    written, stage = {}, ngram_join.stage

    def counted(df, name):
        out = stage(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stage", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.jaccard_join(docs)) == set(brute.jaccard_components(rows))
    assert written["apart"] > 0 and written["members"] <= 9


def test_shuffles_go_when_their_table_is_written(spark):
    local = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {p for p in local.rglob("shuffle_*.data")}
    known = files()
    out = lean_stage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    ends = time.time() + 10
    while files() - known and time.time() < ends:
        time.sleep(0.2)
    assert not files() - known
    assert out.count() == 700


@pytest.mark.parametrize(("most", "join"), [(10, "LeftAnti"), (2, "LeftSemi")])
def test_texts_stay_where_few_documents_are_copies(spark, monkeypatch, most, join):
    """More owners than are broadcast, but few others: the others are."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", most)
    owned, plans = ngram_join._owned, []

    def seen(*given):
        out = owned(*given)
        plans.append(out[0]._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(ngram_join, "_owned", seen)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    rows += [(50 + i, rows[i][1]) for i in range(5)] + [(60 + i, rows[i][1] + " x") for i in range(5, 9)] + [(70, ""), (71, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.jaccard_join(docs)) == set(brute.jaccard_components(rows))
    assert join in plans[0]
