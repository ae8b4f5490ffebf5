"""op8 where one doc_id has several texts: each keeps its own marks."""

import pytest

from tidewell.llm import substring_dedup

PASSAGE = " ".join(f"p{i}" for i in range(20))
SHORT, OTHER, LONG = "only three words", " ".join(f"c{i}" for i in range(60)), " ".join(f"z{i}" for i in range(40)) + f" {PASSAGE}"


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("group", [500_000, 40])
def test_one_id_with_several_texts(spark, monkeypatch, limit, group):
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", limit)
    texts = [(1, PASSAGE), (2, LONG), (2, LONG), (2, SHORT), (2, OTHER), (2, None), (3, f"{PASSAGE} end"), (None, OTHER), (None, SHORT)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, group=group).collect())
    head = LONG.removesuffix(f" {PASSAGE}")
    # OTHER of id 2 repeats that of the null id, which counts as the smallest
    assert got == sorted([(1, 0, PASSAGE), (2, 20, head), (2, 20, head), (2, 0, SHORT), (2, 60, ""), (2, 0, ""), (3, 20, "end"), (0, 0, OTHER), (0, 0, SHORT)])


def test_clean_words_at_the_places_of_marks_stay(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (2, f"{PASSAGE} tail"), (2, OTHER)], "doc_id long, text string")
    assert {(r.doc_id, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect()} == {(1, PASSAGE), (2, "tail"), (2, OTHER)}
