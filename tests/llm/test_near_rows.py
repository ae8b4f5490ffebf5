"""The near-copy stage keeps one row of each group, whatever the ids of its rows."""

from collections import Counter

import corpus_pipeline
from tidewell.runtime import stage, table

DIR = "/root/testdata/sf0.01"


def test_one_row_of_each_group_stays(spark):
    copy, clean, alone = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [
        (None, copy, "en", "s", 1), (3, copy, "en", "s", 1), (3, copy, "en", "s", 1), (4, copy + " x", None, None, 1), (9, clean, "en", "s", 1),
        (9, copy, "en", "s", 1), (5, alone, "en", "s", 1), (5, alone, "en", "s", 1), (5, alone + " y", "en", "s", 1), (6, None, "en", "s", 0), (6, None, "en", "s", 0), (None, "", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, table(spark, DIR, "documents").schema)
    after = corpus_pipeline.dedup_near(spark, stage(docs, "docs"), DIR)
    assert after.dtypes == docs.dtypes
    got = Counter((r.doc_id, r.text) for r in after.collect())
    assert got.pop((5, alone), 0) + got.pop((5, alone + " y"), 0) == 1
    assert got == Counter({(None, copy): 1, (9, clean): 1, (6, None): 2, (None, ""): 1})


def test_null_ids_with_equal_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, x, "s", 1) for x in ("de", "en", None, "fr")] + [(7, text, "en", "s", 1)], table(spark, DIR, "documents").schema)
    assert [r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, DIR).collect()] == [None]
