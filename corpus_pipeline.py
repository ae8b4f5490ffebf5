"""A corpus pipeline of five stages, each calling one operator of ``tidewell.llm``.

Every stage reads what its predecessor kept and returns the columns of ``documents``; the last one
returns the packed pieces. Stages hand over through Parquet files, so a lost executor costs a part
of one stage.

Defined cases: columns beyond those of ``documents`` pass through all stages but the last, whatever
their names; null and empty texts are scored, have no line or n-gram to share, are taken 0 words by
the mix and so end there; rows with null or repeated ids count as each operator's docstring says; an
empty table gives empty stages, and an empty ``labels`` table accepts every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import classifier, line_dedup, mixing, ngram_join, packing
from tidewell.llm.tokens import vocabulary_path
from tidewell.runtime import stage, table

KEEP_SCORE = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to labels of these documents, accepts."""
    machine = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = classifier.scored(docs, machine)
    return scored.filter(F.col(scored.columns[-1]) >= KEEP_SCORE).drop(scored.columns[-1])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that five documents or more share, except in the line's holder."""
    cleaned = line_dedup.dedup(docs, 5)
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group that similar n-gram sets link."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences with their places."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality classifier", classify), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_near), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: Neither the classifier nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
