"""Quality rules on the level of hosts.

Each document is measured and judged by rules of its own; the failures of each rule are summed up
by host (here: ``source``); each host's rate is shrunk towards all hosts by a beta prior whose two
parameters are fitted to the hosts' rates by their moments; and the host's verdict goes back to
its documents. A host is refused as a whole if the shrunk rate of any rule reaches
``host_limit``; a document of an accepted host is kept if it fails no rule itself.

All is computed inside rows by DataFrame functions, so no text is shuffled; by host only sums are.
Repeated words are found through 64-bit digests of the three-word windows: the upper 40 bits with
the position below them are sorted as plain numbers, neighbours compared in full, and a document
in which two different windows share those bits is counted over again by full digests.

Defined cases: null or empty texts have no words, so they fail the base rule; null is a host of
its own; repeated rows count as often as they occur; with one host the prior is that host's rate
with the weight of one document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.text import SPACE, words
from tidewell.runtime import let, stage, table

#: Per hundred words: symbols, and per hundred lines: repeated ones.
SYMBOL_LIMIT, LINE_LIMIT, HOST_LIMIT = 10, 50, 0.6
_LOW = 24  # bits for the position


def _marked(h: Column) -> Column:
    """Positions (any order) of the digests that occur twice or more in ``h``."""

    def by_sorted(keys: Column) -> Column:
        at = lambda k: F.shiftright(F.try_element_at(keys, k), _LOW)
        low = lambda k: F.element_at(keys, k).bitwiseAND((1 << _LOW) - 1).cast("int")
        n = F.size(keys)
        same = lambda i, j: (at(i) == at(j)) & (F.element_at(h, low(i) + 1) == F.element_at(h, low(j) + 1))
        prev = lambda i: (i > 1) & same(F.greatest(i - 1, F.lit(1)), i)
        nxt = lambda i: (i < n) & same(i, F.least(i + 1, n))
        return F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: prev(i) | nxt(i)), low)

    def mixed(keys: Column) -> Column:
        """Two neighbours share the upper bits but differ in full."""
        full = lambda i: F.element_at(h, F.element_at(keys, i).bitwiseAND((1 << _LOW) - 1).cast("int") + 1)
        clash = lambda i: (F.shiftright(F.element_at(keys, i), _LOW) == F.shiftright(F.element_at(keys, i + 1), _LOW)) & (full(i) != full(i + 1))
        return (F.size(keys) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(keys) - 1, F.lit(1))), clash)

    def in_full(pairs: Column) -> Column:
        n, p = F.size(pairs), lambda i: F.element_at(pairs, i)
        prev = lambda i: (i > 1) & (p(F.greatest(i - 1, F.lit(1)))["h"] == p(i)["h"])
        nxt = lambda i: (i < n) & (p(F.least(i + 1, n))["h"] == p(i)["h"])
        return F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: prev(i) | nxt(i)), lambda i: p(i)["at"])

    # the sign goes with the upper bits: shifting right keeps it
    keys = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, _LOW), _LOW).bitwiseOR(i.cast("long"))))
    slow = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), in_full)
    fast = let(keys, lambda k: F.when(mixed(k), slow).otherwise(by_sorted(k)))
    return F.when(F.size(h) >= 1 << _LOW, slow).otherwise(fast)


def _repeat_words(w: Column) -> Column:
    """How many words lie in three-word windows found twice or more."""
    window = lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    h = F.transform(F.sequence(F.lit(1), F.size(w) - 2), window)
    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))
    count = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(let(_marked(x), covered))
    return F.when(F.size(w) < 4, 0).otherwise(let(h, count)).cast("long")


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    per_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
    return F.struct(
        let(words(text), per_words).alias("w"),
        F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )


def measured(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.col("source").alias("host"), measures(F.col("text")).alias("m"))
    return d.select("doc_id", "host", "m.w.n_words", "m.word_chars", "m.n_symbols", F.col("m.l.dup").alias("n_dup_lines"), "m.w.n_repeat_words", F.col("m.l.n").alias("n_lines"))


def rules(symbol_limit: int = SYMBOL_LIMIT, line_limit: int = LINE_LIMIT) -> dict[str, Column]:
    """name -> true where a document fails."""
    return {
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols_failed": 100 * F.col("n_symbols") > symbol_limit * F.col("n_words"),
        "lines_failed": 100 * F.col("n_dup_lines") > line_limit * F.col("n_lines"),
    }


def beta_prior(n: Column, failed: Column) -> tuple[Column, Column]:
    """Aggregates for alpha and beta of a prior over hosts' failure rates, by the method of moments.

    Without spread between hosts, or beyond what a beta law can have, its weight is one document
    to the least and a million at most."""
    rate = failed / n
    mean, var = F.avg(rate), F.var_pop(rate)
    weight = F.least(F.greatest(F.coalesce(F.try_divide(mean * (1 - mean), var) - 1, F.lit(1.0)), F.lit(1.0)), F.lit(1e6))
    return mean * weight, (1 - mean) * weight


def host_verdicts(d: DataFrame, names: list[str], host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, host_rate, host_refused), one row per host; host_rate is its worst rule's."""
    sums = d.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.sum(F.col(x).cast("long")).alias(x) for x in names])
    prior = []
    for x in names:
        a, b = beta_prior(F.col("host_docs"), F.col(x))
        prior += [a.alias(f"{x}_a"), b.alias(f"{x}_b")]
    both = sums.crossJoin(F.broadcast(sums.agg(*prior)))  # a single row
    shrunk = [(F.col(x) + F.col(f"{x}_a")) / (F.col("host_docs") + F.col(f"{x}_a") + F.col(f"{x}_b")) for x in names]
    worst = F.greatest(*shrunk)
    return both.select("host", "host_docs", worst.alias("host_rate"), (worst >= host_limit).alias("host_refused"))


def judge(docs: DataFrame, *, host_limit: float = HOST_LIMIT, symbol_limit: int = SYMBOL_LIMIT, line_limit: int = LINE_LIMIT) -> DataFrame:
    """Measures, verdict of each rule, of the host and of both for every document."""
    failing = rules(symbol_limit, line_limit)
    d = stage(measured(docs).withColumns(failing), "measures")
    hosts = host_verdicts(d, list(failing), host_limit).withColumnRenamed("host", "h")
    out = d.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    own = ~F.col("base_failed") & ~F.col("symbols_failed") & ~F.col("lines_failed")
    return out.withColumn("kept", own & ~F.col("host_refused"))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select(*cols)
