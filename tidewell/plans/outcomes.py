"""Queries over outcomes of branches, calls and runs, with their SQL twins.

A branch is an order and its commits are lines of the order: flag N has landed, A has not, R is a
merge and counts as neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import stats, wording
from tidewell.operators import branches
from tidewell.plans.events import EVENTS, events
from tidewell.runtime import table

QUERIES, ORACLE = {}, {}
RATE_IN, RATE_OUT = 0.3, 1.2
BRANCHES = """c AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'N') AS landed, count(*) FILTER (l_returnflag = 'A') AS unlanded FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS branch, o_custkey AS project, coalesce(landed, 0) AS landed, coalesce(unlanded, 0) AS unlanded, o_orderpriority LIKE '1%' AS merged, o_orderpriority LIKE '3%' AS reverted, o_orderstatus = 'O' AS live FROM orders LEFT JOIN c USING (o_orderkey)),
b AS (SELECT branch, project, landed, unlanded, CASE WHEN branch % 11 = 0 THEN 'git_branch_gone' WHEN branch % 13 = 0 THEN 'git_no_merge_base' WHEN landed > 0 AND unlanded > 0 THEN 'git_partial_squash' WHEN landed > 0 AND reverted THEN 'git_revert_on_main' WHEN landed > 0 THEN 'git_squash_equiv' WHEN merged THEN 'git_merged_into_main' WHEN unlanded = 0 THEN 'git_empty_branch' WHEN live THEN 'git_pending' ELSE 'git_discarded_unmerged' END AS source FROM f),
o AS (SELECT *, CASE WHEN source IN ('git_no_merge_base', 'git_pending') THEN NULL WHEN source = 'git_revert_on_main' THEN 'reverted' WHEN source IN ('git_partial_squash', 'git_squash_equiv', 'git_merged_into_main') THEN 'landed' ELSE 'abandoned' END AS outcome, CASE WHEN source = 'git_no_merge_base' THEN 'low' WHEN source IN ('git_branch_gone', 'git_partial_squash', 'git_discarded_unmerged') THEN 'medium' ELSE 'high' END AS confidence FROM b)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def classified(spark, sf_dir) -> DataFrame:
    of = lambda flag, name: F.count_if(F.col("l_returnflag") == flag).alias(name)
    commits = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(of("N", "landed"), of("A", "unlanded"))
    b, p = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(commits, "o_orderkey", "left")
    o = branches.outcome(b % 11 != 0, b % 13 != 0, F.col("landed"), F.col("unlanded"), p.startswith("1"), p.startswith("3"), F.col("o_orderstatus") == "O")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(b.alias("branch"), F.col("o_custkey").alias("project"), n("landed"), n("unlanded"), o.alias("o")).select("branch", "project", "landed", "unlanded", "o.*")


@query(f"WITH {BRANCHES} SELECT branch, project, landed, unlanded, outcome, source, confidence FROM o")
def branch_outcomes(spark, sf_dir):
    return classified(spark, sf_dir)


@query(f"WITH {BRANCHES} SELECT project, CASE WHEN source = 'git_empty_branch' THEN 'abandoned_empty' WHEN source = 'git_discarded_unmerged' THEN 'abandoned_discarded' ELSE coalesce(outcome, 'pending') END AS bucket, count(*) AS n FROM o GROUP BY 1, 2")
def branch_rollup(spark, sf_dir):
    return branches.rollup(classified(spark, sf_dir), "project")


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, value::DOUBLE AS v, event_type <> 'error' AS ok, event_id % 900 / 1000000.0 * {RATE_IN} + event_id % 200 / 1000000.0 * {RATE_OUT} AS cost FROM ev),
a AS (SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS n_ok, round(count(*) FILTER (ok) / count(*)::DOUBLE, 9) AS success_rate, round(avg(v) FILTER (ok), 6) AS mean, round(avg(cost) FILTER (ok), 9) AS mean_cost FROM r GROUP BY 1),
s AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM r WHERE ok AND v IS NOT NULL),
p AS (SELECT user_id, round(median(v), 6) AS p50, min(v) FILTER (k = greatest(1, (95 * m + 50) // 100)) AS p95 FROM s GROUP BY 1)
SELECT a.*, p50, p95 FROM a LEFT JOIN p USING (user_id)""")
def latency_summary(spark, sf_dir):
    """Calls by user: success rate, and of those that went well mean, median, 95th percentile by rounded rank, and cost."""
    i, ok = F.col("event_id"), F.col("event_type") != "error"
    e = events(spark, sf_dir).select("user_id", F.col("value").cast("double").alias("v"), ok.alias("ok"), wording.cost(i % 900, i % 200, RATE_IN, RATE_OUT).alias("cost"))
    of = lambda c: F.avg(F.when(F.col("ok"), F.col(c)))
    a = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.round(F.count_if("ok") / F.count("*"), 9).alias("success_rate"), F.round(of("v"), 6).alias("mean"), F.round(of("cost"), 9).alias("mean_cost"))
    p = stats.ranked_percentiles(e.filter("ok"), "user_id", F.col("v"), ["median", "p95_rounded"])
    return a.join(p.select("user_id", F.round("median", 6).alias("p50"), F.col("p95_rounded").alias("p95")), "user_id", "left")


@query(f"""WITH {EVENTS}, t AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2), u AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) FILTER (k <= 4) AS tools, sum(n)::BIGINT AS events, coalesce(sum(n) FILTER (event_type = 'error'), 0)::BIGINT AS bad, coalesce(sum(n) FILTER (event_type = 'purchase'), 0)::BIGINT AS bought FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM t) GROUP BY 1)
SELECT user_id, '  outcome=' || CASE WHEN user_id % 3 = 0 THEN 'clean' ELSE '?' END || '  agent_kind=shop  events=' || events || '  close_reason=idle' || CASE WHEN bad > 2 THEN '  thrash_loops=' || (bad - 2) ELSE '' END || CASE WHEN bad > 0 THEN '  bash_fail_rate=' || printf('%.2f', bad * 100 // events / 100.0) ELSE '' END || CASE WHEN bought > 5 THEN '  has_commit=yes' ELSE '' END || '  top_tools=' || tools AS line FROM u""")
def run_lines(spark, sf_dir):
    """Users' runs, a line each; the number of types is bounded, so are the arrays."""
    t = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    most = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("event_type").alias("name"), "n")))
    only = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("n"))), F.lit(0))
    u = t.groupBy("user_id").agg(most.alias("tools"), F.sum("n").alias("events"), only("error").alias("bad"), only("purchase").alias("bought"))
    rate = F.when(F.col("bad") > 0, F.floor(F.col("bad") * 100 / F.col("events")) / 100)
    line = wording.run_line(F.when(F.col("user_id") % 3 == 0, "clean"), F.lit("shop"), F.col("events"), F.lit("idle"), F.col("bad") - 2, rate, F.col("bought") > 5, F.col("tools"))
    return u.select("user_id", line.alias("line"))
