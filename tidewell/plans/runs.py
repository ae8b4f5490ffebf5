"""Queries over runs, detector hits, issues and dead letters, which orders and line items stand for.

A run is an order: project is its priority, outcome its status with "O" as not labeled, its events
are its lines. A hit is a returned line; its detector is named by the ship year's parity and flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.timeutil import DAY, HOUR, micros, recency
from tidewell.operators import deadletters, graph, joins, keys, runs
from tidewell.runtime import table

QUERIES, ORACLE = {}, {}
#: 2000-01-01, a moment within the orders' years.
AS_OF = 946_684_800_000_000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


RUNS = """run AS (SELECT o_orderkey AS run_id, o_orderpriority AS project, CASE o_orderstatus WHEN 'F' THEN 'thrashed' WHEN 'P' THEN 'clean' END AS outcome, CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) END AS labeled_at,
epoch_us(o_orderdate) AS started, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS cust, 1 + o_orderkey % 200 AS event_count FROM orders)"""
HITS = """hit AS (SELECT l_orderkey AS run_id, CASE WHEN l_linestatus = 'F' THEN 'reread_same_file' ELSE 'edit_build_fail_revert' END AS detector, l_linenumber AS line, epoch_us(l_shipdate) AS ts, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'R')"""


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    open_ = F.col("o_orderstatus") == "O"
    started = micros(F.col("o_orderdate"))
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("project"), F.when(F.col("o_orderstatus") == "F", "thrashed").when(F.col("o_orderstatus") == "P", "clean").alias("outcome"),
        F.when(~open_, started).alias("labeled_at"), started.alias("started"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_custkey").alias("cust"), (1 + F.col("o_orderkey") % 200).alias("event_count"),
    )


def hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    detector = F.when(F.col("l_linestatus") == "F", "reread_same_file").otherwise("edit_build_fail_revert")
    return h.select(F.col("l_orderkey").alias("run_id"), detector.alias("detector"), F.col("l_linenumber").alias("line"), micros(F.col("l_shipdate")).alias("ts"), F.col("l_suppkey").alias("supp"))


@query(f"WITH {RUNS} SELECT run_id, project, CASE WHEN labeled_at IS NOT NULL AND outcome IS NOT NULL THEN outcome ELSE 'unlabeled' END AS label, started FROM run WHERE started >= {AS_OF - 1500 * DAY} ORDER BY started DESC, run_id LIMIT 50")
def runs_recent(spark, sf_dir):
    r = runs.select_runs(run_table(spark, sf_dir), since=AS_OF - 1500 * DAY)
    return keys.ranked_limit(r.select("run_id", "project", runs.outcome_label().alias("label"), "started"), [F.desc("started"), F.col("run_id")], 50)


@query(f"WITH {RUNS} SELECT run_id, project FROM run WHERE labeled_at IS NULL AND project = '1-URGENT'")
def runs_unlabeled(spark, sf_dir):
    return runs.select_runs(run_table(spark, sf_dir), project="1-URGENT", outcome="unlabeled").select("run_id", "project")


@query(f"WITH {RUNS} SELECT run_id, outcome FROM run WHERE labeled_at IS NOT NULL AND outcome IN ('thrashed','abandoned','reverted')")
def thrash_runs(spark, sf_dir):
    return runs.thrash_runs(run_table(spark, sf_dir)).select("run_id", "outcome")


@query(f"WITH {RUNS} SELECT project, count(*) AS runs, count(labeled_at) AS labeled, count(*) - count(labeled_at) AS unlabeled, round(sum(event_count)::DOUBLE / count(event_count), 6) AS avg_events FROM run GROUP BY 1")
def project_stats(spark, sf_dir):
    return runs.project_stats(run_table(spark, sf_dir)).withColumn("avg_events", F.round("avg_events", 6))


@query(f"WITH {RUNS} SELECT project, CASE WHEN labeled_at IS NOT NULL AND outcome IS NOT NULL THEN outcome ELSE 'unlabeled' END AS label, count(*) AS n FROM run GROUP BY 1, 2")
def outcome_breakdown(spark, sf_dir):
    return run_table(spark, sf_dir).groupBy("project", runs.outcome_label().alias("label")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS reads, count(*) FILTER (l_returnflag = 'A') AS writes FROM lineitem GROUP BY 1)
SELECT o_orderpriority AS project, round(sum(reads / writes::DOUBLE) / count(*), 6) AS ratio FROM h JOIN orders ON l_orderkey = o_orderkey WHERE writes > 0 GROUP BY 1""")
def read_write_ratio(spark, sf_dir):
    flag = F.col("l_returnflag")
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count_if(flag == "N").alias("reads"), F.count_if(flag == "A").alias("writes"))
    h = h.join(run_table(spark, sf_dir).select("run_id", "project"), "run_id")
    return runs.read_write_ratio(h).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {RUNS}, {HITS}, h AS (SELECT project, detector, count(DISTINCT run_id) AS hit_runs FROM hit JOIN run USING (run_id) GROUP BY 1, 2), t AS (SELECT project, count(*) AS runs FROM run GROUP BY 1)
SELECT project, detector, hit_runs, runs, round(hit_runs::DOUBLE / runs, 9) AS rate FROM h LEFT JOIN t USING (project)""")
def prevalence_rate(spark, sf_dir):
    r = run_table(spark, sf_dir)
    h = hit_table(spark, sf_dir).join(r.select("run_id", "project"), "run_id")
    return runs.prevalence(h, r).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {RUNS}, {HITS}, d AS (SELECT DISTINCT run_id, detector FROM hit) SELECT detector, count(*) FILTER (labeled_at IS NOT NULL AND outcome IN ('thrashed','abandoned','reverted')) AS failures,
count(*) FILTER (labeled_at IS NOT NULL AND outcome IN ('clean','landed','corrected')) AS clean, count(*) FILTER (labeled_at IS NULL) AS unlabeled FROM d JOIN run USING (run_id) GROUP BY 1""")
def labeled_support(spark, sf_dir):
    return runs.labeled_support(hit_table(spark, sf_dir), run_table(spark, sf_dir))


ISSUES = f"""{RUNS}, {HITS}, g AS (SELECT project, detector, count(DISTINCT run_id) AS hit_runs, count(*) AS hits, max(ts) AS last_seen, count(DISTINCT CASE WHEN outcome = 'thrashed' THEN run_id END) AS failures, count(DISTINCT CASE WHEN outcome = 'clean' THEN run_id END) AS clean FROM hit JOIN run USING (run_id) GROUP BY 1, 2),
t AS (SELECT project, count(*) AS runs FROM run GROUP BY 1),
i AS (SELECT *, hit_runs::DOUBLE / runs AS prevalence, CASE WHEN detector = 'reread_same_file' THEN 'inform' ELSE 'eliminate' END AS rung, CASE WHEN failures + clean = 0 THEN 0.0 ELSE 0.30 * (failures::DOUBLE / (failures + clean) - 0.5) END AS term, exp(-ln(2.0::DOUBLE) * greatest(0.0, ({AS_OF} - last_seen) / {DAY}.0::DOUBLE) / 14.0::DOUBLE) AS recency FROM g JOIN t USING (project)),
s AS (SELECT *, 0.35 * prevalence + 0.25 * least(1.0, ln(1 + hits::DOUBLE) / ln(21.0::DOUBLE)) + 0.25 * (CASE WHEN rung = 'inform' THEN 1.0::DOUBLE / 3 ELSE 1.0 END) + 0.08 * term + 0.07 * recency AS score FROM i)"""


def issues(spark, sf_dir) -> DataFrame:
    r = run_table(spark, sf_dir)
    h = hit_table(spark, sf_dir).join(r, "run_id")
    g = h.groupBy("project", "detector").agg(
        F.countDistinct("run_id").alias("hit_runs"), F.count("*").alias("hits"), F.max("ts").alias("last_seen"),
        F.countDistinct(F.when(F.col("outcome") == "thrashed", F.col("run_id"))).alias("failures"), F.countDistinct(F.when(F.col("outcome") == "clean", F.col("run_id"))).alias("clean"),
    )
    g = g.join(r.groupBy("project").agg(F.count("*").alias("runs")), "project")
    rung = F.when(F.col("detector") == "reread_same_file", "inform").otherwise("eliminate")
    g = g.withColumns({"prevalence": F.col("hit_runs") / F.col("runs"), "rung": rung, "term": runs.label_term(F.col("failures"), F.col("clean")), "recency": recency(F.col("last_seen"), AS_OF)})
    return g.withColumn("score", runs.issue_score(F.col("prevalence"), F.col("hits"), F.col("rung"), F.col("term"), F.col("recency")))


@query(f"WITH {ISSUES} SELECT project, detector, hits, failures, clean, round(score, 6) AS score FROM s")
def issue_scores(spark, sf_dir):
    return issues(spark, sf_dir).select("project", "detector", "hits", "failures", "clean", F.round("score", 6).alias("score"))


@query(f"""WITH {ISSUES} SELECT project, detector, CASE WHEN runs < 2 THEN 'needs_more_data' WHEN (clean > failures AND clean >= 3) THEN 'suppressed' WHEN rung = 'inform' AND score >= 0.55 THEN 'propose_fix' WHEN rung <> 'inform' AND score >= 0.30 THEN 'propose_fix' ELSE 'monitor' END AS decision FROM s""")
def decision_ladder(spark, sf_dir):
    i = issues(spark, sf_dir)
    d = runs.decision(F.col("score"), F.col("rung"), F.lit("passed"), F.col("failures"), F.col("clean"), F.col("runs"))
    return i.select("project", "detector", d.alias("decision"))


@query(f"""WITH {RUNS} SELECT run_id, round(exp(-ln(2.0::DOUBLE) * greatest(0.0, ({AS_OF} - started) / {DAY}.0::DOUBLE) / 14.0::DOUBLE), 9) AS recency FROM run""")
def recency_decay(spark, sf_dir):
    return run_table(spark, sf_dir).select("run_id", F.round(recency(F.col("started"), AS_OF), 9).alias("recency"))


@query(f"""WITH {RUNS}, {HITS}, h AS (SELECT run_id, bool_or(detector = 'reread_same_file') AS ctx, bool_or(detector = 'edit_build_fail_revert') AS ver FROM hit GROUP BY 1), p AS (SELECT l_orderkey AS run_id, count(*) AS permissions FROM lineitem WHERE l_tax >= 0.08 GROUP BY 1),
x AS (SELECT run.*, coalesce(ctx, false) AS ctx, coalesce(ver, false) AS ver, coalesce(permissions, 0) AS permissions FROM run LEFT JOIN h USING (run_id) LEFT JOIN p USING (run_id)),
b AS (SELECT run_id, unnest([x FOR x IN [CASE WHEN ctx THEN 'context_failure' END, CASE WHEN permissions > 0 THEN 'constraint_failure' END, CASE WHEN ver THEN 'verification_failure' END,
CASE WHEN (labeled_at IS NOT NULL AND outcome = 'thrashed') OR (NOT coalesce(labeled_at IS NOT NULL AND outcome = 'clean', false) AND event_count >= 150) THEN 'planning_failure' END, CASE WHEN NOT ctx AND permissions = 0 AND NOT ver AND NOT ((labeled_at IS NOT NULL AND coalesce(outcome = 'thrashed', false)) OR (NOT coalesce(labeled_at IS NOT NULL AND outcome = 'clean', false) AND event_count >= 150)) THEN 'unclassified' END] IF x IS NOT NULL]) AS bucket FROM x)
SELECT bucket, count(*) AS n FROM b GROUP BY 1""")
def failure_taxonomy(spark, sf_dir):
    hit = F.col("l_returnflag") == "R"
    detector = F.when(hit, F.when(F.col("l_linestatus") == "F", "reread_same_file").otherwise("edit_build_fail_revert"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set(detector).alias("hits"), F.count_if(F.col("l_tax") >= 0.08).alias("permissions"))  # two names at most
    r = run_table(spark, sf_dir).join(lines, "run_id", "left")
    found = runs.failure_buckets(F.coalesce("hits", F.array().cast("array<string>")), F.col("outcome"), runs.labeled(), F.coalesce("permissions", F.lit(0)), F.col("event_count"))
    return r.select(F.explode(found).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {HITS} SELECT run_id, detector, min(line) AS line, count(*) AS repeats FROM hit GROUP BY 1, 2")
def distinct_hits(spark, sf_dir):
    return hit_table(spark, sf_dir).groupBy("run_id", "detector").agg(F.min("line").alias("line"), F.count("*").alias("repeats"))


@query(f"""WITH {HITS}, o AS (SELECT detector, supp, count(DISTINCT run_id) AS c, min(ts) AS a, max(ts) AS b FROM hit WHERE ts < {AS_OF} GROUP BY 1, 2), n AS (SELECT detector, supp, count(DISTINCT run_id) AS c, min(ts) AS a, max(ts) AS b FROM hit WHERE ts >= {AS_OF} GROUP BY 1, 2)
SELECT detector, supp, CASE WHEN o.c IS NULL THEN 1 ELSE o.c + coalesce(n.c, 0) END AS recurrence_count, least(o.a, n.a) AS first_seen, greatest(o.b, n.b) AS last_seen FROM o FULL JOIN n USING (detector, supp)""")
def issue_upsert(spark, sf_dir):
    h = hit_table(spark, sf_dir)
    fold = lambda d, n, a, b: d.groupBy("detector", "supp").agg(F.countDistinct("run_id").alias(n), F.min("ts").alias(a), F.max("ts").alias(b))
    old = fold(h.filter(F.col("ts") < AS_OF), "recurrence_count", "first_seen", "last_seen")
    new = fold(h.filter(F.col("ts") >= AS_OF), "new_hits", "seen_from", "seen_to")
    return keys.issue_update(old, new, ["detector", "supp"])


@query(f"WITH {RUNS}, n AS (SELECT * FROM run WHERE started >= {AS_OF - 900 * DAY}), o AS (SELECT * FROM run WHERE started < {AS_OF - 900 * DAY}) SELECT cust, project, min(run_id) AS run_id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.cust = n.cust AND o.project = n.project) GROUP BY 1, 2")
def insert_absent(spark, sf_dir):
    r = run_table(spark, sf_dir)
    old, new = r.filter(F.col("started") < AS_OF - 900 * DAY), r.filter(F.col("started") >= AS_OF - 900 * DAY)
    return keys.insert_absent(old, new, ["cust", "project"], [F.col("run_id")]).select("cust", "project", "run_id")


@query(f"WITH {RUNS}, n AS (SELECT cust, max(run_id) AS run_id FROM run WHERE outcome = 'clean' GROUP BY 1), o AS (SELECT cust, min(run_id) AS run_id FROM run GROUP BY 1) SELECT cust, coalesce(n.run_id, o.run_id) AS run_id FROM o LEFT JOIN n USING (cust)")
def upsert_by_key(spark, sf_dir):
    r = run_table(spark, sf_dir)
    old = r.groupBy("cust").agg(F.min("run_id").alias("run_id"))
    new = r.filter(F.col("outcome") == "clean").groupBy("cust").agg(F.max("run_id").alias("run_id"))
    return keys.upsert(old, new, ["cust"])


@query(f"WITH {RUNS} SELECT cust, run_id, started FROM run QUALIFY row_number() OVER (PARTITION BY cust ORDER BY started DESC, run_id DESC) = 1")
def latest_run_per_key(spark, sf_dir):
    return keys.dedupe(run_table(spark, sf_dir), ["cust"], [F.desc("started"), F.desc("run_id")]).select("cust", "run_id", "started")


LETTERS = """letter AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'schema_violation' WHEN '2-HIGH' THEN 'malformed_json' ELSE 'timeout' END AS failure_reason, (o_custkey % 5)::INT AS retry_count, CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) END AS resolved_at, epoch_us(o_orderdate) AS next_retry_at FROM orders)"""


def letters(spark, sf_dir) -> DataFrame:
    at = micros(F.col("o_orderdate"))
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "schema_violation").when(F.col("o_orderpriority") == "2-HIGH", "malformed_json").otherwise("timeout")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), reason.alias("failure_reason"), (F.col("o_custkey") % 5).cast("int").alias("retry_count"), F.when(F.col("o_orderstatus") == "F", at).alias("resolved_at"), at.alias("next_retry_at"))


@query(f"WITH {LETTERS} SELECT id, retry_count, next_retry_at + CASE retry_count WHEN 0 THEN 300 WHEN 1 THEN 1800 END * 1000000 AS then_at FROM letter WHERE resolved_at IS NULL AND failure_reason NOT IN ('schema_violation','malformed_json') AND next_retry_at <= {AS_OF} AND retry_count < 3")
def due_retries(spark, sf_dir):
    d = deadletters.due(letters(spark, sf_dir), AS_OF)
    return d.select("id", "retry_count", deadletters.next_retry(F.col("next_retry_at"), F.col("retry_count")).alias("then_at"))


@query(f"WITH {LETTERS} SELECT id, failure_reason FROM letter WHERE resolved_at IS NULL ORDER BY next_retry_at DESC, id LIMIT 100")
def unresolved_newest(spark, sf_dir):
    d = letters(spark, sf_dir).filter(F.col("resolved_at").isNull())
    return keys.ranked_limit(d, [F.desc("next_retry_at"), F.col("id")], 100).select("id", "failure_reason")


CHAIN = f"""{RUNS}, link AS (SELECT run_id AS id, CASE WHEN started - lag(started) OVER w <= {120 * DAY} THEN lag(run_id) OVER w END AS parent FROM run WINDOW w AS (PARTITION BY cust ORDER BY started, run_id))"""


@query(f"WITH RECURSIVE {CHAIN}, up AS (SELECT id, id AS root FROM link WHERE parent IS NULL UNION ALL SELECT link.id, up.root FROM link JOIN up ON link.parent = up.id) SELECT id, root FROM up")
def logical_run_roots(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("cust").orderBy("started", "run_id")
    r = run_table(spark, sf_dir)
    near = F.col("started") - F.lag("started").over(w) <= 120 * DAY
    return graph.chain_roots(r.select(F.col("run_id").alias("id"), F.when(near, F.lag("run_id").over(w)).alias("parent")))


NAMES = "ch AS (SELECT DISTINCT lower(p_brand) AS name0, 'shop.' || replace(lower(p_brand), '#', '') || '.' || lower(p_type) AS name FROM part)"
SUBS = "sub AS (SELECT s_suppkey AS consumer, CASE WHEN s_suppkey % 11 = 0 THEN 'shop.ghost' ELSE 'shop.brand' END || (1 + s_suppkey % 7) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '.economy' END AS channel, CASE WHEN s_suppkey % 2 = 0 THEN 'prefix' ELSE 'exact' END AS match_type FROM supplier)"


def names(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("shop."), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("."), F.lower("p_type")).alias("name")).distinct()


def subscriptions(spark, sf_dir) -> DataFrame:
    even = F.col("s_suppkey") % 2 == 0
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("consumer"), F.concat(F.when(F.col("s_suppkey") % 11 == 0, "shop.ghost").otherwise("shop.brand"), (1 + F.col("s_suppkey") % 7).cast("string"), F.when(even, "").otherwise(".economy")).alias("channel"), F.when(even, "prefix").otherwise("exact").alias("match_type")
    )


@query(f"WITH {NAMES}, {SUBS}, n AS (SELECT DISTINCT name FROM ch) SELECT consumer, channel, match_type, name FROM sub JOIN n ON n.name = sub.channel OR (match_type = 'prefix' AND starts_with(n.name, sub.channel || '.'))")
def prefix_theta_join(spark, sf_dir):
    return joins.match_subscriptions(subscriptions(spark, sf_dir), names(spark, sf_dir), "channel", "match_type", "name").select("consumer", "channel", "match_type", "name")


@query(f"WITH {NAMES}, {SUBS}, n AS (SELECT DISTINCT name FROM ch) SELECT consumer, channel FROM sub WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.name = sub.channel OR (match_type = 'prefix' AND starts_with(n.name, sub.channel || '.')))")
def coverage_missing(spark, sf_dir):
    s = subscriptions(spark, sf_dir)
    hit = joins.match_subscriptions(s, names(spark, sf_dir), "channel", "match_type", "name").select("consumer", "channel").distinct()
    return joins.orphans(s.select("consumer", "channel"), hit, ["consumer", "channel"])


@query(f"WITH {NAMES}, {SUBS}, n AS (SELECT DISTINCT name FROM ch) SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM sub WHERE n.name = sub.channel OR (match_type = 'prefix' AND starts_with(n.name, sub.channel || '.')))")
def orphan_schemas(spark, sf_dir):
    hit = joins.match_subscriptions(subscriptions(spark, sf_dir), names(spark, sf_dir), "channel", "match_type", "name").select("name").distinct()
    return joins.orphans(names(spark, sf_dir), hit, ["name"])


@query("SELECT p_partkey AS channel FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def silent_channels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("channel"))
    seen = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 45).select(F.col("l_partkey").alias("channel"))
    return joins.orphans(p, seen, ["channel"])


@query("""WITH r AS (SELECT n_name, count(*) AS suppliers, count(*) FILTER (s_acctbal < 0) AS negative FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_name AS project, suppliers, negative, CASE WHEN negative >= 2 AND suppliers - negative >= 2 THEN true ELSE false END AS contrast FROM r""")
def contrast_sets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = s.groupBy(F.col("n_name").alias("project")).agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") < 0).alias("negative"))
    return r.withColumn("contrast", (F.col("negative") >= 2) & (F.col("suppliers") - F.col("negative") >= 2))


@query("""WITH c AS (SELECT l_orderkey AS cohort, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY cohort) AS width FROM c) SELECT cohort, class, n, width::BIGINT AS width FROM t WHERE n >= 0.6 * width AND width >= 2""")
def majority_class(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cohort"), F.col("l_returnflag").alias("class")).agg(F.count("*").alias("n"))
    c = c.withColumn("width", F.sum("n").over(Window.partitionBy("cohort")))
    return c.filter((F.col("n") >= 0.6 * F.col("width")) & (F.col("width") >= 2))


@query(f"""WITH {RUNS}, {HITS}, f AS (SELECT cust, detector, min(started) AS started FROM hit JOIN run USING (run_id) GROUP BY 1, 2) SELECT run_id, cust, detector FROM (SELECT DISTINCT run_id, detector FROM hit) JOIN run USING (run_id) JOIN f USING (cust, detector) WHERE run.started = f.started""")
def first_hit_per_customer(spark, sf_dir):
    h = hit_table(spark, sf_dir).select("run_id", "detector").distinct().join(run_table(spark, sf_dir), "run_id")
    first = h.groupBy("cust", "detector").agg(F.min("started").alias("started"))
    return h.join(first, ["cust", "detector", "started"], "left_semi").select("run_id", "cust", "detector")


@query(f"""WITH {RUNS} SELECT run_id, CASE WHEN event_count >= 180 AND outcome = 'thrashed' THEN 'thrashed' WHEN outcome IS NULL AND event_count >= 10 THEN 'abandoned' WHEN price > 200000 THEN 'clean' END AS inferred FROM run""")
def behavior_inference(spark, sf_dir):
    r = run_table(spark, sf_dir)
    c = F.col
    loops = F.when((c("event_count") >= 180) & (F.coalesce(c("outcome"), F.lit("")) == "thrashed"), 3).otherwise(0)
    reason = F.when(c("outcome").isNull(), "idle_timeout").otherwise("ended")
    inferred = runs.inferred_outcome(loops, F.lit(0), F.lit(0), F.lit(0.5), c("event_count"), F.lit(False), (c("price") > 200000) & c("outcome").isNotNull(), reason)
    return r.select("run_id", F.coalesce(inferred, F.when(c("price") > 200000, "clean")).alias("inferred"))


@query(f"WITH {RUNS} SELECT project, started // {7 * DAY} AS week, count(*) AS n, sum(price) AS spend, sum(sum(price)) OVER (PARTITION BY project ORDER BY started // {7 * DAY}) AS spent FROM run GROUP BY 1, 2")
def weekly_spend(spark, sf_dir):
    from pyspark.sql import Window

    g = run_table(spark, sf_dir).groupBy("project", F.floor(F.col("started") / (7 * DAY)).alias("week")).agg(F.count("*").alias("n"), F.sum("price").alias("spend"))
    return g.withColumn("spent", F.sum("spend").over(Window.partitionBy("project").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"WITH {RUNS} SELECT project, count(*) FILTER (started >= {AS_OF - 365 * DAY} AND started < {AS_OF}) AS year, count(*) FILTER (started >= {AS_OF - 30 * DAY} AND started < {AS_OF}) AS month, count(*) FILTER (started >= {AS_OF - 24 * HOUR} AND started < {AS_OF}) AS day FROM run GROUP BY 1")
def recent_activity(spark, sf_dir):
    since = lambda d: F.count_if((F.col("started") >= AS_OF - d) & (F.col("started") < AS_OF))
    return run_table(spark, sf_dir).groupBy("project").agg(since(365 * DAY).alias("year"), since(30 * DAY).alias("month"), since(24 * HOUR).alias("day"))
