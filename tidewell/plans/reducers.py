"""Reducers behind boards of running sessions, over the event table, with their SQL twins.

A session is a user, an iteration a day, a case one of 20 numbers; an event's type is its verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text, wording
from tidewell.functions.timeutil import DAY, HOUR
from tidewell.operators import keys
from tidewell.plans.events import _FINGER, EVENTS, events
from tidewell.runtime import table

QUERIES, ORACLE = {}, {}
RES = f"""{EVENTS}, res AS (SELECT *, user_id AS session, us // {DAY} AS iteration, CASE WHEN event_id % 3 = 0 THEN 'dp-' ELSE 'cf-' END || (event_id % 20) AS case_id, CASE event_type WHEN 'purchase' THEN 'AC' WHEN 'error' THEN 'CE' WHEN 'view' THEN 'WA' ELSE 'TLE' END AS verdict FROM ev)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def results(spark, sf_dir) -> DataFrame:
    t, i = F.col("event_type"), F.col("event_id")
    e = events(spark, sf_dir)
    verdict = F.when(t == "purchase", "AC").when(t == "error", "CE").when(t == "view", "WA").otherwise("TLE")
    case = F.concat(F.when(i % 3 == 0, "dp-").otherwise("cf-"), (i % 20).cast("string"))
    return e.withColumns({"session": F.col("user_id"), "iteration": F.floor(F.col("us") / DAY), "case_id": case, "verdict": verdict})


def last() -> Column:
    """What orders a session's events."""
    return F.struct("us", "event_id")


@query(f"WITH {RES} SELECT session, count(*) AS n, round(count(*) FILTER (verdict = 'CE') / count(*)::DOUBLE, 9) AS ce_rate, bool_or(NOT starts_with(case_id, 'cf-') AND case_id <> '') AS cross_domain FROM res GROUP BY 1")
def ce_fraction(spark, sf_dir):
    foreign = ~F.col("case_id").startswith("cf-") & (F.col("case_id") != "")
    return results(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("verdict") == "CE") / F.count("*"), 9).alias("ce_rate"), F.bool_or(foreign).alias("cross_domain"))


@query(f"""WITH {RES}, g AS (SELECT session, count(*) FILTER (event_type = 'signup') AS judges, count(*) FILTER (event_type = 'error') AS classifier, count(*) FILTER (verdict = 'CE') / count(*)::DOUBLE AS ce FROM res GROUP BY 1),
u AS (SELECT session, 'judges_firing' AS goal, judges::DOUBLE AS value, CASE WHEN judges > 0 THEN 'pass' ELSE 'pending' END AS status FROM g UNION ALL SELECT session, 'classifier_firing', classifier::DOUBLE, CASE WHEN classifier > 0 THEN 'pass' ELSE 'pending' END FROM g UNION ALL SELECT session, 'ce_rate', ce, CASE WHEN ce < 0.2 THEN 'pass' ELSE 'fail' END FROM g)
SELECT session, goal, round(value, 9) AS value, status FROM u""")
def goal_snapshot(spark, sf_dir):
    g = results(spark, sf_dir).groupBy("session").agg(F.count_if(F.col("event_type") == "signup").alias("judges"), F.count_if(F.col("event_type") == "error").alias("classifier"), (F.count_if(F.col("verdict") == "CE") / F.count("*")).alias("ce"))
    goal = lambda name, value, ok, other: F.struct(F.lit(name).alias("goal"), F.round(value.cast("double"), 9).alias("value"), F.when(ok, "pass").otherwise(other).alias("status"))
    c = F.col
    return g.select("session", F.inline(F.array(goal("judges_firing", c("judges"), c("judges") > 0, "pending"), goal("classifier_firing", c("classifier"), c("classifier") > 0, "pending"), goal("ce_rate", c("ce"), c("ce") < 0.2, "fail"))))


@query(f"WITH {RES}, g AS (SELECT session, event_type, count(*) AS n FROM res GROUP BY 1, 2) SELECT session, event_type, n, row_number() OVER (PARTITION BY session ORDER BY n DESC, event_type) AS rank FROM g QUALIFY rank <= 12")
def top_types_per_session(spark, sf_dir):
    g = results(spark, sf_dir).groupBy("session", "event_type").agg(F.count("*").alias("n"))
    return keys.per_key(g, ["session"], [F.desc("n"), F.col("event_type")], 12).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {EVENTS} SELECT event_type AS source, count(*) AS n, max(value) AS best, round(avg(value::DOUBLE), 6) AS mean FROM ev GROUP BY 1")
def fitness_by_source(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.max("value").alias("best"), F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))


@query(f"WITH {RES}, g AS (SELECT session, iteration, count(*) AS n, avg(value::DOUBLE) AS mean, coalesce(stddev_samp(value::DOUBLE), 0) AS sd, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM res GROUP BY 1, 2) SELECT session, iteration, n, round(mean, 6) AS mean, round(sd, 6) AS sd, lo, hi, round(hi - lo, 6) AS range, round(2 * sd, 6) AS floor FROM g")
def sample_noise(spark, sf_dir):
    """Noise of repeated runs: mean, sample deviation (0 for one run), range, and twice the deviation as the floor of a real change."""
    v = F.col("value").cast("double")
    g = results(spark, sf_dir).groupBy("session", "iteration").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    r = lambda c: F.round(c, 6)
    return g.select("session", "iteration", "n", r(F.col("mean")).alias("mean"), r(F.col("sd")).alias("sd"), "lo", "hi", r(F.col("hi") - F.col("lo")).alias("range"), r(2 * F.col("sd")).alias("floor"))


@query(f"""WITH {RES}, i AS (SELECT session, iteration, sum(value) FILTER (event_type <> 'signup') AS score, count(*) AS total, count(*) FILTER (verdict = 'AC') AS hits, sum(value) FILTER (event_type = 'purchase') AS cost FROM res GROUP BY 1, 2)
SELECT session, arg_min(score, iteration) FILTER (score IS NOT NULL) AS initial, arg_max(score, iteration) FILTER (score IS NOT NULL) AS final, count(*) AS iterations, sum(hits)::BIGINT AS hits, sum(total)::BIGINT AS total, coalesce(sum(cost), 0) AS cost FROM i GROUP BY 1""")
def cycle_outcome(spark, sf_dir):
    v, t = F.col("value"), F.col("event_type")
    i = results(spark, sf_dir).groupBy("session", "iteration").agg(F.sum(F.when(t != "signup", v)).alias("score"), F.count("*").alias("total"), F.count_if(F.col("verdict") == "AC").alias("hits"), F.sum(F.when(t == "purchase", v)).alias("cost"))
    known = F.when(F.col("score").isNotNull(), F.col("iteration"))
    return i.groupBy("session").agg(F.min_by("score", known).alias("initial"), F.max_by("score", known).alias("final"), F.count("*").alias("iterations"), F.sum("hits").alias("hits"), F.sum("total").alias("total"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


@query(f"WITH {RES}, f AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY session, iteration, case_id ORDER BY us, event_id) = 1) SELECT session, verdict, count(*) AS n, count(DISTINCT case_id) AS cases FROM f GROUP BY 1, 2")
def live_verdicts(spark, sf_dir):
    f = results(spark, sf_dir).groupBy("session", "iteration", "case_id").agg(F.min_by("verdict", last()).alias("verdict"))
    return f.groupBy("session", "verdict").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query(f"""WITH {RES}, g AS (SELECT session, iteration, count(*) AS n FROM res GROUP BY 1, 2), c AS (SELECT *, CASE WHEN n >= 5 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' WHEN n < 2 THEN 'LOW' ELSE 'NONE' END AS confidence FROM g)
SELECT session, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low, count(*) FILTER (confidence = 'NONE') AS none, bool_and(confidence = 'HIGH') AS all_high FROM c GROUP BY 1""")
def claim_confidence(spark, sf_dir):
    n, c = F.col("n"), F.col("confidence")
    g = results(spark, sf_dir).groupBy("session", "iteration").agg(F.count("*").alias("n"))
    g = g.withColumn("confidence", F.when(n >= 5, "HIGH").when(n >= 3, "MEDIUM").when(n < 2, "LOW").otherwise("NONE"))
    return g.groupBy("session").agg(*[F.count_if(c == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW", "NONE")], F.bool_and(c == "HIGH").alias("all_high"))


@query(f"""WITH {EVENTS}, e AS (SELECT user_id, event_id, 'stderr' AS ring, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rank FROM ev WHERE event_type = 'error' QUALIFY rank <= 5), f AS (SELECT user_id, event_id, 'failure' AS ring, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rank FROM ev WHERE value < 5 QUALIFY rank <= 3) SELECT * FROM e UNION ALL SELECT * FROM f""")
def failure_rings(spark, sf_dir):
    e = events(spark, sf_dir)
    newest = [F.desc("us"), F.desc("event_id")]
    ring = lambda d, name, n: keys.per_key(d, ["user_id"], newest, n).select("user_id", "event_id", F.lit(name).alias("ring"), F.col("rank").cast("long").alias("rank"))
    return ring(e.filter(F.col("event_type") == "error"), "stderr", 5).unionByName(ring(e.filter(F.col("value") < 5), "failure", 3))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, us, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM ev WHERE event_type = 'purchase'), b AS (SELECT unnest([50, 80, 100]) AS percent) SELECT user_id, percent, min(us) AS fired_at, min(spent) AS spent FROM r, b WHERE spent * 100 >= percent * 200 GROUP BY 1, 2""")
def budget_thresholds(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = events(spark, sf_dir).filter(F.col("event_type") == "purchase").withColumn("spent", F.sum("value").over(w))
    r = r.withColumn("percent", F.explode(F.array(F.lit(50), F.lit(80), F.lit(100)))).filter(F.col("spent") * 100 >= F.col("percent") * 200)
    return r.groupBy("user_id", "percent").agg(F.min("us").alias("fired_at"), F.min("spent").alias("spent"))


@query(f"""WITH {EVENTS}, h AS (SELECT event_type, us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY 1, 2), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY hour DESC) <= 30), g AS (SELECT event_type, arg_max(n, hour) AS latest, avg(n) AS mean, string_agg(n::VARCHAR, ',' ORDER BY hour) AS rates FROM k GROUP BY 1)
SELECT event_type, latest, rates, CASE WHEN abs(latest - mean) / mean >= 0.5 THEN 'critical' WHEN abs(latest - mean) / mean >= 0.25 THEN 'watch' ELSE 'normal' END AS band FROM g""")
def queue_pressure(spark, sf_dir):
    h = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").alias("n"))
    k = keys.per_key(h, ["event_type"], [F.desc("hour")], 30)
    g = k.groupBy("event_type").agg(F.max_by("n", "hour").alias("latest"), F.avg("n").alias("mean"), F.sort_array(F.collect_list(F.struct("hour", "n"))).alias("x"))  # 30 at most
    return g.select("event_type", "latest", F.array_join(F.transform("x", lambda s: s["n"].cast("string")), ",").alias("rates"), wording.band(F.abs(F.col("latest") - F.col("mean")) / F.col("mean")).alias("band"))


@query(f"WITH {EVENTS} SELECT us // {DAY} AS day, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY us // {DAY} ORDER BY us DESC, event_id DESC) = 1")
def latest_snapshot(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    return keys.newest(e, ["day"], last(), ["event_id", "value"])


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, us, value FROM ev WHERE event_type = 'click'), k AS (SELECT * FROM p ORDER BY us DESC, event_id DESC LIMIT 400) SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS recency, CASE WHEN value >= 20 THEN 'confirmed' ELSE 'open' END AS state FROM k QUALIFY recency <= 5""")
def prediction_history(spark, sf_dir):
    """Of the 400 newest predictions the last five of each session."""
    newest = [F.desc("us"), F.desc("event_id")]
    p = keys.ranked_limit(events(spark, sf_dir).filter(F.col("event_type") == "click"), newest, 400)
    p = keys.per_key(p, ["user_id"], newest, 5)
    return p.select("event_id", "user_id", F.col("rank").cast("long").alias("recency"), F.when(F.col("value") >= 20, "confirmed").otherwise("open").alias("state"))


@query(f"WITH {EVENTS} SELECT user_id, arg_max(event_type, (us, event_id)) AS latest, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS parsed, count(*) AS seen FROM ev GROUP BY 1")
def parse_status(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", last()).alias("latest"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("parsed"), F.count("*").alias("seen"))


@query(f"""WITH {RES}, s AS (SELECT session, iteration, sum(value) AS score, count(*) AS cost FROM res WHERE event_type = 'signup' GROUP BY 1, 2), m AS (SELECT session, max(value) AS score, count(*) AS cost FROM res WHERE session NOT IN (SELECT session FROM s) GROUP BY 1) SELECT session, iteration, score, cost FROM s UNION ALL SELECT session, NULL, score, cost FROM m""")
def pareto_cloud(spark, sf_dir):
    """A point per iteration with a summary; for sessions without any, their best score."""
    r = results(spark, sf_dir)
    s = r.filter(F.col("event_type") == "signup").groupBy("session", "iteration").agg(F.sum("value").cast("decimal(38,2)").alias("score"), F.count("*").alias("cost"))
    m = r.join(s.select("session").distinct(), "session", "left_anti").groupBy("session").agg(F.max("value").cast("decimal(38,2)").alias("score"), F.count("*").alias("cost"))
    return s.unionByName(m, allowMissingColumns=True)


@query(f"""WITH {EVENTS}, m AS (SELECT max(us) AS now FROM ev), g AS (SELECT user_id, arg_max(event_type, (us, event_id)) AS phase, max(us) AS last, sum(value) AS spent, min(us) AS first FROM ev GROUP BY 1) SELECT phase, count(*) AS n, count(*) FILTER (now - last > {6 * HOUR}) AS stuck, round(sum(spent::DOUBLE / greatest(1.0::DOUBLE, (last - first) / {HOUR}.0::DOUBLE)), 6) AS per_hour FROM g, m GROUP BY 1""")
def phase_board(spark, sf_dir):
    e = events(spark, sf_dir)
    g = e.groupBy("user_id").agg(F.max_by("event_type", last()).alias("phase"), F.max("us").alias("last"), F.sum("value").alias("spent"), F.min("us").alias("first"))
    g = g.crossJoin(F.broadcast(e.agg(F.max("us").alias("now"))))  # one row
    rate = F.col("spent").cast("double") / F.greatest(F.lit(1.0), (F.col("last") - F.col("first")) / float(HOUR))
    return g.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("now") - F.col("last") > 6 * HOUR).alias("stuck"), F.round(F.sum(rate), 6).alias("per_hour"))


@query("""WITH s AS (SELECT l_returnflag AS channel, date_diff('day', o_orderdate, l_shipdate) AS days, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY r <= 200) SELECT channel, count(*) AS n, quantile_disc(days, 0.5)::BIGINT AS p50, max(days)::BIGINT AS worst FROM s GROUP BY 1""")
def transport_latency(spark, sf_dir):
    """Median and worst delay of the last 200 deliveries of each channel."""
    d = F.datediff("l_shipdate", "o_orderdate")
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = keys.per_key(j, ["l_returnflag"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")], 200)
    sorted_ = F.sort_array(F.collect_list(d))  # 200 at most
    return s.groupBy(F.col("l_returnflag").alias("channel")).agg(F.count("*").alias("n"), F.element_at(sorted_, F.ceil(F.count("*") * 0.5).cast("int")).cast("long").alias("p50"), F.max(d).cast("long").alias("worst"))


@query(f"WITH {EVENTS} SELECT 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'runs', count(DISTINCT user_id) FROM ev")
def table_sizes(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(F.lit("events").alias("name")).groupBy("name").agg(F.count("*").alias("n")).unionByName(e.agg(F.countDistinct("user_id").alias("n")).withColumn("name", F.lit("runs")))


@query(f"""WITH {RES}, g AS (SELECT session, iteration, count(DISTINCT case_id) AS done, max(us) - min(us) AS took FROM res GROUP BY 1, 2) SELECT session, iteration, done, round(done / 20.0::DOUBLE, 6) AS progress, CASE WHEN done > 1 THEN round(took / 1e6 / (done - 1) * (20 - done), 3) END AS eta FROM g""")
def iteration_eta(spark, sf_dir):
    g = results(spark, sf_dir).groupBy("session", "iteration").agg(F.countDistinct("case_id").alias("done"), (F.max("us") - F.min("us")).alias("took"))
    done = F.col("done")
    return g.select("session", "iteration", "done", F.round(done / 20.0, 6).alias("progress"), F.when(done > 1, F.round(F.col("took") / 1e6 / (done - 1) * (20 - done), 3)).alias("eta"))


@query(f"WITH {EVENTS}, k AS (SELECT event_type, user_id, substr(props, 1, 80) AS head, max(us) AS t, arg_max(event_id, (us, event_id)) AS event_id FROM ev GROUP BY 1, 2, 3) SELECT event_type, user_id, head, event_id FROM k ORDER BY t DESC, event_id DESC LIMIT 40")
def probe_newest(spark, sf_dir):
    """Newest of each cluster of like events, then the newest 40 clusters."""
    k = events(spark, sf_dir).groupBy("event_type", "user_id", F.substring("props", 1, 80).alias("head")).agg(F.max(last()).alias("at"))
    return keys.ranked_limit(k, [F.desc("at")], 40).select("event_type", "user_id", "head", F.col("at.event_id").alias("event_id"))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, max(us) AS updated, arg_max(event_type, (us, event_id)) <> 'error' AS running FROM ev GROUP BY 1) SELECT user_id, updated, running FROM g ORDER BY running DESC, updated DESC, user_id LIMIT 8""")
def leaderboard(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id").agg(F.max("us").alias("updated"), (F.max_by("event_type", last()) != "error").alias("running"))
    return keys.ranked_limit(g, [F.desc("running"), F.desc("updated"), F.col("user_id")], 8)


@query(f"WITH {EVENTS} SELECT event_id, props FROM ev WHERE event_type = 'signup' ORDER BY us DESC, event_id DESC LIMIT 25")
def newest_feed(spark, sf_dir):
    return keys.ranked_limit(events(spark, sf_dir).filter(F.col("event_type") == "signup"), [F.desc("us"), F.desc("event_id")], 25).select("event_id", "props")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, max(us) AS last FROM ev GROUP BY 1 ORDER BY last DESC, user_id LIMIT 100) SELECT user_id, count(*) FILTER (event_type = 'click') AS predictions FROM ev WHERE user_id IN (SELECT user_id FROM s) GROUP BY 1""")
def sessions_kept(spark, sf_dir):
    """The 100 sessions seen last, with what is kept of their predictions."""
    e = events(spark, sf_dir)
    s = keys.ranked_limit(e.groupBy("user_id").agg(F.max("us").alias("last")), [F.desc("last"), F.col("user_id")], 100)
    return e.join(F.broadcast(s), "user_id", "left_semi").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("predictions"))  # 100 rows


@query(f"""WITH {EVENTS}, g AS (SELECT event_type || '/' || (user_id % 40) AS alert, max(us) AS last, CASE arg_max(event_type, (us, event_id)) WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS status FROM ev GROUP BY 1) SELECT alert, status, last FROM g ORDER BY status, last DESC, alert LIMIT 60""")
def alerts_in_order(spark, sf_dir):
    status = F.max_by("event_type", last())
    rank = F.when(status == "error", 0).when(status == "view", 1).otherwise(2)
    g = events(spark, sf_dir).groupBy(F.concat_ws("/", "event_type", (F.col("user_id") % 40).cast("string")).alias("alert")).agg(F.max("us").alias("last"), rank.alias("status"))
    return keys.ranked_limit(g, [F.col("status"), F.desc("last"), F.col("alert")], 60)


@query(f"WITH {EVENTS} SELECT event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC) <= 50")
def annotations_kept(spark, sf_dir):
    return keys.per_key(events(spark, sf_dir), ["event_type"], [F.desc("us"), F.desc("event_id")], 50).select("event_type", "event_id")


@query(f"WITH {EVENTS} SELECT event_id, event_id % 4 AS tier, value AS score FROM ev WHERE NOT (event_id % 4 < 3 AND value < 45) ORDER BY us DESC, event_id DESC LIMIT 30")
def headlines(spark, sf_dir):
    """Rows of a tier or a score that suffices, the last 30."""
    e = events(spark, sf_dir).withColumn("tier", F.col("event_id") % 4).filter((F.col("tier") >= 3) | (F.col("value") >= 45))
    return keys.ranked_limit(e, [F.desc("us"), F.desc("event_id")], 30).select("event_id", "tier", F.col("value").alias("score"))


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS n FROM ev WHERE user_id % 3 = 0 GROUP BY 1 HAVING count(*) >= 20")
def large_subruns(spark, sf_dir):
    return events(spark, sf_dir).filter(F.col("user_id") % 3 == 0).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 20")


@query(f"WITH {EVENTS} SELECT DISTINCT user_id, us // {DAY} AS day FROM ev WHERE event_type = 'click' EXCEPT SELECT user_id, us // {DAY} FROM ev WHERE event_type = 'purchase'")
def started_without_result(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    of = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", "day")
    return of("click").subtract(of("purchase"))


@query(f"""WITH {EVENTS}, m AS (SELECT event_type, substr(trim(lower(regexp_replace(regexp_replace(props, '\\d+', '{{N}}', 'g'), '\\s+', ' ', 'g'))), 1, 150) AS fp, props, us, us // {6 * HOUR} AS win, event_id FROM ev),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_type, win ORDER BY us, event_id) <= 20) SELECT event_type, fp, count(*) AS n, min(us) AS first_seen, max(us) AS last_seen, arg_min(substr(props, 1, 200), (us, event_id)) AS sample FROM k GROUP BY 1, 2""")
def fingerprint_ledger(spark, sf_dir):
    """Counts of like messages by channel from at most 20 of each window."""
    e = events(spark, sf_dir).withColumns({"win": F.floor(F.col("us") / (6 * HOUR)), "fp": text.fingerprint(F.col("props"))})
    k = keys.per_key(e, ["event_type", "win"], [F.col("us"), F.col("event_id")], 20)
    return k.groupBy("event_type", "fp").agg(F.count("*").alias("n"), F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.min_by(F.substring("props", 1, 200), last()).alias("sample"))


#: A message whose letters name one of thirty queues; its numbers differ from event to event.
_MESSAGE = "'Queue ' || translate((user_id % 30)::VARCHAR, '0123456789', 'abcdefghij') || ' failed after ' || event_id || ' ms at 0x00ff' || (1000 + event_id % 9000)"


@query(f"""WITH {EVENTS}, m AS (SELECT event_type, {_FINGER.format(x=_MESSAGE)} AS fp, us FROM ev), g AS (SELECT event_type, fp, count(*) AS n, max(us) AS last_seen FROM m GROUP BY 1, 2 HAVING count(*) >= 2) SELECT event_type, fp, n, last_seen, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, fp) AS rank FROM g QUALIFY rank <= 8""")
def recurring_fingerprints(spark, sf_dir):
    e = events(spark, sf_dir)
    queue = F.translate((F.col("user_id") % 30).cast("string"), "0123456789", "abcdefghij")
    message = F.concat(F.lit("Queue "), queue, F.lit(" failed after "), F.col("event_id").cast("string"), F.lit(" ms at 0x00ff"), (1000 + F.col("event_id") % 9000).cast("string"))
    g = e.groupBy("event_type", text.fingerprint(message).alias("fp")).agg(F.count("*").alias("n"), F.max("us").alias("last_seen")).filter("n >= 2")
    return keys.per_key(g, ["event_type"], [F.desc("n"), F.col("fp")], 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {EVENTS}, c AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'log:' ELSE 'shop.' END || event_type AS channel FROM ev) SELECT channel, CASE WHEN starts_with(channel, 'shop.cl') THEN 10 WHEN starts_with(channel, 'shop.') AND channel = 'shop.view' THEN 20 WHEN starts_with(channel, 'log:') THEN 100 ELSE 50 END AS count_trigger,
CASE WHEN starts_with(channel, 'shop.cl') THEN 60.0 WHEN channel = 'shop.view' THEN 120.0 WHEN starts_with(channel, 'log:') THEN 300.0 ELSE 900.0 END::DOUBLE AS seconds FROM c""")
def channel_triggers(spark, sf_dir):
    from tidewell.functions.channels import triggers

    channel = F.concat(F.when(F.col("event_type") == "error", "log:").otherwise("shop."), F.col("event_type"))
    t = triggers(F.col("channel"), [("shop.cl", 10, 60.0), ("shop.view", 20, 120.0)])
    return events(spark, sf_dir).select(channel.alias("channel")).distinct().select("channel", t["count"].alias("count_trigger"), t["seconds"].alias("seconds"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id % 50 ORDER BY us, event_id) AS seq FROM ev) SELECT user_id % 50 AS pool, event_id, seq FROM o""")
def session_pool(spark, sf_dir):
    """Events of all runs of a session in one order, numbered anew."""
    w = Window.partitionBy("pool").orderBy("us", "event_id")
    e = events(spark, sf_dir).withColumn("pool", F.col("user_id") % 50)
    return e.select("pool", "event_id", F.row_number().over(w).cast("long").alias("seq"))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, (max(us) - min(us)) / 1e6 AS seconds, sum(value)::DOUBLE AS usd, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM ev GROUP BY 1), s AS (SELECT *, greatest(round(seconds)::BIGINT, 0) AS s FROM g)
SELECT user_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 3600) || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS duration, 'n=' || n || CASE WHEN clicks > 0 THEN ' clicks=' || clicks ELSE '' END AS line, round(n * 3.0::DOUBLE / 1e6 + clicks * 15.0::DOUBLE / 1e6, 9) AS cost FROM s""")
def session_lines(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("seconds"), F.count("*").alias("n"), F.nullif(F.count_if(F.col("event_type") == "click"), F.lit(0)).alias("clicks"))
    cost = F.round(F.col("n") * 3.0 / 1e6 + F.coalesce("clicks", F.lit(0)) * 15.0 / 1e6, 9)
    return e.select("user_id", wording.duration(F.col("seconds")).alias("duration"), wording.first_informative({"n": F.col("n"), "clicks": F.col("clicks")}).alias("line"), cost.alias("cost"))


@query(f"""WITH {RES}, i AS (SELECT session, iteration, sum(value) AS score, arg_max(event_type, (us, event_id)) AS last FROM res GROUP BY 1, 2), d AS (SELECT *, score - lag(score) OVER (PARTITION BY session ORDER BY iteration) AS delta FROM i)
SELECT session, CASE WHEN last = 'signup' THEN 'running' WHEN delta IS NULL THEN 'complete' WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'regressed' ELSE 'flat' END AS verdict FROM d QUALIFY row_number() OVER (PARTITION BY session ORDER BY iteration DESC) = 1""")
def session_verdict(spark, sf_dir):
    i = results(spark, sf_dir).groupBy("session", "iteration").agg(F.sum("value").alias("score"), F.max_by("event_type", last()).alias("last"))
    d = i.withColumn("delta", F.col("score") - F.lag("score").over(Window.partitionBy("session").orderBy("iteration")))
    v = wording.verdict(F.when(F.col("last") == "signup", "start").otherwise("done"), F.col("delta").cast("double"))
    return keys.newest(d.withColumn("verdict", v), ["session"], F.col("iteration"), ["verdict"])
