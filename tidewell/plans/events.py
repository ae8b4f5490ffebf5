"""Queries over the event table as a bus of envelopes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import channels, stats, text
from tidewell.functions.timeutil import AS_OF, DAY, HOUR, MINUTE, micros
from tidewell.operators import folds, joins, jumps, keys, sequences, sessions
from tidewell.runtime import table

QUERIES, ORACLE = {}, {}
#: The event table as the SQL twins see it.
EVENTS = "ev AS (SELECT event_id, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value, props, epoch_us(ts) AS us FROM events)"
GAP = 6 * HOUR


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), "props", micros(F.col("ts")).alias("us"))


def kind(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def channel() -> Column:
    return F.concat(F.lit("shop."), F.when(kind("click", "view"), "session.").otherwise("order."), F.col("event_type"), F.lit(".v1"))


CHANNEL = "'shop.' || CASE WHEN event_type IN ('click','view') THEN 'session.' ELSE 'order.' END || event_type || '.v1'"
PREFIXES = ["shop.session", "shop.order.error"]
ORDER = ["us", "event_id"]


@query(f"""WITH {EVENTS}, w AS (SELECT event_type, us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY 1, 2),
b AS (SELECT event_type, count(*) AS bn, sum(n)::DOUBLE / count(*)::DOUBLE AS avg, sqrt(greatest(0.0, sum(n*n)::DOUBLE / count(*)::DOUBLE - (sum(n)::DOUBLE / count(*)::DOUBLE) * (sum(n)::DOUBLE / count(*)::DOUBLE))) AS sd FROM w GROUP BY 1)
SELECT event_type, hour, n, bn, CASE WHEN bn >= 100 AND sd >= 0.001 THEN round((n - avg) / sd, 6) END AS z FROM w JOIN b USING (event_type)""")
def rate_zscore_by_type(spark, sf_dir):
    w = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").alias("n"))
    b = w.groupBy("event_type").agg(F.count("n").alias("bn"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    b = b.select("event_type", "bn", stats.mean(F.col("bn"), F.col("t")).alias("avg"), stats.stddev_pop(F.col("bn"), F.col("t"), F.col("q")).alias("sd"))
    z = stats.deviation(F.col("n"), F.col("bn"), F.col("avg"), F.col("sd"))
    return w.join(b, "event_type").select("event_type", "hour", "n", "bn", F.round(z, 6).alias("z"))


@query(f"WITH {EVENTS} SELECT event_type, us // {DAY} AS day, count(*) AS n, count(DISTINCT user_id) AS users, sum(value) AS total FROM ev GROUP BY 1, 2")
def channel_rates_daily(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("event_type", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("value").alias("total"))


@query(f"""WITH {EVENTS}, k AS (SELECT DISTINCT event_type FROM ev), s AS (SELECT event_type, unnest(generate_series(0, 59)) AS slot FROM k),
c AS (SELECT event_type, (us - {AS_OF - 2 * DAY - 60 * HOUR}) // {HOUR} AS slot, count(*) AS n FROM ev WHERE us >= {AS_OF - 2 * DAY - 60 * HOUR} AND us < {AS_OF - 2 * DAY} GROUP BY 1, 2)
SELECT event_type, s.slot::INT AS slot, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (event_type, slot)""")
def sparse_hour_ring(spark, sf_dir):
    return sessions.bucket_counts(events(spark, sf_dir), "event_type", "us", HOUR, 60, AS_OF - 2 * DAY)


@query(f"WITH {EVENTS} SELECT event_id::VARCHAR AS event_id, '/user/' || user_id AS source, event_type AS type, us, json_extract_string(props, '$.k') AS data_k FROM ev")
def envelope_flatten(spark, sf_dir):
    flat = F.from_json("props", "map<string,string>")
    return events(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("/user/"), F.col("user_id")).alias("source"), F.col("event_type").alias("type"), "us", F.element_at(flat, "k").alias("data_k"))


@query(f"WITH {EVENTS} SELECT {CHANNEL} AS channel, count(*) AS n FROM ev WHERE regexp_full_match({CHANNEL}, 'shop\\.[^.]+\\.error(\\..*)?') OR regexp_full_match({CHANNEL}, 'shop\\.session(\\..*)?') GROUP BY 1")
def topic_glob_filter(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("channel", channel())
    hit = channels.matches_topic(F.col("channel"), "shop.*.error.#") | channels.matches_topic(F.col("channel"), "shop.session.#")
    return e.filter(hit).groupBy("channel").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT event_id, {CHANNEL} AS channel FROM ev WHERE starts_with({CHANNEL}, 'shop.session') OR starts_with({CHANNEL}, 'shop.order.error')")
def prefix_filter(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("channel", channel())
    return e.filter(channels.prefix_filter(F.col("channel"), PREFIXES)).select("event_id", "channel")


@query(f"WITH {EVENTS} SELECT CASE WHEN starts_with({CHANNEL}, 'shop.session') THEN 'shop.session' WHEN starts_with({CHANNEL}, 'shop.order.error') THEN 'shop.order.error' ELSE {CHANNEL} END AS family, count(*) AS n FROM ev GROUP BY 1")
def family_rollup(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("channel", channel())
    return e.groupBy(channels.family(F.col("channel"), PREFIXES).alias("family")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT CASE WHEN {CHANNEL} LIKE '%.session.%' THEN 'Browsing' WHEN {CHANNEL} LIKE '%.error.%' THEN 'Faults' ELSE 'Trade' END AS cluster, regexp_replace({CHANNEL}, '\\.v\\d+$', '') AS base, count(*) AS n FROM ev GROUP BY 1, 2")
def cluster_classify(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("channel", channel())
    c = channels.cluster(F.col("channel"), [(r"\.session\.", "Browsing"), (r"\.error\.", "Faults")], "Trade")
    return e.groupBy(c.alias("cluster"), channels.without_version(F.col("channel")).alias("base")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type, us // {HOUR} ORDER BY us, event_id) = 1")
def dedupe_within_hour(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", F.floor(F.col("us") / HOUR))
    return keys.dedupe(e, ["user_id", "event_type", "h"], [F.col("us"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query(f"WITH {EVENTS} SELECT user_id, event_type, arg_max(event_id, (us, event_id)) AS event_id, max(us) AS us FROM ev GROUP BY 1, 2")
def keep_newest_per_key(spark, sf_dir):
    return keys.newest(events(spark, sf_dir), ["user_id", "event_type"], F.struct("us", "event_id"), ["event_id", "us"])


@query(f"WITH {EVENTS} SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id) AS rank FROM ev QUALIFY rank <= 256")
def last_n_per_channel(spark, sf_dir):
    return keys.per_key(events(spark, sf_dir), ["event_type"], [F.desc("us"), F.col("event_id")], 256).select("event_type", "event_id", "rank")


SESSIONS = f"""{EVENTS}, c AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > {GAP} OR lag(event_type) OVER w = 'signup' THEN 1 ELSE 0 END AS cut FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS session FROM c),
r AS (SELECT user_id, session, min(us) AS started, max(us) AS last, count(*) AS events, bool_or(event_type = 'signup') AS ended FROM s GROUP BY 1, 2)"""


def sessioned(spark, sf_dir):
    return sessions.idle_sessions(events(spark, sf_dir), "user_id", "us", "event_id", GAP, kind("signup"))


@query(f"WITH {SESSIONS} SELECT user_id, session, started, last, events, CASE WHEN ended THEN 'ended' WHEN {AS_OF} - last > {GAP} THEN 'idle_timeout' ELSE 'open' END AS close_reason FROM r")
def idle_sessions(spark, sf_dir):
    return sessions.session_rows(sessioned(spark, sf_dir), "user_id", "us", kind("signup"), GAP, AS_OF)


@query(f"WITH {SESSIONS} SELECT user_id, session, lag(session) OVER (PARTITION BY user_id ORDER BY session) AS continues FROM r")
def session_links(spark, sf_dir):
    s = sessioned(spark, sf_dir).select("user_id", "session").distinct()
    return sessions.continuation(s, "user_id")


@query(f"WITH {SESSIONS} SELECT user_id, session, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3")
def session_histogram(spark, sf_dir):
    return sessioned(spark, sf_dir).groupBy("user_id", "session", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {SESSIONS} SELECT CASE WHEN ended THEN 'ended' WHEN {AS_OF} - last > {GAP} THEN 'idle_timeout' ELSE 'open' END AS close_reason, count(*) AS sessions, sum(events)::BIGINT AS events FROM r GROUP BY 1")
def session_close_reasons(spark, sf_dir):
    return idle_sessions(spark, sf_dir).groupBy("close_reason").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query(f"WITH {EVENTS} SELECT event_id, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap FROM ev")
def gap_to_next(spark, sf_dir):
    return sessions.with_gap(events(spark, sf_dir), "user_id", "us", "event_id").select("event_id", "gap")


@query(f"""WITH {EVENTS}, g AS (SELECT event_id, event_type, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap FROM ev),
m AS (SELECT event_type, count(gap) AS n, quantile_disc(gap, 0.5) AS lo, median(gap) AS med FROM g GROUP BY 1)
SELECT g.event_id, g.event_type, g.gap FROM g JOIN m USING (event_type) WHERE gap > {12 * HOUR} OR gap > 3 * med""")
def slow_outliers(spark, sf_dir):
    g = sessions.with_gap(events(spark, sf_dir), "user_id", "us", "event_id").select("event_id", "event_type", "gap")
    m = stats.ranked_percentiles(g, "event_type", F.col("gap"), ["median"])
    return g.join(m, "event_type").filter((F.col("gap") > 12 * HOUR) | (F.col("gap") > 3 * F.col("median"))).select("event_id", "event_type", "gap")


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, lag(event_type) OVER w = 'click' AND event_type = 'error' AND lead(event_type) OVER w = 'click' AS hit FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, sum(coalesce(hit, false)::INT)::BIGINT AS loops FROM l GROUP BY 1""")
def edit_fail_edit(spark, sf_dir):
    return sequences.triples(events(spark, sf_dir), "user_id", ORDER, kind("click"), kind("error"), kind("click"))


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, event_type, coalesce(max((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS near FROM ev)
SELECT user_id, count(*) FILTER (event_type = 'click') AS total, count(*) FILTER (event_type = 'click' AND near = 1) AS followed FROM l GROUP BY 1""")
def verify_within_4(spark, sf_dir):
    return sequences.followed_within(events(spark, sf_dir), "user_id", ORDER, kind("click"), kind("view"), 4)


PHASES = f"""{EVENTS}, f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
p AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS phase FROM f),
r AS (SELECT user_id, phase, event_type, count(*) AS length FROM p GROUP BY 1, 2, 3)"""


@query(f"WITH {PHASES} SELECT * FROM r")
def phases_rle(spark, sf_dir):
    return sequences.phases(events(spark, sf_dir), "user_id", ORDER, "event_type")


@query(f"""WITH {PHASES}, t AS (SELECT *, max(phase) OVER (PARTITION BY user_id) > 12 AND phase >= 12 AS tail FROM r)
SELECT user_id, CASE WHEN tail THEN 12 ELSE phase END AS phase, CASE WHEN tail THEN '…' ELSE event_type END AS event_type, sum(length)::BIGINT AS length FROM t GROUP BY 1, 2, 3""")
def phases_compressed(spark, sf_dir):
    return sequences.compressed_phases(phases_rle(spark, sf_dir), "user_id", "event_type")


@query(f"WITH {EVENTS}, b AS (SELECT event_type || '->' || lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS bigram FROM ev) SELECT bigram, count(*) AS n FROM b WHERE bigram IS NOT NULL GROUP BY 1 ORDER BY n DESC, bigram LIMIT 8")
def bigrams_top8(spark, sf_dir):
    return keys.ranked_limit(sequences.bigrams(events(spark, sf_dir), "user_id", ORDER, "event_type"), [F.desc("n"), F.col("bigram")], 8)


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS seen FROM ev)
SELECT user_id, count(*) FILTER (event_type IN ('view','click') AND seen = 0) AS n FROM l GROUP BY 1""")
def nav_before_first(spark, sf_dir):
    return sequences.before_first(events(spark, sf_dir), "user_id", ORDER, kind("purchase"), kind("view", "click"))


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS back FROM ev)
SELECT user_id, bool_or(event_type = 'signup' AND back <= greatest(3, n // 5)) AS in_tail FROM l GROUP BY 1""")
def tail_test(spark, sf_dir):
    return sequences.in_tail(events(spark, sf_dir), "user_id", ORDER, kind("signup"))


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, event_type, lag(event_type) OVER w AS before FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, count(*) FILTER (event_type IN ('click','view') AND before IN ('click','view')) AS pairs, count(*) FILTER (event_type IN ('click','view') AND before IN ('click','view') AND before <> event_type) AS flips FROM p GROUP BY 1""")
def navigation_churn(spark, sf_dir):
    return sequences.churn(events(spark, sf_dir), "user_id", ORDER, kind("click", "view"), "event_type")


@query(f"""WITH {EVENTS}, c AS (SELECT event_id, user_id, CASE WHEN us - lag(us) OVER w <= {8 * HOUR} THEN 0 ELSE 1 END AS cut, us FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, sum(cut) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS cohort FROM c""")
def dispatch_cohorts(spark, sf_dir):
    return sessions.cohorts(events(spark, sf_dir), "user_id", "us", "event_id", 8 * HOUR).select("event_id", "cohort")


@query(f"""WITH {EVENTS}, e AS (SELECT event_id, user_id, 40 * row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) + 10 * (event_id % 3) AS seq, CASE WHEN event_id % 4 > 0 THEN us END AS us FROM ev),
n AS (SELECT *, last_value(us IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS p FROM e),
c AS (SELECT *, CASE WHEN p IS NULL THEN 1 WHEN us IS NOT NULL AND known IS NOT NULL THEN (us - known > {8 * HOUR})::INT ELSE (seq - p > 45)::INT END AS cut FROM n) SELECT event_id, sum(cut) OVER (PARTITION BY user_id ORDER BY seq)::BIGINT AS wave FROM c""")
def dispatch_waves(spark, sf_dir):
    """Cohorts by time where it is known, else by jumps of the sequence; every fourth event has no time."""
    n = F.row_number().over(sessions.ordered("user_id", *ORDER))
    e = events(spark, sf_dir).withColumn("seq", (40 * n + 10 * (F.col("event_id") % 3)).cast("long")).withColumn("us", F.when(F.col("event_id") % 4 > 0, F.col("us")))
    return sessions.waves(e, "user_id", "seq", "us", 8 * HOUR, 45).select("event_id", "wave")


@query(f"""WITH {EVENTS}, e AS (SELECT * FROM ev WHERE event_type = 'error'), c AS (SELECT event_id, user_id, CASE WHEN lag(us) OVER w - us <= {DAY} THEN 0 ELSE 1 END AS cut, us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us DESC, event_id DESC))
SELECT event_id, sum(cut) OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC)::BIGINT AS cohort FROM c""")
def annotation_clusters(spark, sf_dir):
    return sessions.cohorts(events(spark, sf_dir).filter(kind("error")), "user_id", "us", "event_id", DAY, newest_first=True).select("event_id", "cohort")


@query(f"""WITH {EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS last_view FROM ev""")
def asof_last_verify(spark, sf_dir):
    return sequences.last_before(events(spark, sf_dir), "user_id", ORDER, kind("view"), F.col("value"), 200, "last_view").select("event_id", "last_view")


@query(f"WITH {EVENTS} SELECT DISTINCT user_id, us // {DAY} AS day FROM ev WHERE event_type = 'purchase' EXCEPT SELECT user_id, us // {DAY} FROM ev WHERE event_type = 'view'")
def orphan_anti(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    return joins.orphans(e.filter(kind("purchase")).select("user_id", "day").distinct(), e.filter(kind("view")), ["user_id", "day"])


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, us // {DAY} AS day FROM ev WHERE event_type = 'signup'), b AS (SELECT user_id, us // {DAY} AS day FROM ev WHERE event_type = 'purchase'),
u AS (SELECT user_id, day, 1 AS x, 0 AS y FROM a UNION ALL SELECT user_id, day, 0, 1 FROM b)
SELECT user_id, day, CASE WHEN max(x) = 0 THEN 'right' WHEN max(y) = 0 THEN 'left' ELSE 'both' END AS side FROM u GROUP BY 1, 2""")
def two_sided_orphans(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    return joins.both_sides(e.filter(kind("signup")), e.filter(kind("purchase")), ["user_id", "day"])


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, min(us) AS created FROM ev WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, min(us) AS opened FROM ev WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, created, opened, opened - created AS took, coalesce(abs(opened - created) > {30 * MINUTE}, false) AS late FROM a LEFT JOIN b USING (user_id)""")
def sla_pairs(spark, sf_dir):
    e = events(spark, sf_dir)
    p = joins.paired(e.filter(kind("view")).withColumnRenamed("us", "created"), e.filter(kind("purchase")).withColumnRenamed("us", "opened"), ["user_id"], "created", "opened")
    return p.withColumn("late", F.coalesce(F.abs("took") > 30 * MINUTE, F.lit(False)))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, us // {DAY} AS day, min(us) AS started FROM ev WHERE event_type = 'click' GROUP BY 1, 2), d AS (SELECT user_id, us // {DAY} AS day, min(us) AS done FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT day, count(*) AS starts, count(done) AS done, CAST(sum(done - started) AS BIGINT) AS took FROM s LEFT JOIN d USING (user_id, day) GROUP BY 1""")
def start_done_pairs(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    p = joins.paired(e.filter(kind("click")).withColumnRenamed("us", "started"), e.filter(kind("purchase")).withColumnRenamed("us", "done"), ["user_id", "day"], "started", "done")
    return p.groupBy("day").agg(F.count("*").alias("starts"), F.count("done").alias("done"), F.sum("took").alias("took"))


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, (us // {DAY})::BIGINT AS i, count(*) AS predicted FROM ev WHERE event_type = 'view' GROUP BY 1, 2), a AS (SELECT user_id, (us // {DAY})::BIGINT AS i, count(*) AS actual FROM ev WHERE event_type = 'click' GROUP BY 1, 2)
SELECT p.user_id, p.i, predicted, coalesce(n.actual, o.actual) AS actual, CASE WHEN n.actual IS NOT NULL THEN 'next' WHEN o.actual IS NOT NULL THEN 'same' ELSE 'open' END AS status
FROM p LEFT JOIN a n ON n.user_id = p.user_id AND n.i = p.i + 1 LEFT JOIN a o ON o.user_id = p.user_id AND o.i = p.i""")
def prediction_status(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("i", F.floor(F.col("us") / DAY))
    count = lambda k, name: e.filter(kind(k)).groupBy("user_id", "i").agg(F.count("*").alias(name))
    return joins.prediction_status(count("view", "predicted"), count("click", "actual"), "user_id", "i")


@query(f"""WITH {EVENTS}, f AS (SELECT DISTINCT user_id, us AS fixed FROM ev WHERE event_type = 'signup'), j AS (SELECT f.user_id, fixed, count(*) FILTER (e.us >= fixed - {7 * DAY} AND e.us < fixed) AS before, count(*) FILTER (e.us >= fixed AND e.us <= fixed + {7 * DAY}) AS after
FROM f LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') e USING (user_id) GROUP BY 1, 2) SELECT user_id, fixed, before, after, before - after AS drop FROM j""")
def fix_effect_windows(spark, sf_dir):
    e = events(spark, sf_dir)
    fixes = e.filter(kind("signup")).select("user_id", F.col("us").alias("fixed")).distinct()
    return joins.interval_effects(fixes, e.filter(kind("error")), "user_id", "fixed", "us")


@query(f"WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS n FROM ev")
def rolling_rate(spark, sf_dir):
    return sessions.rolling_count(events(spark, sf_dir), "event_type", "us", HOUR).select("event_id", "n")


@query(f"WITH {EVENTS} SELECT event_id, sum(value) OVER w AS total, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_last_5(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(-4, 0)
    return events(spark, sf_dir).select("event_id", F.sum("value").over(w).alias("total"), F.count("*").over(w).alias("n"))


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, us, count(*) FILTER (event_type = 'error') OVER w AS f, count(*) FILTER (event_type IN ('error','purchase')) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW))
SELECT event_id, f, n, CASE WHEN f >= 0.5 * greatest(1, n) AND f > 0 THEN 'active' WHEN f = 0 THEN 'resolved' ELSE 'stabilizing' END AS status FROM r""")
def failure_ratio(spark, sf_dir):
    e = sessions.rolling_count(events(spark, sf_dir), "user_id", "us", DAY, "f", kind("error").cast("long"))
    e = sessions.rolling_count(e, "user_id", "us", DAY, "n", kind("error", "purchase").cast("long"))
    loud = (F.col("f") >= 0.5 * F.greatest(F.lit(1), F.col("n"))) & (F.col("f") > 0)
    return e.select("event_id", "f", "n", F.when(loud, "active").when(F.col("f") == 0, "resolved").otherwise("stabilizing").alias("status"))


@query(f"WITH {EVENTS} SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS cost FROM ev WHERE event_type = 'purchase'")
def cumulative_cost(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).filter(kind("purchase")).select("event_id", F.sum("value").over(w).alias("cost"))


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT event_type, us, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS i FROM ev),
s AS (SELECT event_type, i, 1::BIGINT AS win, us AS opened, us AS last, 1::BIGINT AS n FROM r WHERE i = 1
UNION ALL SELECT r.event_type, r.i, CASE WHEN s.n >= 50 OR r.us - s.opened >= {DAY} THEN s.win + 1 ELSE s.win END, CASE WHEN s.n >= 50 OR r.us - s.opened >= {DAY} THEN r.us ELSE s.opened END, r.us, CASE WHEN s.n >= 50 OR r.us - s.opened >= {DAY} THEN 1 ELSE s.n + 1 END
FROM s JOIN r ON r.event_type = s.event_type AND r.i = s.i + 1)
SELECT event_type, win AS window, min(opened) AS opened, max(last) AS last, max(n) AS events FROM s GROUP BY 1, 2""")
def count_or_time_windows(spark, sf_dir):
    return jumps.count_or_time(events(spark, sf_dir), "event_type", "us", ORDER, 50, DAY)


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, value::DOUBLE / 10 AS dev, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev WHERE event_type = 'error'),
s AS (SELECT user_id, i, greatest(1.5::DOUBLE, 3.0::DOUBLE * 0.95::DOUBLE + abs(dev) * (1 - 0.95::DOUBLE)) AS x FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, greatest(1.5::DOUBLE, s.x * 0.95::DOUBLE + abs(r.dev) * (1 - 0.95::DOUBLE)) FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT user_id, max(i) AS updates, round(arg_max(x, i), 6) AS threshold FROM s GROUP BY 1""")
def adaptive_threshold(spark, sf_dir):
    e = events(spark, sf_dir).filter(kind("error")).withColumn("dev", (F.col("value") / 10).cast("double"))
    return folds.ordered_fold(e, "user_id", ORDER, folds.adaptive_threshold("dev")).withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH {EVENTS}, v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'r' ELSE 'a' END AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev),
c AS (SELECT user_id, count(*) FILTER (verdict = 'a') AS accepts, count(*) FILTER (verdict = 'r') AS rejects, coalesce(max(i) FILTER (verdict = 'r'), 0) AS last_reject FROM v GROUP BY 1)
SELECT *, accepts + rejects >= 15 AND accepts::DOUBLE / (accepts + rejects) >= 0.7 AND accepts + rejects - last_reject >= 3 AS auto_enabled FROM c""")
def calibration_fold(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("verdict", F.when(kind("error"), "reject").otherwise("accept"))
    return folds.ordered_fold(e, "user_id", ORDER, folds.calibration("verdict"))


_BAD = f"(r.n > 400 OR (r.n > 0 AND r.us - (CASE WHEN r.n < s.n THEN r.us ELSE s.fell END) >= {2 * DAY}))"


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, us, CASE WHEN event_type = 'signup' THEN 0 ELSE floor(value * 10)::BIGINT END AS n, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev),
s AS (SELECT user_id, i, us, us AS fell, n, n > 400 AS latched, CASE WHEN n > 400 THEN 'raised' END AS alert FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.i, r.us, CASE WHEN r.n < s.n OR r.n = 0 THEN r.us ELSE s.fell END, r.n, CASE WHEN {_BAD} THEN true WHEN r.n = 0 THEN false ELSE s.latched END, CASE WHEN {_BAD} AND NOT s.latched THEN 'raised' WHEN r.n = 0 AND s.latched THEN 'recovered' END FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT user_id, us AS at, alert FROM s WHERE alert IS NOT NULL""")
def alert_latch(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("lag", F.when(kind("signup"), 0).otherwise((F.col("value") * 10).cast("long")))
    return folds.ordered_fold(e, "user_id", ORDER, folds.alert_latch("us", "lag", spike=400, stall=2 * DAY))


@query(f"""WITH RECURSIVE {EVENTS}, k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'build' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'revert' END AS kind FROM ev),
b AS (SELECT *, min(CASE WHEN kind = 'build' THEN i END) OVER (o ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nb, min(CASE WHEN kind = 'fail' THEN i END) OVER (o ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS nf, min(CASE WHEN kind = 'revert' THEN i END) OVER (o ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS nr FROM k WINDOW o AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT e.user_id, e.i AS edit, b.i AS build, f.i AS fail, f.nr AS revert FROM b e JOIN b ON b.user_id = e.user_id AND b.i = e.nb JOIN b f ON f.user_id = b.user_id AND f.i = b.nf WHERE e.kind = 'edit' AND f.nr IS NOT NULL),
n AS (SELECT *, (SELECT min(x.edit) FROM c x WHERE x.user_id = c.user_id AND x.edit > c.revert) AS nx FROM c), f AS (SELECT user_id, min(edit) AS edit FROM c GROUP BY 1),
r AS (SELECT n.* FROM n JOIN f USING (user_id, edit) UNION ALL SELECT n.* FROM r JOIN n ON n.user_id = r.user_id AND n.edit = r.nx) SELECT user_id, edit, build, fail, revert FROM r""")
def thrash_cycles(spark, sf_dir):
    k = F.when(kind("click"), "edit").when(kind("view"), "build").when(kind("error"), "fail").when(kind("signup"), "revert").otherwise("other")
    return jumps.thrash_cycles(events(spark, sf_dir).withColumn("kind", k), "user_id", "kind", ORDER).drop("cycle")


@query(f"WITH {SESSIONS} SELECT user_id, session, started, last, events, CASE WHEN ended THEN 'ended' WHEN session = max(session) OVER (PARTITION BY user_id) THEN 'open' ELSE 'idle_timeout' END AS close_reason FROM r")
def idle_sessions_fold(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ended", kind("signup"))
    return folds.ordered_fold(e, "user_id", ORDER, folds.idle_sessions("us", "ended", GAP))


@query(f"""WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, us, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'step' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev),
s AS (SELECT user_id, i, us, kind = 'started' AS running, (kind = 'started')::BIGINT AS saga, 0::BIGINT AS steps, NULL::BIGINT AS of, NULL::BIGINT AS done, NULL::VARCHAR AS outcome FROM r WHERE i = 1
UNION ALL SELECT user_id, i, us, CASE WHEN o THEN kind NOT IN ('completed', 'failed') ELSE kind = 'started' END, saga + (NOT o AND kind = 'started')::BIGINT, CASE WHEN NOT o AND kind = 'started' THEN 0 WHEN o AND kind NOT IN ('completed', 'failed') THEN steps + 1 ELSE steps END,
saga, steps, CASE WHEN k THEN 'killed' WHEN o AND kind IN ('completed', 'failed') THEN kind END FROM (SELECT r.user_id, r.i, r.us, r.kind, s.saga, s.steps, s.running AND r.us - s.us > {2 * DAY} AS k, s.running AND r.us - s.us <= {2 * DAY} AS o FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))
SELECT user_id, of AS saga, done AS steps, outcome FROM s WHERE outcome IS NOT NULL UNION ALL SELECT user_id, saga, steps, 'open' FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1) WHERE running""")
def sagas(spark, sf_dir):
    k = F.when(kind("signup"), "started").when(kind("purchase"), "completed").when(kind("error"), "failed").otherwise("step")
    return folds.ordered_fold(events(spark, sf_dir).withColumn("kind", k), "user_id", ORDER, folds.saga("us", "kind", 2 * DAY))


@query(f"WITH {EVENTS} SELECT count(*) AS total, count(*) FILTER (event_type = 'error' AND value > 50) AS quarantined, count(*) FILTER (event_type = 'purchase') AS retried_ok, count(*) FILTER (event_type NOT IN ('error','purchase') OR (event_type = 'error' AND value <= 50)) AS pending FROM ev")
def conditional_counters(spark, sf_dir):
    from tidewell.operators.deadletters import counters

    e = events(spark, sf_dir)
    bad = kind("error") & (F.col("value") > 50)
    return counters(e.select(F.when(bad, F.col("us")).alias("quarantined_at"), F.when(bad | kind("purchase"), F.col("us")).alias("resolved_at")))


@query(f"WITH {EVENTS} SELECT event_type AS reason, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, reason")
def reason_histogram(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query(f"WITH {EVENTS} SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2 ORDER BY n DESC, user_id, event_type LIMIT 8")
def talkers_top8(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return keys.ranked_limit(n, [F.desc("n"), F.col("user_id"), F.col("event_type")], 8)


BUCKETS = [("0-5s", 0), ("5-10s", 5_000), ("10-15s", 10_000), ("15-20s", 15_000), ("20-30s", 20_000), ("30-45s", 30_000), ("45-60s", 45_000), ("60s+", 60_000)]
_CASE = "CASE " + " ".join(f"WHEN value * 1000 >= {lo} THEN '{b}'" for b, lo in reversed(BUCKETS)) + " END"


@query(f"WITH {EVENTS}, d AS (SELECT unnest({[b for b, _ in BUCKETS]}) AS bucket), c AS (SELECT {_CASE} AS bucket, count(*) AS n FROM ev GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (bucket)")
def latency_histogram(spark, sf_dir):
    ms = F.col("value") * 1000
    case = F
    for b, lo in reversed(BUCKETS):
        case = case.when(ms >= lo, b)
    counts = events(spark, sf_dir).groupBy(case.otherwise(None).alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b, _ in BUCKETS])).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {EVENTS}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev)
SELECT event_type, max(n) AS n, ((min(value) FILTER (i = (n + 1) // 2)) + (min(value) FILTER (i = n // 2 + 1)))::DOUBLE / 2 AS median, min(value) FILTER (i = n // 2 + 1) AS upper_median,
min(value) FILTER (i = least(n * 95 // 100 + 1, n)) AS p95_floor, min(value) FILTER (i = (n * 95 + 99) // 100) AS p95_nearest, min(value) FILTER (i = greatest(n * 95 // 100, 1)) AS p95_below FROM r GROUP BY 1""")
def percentile_rules(spark, sf_dir):
    p = stats.ranked_percentiles(events(spark, sf_dir), "event_type", F.col("value"), ["median", "upper_median", "p95_floor", "p95_nearest", "p95_below"])
    return p.withColumn("median", F.col("median").cast("double"))


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, sum(value) AS cost, count(*) AS score FROM ev GROUP BY 1)
SELECT user_id, cost, score, EXISTS (SELECT 1 FROM p q WHERE q.cost <= p.cost AND q.score >= p.score AND (q.cost < p.cost OR q.score > p.score)) AS dominated FROM p""")
def pareto_dominated(spark, sf_dir):
    p = events(spark, sf_dir).groupBy("user_id").agg(F.sum("value").alias("cost"), F.count("*").alias("score"))
    return joins.pareto(p, "cost", "score")


@query(f"""WITH {EVENTS}, p AS (SELECT event_type, user_id, sum(value) AS cost, count(*) AS score FROM ev GROUP BY 1, 2)
SELECT event_type, user_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.event_type = p.event_type AND q.cost <= p.cost AND q.score >= p.score AND (q.cost < p.cost OR q.score > p.score))""")
def pareto_frontier(spark, sf_dir):
    p = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.sum("value").alias("cost"), F.count("*").alias("score"))
    return joins.pareto(p, "cost", "score", "event_type").filter(~F.col("dominated")).select("event_type", "user_id")


@query(f"""WITH {EVENTS}, p AS (SELECT event_type AS label, count(*) AS n FROM ev WHERE user_id % 2 = 0 GROUP BY 1), q AS (SELECT event_type AS label, count(*) AS n FROM ev WHERE user_id % 2 = 1 GROUP BY 1),
b AS (SELECT coalesce(p.n, 0) / (SELECT sum(n) FROM p)::DOUBLE AS p, coalesce(q.n, 0) / (SELECT sum(n) FROM q)::DOUBLE AS q FROM p FULL JOIN q USING (label))
SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 9) AS js FROM b""")
def js_divergence(spark, sf_dir):
    e = events(spark, sf_dir)
    side = lambda k: e.filter(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return stats.js_divergence(side(0), side(1)).select(F.round("js", 9).alias("js"))


@query(f"""WITH {EVENTS}, p AS (SELECT value, count(*) FILTER (event_type = 'view') AS x, count(*) FILTER (event_type = 'purchase') AS y FROM ev WHERE event_type IN ('view','purchase') GROUP BY 1),
c AS (SELECT sum(x) OVER (ORDER BY value)::DOUBLE / (SELECT sum(x) FROM p) AS cx, sum(y) OVER (ORDER BY value)::DOUBLE / (SELECT sum(y) FROM p) AS cy FROM p) SELECT round(max(abs(cx - cy)), 9) AS ks FROM c""")
def ks_distance(spark, sf_dir):
    e = events(spark, sf_dir).filter(kind("view", "purchase")).select(F.col("value").alias("v"), F.when(kind("view"), 0).otherwise(1).alias("side"))
    return stats.ks_distance(e).select(F.round("ks", 9).alias("ks"))


_FINGER = "lower(substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr({x}, 1, 500), '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}[^\\s]*', '{{ts}}', 'g'), '0x[0-9a-fA-F]{{4,}}', '{{hex}}', 'g'), '\\b[0-9A-Z]{{26}}\\b', '{{ulid}}', 'g'), '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '{{uuid}}', 'g'), '\\b(?:pid|PID)[=: ]\\d+', 'pid={{N}}', 'g'), '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b', '{{ip}}', 'g'), '\\d+', '{{N}}', 'g'), '\\s+', ' ', 'g')), 1, 150))"
LINE = "event_type || ' took ' || value || ' at 10.0.0.' || user_id || ' pid=' || event_id || ' ' || props"


def log_line() -> Column:
    return F.concat_ws("", F.col("event_type"), F.lit(" took "), F.col("value").cast("string"), F.lit(" at 10.0.0."), F.col("user_id"), F.lit(" pid="), F.col("event_id"), F.lit(" "), F.col("props"))


@query(f"WITH {EVENTS}, f AS (SELECT {_FINGER.format(x=LINE)} AS fp, event_id FROM ev) SELECT fp, substr(sha256(fp), 1, 16) AS hash, count(*) AS n, min(event_id) AS first_seen FROM f GROUP BY 1, 2")
def fingerprint_counts(spark, sf_dir):
    f = events(spark, sf_dir).select(text.fingerprint(log_line()).alias("fp"), "event_id")
    return f.groupBy("fp", text.fingerprint_hash(F.col("fp")).alias("hash")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, us // {DAY} AS day, event_type, count(*) AS n FROM ev WHERE event_type IN ('error','view') GROUP BY 1, 2, 3)
SELECT user_id, day, count(*) FILTER (n >= 2) AS dense, count(*) FILTER (n >= 2) >= 2 AS gate FROM d GROUP BY 1, 2""")
def density_gate(spark, sf_dir):
    e = events(spark, sf_dir).filter(kind("error", "view")).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day"), "event_type").agg(F.count("*").alias("n"))
    return e.groupBy("user_id", "day").agg(F.count_if(F.col("n") >= 2).alias("dense")).withColumn("gate", F.col("dense") >= 2)


@query(f"""WITH {EVENTS}, w AS (SELECT event_type, us // {DAY} AS day, count(*) AS n, min(us) AS a, max(us) AS b, count(*) FILTER (value > 40) AS errors, sum(value) AS total, sum(value * value) AS squares, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1, 2)
SELECT event_type, day, n, round(n * 60.0 / (greatest(b - a, 1000000) / 1000000.0), 6) AS per_minute, round(errors::DOUBLE / n, 6) AS error_rate, round(total::DOUBLE / n, 6) AS mean, lo, hi FROM w""")
def window_stats(spark, sf_dir):
    v = F.col("value")
    w = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"), F.count_if(v > 40).alias("errors"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    rate = sessions.rate_per_minute(F.col("n").cast("double"), F.col("a"), F.col("b"))
    return w.select("event_type", "day", "n", F.round(rate, 6).alias("per_minute"), F.round(F.col("errors").cast("double") / F.col("n"), 6).alias("error_rate"), F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean"), "lo", "hi")


@query(f"""WITH {EVENTS}, h AS (SELECT user_id, us // {HOUR} AS hour, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT user_id, hour, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY hour) AS growth, greatest(0, n - lag(n) OVER (PARTITION BY user_id ORDER BY hour)) AS rate FROM h""")
def counter_growth(spark, sf_dir):
    from pyspark.sql import Window

    h = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").alias("n"))
    growth = F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("hour"))
    return h.select("user_id", "hour", "n", growth.alias("growth"), F.when(growth.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), growth)).cast("long").alias("rate"))
