"""Audits of dead letters, schemas, channels, hits and evaluations, with their SQL twins.

Letters are orders: the type is the priority, the detail one of three texts by the number; older
letters carry the old field names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import channels, wording
from tidewell.functions.timeutil import DAY, HOUR, micros, parse_time
from tidewell.operators import audits, keys
from tidewell.plans import runs
from tidewell.plans.activity import ACT, activity
from tidewell.plans.events import CHANNEL, EVENTS, channel, events
from tidewell.plans.runs import AS_OF, HITS, RUNS, hit_table, run_table
from tidewell.runtime import table

QUERIES, ORACLE = {}, {}
HANDLERS = [("shop.urgent.v1", "page"), ("shop.high.*", "mail"), ("medium.*", "queue")]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LETTERS = """lt AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS sent, 'shop.' || lower(regexp_extract(o_orderpriority, '[A-Z].*')) || '.v' || (1 + o_orderkey % 2) AS original_type, CASE WHEN o_orderstatus = 'F' THEN 'schema_violation' ELSE 'timeout' END AS failure_reason,
CASE o_orderkey % 3 WHEN 0 THEN '''v' || (o_orderkey % 5) || ''' is not one of [''a'', ''b'']' WHEN 1 THEN 'missing required property ''f' || (o_orderkey % 4) || '''' ELSE 'other ' || (o_orderkey % 2) END AS detail FROM orders)"""
GROUPS = LETTERS + """, vl AS (SELECT *, nullif(regexp_extract(detail, '^''([^'']+)'' is not one of \\[\\s*.+?\\s*\\]', 1), '') AS value, nullif(regexp_extract(detail, 'missing required property ''([^'']+)''', 1), '') AS missing FROM lt),
gr AS (SELECT original_type, coalesce(value, '(required: ' || missing || ')') AS field, value, count(*) AS n, min(sent) AS first_seen, max(sent) AS last_seen FROM vl GROUP BY 1, 2, 3)"""


def letters(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col
    old = k % 4 == 0
    name = F.concat(F.lit("shop."), F.lower(F.regexp_extract("o_orderpriority", "[A-Z].*", 0)), F.lit(".v"), (1 + k % 2).cast("string"))
    reason = F.when(c("o_orderstatus") == "F", "schema_violation").otherwise("timeout")
    detail = F.when(k % 3 == 0, F.concat(F.lit("'v"), (k % 5).cast("string"), F.lit("' is not one of ['a', 'b']"))).when(k % 3 == 1, F.concat(F.lit("missing required property 'f"), (k % 4).cast("string"), F.lit("'"))).otherwise(F.concat(F.lit("other "), (k % 2).cast("string")))
    raw = table(spark, sf_dir, "orders").select(
        k.alias("id"), micros(c("o_orderdate")).alias("at"), F.when(~old, name).alias("original_type"), F.when(old, name).alias("channel"), F.when(~old, reason).alias("failure_reason"), F.when(old, reason).alias("reason"), detail.alias("detail"),
    )
    return audits.with_fallbacks(raw)


@query(f"WITH {LETTERS} SELECT original_type, failure_reason, count(*) AS n FROM lt GROUP BY 1, 2")
def letters_by_reason(spark, sf_dir):
    return letters(spark, sf_dir).groupBy("original_type", "failure_reason").agg(F.count("*").alias("n"))


@query(f"WITH {GROUPS} SELECT * FROM gr")
def letter_groups(spark, sf_dir):
    return audits.letter_groups(letters(spark, sf_dir))


_HANDLER = "CASE WHEN original_type = 'shop.urgent.v1' THEN 'page' WHEN contains(original_type, 'shop.high') THEN 'mail' WHEN contains(original_type, 'medium') THEN 'queue' END"


@query(f"WITH {GROUPS} SELECT original_type, {_HANDLER} AS handler, {_HANDLER} IS NOT NULL AS handled, sum(n)::BIGINT AS n FROM gr GROUP BY 1")
def flow_matrix(spark, sf_dir):
    g = letters(spark, sf_dir).groupBy("original_type").agg(F.count("*").alias("n"))
    g = g.withColumn("handler", audits.first_handler(F.col("original_type"), HANDLERS))
    return g.withColumn("handled", F.col("handler").isNotNull())


@query(f"""WITH {GROUPS}, k AS (SELECT DISTINCT original_type FROM lt WHERE id % 4 <> 1) SELECT g.original_type, field, n, {_HANDLER.replace('original_type', 'g.original_type')} AS handler, k.original_type IS NOT NULL AS known, CASE WHEN k.original_type IS NULL THEN 'no_schema' WHEN {_HANDLER.replace('original_type', 'g.original_type')} IS NULL THEN 'no_handler' WHEN value IS NOT NULL THEN 'enum' WHEN field IS NOT NULL THEN 'required' ELSE 'other' END AS finding
FROM gr g LEFT JOIN k USING (original_type)""")
def hygiene_report(spark, sf_dir):
    """Groups of letters with what is to be done about each: the first finding that holds."""
    d = letters(spark, sf_dir)
    known = d.filter(F.col("id") % 4 != 1).select("original_type").distinct().withColumn("known", F.lit(True))
    g = audits.letter_groups(d).withColumn("handler", audits.first_handler(F.col("original_type"), HANDLERS)).join(known, "original_type", "left")
    g = g.withColumn("known", F.coalesce("known", F.lit(False)))
    finding = F.when(~F.col("known"), "no_schema").when(F.col("handler").isNull(), "no_handler").when(F.col("value").isNotNull(), "enum").when(F.col("field").isNotNull(), "required").otherwise("other")
    return g.select("original_type", "field", "n", "handler", "known", finding.alias("finding"))


@query(f"WITH {GROUPS} SELECT original_type, string_agg(DISTINCT value, ',' ORDER BY value) AS add, sum(n)::BIGINT AS n FROM gr WHERE value IS NOT NULL GROUP BY 1")
def schema_patches(spark, sf_dir):
    return audits.enum_patches(audits.letter_groups(letters(spark, sf_dir)))


@query(f"WITH {GROUPS} SELECT original_type, sum(n)::BIGINT AS n, max(last_seen) AS last_seen, {AS_OF - 500 * DAY} - max(last_seen) > {30 * DAY} AS stale FROM gr WHERE starts_with(original_type, 'shop.') GROUP BY 1")
def stale_types(spark, sf_dir):
    return audits.stale(audits.letter_groups(letters(spark, sf_dir)), "shop.", AS_OF - 500 * DAY, 30 * DAY)


@query(f"WITH {LETTERS} SELECT id, original_type, CASE WHEN failure_reason = 'timeout' AND id % 3 = 2 THEN sent + {HOUR} END AS resolved_at, failure_reason = 'timeout' AND id % 3 = 2 AS resubmitted FROM lt")
def retry_results(spark, sf_dir):
    """Letters after a retry: those whose publishing succeeded are resolved and sent again."""
    d = letters(spark, sf_dir)
    ok = (F.col("failure_reason") == "timeout") & (F.col("id") % 3 == 2)
    return d.select("id", "original_type", F.when(ok, F.col("at") + HOUR).alias("resolved_at"), ok.alias("resubmitted"))


@query(f"WITH {LETTERS}, q AS (SELECT * FROM lt ORDER BY sent DESC, id DESC LIMIT 500) SELECT id, substr(detail, 1, 12) AS description FROM q ORDER BY sent DESC, id DESC LIMIT 20")
def draft_queue(spark, sf_dir):
    """The queue keeps the newest 500 drafts; its first 20."""
    newest = [F.desc("at"), F.desc("id")]
    q = keys.ranked_limit(letters(spark, sf_dir), newest, 500)
    return keys.ranked_limit(q, newest, 20).select("id", F.substring("detail", 1, 12).alias("description"))


@query(f"WITH {EVENTS}, c AS (SELECT {CHANNEL} AS channel, us, event_id FROM ev), g AS (SELECT regexp_replace(channel, '\\.v\\d+$', '') AS base, count(*) AS n, count(DISTINCT channel) AS versions, min(event_id) AS example FROM c GROUP BY 1) SELECT base, CASE WHEN base LIKE '%.session.%' THEN 'Browsing' ELSE 'Trade' END AS cluster, n, versions, example FROM g WHERE contains(base, 'shop')")
def channel_catalogue(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("channel", channel())
    g = e.groupBy(channels.without_version(F.col("channel")).alias("base")).agg(F.count("*").alias("n"), F.countDistinct("channel").alias("versions"), F.min("event_id").alias("example"))
    return g.filter(F.contains("base", F.lit("shop"))).withColumn("cluster", channels.cluster(F.col("base"), [(r"\.session\.", "Browsing")], "Trade"))


@query(f"WITH {EVENTS}, c AS (SELECT DISTINCT regexp_replace({CHANNEL}, '\\.v\\d+$', '') AS base FROM ev), s AS (SELECT DISTINCT 'shop.order.' || event_type AS base FROM ev) SELECT count(*) AS channels, count(s.base) AS covered, round(count(s.base) / count(*)::DOUBLE, 3) AS ratio FROM c LEFT JOIN s USING (base)")
def schema_coverage(spark, sf_dir):
    e = events(spark, sf_dir)
    c = e.select(channels.without_version(channel()).alias("base")).distinct()
    s = e.select(F.concat(F.lit("shop.order."), "event_type").alias("base")).distinct().withColumn("known", F.lit(1))
    return c.join(s, "base", "left").groupBy().agg(F.count("*").alias("channels"), F.count("known").alias("covered"), F.round(F.count("known") / F.count("*"), 3).alias("ratio"))


@query("WITH l AS (SELECT DISTINCT trim(split_part(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' # note' ELSE '' END, '#', 1)) AS pattern FROM part WHERE p_partkey % 50 = 0), n AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, (SELECT count(*) FROM l WHERE pattern <> '') AS patterns FROM n WHERE NOT (name LIKE 'Brand#1%' OR regexp_full_match(name, 'Brand#.2'))")
def not_allowed_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lines = p.filter(F.col("p_partkey") % 50 == 0).select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " # note").otherwise("")).alias("value"))
    n = audits.patterns(lines).agg(F.count("*").alias("patterns"))
    bad = audits.not_allowed(p.select(F.col("p_brand").alias("name")).distinct(), "name", ["Brand#1*", "Brand#?2"])
    return bad.crossJoin(F.broadcast(n))  # one row


PANES = "pn AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'zellij:desk' || (user_id % 5) || ':1' WHEN 1 THEN 'docker:shop-agent-' || user_id WHEN 2 THEN 'host:h' || (user_id % 3) || ':2' ELSE '' END AS pane, CASE user_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '' WHEN 2 THEN 'alpha' END AS project, CASE WHEN user_id % 6 = 5 THEN '' ELSE '/src' || (user_id % 3) || '/x' END AS source, ['working', 'idle', 'waiting', 'done'][1 + event_id % 4] AS state, CASE WHEN user_id % 5 = 0 THEN ' ' ELSE 'agent' END AS agent_type FROM ev)"


@query(f"""WITH {EVENTS}, {PANES} SELECT CASE WHEN pane = '' THEN '?' WHEN starts_with(pane, 'docker:') THEN CASE WHEN contains(pane, 'shop') THEN 'shop' ELSE 'other' END ELSE split_part(pane, ':', 2) END AS pane_project, coalesce(nullif(nullif(project, ''), 'unknown'), nullif(split_part(ltrim(source, '/'), '/', 1), ''), '?') AS label, count(*) AS n FROM pn WHERE state IN ('working', 'idle', 'waiting') AND trim(agent_type) <> '' GROUP BY 1, 2""")
def project_labels(spark, sf_dir):
    """Live sessions by the project of their pane and of their events."""
    i, u, s = F.col("event_id"), F.col("user_id"), lambda c: c.cast("string")
    pane = F.when(i % 4 == 0, F.concat(F.lit("zellij:desk"), s(u % 5), F.lit(":1"))).when(i % 4 == 1, F.concat(F.lit("docker:shop-agent-"), s(u))).when(i % 4 == 2, F.concat(F.lit("host:h"), s(u % 3), F.lit(":2"))).otherwise("")
    project = F.when(u % 4 == 0, "unknown").when(u % 4 == 1, "").when(u % 4 == 2, "alpha")
    source = F.when(u % 6 == 5, "").otherwise(F.concat(F.lit("/src"), s(u % 3), F.lit("/x")))
    state = F.element_at(F.array(*map(F.lit, ("working", "idle", "waiting", "done"))), (1 + i % 4).cast("int"))
    live = channels.live(state, F.when(u % 5 == 0, " ").otherwise("agent"), ("working", "idle", "waiting"))
    e = events(spark, sf_dir).filter(live)
    return e.groupBy(channels.project_of_pane(pane, ["shop"], "other").alias("pane_project"), channels.project_label(project, source).alias("label")).agg(F.count("*").alias("n"))


KINDS = "kn AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'tsp.best.v1' WHEN 1 THEN 'kernel.run.start.v1' WHEN 2 THEN 'bench.island.health.v1' WHEN 3 THEN 'kernel.best.v1' ELSE 'bench.x.best.v1' END AS type, CASE WHEN event_id % 3 = 0 THEN 'tsp' WHEN event_id % 3 = 1 THEN 'sat' END AS domain FROM ev)"


@query(f"""WITH {EVENTS}, {KINDS} SELECT type, domain, CASE WHEN type = 'bench.island.health.v1' THEN '?/island_health' WHEN starts_with(type, 'kernel.') THEN coalesce(domain, '?') || CASE type WHEN 'kernel.best.v1' THEN '/best' ELSE '/start' END WHEN starts_with(type, 'bench.') THEN NULL ELSE 'tsp/best' END AS kind,
CASE WHEN starts_with(type, 'tsp.') THEN type WHEN starts_with(type, 'kernel.') AND coalesce(domain, 'tsp') = 'tsp' THEN CASE type WHEN 'kernel.best.v1' THEN 'tsp.best.v1' ELSE 'tsp.run.start.v1' END END AS legacy, count(*) AS n FROM kn GROUP BY 1, 2""")
def kernel_kinds(spark, sf_dir):
    i = F.col("event_id")
    type_ = F.when(i % 5 == 0, "tsp.best.v1").when(i % 5 == 1, "kernel.run.start.v1").when(i % 5 == 2, "bench.island.health.v1").when(i % 5 == 3, "kernel.best.v1").otherwise("bench.x.best.v1")
    domain = F.when(i % 3 == 0, "tsp").when(i % 3 == 1, "sat")
    e = events(spark, sf_dir).groupBy(type_.alias("type"), domain.alias("domain")).agg(F.count("*").alias("n"))
    kinds = {"best": "best", "run.start": "start"}
    return e.withColumns({"kind": channels.kernel_kind(F.col("type"), F.col("domain"), kinds, {"bench.island.health.v1": "island_health"}, "bench"), "legacy": channels.legacy_kernel_type(F.col("type"), F.col("domain"), "tsp", list(kinds))})


@query(f"""WITH {ACT}, q AS (SELECT event_id, run_id, CASE WHEN event_id % 2 = 0 THEN 'permission_requested' ELSE 'activity' END AS event_type, tool, summary FROM act) SELECT event_id, CASE WHEN event_type = 'permission_requested' THEN trim(summary) ELSE trim(json_extract_string(CASE WHEN json_valid(summary) THEN summary END, '$.description')) END AS question FROM q
WHERE CASE WHEN event_type = 'permission_requested' THEN summary <> '' ELSE tool IN ('Task') AND coalesce(json_extract_string(CASE WHEN json_valid(summary) THEN summary END, '$.description'), '') LIKE 'fix%' END""")
def question_texts(spark, sf_dir):
    """The question that an event puts to a person: of a permission its summary, of other calls a description of a certain form."""
    asked = F.col("event_id") % 2 == 0
    said = F.when(asked, F.nullif(F.trim("summary"), F.lit(""))).when((F.col("tool") == "Task") & F.get_json_object("summary", "$.description").startswith("fix"), F.trim(F.get_json_object("summary", "$.description")))
    return activity(spark, sf_dir).select("event_id", said.alias("question")).filter("question IS NOT NULL")


@query(f"""WITH {RUNS}, e AS (SELECT cust AS signature, run_id, started, CASE WHEN price > 150000 THEN 'propose_fix' ELSE 'monitor' END AS decision, floor(price)::BIGINT / 400000.0::DOUBLE AS score FROM run), l AS (SELECT *, lag(decision) OVER w AS d0, lag(score) OVER w AS s0, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY signature ORDER BY started, run_id))
SELECT signature, run_id, decision, score FROM l WHERE k = 1 OR d0 <> decision OR abs(s0 - score) > 0.05""")
def evaluations_written(spark, sf_dir):
    r = run_table(spark, sf_dir)
    e = r.select(F.col("cust").alias("signature"), "run_id", "started", F.when(F.col("price") > 150000, "propose_fix").otherwise("monitor").alias("decision"), (F.floor("price") / F.lit(400000.0)).alias("score"))
    return audits.changed_evaluations(e, "signature", ["started", "run_id"], ["decision"]).drop("started")


LOGICAL = f"""{runs.CHAIN}, {HITS}, up AS (SELECT id, id AS root FROM link WHERE parent IS NULL UNION ALL SELECT link.id, up.root FROM link JOIN up ON link.parent = up.id), lg AS (SELECT run_id, root AS logical, project FROM run JOIN up ON id = run_id)"""


def logical_runs(spark, sf_dir) -> DataFrame:
    """A run's logical run is the root of its chain: runs of a customer that follow each other within the gap."""
    roots = runs.logical_run_roots(spark, sf_dir).select(F.col("id").alias("run_id"), F.col("root").alias("logical"))
    return run_table(spark, sf_dir).select("run_id", "project").join(roots, "run_id")


@query(f"""WITH RECURSIVE {LOGICAL}, t AS (SELECT project, count(DISTINCT logical) AS runs FROM lg GROUP BY 1), h AS (SELECT project, detector, count(DISTINCT logical) AS hit_runs FROM hit JOIN lg USING (run_id) GROUP BY 1, 2) SELECT project, detector, hit_runs, runs, round(hit_runs / runs::DOUBLE, 9) AS rate FROM h JOIN t USING (project)""")
def logical_prevalence(spark, sf_dir):
    """Prevalence by logical runs: runs that continue one another count once."""
    lg = logical_runs(spark, sf_dir)
    t = lg.groupBy("project").agg(F.countDistinct("logical").alias("runs"))
    h = hit_table(spark, sf_dir).join(lg, "run_id").groupBy("project", "detector").agg(F.countDistinct("logical").alias("hit_runs"))
    return h.join(t, "project").withColumn("rate", F.round(F.col("hit_runs") / F.col("runs"), 9))


@query(f"WITH RECURSIVE {LOGICAL} SELECT logical, detector, min(run_id) AS run_id, count(*) AS hits FROM hit JOIN lg USING (run_id) GROUP BY 1, 2")
def hits_by_logical_run(spark, sf_dir):
    h = hit_table(spark, sf_dir).join(logical_runs(spark, sf_dir), "run_id")
    return h.groupBy("logical", "detector").agg(F.min("run_id").alias("run_id"), F.count("*").alias("hits"))


@query(f"""WITH {RUNS}, {HITS}, r AS (SELECT run_id, count(*) AS hits, count(*) FILTER (ts >= started + {60 * DAY}) AS later FROM hit JOIN run USING (run_id) GROUP BY 1) SELECT run_id, CASE WHEN later > 0 THEN later ELSE hits END AS counted, later = 0 AS fell_back FROM r""")
def hits_after_cut(spark, sf_dir):
    """Hits after a run's cut; all of its hits where none is."""
    h = hit_table(spark, sf_dir).join(run_table(spark, sf_dir), "run_id")
    g = h.groupBy("run_id").agg(F.count("*").alias("hits"), F.count_if(F.col("ts") >= F.col("started") + 60 * DAY).alias("later"))
    return g.select("run_id", F.when(F.col("later") > 0, F.col("later")).otherwise(F.col("hits")).alias("counted"), (F.col("later") == 0).alias("fell_back"))


@query(f"WITH {RUNS}, {HITS} SELECT run_id, project FROM run WHERE labeled_at IS NOT NULL AND EXISTS (SELECT 1 FROM hit WHERE hit.run_id = run.run_id)")
def labeled_with_hits(spark, sf_dir):
    r = run_table(spark, sf_dir).filter(F.col("labeled_at").isNotNull())
    return r.join(hit_table(spark, sf_dir), "run_id", "left_semi").select("run_id", "project")


@query(f"WITH {ACT}, c AS (SELECT DISTINCT run_id FROM act WHERE tool = 'Bash' AND contains(lower(summary), 'cargo ')) SELECT run_id, tool, count(*) AS n FROM act WHERE run_id IN (SELECT run_id FROM c) GROUP BY 1, 2")
def runs_with_cargo(spark, sf_dir):
    """Two passes: runs with a candidate command, then all calls of these runs."""
    a = activity(spark, sf_dir)
    c = a.filter((F.col("tool") == "Bash") & F.contains(F.lower("summary"), F.lit("cargo "))).select("run_id").distinct()
    return a.join(c, "run_id", "left_semi").groupBy("run_id", "tool").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT c_custkey AS session, [c_nationkey, c_custkey % 25, 24] AS advocates FROM customer), x AS (SELECT session, unnest(advocates) AS advocate FROM s) SELECT advocate, n_name AS name, count(*) AS votes, count(DISTINCT session) AS sessions FROM x LEFT JOIN nation ON n_nationkey = advocate GROUP BY 1, 2")
def advocates(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.explode(F.array(F.col("c_nationkey").cast("long"), (F.col("c_custkey") % 25).cast("long"), F.lit(24).cast("long"))).alias("advocate"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("advocate"), F.col("n_name").alias("name"))
    return x.join(n, "advocate", "left").groupBy("advocate", "name").agg(F.count("*").alias("votes"), F.countDistinct("session").alias("sessions"))


@query("SELECT c_custkey AS session, count(o_orderkey) AS tasks, coalesce(max(o_orderpriority), '-') AS task FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1")
def session_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O")
    j = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy(F.col("c_custkey").alias("session")).agg(F.count("o_orderkey").alias("tasks"), F.coalesce(F.max("o_orderpriority"), F.lit("-")).alias("task"))


@query(f"WITH {EVENTS} SELECT 'bus' AS origin, event_type AS channel, us // {HOUR} AS win, count(*) AS n FROM ev WHERE event_type <> 'error' GROUP BY 1, 2, 3 UNION ALL SELECT 'log', 'log:' || (user_id % 3), us // {HOUR}, count(*) FROM ev WHERE event_type = 'error' GROUP BY 1, 2, 3")
def bundle_windows(spark, sf_dir):
    """Windows of bus channels and of logs as one stream of bundles."""
    e = events(spark, sf_dir).withColumn("win", F.floor(F.col("us") / HOUR))
    error = F.col("event_type") == "error"
    of = lambda d, origin, name: d.groupBy(F.lit(origin).alias("origin"), name.alias("channel"), "win").agg(F.count("*").alias("n"))
    return of(e.filter(~error), "bus", F.col("event_type")).unionByName(of(e.filter(error), "log", F.concat(F.lit("log:"), (F.col("user_id") % 3).cast("string"))))


@query(f"WITH {EVENTS} SELECT event_type, user_id % 7 AS project, count(*) AS n, count(DISTINCT event_id) AS ids FROM ev GROUP BY 1, 2")
def counters_by_project(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 7).alias("project")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query(f"WITH {EVENTS} SELECT event_id, '[\"a\",\"' || json_extract_string(props, '$.k') || '\"]' AS items FROM ev WHERE event_id % 3 > 0")
def fenced_arrays(spark, sf_dir):
    """JSON arrays out of answers that wrap them in fences and words; answers without one give nothing."""
    k = F.get_json_object("props", "$.k")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("none of these "), k)).when(F.col("event_id") % 3 == 1, F.concat(F.lit('Here:\n```json\n["a", "'), k, F.lit('"]\n```\ndone'))).otherwise(F.concat(F.lit('["a","'), k, F.lit('"]')))
    return events(spark, sf_dir).select("event_id", wording.json_array(said).alias("x")).filter("x IS NOT NULL").select("event_id", F.to_json("x").alias("items"))


@query("SELECT s_nationkey AS a, t.s_nationkey AS b, count(*) AS shared FROM (SELECT DISTINCT s_nationkey, s_suppkey % 20 AS f FROM supplier) s JOIN (SELECT DISTINCT s_nationkey, s_suppkey % 20 AS f FROM supplier) t USING (f) WHERE s.s_nationkey < t.s_nationkey GROUP BY 1, 2 HAVING count(*) >= 2".replace("SELECT s_nationkey AS a", "SELECT s.s_nationkey AS a"))
def field_overlap(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 20).alias("f"))
    return audits.overlapping(s, "s_nationkey", "f", 2)


@query(f"WITH {EVENTS} SELECT k AS key, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT 'k' AS k, json_extract_string(props, '$.k')::BIGINT AS v FROM ev) GROUP BY 1")
def map_value_totals(spark, sf_dir):
    m = events(spark, sf_dir).select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return m.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("total"))


@query(f"WITH {HITS}, g AS (SELECT detector, supp, count(DISTINCT run_id) AS recurrence, max(ts) AS last_seen FROM hit WHERE ts >= {AS_OF - 900 * DAY} GROUP BY 1, 2) SELECT * FROM g ORDER BY recurrence DESC, last_seen DESC, detector, supp LIMIT 40")
def issues_by_recurrence(spark, sf_dir):
    g = hit_table(spark, sf_dir).filter(F.col("ts") >= AS_OF - 900 * DAY).groupBy("detector", "supp").agg(F.countDistinct("run_id").alias("recurrence"), F.max("ts").alias("last_seen"))
    return keys.ranked_limit(g, [F.desc("recurrence"), F.desc("last_seen"), F.col("detector"), F.col("supp")], 40)


@query(f"""WITH {RUNS}, c AS (SELECT project, cust, count(*) AS flagged, sum(event_count)::BIGINT AS cost FROM run WHERE event_count >= 100 GROUP BY 1, 2) SELECT project, count(*) AS n, sum(flagged)::BIGINT AS flagged, quantile_disc(cost, 0.5) AS p50, quantile_disc(cost, 0.9) AS p90 FROM c GROUP BY 1 HAVING sum(flagged) >= 2""")
def cost_distribution(spark, sf_dir):
    """Median and 90th percentile of a cost by project, for projects with two flagged runs or more: values are counted before they are ranked."""
    c = run_table(spark, sf_dir).filter(F.col("event_count") >= 100).groupBy("project", "cust").agg(F.count("*").alias("flagged"), F.sum("event_count").cast("long").alias("cost"))
    v = c.groupBy("project", "cost").agg(F.count("*").alias("n"), F.sum("flagged").alias("flagged"))
    upto = F.sum("n").over(Window.partitionBy("project").orderBy("cost").rowsBetween(Window.unboundedPreceding, 0))
    v = v.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy("project"))})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("all")), F.col("cost")))
    return v.groupBy("project").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), at(0.5).alias("p50"), at(0.9).alias("p90")).filter("flagged >= 2")


@query(f"""WITH {EVENTS}, g AS (SELECT event_type, max(us) AS last, count(*) FILTER (event_id % 9 = 0) AS backlog FROM ev GROUP BY 1), m AS (SELECT max(us) AS now FROM ev) SELECT event_type, now - last <= {1800 * 1_000_000} AS fresh, backlog, now - last <= {1800 * 1_000_000} AND backlog <= 100 AS alive FROM g, m""")
def pipeline_liveness(spark, sf_dir):
    e = events(spark, sf_dir)
    g = e.groupBy("event_type").agg(F.max("us").alias("last"), F.count_if(F.col("event_id") % 9 == 0).alias("backlog")).crossJoin(F.broadcast(e.agg(F.max("us").alias("now"))))  # one row
    fresh = F.col("now") - F.col("last") <= 1800 * 1_000_000
    return g.select("event_type", fresh.alias("fresh"), "backlog", (fresh & (F.col("backlog") <= 100)).alias("alive"))


@query(f"""WITH {EVENTS}, p AS (SELECT event_type, max(event_id) AS head, max(event_id) FILTER (event_type <> 'x' AND value > 5) AS acked, count(*) FILTER (value <= 5) AS pending, min(us) FILTER (value <= 5) AS oldest FROM ev GROUP BY 1) SELECT event_type, head - acked AS lag, pending, oldest FROM p""")
def consumer_lag(spark, sf_dir):
    open_ = F.col("value") <= 5
    p = events(spark, sf_dir).groupBy("event_type").agg(F.max("event_id").alias("head"), F.max(F.when(~open_, F.col("event_id"))).alias("acked"), F.count_if(open_).alias("pending"), F.min(F.when(open_, F.col("us"))).alias("oldest"))
    return p.select("event_type", (F.col("head") - F.col("acked")).alias("lag"), "pending", "oldest")


@query(f"""WITH {EVENTS}, f AS (SELECT event_type, user_id % 30 AS fp, count(*) AS n FROM ev GROUP BY 1, 2), g AS (SELECT DISTINCT event_type, user_id % 30 AS fp, us FROM ev), s AS (SELECT event_id, event_type, us FROM ev WHERE event_id % 211 = 0),
d AS (SELECT g.event_type, g.fp, count(DISTINCT s.event_id) AS dismissed FROM g JOIN s ON s.event_type = g.event_type AND s.us >= g.us AND s.us - g.us < {DAY} GROUP BY 1, 2) SELECT f.event_type, f.fp, n, coalesce(dismissed, 0) AS dismissed FROM f LEFT JOIN d USING (event_type, fp)""")
def dismissed_fingerprints(spark, sf_dir):
    """Fingerprints with how many rejected signals of their channel came within a day behind any of their sights."""
    e = events(spark, sf_dir).withColumn("fp", F.col("user_id") % 30)
    day = F.floor(F.col("us") / DAY)
    s = e.filter(F.col("event_id") % 211 == 0).select(F.col("event_type").alias("t"), F.col("event_id").alias("signal"), F.col("us").alias("at"), F.explode(F.array(day, day - 1)).alias("on"))  # verdicts are few
    g = e.select("event_type", "fp", "us", day.alias("day")).distinct()
    near = (F.col("event_type") == F.col("t")) & (F.col("day") == F.col("on")) & (F.col("at") >= F.col("us")) & (F.col("at") - F.col("us") < DAY)
    d = g.join(s, near).groupBy("event_type", "fp").agg(F.count_distinct("signal").alias("dismissed"))
    f = e.groupBy("event_type", "fp").agg(F.count("*").alias("n"))
    return f.join(d, ["event_type", "fp"], "left").fillna(0, ["dismissed"])


@query(f"""WITH {EVENTS}, c AS (SELECT event_type, user_id % 10 AS kind, count(*) AS n, round(avg(value::DOUBLE), 6) AS rate FROM ev GROUP BY 1, 2), g AS (SELECT user_id % 10 AS kind, round(avg(value::DOUBLE), 6) AS rate FROM ev GROUP BY 1) SELECT event_type, kind, CASE WHEN n >= 150 THEN c.rate ELSE g.rate END AS rate, n < 150 AS global FROM c JOIN g USING (kind)""")
def calibration_fallback(spark, sf_dir):
    """Rates by channel where it has enough cases, else those of all channels."""
    e = events(spark, sf_dir).withColumn("kind", F.col("user_id") % 10)
    mean = F.round(F.avg(F.col("value").cast("double")), 6)
    c = e.groupBy("event_type", "kind").agg(F.count("*").alias("n"), mean.alias("own"))
    j = c.join(e.groupBy("kind").agg(mean.alias("all")), "kind")
    return j.select("event_type", "kind", F.when(F.col("n") >= 150, F.col("own")).otherwise(F.col("all")).alias("rate"), (F.col("n") < 150).alias("global"))


@query(f"WITH {RUNS} SELECT run_id, o AS text, epoch_us(d) AS us FROM (SELECT run_id, make_timestamp(started) AS d, CASE run_id % 4 WHEN 0 THEN strftime(make_timestamp(started), '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(make_timestamp(started), '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(make_timestamp(started), '%Y-%m-%dT%H:%M:%S.000000Z') ELSE 'soon' END AS o FROM run) WHERE o <> 'soon'")
def parsed_times(spark, sf_dir):
    at = F.timestamp_micros("started")
    t = F.when(F.col("run_id") % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("run_id") % 4 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(F.col("run_id") % 4 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.000000Z'")).otherwise("soon")
    r = run_table(spark, sf_dir).select("run_id", t.alias("text"))
    return r.withColumn("us", micros(parse_time(F.col("text")))).filter("us IS NOT NULL")
