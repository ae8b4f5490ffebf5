"""Queries over stored partial rows, sketches with their measured errors, and lists of patterns, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import records
from tidewell.functions.timeutil import DAY
from tidewell.operators import alerts, audits, boards, moments, patterns
from tidewell.plans.events import EVENTS, GAP, events, kind
from tidewell.runtime import table
from tidewell.sources import schema_checks
from tidewell.streaming import processors

QUERIES, ORACLE = {}, {}
RANK_ERROR, DISTINCT_ERROR = 0.03, 0.06


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def by_day(spark, sf_dir):
    return events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY).cast("long"))


@query(f"""WITH {EVENTS} SELECT event_type, count(*) AS n, round(avg(value::DOUBLE), 6) AS mean, round(stddev_pop(value::DOUBLE), 6) AS deviation, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high FROM ev GROUP BY 1""")
def moments_of_merged_days(spark, sf_dir):
    """The moments of each type from its days' rows."""
    days = moments.daily(by_day(spark, sf_dir), ["event_type", "day"], "value")
    m = moments.merged(days, ["event_type"])
    return m.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round(moments.deviation(F.col("n"), F.col("m2")), 6).alias("deviation"), "low", "high")


@query(f"""WITH {EVENTS} SELECT event_type, q, count(*) AS n, true AS within FROM ev, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS q) GROUP BY 1, 2""")
def quantile_sketch_errors(spark, sf_dir):
    """Whether the quantiles of merged days' sketches are within 3 % of the exact ranks."""
    e = by_day(spark, sf_dir)
    m = moments.merged(moments.daily(e, ["event_type", "day"], "value"), ["event_type"])
    given = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), moments.quantile(F.col("sketch"), q).alias("estimate")) for q in (0.5, 0.95, 0.99)])).alias("x")
    off = moments.rank_error(e, ["event_type"], "value", m.select("event_type", given).select("event_type", "x.*"))
    return off.select("event_type", "q", "n", (F.col("error") <= RANK_ERROR).alias("within"))


@query(f"""WITH {EVENTS} SELECT event_type, count(DISTINCT user_id) AS sources, true AS within FROM ev GROUP BY 1""")
def distinct_sources_of_merged_days(spark, sf_dir):
    """Distinct users of each type, and whether the union of its days' sketches comes within 6 %."""
    e = by_day(spark, sf_dir)
    s = moments.union_of(moments.sources(e, ["event_type", "day"], "user_id"), ["event_type"])
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("sources"))
    off = F.abs(moments.distinct_of(F.col("s")) - F.col("sources")) / F.col("sources")
    return exact.join(s.select("event_type", F.col("sources").alias("s")), "event_type").select("event_type", "sources", (off <= DISTINCT_ERROR).alias("within"))


@query(f"""WITH {EVENTS} SELECT user_id, count(*) AS n, true AS not_below, true AS within FROM ev GROUP BY 1""")
def counter_sketch_errors(spark, sf_dir):
    """Events of each user, and whether merged days' counters are never below and within e / width of all events above."""
    e = by_day(spark, sf_dir)
    counters = moments.merge_counters(moments.count_min(e, ["day"], "user_id"), [])
    exact = e.groupBy("user_id").agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("total"))
    x = moments.estimates(exact, "user_id", counters).crossJoin(F.broadcast(total))
    return x.select("user_id", "n", (F.col("estimate") >= F.col("n")).alias("not_below"), (F.col("estimate") - F.col("n") <= F.ceil(2.72 * F.col("total") / moments.WIDTH)).alias("within"))


@query("""WITH n AS (SELECT DISTINCT 'seg' || (c_custkey % 7) || '.cust.' || c_custkey || '.v1' AS name FROM customer), k AS (SELECT o_orderkey AS place, o_custkey AS k FROM orders),
p AS (SELECT place, CASE place % 4 WHEN 0 THEN 'seg' || (k % 7) || '.cust.' || k || '.v1' WHEN 1 THEN 'seg' || (k % 7) || '.cust.' || (k // 10) || '*' WHEN 2 THEN '*.' || k || '.v1' ELSE '*st.' || (k // 3) || '*1' END AS pattern FROM k)
SELECT name, min(place) AS place, arg_min(pattern, place) AS pattern FROM n JOIN p ON name GLOB pattern GROUP BY 1""")
def first_listed_pattern(spark, sf_dir):
    """For each name the first of a list of patterns, one an order, that takes it."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("seg"), (k % 7).cast("string"), F.lit(".cust."), k.cast("string"), F.lit(".v1"))
    c, seg = F.col("o_custkey"), F.concat(F.lit("seg"), (F.col("o_custkey") % 7).cast("string"), F.lit(".cust."))
    whole = lambda x: F.floor(x).cast("string")
    turn = F.col("o_orderkey") % 4
    p = F.when(turn == 0, F.concat(seg, c.cast("string"), F.lit(".v1"))).when(turn == 1, F.concat(seg, whole(c / 10), F.lit("*"))).when(turn == 2, F.concat(F.lit("*."), c.cast("string"), F.lit(".v1"))).otherwise(F.concat(F.lit("*st."), whole(c / 3), F.lit("*1")))
    return patterns.first_match(table(spark, sf_dir, "customer").select(name.alias("name")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), p.alias("pattern")))


def run_events(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("run_key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.floor(F.col("us") / 1_000_000).cast("long").alias("at"), F.col("event_type").alias("what"), F.lit(None).cast("string").alias("body"))


@query(f"""WITH {EVENTS}, e AS (SELECT user_id::VARCHAR AS run_key, lpad(event_id::VARCHAR, 12, '0') AS event_id, us // 1000000 AS sec, event_type AS what FROM ev),
a AS (SELECT *, lag(sec) OVER o AS p, lag(what) OVER o AS w FROM e WINDOW o AS (PARTITION BY run_key ORDER BY sec, event_id)), b AS (SELECT *, sum(CASE WHEN p IS NULL OR w = 'signup' OR sec - p > {GAP // 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY run_key ORDER BY sec, event_id) AS s FROM a),
r AS (SELECT run_key, s, min(sec) AS started, max(sec) AS ended, count(*) AS events, arg_min(event_id, (sec, event_id)) AS f, bool_or(what = 'signup') AS done FROM b GROUP BY 1, 2),
i AS (SELECT *, run_key || '@' || started || '#' || f AS run_id, s = max(s) OVER (PARTITION BY run_key) AS last FROM r),
c AS (SELECT *, lag(run_id) OVER (PARTITION BY run_key ORDER BY s) AS continues, CASE WHEN done THEN 'ended' WHEN last THEN 'shutdown' ELSE 'idle_timeout' END AS close_reason FROM i)
SELECT run_key, run_id, 'event' AS record, row_number() OVER (PARTITION BY run_id ORDER BY sec, event_id) AS seq, event_id, what, close_reason, continues FROM c JOIN b USING (run_key, s)
UNION ALL SELECT run_key, run_id, 'run', events + 1, NULL, 'run.closed', close_reason, continues FROM c""")
def recorded_runs(spark, sf_dir):
    """Runs with their buffered events, as the recorder gives them at each close."""
    r = processors.recorded_batch(run_events(spark, sf_dir), GAP // 1_000_000, ["signup"])
    return r.select("run_key", "run_id", "record", "seq", "event_id", "what", "close_reason", "continues")


@query(None)
def alert_status_changes(spark, sf_dir):
    """Changes of status of alert kinds: an error is a warning of its user's stage, a purchase finishes it. No SQL twin: rings of 500 and a
    regression flag; tests hold it against cases by hand and a stream against it."""
    e = events(spark, sf_dir).filter(kind("error", "purchase"))
    stage = F.to_json(F.struct((F.col("user_id") % 40).cast("string").alias("stage"), F.lit("m").alias("model"), F.lit("slow").alias("issue")))
    name = F.when(kind("error"), "shop." + alerts.WARNING).otherwise("shop." + alerts.DONE)
    return alerts.alert_changes(alerts.alert_facts(e.select(name.alias("type"), stage.alias("data"), F.floor(F.col("us") / 1_000_000).cast("long").alias("at")), []))




#: Of types "click" and "error"; a purchase's schema has a rule that nobody knows, other types have none.
SCHEMAS = {
    "click": {"type": "object", "required": ["value", "who"], "additionalProperties": False, "properties": {"value": {"type": "number", "minimum": 5, "maximum": 90}, "who": {"oneOf": [{"type": "integer", "minimum": 20}, {"type": "null"}]}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}},
    "error": {"if": {"properties": {"value": {"minimum": 50}}}, "then": {"required": ["reason"]}, "else": {"not": {"required": ["reason"]}}},
    "purchase": {"shape": "round"},
}


@query(f"""WITH {EVENTS}, x AS (SELECT event_id, event_type, value::DOUBLE AS v, CASE WHEN event_id % 5 > 0 THEN user_id END AS who, event_id % 7 = 0 AS extra, event_id % 11 = 0 AS odd, event_id % 3 = 0 AS reason, event_id % 13 = 0 AS cut FROM ev),
r AS (SELECT event_id, event_type, cut, CASE event_type WHEN 'click' THEN CASE WHEN v < 5 THEN 'value: minimum' WHEN v > 90 THEN 'value: maximum' WHEN who < 20 THEN 'who: oneOf' WHEN odd THEN 'tags[]: not allowed' WHEN extra THEN 'extra: additionalProperties' END
WHEN 'error' THEN CASE WHEN v >= 50 AND NOT reason THEN 'reason: required' WHEN v < 50 AND reason THEN 'value: not' END END AS rule FROM x)
SELECT event_id, CASE WHEN cut THEN 'parse_error' WHEN event_type = 'purchase' THEN 'error' WHEN event_type NOT IN ('click', 'error') THEN 'skipped' WHEN rule IS NULL THEN 'ok' ELSE 'violation' END AS outcome, CASE WHEN cut THEN NULL WHEN event_type = 'purchase' THEN 'shape' ELSE rule END AS detail FROM r""")
def schema_outcomes(spark, sf_dir):
    """The five ends of a check of every event's envelope, parsed once."""
    e, i = events(spark, sf_dir), F.col("event_id")
    json_of = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(c.cast("string"))
    tags = F.when(i % 11 == 0, ', "tags": ["a", "c"]').otherwise(', "tags": ["b"]')
    more = F.concat(F.when(kind("click") & (i % 7 == 0), ', "extra": 1').otherwise(""), F.when(kind("error") & (i % 3 == 0), ', "reason": "r"').otherwise(""))
    raw = F.concat(F.lit('{"data": {"value": '), F.col("value").cast("string"), F.lit(', "who": '), json_of(F.when(i % 5 > 0, F.col("user_id"))), tags, more, F.when(i % 13 == 0, "").otherwise("}}"))
    o = schema_checks.outcome(SCHEMAS, F.col("event_type"), raw, lambda s: False)
    return e.select("event_id", o.alias("o")).select("event_id", "o.*")


@query(f"""WITH {EVENTS}, c AS (SELECT (user_id % 30)::VARCHAR AS session, user_id % 3 AS iteration, event_id % 40 AS cs, CASE event_type WHEN 'error' THEN 'CE' WHEN 'click' THEN 'OK' ELSE 'WA' END AS verdict, us // 1000000 AS sec, lpad(event_id::VARCHAR, 12, '0') AS id FROM ev),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session, iteration, cs ORDER BY sec, id) = 1)
SELECT session, iteration::BIGINT AS iteration, count(*) AS done, count(*) FILTER (verdict = 'OK') AS ok, count(*) FILTER (verdict = 'CE') AS ce FROM f GROUP BY 1, 2""")
def session_boards(spark, sf_dir):
    """Cases done and verdicts of every iteration of a session, by the board's reducer; a case counts once."""
    e = events(spark, sf_dir)
    verdict = F.when(kind("error"), "CE").when(kind("click"), "OK").otherwise("WA")
    data = F.to_json(F.struct((F.col("user_id") % 30).cast("string").alias("session_id"), (F.col("user_id") % 3).alias("iteration"), (F.col("event_id") % 40).cast("string").alias("case_id"), verdict.alias("verdict")))
    of = e.select(F.lit("lab.case.result.v1").alias("type"), data.alias("data"), F.floor(F.col("us") / 1_000_000).cast("long").alias("at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"))
    b = boards.boards(boards.routed(of, "lab.")).filter("part LIKE 'iteration/%'")
    facts = F.from_json("facts", "iteration long, done array<string>, live map<string,long>")
    count = lambda v: F.coalesce(F.col("f.live")[v], F.lit(0))
    return b.select("session", facts.alias("f")).select("session", "f.iteration", F.size("f.done").cast("long").alias("done"), count("OK").alias("ok"), count("CE").alias("ce"))


#: Files made of parts: a struct, a type or a class with a field for each word of the name, the brand and the kind.
_FILES = "f AS (SELECT p_partkey AS k, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(replace(p_brand, '#', '_')), lower(p_type)] AS fs FROM part)"


def source_files(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    a, b, c, d = word(1), word(2), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lower("p_type")
    rust = F.concat(F.lit("// struct Old { gone: u8 }\npub struct R"), k, F.lit(" {\n  pub "), a, F.lit(": Vec<(u8, u8)>,\n  "), b, F.lit(": Option<String>, /* x: u8, */\n  "), c, F.lit(": [u8; 4],\n  "), d, F.lit(": f64\n}\n"))
    go = F.concat(F.lit("type R"), k, F.lit(" struct {\n\t// note\n\tEmbedded\n\t"), a, F.lit(", "), b, F.lit(" string\n\t"), c, F.lit(" map[string]int\n\t"), d, F.lit(" *Thing\n}\n"))
    python = F.concat(F.lit("@dataclass\nclass R"), k, F.lit("(Base):\n    "), a, F.lit(": int\n    "), b, F.lit(": str = 'x'\n    loose = 3\n    "), c, F.lit(": list[int]\n\n    def f(self):\n        y: int = 2\n    "), d, F.lit(": float\nz: int = 1\n"))
    turn = F.col("p_partkey") % 3
    name = F.concat(F.lit("src/r"), k, F.when(turn == 0, ".rs").when(turn == 1, ".go").otherwise(".py"))
    return p.select(name.alias("path"), F.when(turn == 0, rust).when(turn == 1, go).otherwise(python).alias("text"))


@query(f"WITH {_FILES} SELECT DISTINCT 'src/r' || k || ['.rs', '.go', '.py'][1 + (k % 3)::INT] AS path, 'R' || k AS record, unnest(fs) AS field FROM f")
def record_fields(spark, sf_dir):
    """Fields of the records in source files of three families."""
    return records.record_fields(source_files(spark, sf_dir))


@query(f"""WITH {_FILES}, x AS (SELECT DISTINCT 'R' || k AS n, unnest(fs) AS field FROM f) SELECT a.n AS a, b.n AS b, count(*) AS shared FROM x a JOIN x b ON a.field = b.field AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 4""")
def duplicate_records(spark, sf_dir):
    """Records of different files that share four fields or more: two sources of one truth."""
    return audits.overlapping(records.record_fields(source_files(spark, sf_dir)), "record", "field", 4)
