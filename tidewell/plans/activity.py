"""Queries over agent activity, which the event table stands for, with their SQL twins.

A run is a user; each event is a call whose tool, arguments and answer are one of 28 texts, chosen by
a hash of the event's number and filled with it. Every fourth run draws from the first ten only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import commands as C
from tidewell.functions.timeutil import DAY, HOUR
from tidewell.operators import agents, detectors, rebuilds
from tidewell.plans.events import EVENTS, events
from tidewell.runtime import stage, table

QUERIES, ORACLE = {}, {}

CALLS = [
    ("Edit", '{"file_path": "/home/u/projects/shop/src/m{n}.py"}', "{}"),
    ("Bash", '{"command": "cargo test -p core{n}"}', '{"stdout": "test result: FAILED. 1 failed", "stderr": "", "exitCode": 101}'),
    ("Edit", '{"file_path": "/home/u/projects/shop/.claude/worktrees/agent-a{n}/src/../lib/x.rs"}', "{}"),
    ("Bash", '{"command": "pytest tests/{n}"}', '{"stdout": "3 passed", "stderr": "", "exitCode": 0}'),
    ("Read", '{"file_path": "/home/u/projects/shop/README.md"}', '{"stdout": "ok"}'),
    ("Grep", '{"pattern": "def f{n}"}', "{}"),
    ("Bash", '{"command": "make build"}', '{"stdout": "", "stderr": "error: aborting", "interrupted": false}'),
    ("Write", '{"file_path": "/home/u/projects/shop/docs/n{n}.md"}', "{}"),
    ("Read", '{"file_path": "/home/u/projects/shop/src/m{n}.py"}', "{}"),
    ("Bash", '{"command": "git checkout -- src"}', '{"stdout": "", "stderr": "Warning: x", "interrupted": false}'),
    ("Bash", '{"command": "git -C /home/u/projects/shop commit -m done"}', '{"gitOperation": {"commit": {"kind": "committed"}}}'),
    ("Bash", '{"command": "sleep 5 && cat out.log"}', '{"stdout": ""}'),
    ("Bash", '{"command": "grep -rn x{n} src | head"}', "not json"),
    ("Bash", "ls -la /tmp/{n}", ""),
    ("Task", '{"description": "fix {n}", "name": "w{n}", "model": "m1", "isolation": "worktree", "prompt": "Tests are all green on main. Do part {n}"}', '{"agentId": "a{n}", "description": "d"}'),
    ("Agent", '{"model": "m2", "name": "v{n}", "prompt": "The failure is pre-existing", "more": "a long text that is cut o', '{"agentId": "b{n}", "description": "other {n}", "rest": "cut'),
    ("Edit", '{"file": "/home/u/projects/shop/CLAUDE.md"}', "{}"),
    ("Write", '{"file_path": "/home/u/projects/shop/.claude/hooks/pre{n}.sh"}', "{}"),
    ("Bash", '{"command": "cargo build --package ui{n}"}', '{"stdout": "Compiling", "stderr": "foo: command not found", "exitCode": 127}'),
    ("Bash", '{"command": "bd close shop-{n}ab"}', "{}"),
    ("Bash", '{"command": "gh pr create"}', '{"stdout": "https://x/pull/{n}"}'),
    ("Glob", '{"pattern": "*.rs"}', "{}"),
    ("", "", ""),
    ("Read", '{"file_path": "/srv/data/a/b{n}.csv"}', "{}"),
    ("Bash", '{"command": "go test ./..."}', '{"stdout": "FAIL\\tgithub.com/x", "stderr": "", "exit_code": 1}'),
    ("WebFetch", '{"url": "http://h/{n}"}', "{}"),
    ("Bash", '{"command": "git add .claude/settings.local.json"}', "{}"),
    ("Bash", '{"command": "git push origin HEAD"}', '{"gitOperation": {"push": {"ok": true}}}'),
]


def _q(text: str) -> str:
    parts = [f"'{p}'" for p in text.replace("'", "''").replace("\n", "\0chr(10)\0").replace("\t", "\0chr(9)\0").split("\0")]
    return "(" + " || ".join(p[1:-1] if p.startswith("'chr(") else p for p in parts) + ")"


_VALUES = ", ".join(f"({k}, {_q(tool)}, {_q(s)}, {_q(r)})" for k, (tool, s, r) in enumerate(CALLS))
ACT = f"""{EVENTS}, call(k, tool, summary0, response0) AS (VALUES {_VALUES}), act AS (SELECT user_id AS run_id, event_id, us, tool, replace(summary0, '{{n}}', (event_id % 7)::VARCHAR) AS summary, replace(response0, '{{n}}', (event_id % 7)::VARCHAR) AS response,
event_type = 'error' AS is_error, CASE WHEN value > 50 THEN 'timeout' END AS error_type, event_id % 1000 AS input_tokens, event_id % 300 AS output_tokens, event_id % 50 AS cache_read, event_id % 40 AS cache_write, CASE WHEN event_id % 5 > 0 THEN 'm' || ((user_id + event_id) % 3) END AS model,
CASE WHEN user_id % 7 = 6 THEN NULL WHEN event_id % 3 = 0 THEN '/home/u/projects/shop' WHEN event_id % 3 = 1 THEN '/home/u/projects/shop/.claude/worktrees/agent-a' || (event_id % 7) || '/src' ELSE '/home/u/projects/desk/.worktrees/wf_' || (event_id % 7) END AS cwd
FROM ev JOIN call ON k = ((event_id * 2654435761) >> 16) % (CASE WHEN user_id % 4 = 0 THEN 10 ELSE {len(CALLS)} END))"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col, (F.col("event_id") % 7).cast("string")
    k = F.shiftright(c("event_id") * F.lit(2654435761), 16) % F.when(c("user_id") % 4 == 0, 10).otherwise(len(CALLS))
    call = F.element_at(F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(s).alias("summary"), F.lit(r).alias("response")) for t, s, r in CALLS]), (k + 1).cast("int"))
    e = events(spark, sf_dir).withColumn("call", call)
    text = lambda x: F.replace(c(f"call.{x}"), F.lit("{n}"), n)
    cwd = F.when(c("user_id") % 7 == 6, None).when(c("event_id") % 3 == 0, "/home/u/projects/shop").when(c("event_id") % 3 == 1, F.concat(F.lit("/home/u/projects/shop/.claude/worktrees/agent-a"), n, F.lit("/src"))).otherwise(F.concat(F.lit("/home/u/projects/desk/.worktrees/wf_"), n))
    return e.select(
        c("user_id").alias("run_id"), "event_id", "us", c("call.tool").alias("tool"), text("summary").alias("summary"), text("response").alias("response"), (c("event_type") == "error").alias("is_error"), F.when(c("value") > 50, "timeout").alias("error_type"),
        (c("event_id") % 1000).alias("input_tokens"), (c("event_id") % 300).alias("output_tokens"), (c("event_id") % 50).alias("cache_read"), (c("event_id") % 40).alias("cache_write"), F.when(c("event_id") % 5 > 0, F.concat(F.lit("m"), ((c("user_id") + c("event_id")) % 3).cast("string"))).alias("model"), cwd.alias("cwd"),
    )


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# pieces of SQL
def _j(x: str, key: str) -> str:
    return f"(CASE WHEN json_valid({x}) THEN json_extract_string({x}, '$.{key}') END)"


def _w(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), {_q(w)})" for w in words) + ")"


def _re(x: str, rule: str) -> str:
    return f"regexp_matches({x}, {_q(rule)})"


def _f(x: str, key: str) -> str:
    """A field, also of a summary that is cut off."""
    rule = f'"{key}"' + r'\s*:\s*"((?:[^"\\]|\\.)*)"'
    return f"coalesce({_j(x, key)}, nullif(regexp_extract({x}, {_q(rule)}, 1), ''))"


_CLASS = lambda x: "CASE " + " ".join(f"WHEN {_re(x, rule)} THEN '{name}'" for name, rule in C.CLASSES) + " ELSE 'act' END"
_OUT = f"(coalesce({_j('response', 'stdout')}, '') || chr(10) || coalesce({_j('response', 'stderr')}, ''))"
_CODE = lambda k: f"coalesce(try_cast({_j('response', k)} AS BIGINT) <> 0, false)"
_FAILED = f"(is_error OR {_CODE('exitCode')} OR {_CODE('exit_code')} OR ({_w(_j('response', 'stderr'), C.STDERR_WORDS)} AND coalesce({_j('response', 'interrupted')} = 'false', false)))"
_CMD0 = f"CASE WHEN json_valid(summary) THEN json_extract_string(summary, '$.command') ELSE summary END"
_SETTLES = f"({_j('response', 'gitOperation.commit')} IS NOT NULL OR {_j('response', 'gitOperation.push')} IS NOT NULL OR coalesce({_re(_CMD0, C.SETTLING)}, false))"
_ABOUT = "CASE WHEN json_valid(summary) THEN replace(coalesce(" + ", ".join(_j("summary", k) for k in C.KEY_FIELDS) + ", ''), chr(10), ' ') ELSE summary[:200] END"
_FCMD = f"coalesce({_f('summary', 'command')}, '')"
_VERIFIES = f"({_FCMD} <> '' AND ({_w(_FCMD, C.BUILD_WORDS)} OR ({_CLASS(_FCMD)}) IN ('build', 'run-verify')))"
_PATH = f"coalesce({_j('summary', 'file_path')}, {_j('response', 'filePath')}, {_j('summary', 'file')}, '')"
_ENDING = lambda p: f"regexp_extract(regexp_extract(lower({p}), '[^/]*$'), '\\.([^.]*)$', 1)"
_IS_CODE = lambda p: f"(NOT ({_w(p, C.NO_CODE_FOLDERS)} OR {_ENDING(p)} IN ({', '.join(repr(x) for x in C.NO_CODE_ENDINGS)})))"
_LABEL = lambda x: "CASE " + " ".join(f"WHEN {_re(x, rule)} THEN '{name}'" for name, rule in C.HARNESS) + " END"
_SLUG = f"nullif(regexp_extract(coalesce(cwd, ''), {_q(C.WORKTREE)}, 1), '')"
_STATUS = f"CASE WHEN tool = 'Bash' AND {_VERIFIES} THEN CASE WHEN {_w(_OUT, C.FAIL_WORDS)} THEN 'failed' WHEN length({_OUT}) > 1 THEN 'passed' ELSE 'unknown' END END"
_TOOLCLASS = f"CASE WHEN tool = 'Bash' THEN {_CLASS('about')} " + " ".join(f"WHEN tool IN ({', '.join(repr(t) for t in tools)}) THEN '{name}'" for name, tools in C.TOOL_CLASSES.items()) + " ELSE 'act' END"


@query(f"""WITH {ACT}, b AS (SELECT *, {_FCMD} AS command FROM act WHERE tool = 'Bash') SELECT event_id, command, {_CLASS('command')} AS class, {_w('command', C.BUILD_WORDS)} AS build, {_w('command', C.REVERT_WORDS)} AS revert, {_VERIFIES} AS verifies, {_w(_OUT, C.FAIL_WORDS)} AS failed_output,
{_w(_OUT, ('command not found', 'no such file or directory'))} AS not_found, {_w('command', C.CARGO_WORDS)} AS cargo, coalesce(nullif(regexp_extract(command, '(?:-p|--package)\\s+(\\S+)', 1), ''), 'workspace') AS crate, {_w('cwd', ('/.claude/worktrees/', '/.worktrees/'))} AS in_worktree FROM b""")
def command_facts(spark, sf_dir):
    b = activity(spark, sf_dir).filter(F.col("tool") == "Bash").withColumn("command", F.coalesce(agents.json_command(), F.lit("")))
    c, out = F.col("command"), F.col("response")
    return b.select(
        "event_id", "command", C.command_class(c).alias("class"), C.is_build(c).alias("build"), C.has_word(c, C.REVERT_WORDS).alias("revert"), C.verifies(c).alias("verifies"), C.failed_output(out).alias("failed_output"),
        C.not_found(out).alias("not_found"), C.has_word(c, C.CARGO_WORDS).alias("cargo"), C.crate(c).alias("crate"), C.in_worktree(F.col("cwd")).alias("in_worktree"),
    )


@query(f"""WITH {ACT} SELECT event_id, {_ABOUT} AS about, CASE WHEN summary = '' THEN NULL ELSE {_CMD0} END AS command, {_j('response', 'stdout')} AS stdout, {_w('summary', ('command',))} AS names_command FROM act""")
def summary_fields(spark, sf_dir):
    s = F.col("summary")
    return activity(spark, sf_dir).select("event_id", C.human_key(s).alias("about"), C.command_of(s).alias("command"), C.parsed(F.col("response"), "stdout").alias("stdout"), C.has_word(s, ("command",)).alias("names_command"))


@query(f"""WITH {ACT}, p AS (SELECT event_id, cwd, {_PATH} AS path FROM act WHERE tool IN ('Edit', 'Write', 'Read')), n AS (SELECT *, regexp_replace(path, '/[^/]+/\\.\\./', '/') AS norm FROM p),
x AS (SELECT *, nullif(regexp_extract(norm, '(?:\\.claude/worktrees|\\.worktrees)/[^/]+/(.+)$', 1), '') AS a, nullif(regexp_extract(norm, '/projects/[^/]+/(.+)$', 1), '') AS b FROM n)
SELECT event_id, path, {_IS_CODE('path')} AS code, coalesce(a, b, norm) AS repo_path, CASE WHEN regexp_matches(path, '^.*/projects/[^/]+/(?:\\.claude/worktrees|\\.worktrees)/[^/]+/') THEN regexp_extract(path, '^.*/projects/[^/]+/(?:\\.claude/worktrees|\\.worktrees)/[^/]+/(.*)', 1)
WHEN regexp_matches(path, '^.*/projects/[^/]+/') THEN regexp_extract(path, '^.*/projects/[^/]+/(.*)', 1) ELSE regexp_extract(path, '(?:[^/]*/)?[^/]*$') END AS area, {_LABEL('path')} AS harness FROM x""")
def path_facts(spark, sf_dir):
    e = activity(spark, sf_dir).filter(F.col("tool").isin("Edit", "Write", "Read")).withColumn("path", C.edited_path(F.col("summary"), F.col("response")))
    p = F.col("path")
    return e.select("event_id", "path", C.is_code(p).alias("code"), C.repo_path(p).alias("repo_path"), C.area(p, F.col("cwd"), F.lit("shop")).alias("area"), C.harness_label(p).alias("harness"))


@query(f"""WITH {ACT}, s AS (SELECT *, {_SLUG} AS slug FROM act) SELECT event_id, slug, CASE WHEN slug IS NULL THEN run_id::VARCHAR ELSE run_id || '#' || slug END AS run_key, CASE WHEN contains(cwd, '.claude/worktrees/') THEN split_part(cwd, '.claude/worktrees/', 1) || '.claude/worktrees/' || slug END AS root,
coalesce(nullif(regexp_extract(coalesce(cwd, ''), '/projects/([^/]+)', 1), ''), '(unknown)') AS project FROM s""")
def run_keys(spark, sf_dir):
    slug = C.worktree_slug(F.lit(None).cast("string"), F.col("cwd"))
    e = activity(spark, sf_dir).withColumn("slug", slug)
    return e.select("event_id", "slug", C.run_key(F.col("run_id").cast("string"), F.col("slug")).alias("run_key"), C.worktree_root(F.col("cwd"), F.col("slug")).alias("root"), C.project_of_folder(F.col("cwd")).alias("project"))


BRANCHES = ["loom/shop-{n}ab", "deer-flow/shop-bus-x{n}y", "deer/Shop-{n}ab", "shop-bus-a{n}b.1", "feat/shop-{n}ab", "worktree-agent-{n}", "main", "shop", "ci-{n}abc", "x/shop-{n}ab"]
BRANCH_SQL = "branch AS (SELECT o_orderkey AS run_id, replace([" + ", ".join(f"'{b}'" for b in BRANCHES) + "][1 + o_orderkey % 10], '{n}', (o_orderkey % 7)::VARCHAR) AS git_branch FROM orders)"
_TASK = "CASE WHEN NOT (" + " OR ".join(f"starts_with(git_branch, '{p}')" for p in C.STRUCTURAL) + ") AND regexp_matches(regexp_replace(git_branch, '^(loom|deer-flow|deer)/', ''), '^[a-z][a-z0-9]*(-[a-z][a-z0-9]*)*-[a-z0-9]{3,6}(\\.[^/]*)?$') THEN regexp_replace(git_branch, '^(loom|deer-flow|deer)/', '') END"


def branches(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.replace(F.element_at(F.array(*map(F.lit, BRANCHES)), (1 + k % 10).cast("int")), F.lit("{n}"), (k % 7).cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("run_id"), name.alias("git_branch"))


@query(f"WITH {BRANCH_SQL} SELECT git_branch, {_TASK} AS bead_id, count(*) AS runs FROM branch GROUP BY 1, 2")
def branch_tasks(spark, sf_dir):
    b = branches(spark, sf_dir).withColumn("bead_id", C.task_of_branch(F.col("git_branch")))
    return b.groupBy("git_branch", "bead_id").agg(F.count("*").alias("runs"))


SIGNALS = f"""{ACT}, t AS (SELECT *, tool = 'Bash' AND {_FAILED} AS failed, tool = 'Bash' AND {_SETTLES} AS settled FROM act WHERE tool <> ''),
l AS (SELECT *, coalesce(lag(tool IN ('Edit', 'Write')) OVER w AND failed AND lead(tool IN ('Edit', 'Write')) OVER w, false) AS loop, row_number() OVER (PARTITION BY run_id ORDER BY us DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY run_id) AS n FROM t WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id)),
f AS (SELECT run_id, count(*) AS tools, count(*) FILTER (tool IN ('Read', 'Glob', 'Grep')) AS reads, count(*) FILTER (tool = 'Bash') AS bash, count(*) FILTER (failed) AS bash_failed, count(*) FILTER (loop) AS loops, bool_or(settled) AS committed, bool_or(tool IN ('Edit', 'Write') AND back <= greatest(3, n // 5)) AS edit_in_tail FROM l GROUP BY 1),
sg AS (SELECT run_id, events, coalesce(tools, 0) AS tools, coalesce(reads, 0) AS reads, coalesce(bash, 0) AS bash, coalesce(bash_failed, 0) AS bash_failed, coalesce(loops, 0) AS loops, coalesce(committed, false) AS committed, coalesce(edit_in_tail, false) AS edit_in_tail, ['idle_timeout', 'ended', 'recorder_shutdown'][1 + run_id % 3] AS close_reason FROM (SELECT run_id, count(*) AS events FROM act GROUP BY 1) LEFT JOIN f USING (run_id)),
bh AS (SELECT *, CASE WHEN (loops >= 3 OR (bash >= 10 AND bash_failed >= 0.30 * bash)) AND reads::DOUBLE / greatest(tools, 1) >= 0.35::DOUBLE THEN 'thrashed' WHEN close_reason = 'idle_timeout' AND events >= 5 AND NOT committed AND NOT edit_in_tail AND (bash_failed > 0 OR events >= 10) THEN 'abandoned' WHEN committed OR (edit_in_tail AND close_reason = 'ended') THEN 'clean' END AS behavior FROM sg)"""


def run_signals(spark, sf_dir) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, ("idle_timeout", "ended", "recorder_shutdown"))), (1 + F.col("run_id") % 3).cast("int"))
    return agents.signals(activity(spark, sf_dir)).withColumn("close_reason", reason)


@query(f"""WITH {SIGNALS} SELECT run_id, bash AS bash_calls, bash_failed, CASE WHEN loops > 0 THEN loops END AS loops, CASE WHEN bash > 0 THEN round(bash_failed / bash::DOUBLE, 4) END AS fail_rate, CASE WHEN reads > 0 THEN round(reads / tools::DOUBLE, 4) END AS reread_rate, CASE WHEN committed THEN 'true' END AS committed FROM sg""")
def behavior_signals(spark, sf_dir):
    s = run_signals(spark, sf_dir).withColumn("m", agents.signal_map())
    of = lambda k, kind: F.try_element_at("m", F.lit(k)).cast(kind)
    return s.select("run_id", F.col("bash").alias("bash_calls"), "bash_failed", of("thrash_edit_fail_loops", "long").alias("loops"), of("bash_fail_rate", "double").alias("fail_rate"), of("reread_rate", "double").alias("reread_rate"), of("has_resolving_commit", "string").alias("committed"))


@query(f"WITH {SIGNALS} SELECT run_id, close_reason, behavior FROM bh")
def behavior_outcomes(spark, sf_dir):
    return run_signals(spark, sf_dir).select("run_id", "close_reason", agents.by_behavior().alias("behavior"))


# the evidence that lands beside runs: closed beads, pull requests and merges, here by the run's number
_BEAD = "CASE WHEN run_id % 5 = 0 THEN 'landed' END"
_PR = "CASE WHEN run_id % 7 = 1 THEN 'landed' WHEN run_id % 7 = 2 THEN 'abandoned' END"
_PR_SOURCE = "CASE WHEN run_id % 7 = 1 THEN 'pr_merge' ELSE 'pr_closed_unmerged' END"
_GIT = "CASE WHEN run_id % 11 = 3 THEN 'reverted' END"
LABELS = f"""{SIGNALS}, lb AS (SELECT *, coalesce({_BEAD}, {_PR}, {_GIT}, behavior) AS new_outcome, CASE WHEN {_BEAD} IS NOT NULL THEN 'bead_close' WHEN {_PR} IS NOT NULL THEN {_PR_SOURCE} WHEN {_GIT} IS NOT NULL THEN 'git_revert_on_main' WHEN behavior IS NOT NULL THEN 'behavior_inference' END AS new_source,
CASE run_id % 4 WHEN 1 THEN 'clean' WHEN 2 THEN 'landed' WHEN 3 THEN 'thrashed' END AS old_outcome, CASE run_id % 4 WHEN 1 THEN 'behavior_inference' WHEN 2 THEN 'pr_merge' WHEN 3 THEN 'behavior_inference' END AS old_source, CASE WHEN run_id % 4 > 0 THEN 1 END AS old_version FROM bh),
tr AS (SELECT *, CASE WHEN old_source IN ('pr_merge') THEN 3 ELSE 1 END AS old_tier, CASE WHEN new_source IN ('bead_close', 'pr_merge', 'git_revert_on_main') THEN 3 WHEN new_source = 'pr_closed_unmerged' THEN 2 ELSE 1 END AS new_tier FROM lb),
ap AS (SELECT *, new_outcome IS NOT NULL AND NOT (old_outcome IS NOT NULL AND new_tier < old_tier) AND old_outcome IS DISTINCT FROM new_outcome AS wr, new_outcome IS NULL AND old_outcome IS NOT NULL AND old_tier = 1 AS cl FROM tr)"""


def labelled_runs(spark, sf_dir) -> DataFrame:
    r, c = F.col("run_id"), F.col
    when = lambda m, rest, value: F.when(r % m == rest, value)
    evidence = [(when(5, 0, "landed"), F.lit("bead_close")), (F.when(r % 7 == 1, "landed").when(r % 7 == 2, "abandoned"), F.when(r % 7 == 1, "pr_merge").otherwise("pr_closed_unmerged")), (when(11, 3, "reverted"), F.lit("git_revert_on_main"))]
    s = run_signals(spark, sf_dir).withColumn("label", agents.best_label(evidence, agents.by_behavior()))
    old = F.when(r % 4 == 1, "clean").when(r % 4 == 2, "landed").when(r % 4 == 3, "thrashed")
    entry = F.struct(old.alias("outcome"), F.lit(1).cast("long").alias("labeled_at"), F.lit(1).cast("long").alias("version"), F.when(r % 4 == 2, "pr_merge").otherwise("behavior_inference").alias("source"))
    history = F.when(r % 4 > 0, F.array(entry)).otherwise(F.array().cast("array<struct<outcome:string,labeled_at:bigint,version:bigint,source:string>>"))
    return s.select(
        "run_id", c("label.outcome").alias("new_outcome"), c("label.source").alias("new_source"), agents.signal_map().alias("signals"), old.alias("outcome"), F.when(r % 4 > 0, F.lit(1).cast("long")).alias("labeled_at"),
        F.when(r % 4 > 0, F.lit(1).cast("long")).alias("version"), history.alias("history"), F.create_map(F.lit("bash_calls"), F.lit("0"), F.lit("kept"), F.lit("x")).alias("features"),
    )


@query(f"WITH {LABELS} SELECT run_id, new_outcome AS outcome, new_source AS source FROM lb")
def label_precedence(spark, sf_dir):
    return labelled_runs(spark, sf_dir).select("run_id", F.col("new_outcome").alias("outcome"), F.col("new_source").alias("source"))


@query(f"""WITH {LABELS} SELECT run_id, CASE WHEN wr THEN new_outcome WHEN NOT cl THEN old_outcome END AS outcome, CASE WHEN wr THEN 99 WHEN NOT cl AND old_version IS NOT NULL THEN 1 END::BIGINT AS labeled_at, CASE WHEN wr THEN coalesce(old_version, 0) + 1 ELSE old_version END::BIGINT AS version,
(coalesce(old_version, 0) + wr::INT)::INT AS entries, CASE WHEN wr THEN new_source ELSE old_source END AS last_source, CASE WHEN bash > 0 THEN bash::VARCHAR ELSE '0' END AS bash_calls, 'x' AS kept, wr OR cl AS changed FROM ap""")
def label_write(spark, sf_dir):
    r = agents.with_labels(labelled_runs(spark, sf_dir), 99)
    of = lambda k: F.element_at("features", k)
    return r.select("run_id", "outcome", F.col("labeled_at").cast("long").alias("labeled_at"), "version", F.size("history").alias("entries"), F.try_element_at("history", F.lit(-1))["source"].alias("last_source"), of("bash_calls").alias("bash_calls"), of("kept").alias("kept"), "changed")


@query(f"""WITH {LABELS}, d AS (SELECT run_id, arg_min(cwd, (us, event_id)) AS cwd0 FROM act GROUP BY 1), e AS (SELECT ap.*, CASE WHEN {_SLUG.replace('cwd', 'cwd0')} LIKE 'agent-%' THEN 'loom/shop-' || right('00' || (run_id % 7), 2) || 'x' END AS git_branch FROM ap JOIN d USING (run_id) WHERE old_outcome IS NULL OR run_id % 2 = 0)
SELECT coalesce(new_source, 'behavior_inference') AS source, new_outcome AS outcome, {_TASK} AS bead_id, count(*) AS runs, count(*) FILTER (wr OR cl) AS changed FROM e GROUP BY 1, 2, 3""")
def label_backfill(spark, sf_dir):
    """A pass over runs without a label and those due again, with the branch and task of the first event's folder."""
    a = activity(spark, sf_dir)
    first = a.groupBy("run_id").agg(F.min_by(F.struct("cwd"), F.struct("us", "event_id"))["cwd"].alias("cwd"))
    slug = C.worktree_slug(F.lit(None).cast("string"), F.col("cwd"))
    branch = F.when(slug.startswith("agent-"), F.concat(F.lit("loom/shop-"), F.lpad((F.col("run_id") % 7).cast("string"), 2, "0"), F.lit("x")))
    due = labelled_runs(spark, sf_dir).filter("outcome IS NULL OR run_id % 2 = 0").withColumns({"found": F.col("new_outcome"), "by": F.coalesce("new_source", F.lit("behavior_inference"))})
    r = agents.with_labels(due, 99).join(first, "run_id").withColumn("bead_id", C.task_of_branch(branch))
    return r.groupBy(F.col("by").alias("source"), F.col("found").alias("outcome"), "bead_id").agg(F.count("*").alias("runs"), F.count_if("changed").alias("changed"))


@query(f"""WITH {ACT}, m AS (SELECT run_id, model, count(*) AS n, min((us, event_id)) AS seen FROM act WHERE model IS NOT NULL GROUP BY 1, 2), b AS (SELECT run_id, arg_min(model, (-n, seen)) AS primary_model, count(*) AS models FROM m GROUP BY 1),
g AS (SELECT run_id, sum(input_tokens)::BIGINT AS tokens_in, sum(output_tokens)::BIGINT AS tokens_out, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, count(*) FILTER (tool <> '') AS calls, count(*) FILTER (is_error) AS errors, count(*) FILTER (is_error AND error_type = 'timeout') AS timeouts FROM act GROUP BY 1)
SELECT g.*, primary_model, models, CASE WHEN cache_write > 0 THEN round(cache_read / cache_write::DOUBLE, 4) END AS cache_hit_rate, CASE WHEN calls > 0 THEN round(errors / calls::DOUBLE, 4) END AS error_rate FROM g LEFT JOIN b USING (run_id)""")
def token_features(spark, sf_dir):
    return agents.token_features(activity(spark, sf_dir))


CLASSED = f"{ACT}, ab AS (SELECT *, {_ABOUT} AS about FROM act), cs AS (SELECT *, {_TOOLCLASS} AS class FROM ab)"
_NORM = "trim(split_part(split_part(trim(about), '|', 1), '&&', 1))"
for _rule, _to in [(r"/[\w./@~-]+", "<path>"), (r"\b[0-9a-f]{8,}\b", "<hex>"), (r"\b\d+\b", "<n>"), (r'"[^"]*"', '"<s>"'), (r"'[^']*'", "'<s>'"), (r"\s+", " ")]:
    _NORM = f"regexp_replace({_NORM}, {_q(_rule)}, {_q(_to)}, 'g')"
_NORM = f"trim({_NORM})[:120]"
PATTERNS = f"{CLASSED}, pt AS (SELECT run_id, {_NORM} AS pattern, count(*) AS n FROM cs WHERE tool = 'Bash' AND about <> '' GROUP BY 1, 2), rd AS (SELECT run_id, about, count(*) AS n FROM cs WHERE tool = 'Read' AND about <> '' GROUP BY 1, 2 HAVING count(*) >= 3)"


@query(f"WITH {PATTERNS} SELECT run_id, 'command' AS what, pattern AS name, n FROM pt WHERE n >= 3 UNION ALL SELECT run_id, 'file', CASE WHEN len(string_split(about, '/')) > 3 THEN regexp_extract(about, '(?:[^/]*/){{0,2}}[^/]*$') ELSE about END, n FROM rd")
def repeated_work(spark, sf_dir):
    e = agents.classified(activity(spark, sf_dir))
    r = agents.repeated_commands(e).select("run_id", F.lit("command").alias("what"), F.col("pattern").alias("name"), "n")
    return r.unionByName(agents.redo_reads(e).select("run_id", F.lit("file").alias("what"), F.col("file").alias("name"), "n"))


@query(f"""WITH {PATTERNS}, x AS (SELECT *, lead(us) OVER w - us AS gap, coalesce(lag(class = 'explore') OVER w AND class = 'explore', false) AS pair, tool IN ('Grep', 'Glob', 'Bash') AS kind, lag(tool IN ('Grep', 'Glob', 'Bash')) OVER w AS kind0,
coalesce(bool_or(class IN ('build', 'run-verify')) OVER (PARTITION BY run_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), false) AS checked FROM cs WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id)),
g AS (SELECT run_id, count(*) AS events, max(us) - min(us) AS span, greatest(0, max(us) - min(us) - coalesce(sum(gap) FILTER (gap > {12 * HOUR}), 0))::BIGINT AS active, count(*) FILTER (tool = 'Bash' AND {_re('about', C.POLL)} AND {_re('about', C.PEEK)}) AS polls,
CASE WHEN count(*) FILTER (pair) > 0 THEN round(count(*) FILTER (pair AND kind <> kind0) / (count(*) FILTER (pair))::DOUBLE, 2) ELSE 0.0 END AS churn, count(*) FILTER (class = 'edit' AND checked) AS cycles FROM x GROUP BY 1),
h AS (SELECT g.*, coalesce((SELECT count(*) FROM pt WHERE pt.run_id = g.run_id AND n >= 5), 0) AS big_repeats, coalesce((SELECT count(*) FROM rd WHERE rd.run_id = g.run_id), 0) AS redo FROM g)
SELECT *, concat_ws('; ', CASE WHEN polls > 0 THEN 'busy_wait_polling x' || polls END, CASE WHEN churn >= 0.6 AND events >= 20 THEN 'high_nav_churn=' || churn END, CASE WHEN big_repeats > 0 THEN 'missing_tooling_smell x' || big_repeats END, CASE WHEN redo > 0 THEN 'redo_reads x' || redo END,
CASE WHEN span > 0 AND active > 0 AND active < 0.5 * span THEN 'wait_dominated' END, CASE WHEN cycles = 0 AND events >= 30 THEN 'no_edit_verify_cycle' END) AS flags FROM h""")
def run_profiles(spark, sf_dir):
    return agents.profiles(agents.classified(activity(spark, sf_dir)), 12 * HOUR).withColumn("flags", F.array_join("flags", "; "))


_DISPATCH = f"""d AS (SELECT run_id, us, event_id, coalesce({_f('response', 'agentId')}, '') AS child, coalesce({_f('summary', 'prompt')}, '') AS prompt, coalesce({_f('summary', 'model')}, '') AS model, coalesce({_f('summary', 'name')}, '') AS name, coalesce({_f('summary', 'isolation')}, '') AS isolation,
coalesce({_f('summary', 'description')}, {_f('response', 'description')}, '') AS description FROM act WHERE tool IN ('Agent', 'Task'))"""
_TREES = f"""s0 AS (SELECT *, {_SLUG} AS slug, {_STATUS} AS verified FROM act), wt AS (SELECT run_id, slug, count(*) AS events, count(*) FILTER (tool IN ('Edit', 'Write')) AS edits, count(*) FILTER (tool IN ('Edit', 'Write') AND {_IS_CODE(_PATH)}) AS code_edits, count(verified) AS verifications,
coalesce(arg_max(CASE WHEN verified = 'failed' THEN 'failed' ELSE 'passed' END, (us, event_id)) FILTER (verified IS NOT NULL), 'none') AS last_status, bool_or(tool = 'Bash' AND {_w('summary', C.COMMIT_WORDS)}) AS committed FROM s0 WHERE slug IS NOT NULL GROUP BY 1, 2),
wo AS (SELECT *, CASE WHEN edits = 0 THEN 'readonly' WHEN code_edits = 0 THEN 'docs' WHEN last_status = 'failed' THEN 'left_red' WHEN last_status = 'none' THEN 'unverified' ELSE 'verified' END AS class FROM wt)"""


@query(f"WITH {ACT}, {_DISPATCH} SELECT event_id, child, prompt, model, name, isolation, description FROM d")
def dispatch_records(spark, sf_dir):
    return agents.dispatches(activity(spark, sf_dir)).drop("run_id", "us")


@query(f"WITH {ACT}, {_TREES} SELECT * FROM wo")
def worktree_outcomes(spark, sf_dir):
    return agents.worktree_outcomes(activity(spark, sf_dir))


@query(f"WITH {ACT}, {_DISPATCH}, {_TREES} SELECT d.event_id, d.child, slug, class FROM d LEFT JOIN wo ON d.run_id = wo.run_id AND d.child = regexp_replace(slug, '^agent-', '')")
def dispatched_worktrees(spark, sf_dir):
    a = activity(spark, sf_dir)
    return agents.dispatched_worktrees(agents.dispatches(a), agents.worktree_outcomes(a)).select("event_id", "child", "slug", "class")


@query(f"""WITH {ACT}, {_DISPATCH}, v AS (SELECT *, {_STATUS} AS verified FROM act), l AS (SELECT *, last_value(verified IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY us, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS status FROM v),
c AS (SELECT d.*, status, nullif(trim(regexp_extract(prompt, {_q(C.CLAIM)})), '') AS claim, CASE WHEN d.us - lag(d.us) OVER w <= {DAY} THEN 0 ELSE 1 END AS cut FROM d JOIN l USING (event_id) WINDOW w AS (PARTITION BY d.run_id ORDER BY d.us, d.event_id)),
h AS (SELECT *, sum(cut) OVER (PARTITION BY run_id ORDER BY us, event_id)::BIGINT AS cohort FROM c), g AS (SELECT run_id, cohort, first(status ORDER BY us, event_id) AS status, arg_min(claim, (us, event_id)) FILTER (claim IS NOT NULL) AS claim, count(*) AS width FROM h GROUP BY 1, 2)
SELECT run_id, cohort, claim, width FROM g WHERE status = 'failed' AND claim IS NOT NULL""")
def false_clean_claims(spark, sf_dir):
    return agents.false_claims(activity(spark, sf_dir), DAY)


@query(f"""WITH {ACT}, h AS (SELECT *, CASE WHEN tool IN ('Edit', 'Write') THEN {_LABEL(_PATH)} WHEN tool = 'Bash' AND {_w(_CMD0, ('git',))} THEN {_LABEL("(coalesce(" + _CMD0 + ", '') || chr(10) || response)")} END AS label FROM act)
SELECT run_id, label, CASE WHEN tool = 'Bash' THEN 'git_diff_surface' ELSE 'edit' END AS via, event_id FROM h WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, label ORDER BY us, event_id) = 1""")
def harness_changes(spark, sf_dir):
    return agents.harness_changes(activity(spark, sf_dir))


@query(f"WITH {ACT}, b AS (SELECT run_id, trim(regexp_replace({_FCMD}, '\\s+', ' ', 'g')) AS command FROM act WHERE tool = 'Bash') SELECT run_id, command, count(*) AS n FROM b WHERE {_w('command', C.BUILD_WORDS)} GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_builds(spark, sf_dir):
    return agents.repeated_builds(activity(spark, sf_dir))


@query(f"""WITH {ACT}, g AS (SELECT run_id, cwd, tool, coalesce(nullif(regexp_extract(coalesce(cwd, ''), '/projects/([^/]+)', 1), ''), '(unknown)') AS project, {_FCMD} AS command, (lead(us) OVER (PARTITION BY run_id ORDER BY us, event_id) - us) / 1e6::DOUBLE AS gap FROM act WHERE run_id % 9 > 0),
o AS (SELECT run_id, project, coalesce(nullif(regexp_extract(command, '(?:-p|--package)\\s+(\\S+)', 1), ''), 'workspace') AS crate, gap FROM g WHERE {_w('command', C.CARGO_WORDS)} AND {_w('cwd', ('/.claude/worktrees/', '/.worktrees/'))} AND gap >= 0),
m AS (SELECT project, CASE WHEN count(*) > 1 THEN median(gap) ELSE 0.0 END AS baseline FROM o GROUP BY 1)
SELECT project, crate, count(*) AS slow_builds, count(DISTINCT run_id) AS runs, round(max(gap), 3) AS max_gap, round(any_value(baseline), 3) AS baseline FROM o JOIN m USING (project) WHERE gap > {6 * 86400} OR (baseline > 0 AND gap > baseline * 3) GROUP BY 1, 2""")
def slow_rebuilds(spark, sf_dir):
    """Findings of slow builds in worktrees; these events lie hours apart, so the floor is six days. Each ninth run is still open."""
    e = activity(spark, sf_dir).withColumns({"project": C.project_of_folder(F.col("cwd")), "closed": F.col("run_id") % 9 > 0})
    found = rebuilds.slow_builds(rebuilds.observations(e, agents.json_command(), ["us", "event_id"]), 6 * 86400)
    return found.withColumns({"max_gap": F.round("max_gap", 3), "baseline": F.round("baseline", 3)})


@query(f"""WITH {LABELS}, k AS (SELECT DISTINCT run_id, {_SLUG} AS slug FROM act), r AS (SELECT * FROM k JOIN ap USING (run_id) WHERE slug IS NOT NULL AND old_outcome IN ('landed', 'clean')) SELECT slug, string_agg(run_id::VARCHAR, '|' ORDER BY run_id) AS run_ids, string_agg(old_outcome, '|' ORDER BY run_id) AS outcomes FROM r GROUP BY 1""")
def worktree_groups(spark, sf_dir):
    """Labeled runs with a final outcome that used each worktree: candidates for a worktree left behind."""
    slug = C.worktree_slug(F.lit(None).cast("string"), F.col("cwd"))
    k = activity(spark, sf_dir).select("run_id", slug.alias("slug")).filter("slug IS NOT NULL").distinct()
    r = k.join(labelled_runs(spark, sf_dir).filter(F.col("outcome").isin("landed", "clean")).select("run_id", "outcome"), "run_id")
    g = r.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("run_id", "outcome"))).alias("x"))
    return g.select("slug", F.array_join(F.transform("x", lambda s: s["run_id"].cast("string")), "|").alias("run_ids"), F.array_join(F.transform("x", lambda s: s["outcome"]), "|").alias("outcomes"))


ADAPTERS = [detectors.Adapter("p1", [("build", r"\bbd\s+close\b")]), detectors.Adapter("p[12]", [("wait", r"\bgit\s+push\b")])]


@query(f"""WITH {ACT}, b AS (SELECT event_id, 'p' || (run_id % 3) AS project, {_FCMD} AS command FROM act WHERE tool = 'Bash') SELECT event_id, project, CASE WHEN project = 'p1' AND regexp_matches(command, '\\bbd\\s+close\\b') THEN 'build' WHEN project = 'p2' AND regexp_matches(command, '\\bgit\\s+push\\b') THEN 'wait' ELSE {_CLASS('command')} END AS class FROM b""")
def project_command_classes(spark, sf_dir):
    """Command classes where projects bring their own: the first adapter that applies to the project counts."""
    b = activity(spark, sf_dir).filter(F.col("tool") == "Bash").select("event_id", F.concat(F.lit("p"), (F.col("run_id") % 3).cast("string")).alias("project"), F.coalesce(agents.json_command(), F.lit("")).alias("command"))
    return b.select("event_id", "project", detectors.command_class(F.col("command"), F.col("project"), ADAPTERS).alias("class"))


DETECTORS = [
    detectors.Detector("repeated_build", "automate", lambda e: agents.repeated_builds(e).withColumnRenamed("command", "signature")),
    detectors.Detector("harness_change_watch", "inform", lambda e: agents.harness_changes(e).withColumnRenamed("label", "signature")),
    detectors.Detector("left_red", "eliminate", lambda e: agents.worktree_outcomes(e).filter(F.col("class") == "left_red").withColumnRenamed("slug", "signature")),
]
PASS = f"""{LABELS}, {_TREES}, hc AS (SELECT DISTINCT run_id, CASE WHEN tool IN ('Edit', 'Write') THEN {_LABEL(_PATH)} WHEN tool = 'Bash' AND {_w(_CMD0, ('git',))} THEN {_LABEL("(coalesce(" + _CMD0 + ", '') || chr(10) || response)")} END AS signature FROM act),
rb AS (SELECT run_id, trim(regexp_replace({_FCMD}, '\\s+', ' ', 'g')) AS signature FROM act WHERE tool = 'Bash' AND {_w(_FCMD, C.BUILD_WORDS)} GROUP BY 1, 2 HAVING count(*) > 1),
fd AS (SELECT run_id, 'repeated_build' AS detector, signature FROM rb UNION ALL SELECT run_id, 'harness_change_watch', signature FROM hc WHERE signature IS NOT NULL UNION ALL SELECT run_id, 'left_red', slug FROM wo WHERE class = 'left_red'),
ru AS (SELECT run_id, 'p' || (run_id % 3) AS project, old_outcome AS outcome FROM lb), tt AS (SELECT project, count(*) AS runs FROM ru GROUP BY 1),
gi AS (SELECT project, detector, signature, count(*) AS hit_runs, count(*) FILTER (run_id % 5 <> 0) AS new_hits, count(*) FILTER (outcome IN ('thrashed', 'abandoned', 'reverted')) AS failures, count(*) FILTER (outcome IN ('clean', 'landed', 'corrected')) AS clean FROM fd JOIN ru USING (run_id) GROUP BY 1, 2, 3),
si AS (SELECT gi.*, runs, CASE detector WHEN 'repeated_build' THEN 'automate' WHEN 'left_red' THEN 'eliminate' ELSE 'inform' END AS rung, CASE WHEN detector IN ('repeated_build', 'left_red') THEN 'pending' ELSE 'not_applicable' END AS replay FROM gi JOIN tt USING (project)),
sc AS (SELECT *, 0.35::DOUBLE * hit_runs / runs + 0.25::DOUBLE * least(1.0::DOUBLE, ln(1 + hit_runs::DOUBLE) / ln(21.0::DOUBLE)) + 0.25::DOUBLE * (CASE rung WHEN 'eliminate' THEN 1.0::DOUBLE WHEN 'automate' THEN 2.0::DOUBLE / 3 ELSE 1.0::DOUBLE / 3 END) + 0.08::DOUBLE * (CASE WHEN failures + clean = 0 THEN 0.0::DOUBLE ELSE 0.30::DOUBLE * (failures::DOUBLE / (failures + clean) - 0.5::DOUBLE) END) + 0.07::DOUBLE AS score FROM si)"""


@query(f"""WITH {PASS} SELECT project, detector, signature, hit_runs, new_hits, failures, clean, rung, round(score, 6) AS score, CASE WHEN runs < 2 OR replay = 'insufficient_history' THEN 'needs_more_data' WHEN replay = 'pending' THEN 'monitor' WHEN clean > failures AND clean >= 3 OR replay = 'failed' THEN 'suppressed' WHEN rung = 'inform' AND score >= 0.55 THEN 'propose_fix' WHEN rung <> 'inform' AND replay = 'passed' AND score >= 0.30 THEN 'propose_fix' ELSE 'monitor' END AS decision FROM sc""")
def synthesis_pass(spark, sf_dir):
    """All detectors in order, their hits against those known, and the decision on every issue."""
    found = stage(detectors.hits(DETECTORS, activity(spark, sf_dir)), "hits")  # read again as those known
    found = detectors.with_novelty(found, found.filter(F.col("run_id") % 5 == 0))
    r = labelled_runs(spark, sf_dir).select("run_id", F.concat(F.lit("p"), (F.col("run_id") % 3).cast("string")).alias("project"), "outcome", "labeled_at")
    r = stage(r, "runs")
    i = detectors.issues(DETECTORS, found, r, F.lit(1.0))
    return i.select("project", "detector", "signature", "hit_runs", "new_hits", "failures", "clean", "rung", F.round("score", 6).alias("score"), "decision")


@query(f"""WITH {PASS}, td AS (SELECT 'detector' AS section, detector AS name, sum(hit_runs)::BIGINT AS n, row_number() OVER (ORDER BY sum(hit_runs) DESC, detector) AS k FROM gi GROUP BY 2), hd AS (SELECT 'harness' AS section, signature AS name, sum(hit_runs)::BIGINT AS n FROM gi WHERE detector = 'harness_change_watch' GROUP BY 2)
SELECT section, name, n FROM td WHERE k <= 2 UNION ALL SELECT * FROM hd UNION ALL SELECT 'outcome', coalesce(outcome, 'unlabeled'), count(*) FROM ru GROUP BY 2""")
def nightly_digest(spark, sf_dir):
    """The two detectors with most hits, what changed around the agents, and runs by outcome."""
    g = stage(detectors.hits(DETECTORS, activity(spark, sf_dir)).groupBy("detector", "signature").agg(F.count("*").alias("n")), "hits")
    top = g.groupBy(F.col("detector").alias("name")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(2)
    harness = g.filter(F.col("detector") == "harness_change_watch").groupBy(F.col("signature").alias("name")).agg(F.sum("n").alias("n"))
    outcomes = labelled_runs(spark, sf_dir).groupBy(F.coalesce("outcome", F.lit("unlabeled")).alias("name")).agg(F.count("*").alias("n"))
    section = lambda d, s: d.select(F.lit(s).alias("section"), "name", "n")
    return section(top, "detector").unionByName(section(harness, "harness")).unionByName(section(outcomes, "outcome"))
