"""Facts, profiles and outcome labels of agent runs, from their events in order.

Events: run_id, us, event_id, tool, summary, response, is_error, cwd and what else a function names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import commands as C
from tidewell.functions.text import normal_command
from tidewell.operators import sequences
from tidewell.operators.runs import inferred_outcome

ORDER = ["us", "event_id"]
EDITS, READS, DISPATCHES = ("Edit", "Write"), ("Read", "Glob", "Grep"), ("Agent", "Task")
#: How much the source of a label weighs; others weigh 1.
TIERS = {
    "behavior_inference": 1, "pr_closed_unmerged": 2, "git_revert": 2, "git_merged_into_main": 3, "git_squash_equiv": 3, "git_partial_squash": 2, "git_pickaxe_landed": 3,
    "git_revert_on_main": 3, "git_empty_branch": 2, "git_discarded_verified": 2, "bead_close": 3, "bus_bead_closed": 3, "pr_merge": 3,
}


def _yes(c: Column) -> Column:
    return F.coalesce(F.max(c), F.lit(False))


def signals(events: DataFrame) -> DataFrame:
    """One row per run: events, tools, reads, bash, bash_failed, loops, committed, edit_in_tail."""
    shell = F.col("tool") == "Bash"
    e = events.withColumn("failed", shell & C.bash_failed(F.col("is_error"), F.col("response")))
    calls = e.filter(F.col("tool") != "")
    w = Window.partitionBy("run_id").orderBy(*ORDER)
    back = Window.partitionBy("run_id").orderBy(*[F.desc(c) for c in ORDER])
    edit = F.col("tool").isin(*EDITS)
    loop = F.coalesce(F.lag(edit).over(w) & F.col("failed") & F.lead(edit).over(w), F.lit(False))
    calls = calls.withColumns({"loop": loop, "back": F.row_number().over(back), "n": F.count("*").over(Window.partitionBy("run_id"))})
    tail = F.col("back") <= F.greatest(F.lit(3), F.floor(F.col("n") / 5))
    f = calls.groupBy("run_id").agg(
        F.count("*").alias("tools"), F.count_if(F.col("tool").isin(*READS)).alias("reads"), F.count_if(shell).alias("bash"), F.count_if("failed").alias("bash_failed"),
        F.count_if("loop").alias("loops"), _yes(shell & C.settles(F.col("summary"), F.col("response"))).alias("committed"), _yes(edit & tail).alias("edit_in_tail"),
    )
    all_ = events.groupBy("run_id").agg(F.count("*").alias("events"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tools", "reads", "bash", "bash_failed", "loops")}
    return all_.join(f, "run_id", "left").withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in ("committed", "edit_in_tail")})


def signal_map() -> Column:
    """The signals that say something, as a map of texts; rates have 4 places."""
    c = F.col
    some = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    return F.map_from_entries(F.array_compact(F.array(
        some(c("loops") > 0, "thrash_edit_fail_loops", c("loops")), some(c("bash") > 0, "bash_fail_rate", F.round(F.try_divide("bash_failed", "bash"), 4)), some(c("bash") > 0, "bash_calls", c("bash")),
        some(c("bash") > 0, "bash_failures", c("bash_failed")), some(c("reads") > 0, "reread_rate", F.round(F.try_divide("reads", "tools"), 4)), some(c("reads") > 0, "read_calls", c("reads")), some(c("committed"), "has_resolving_commit", F.lit("true")),
    )))


def by_behavior() -> Column:
    """The outcome that the columns of ``signals`` and ``close_reason`` show; null where they are too weak."""
    c = F.col
    return inferred_outcome(c("loops"), c("bash"), c("bash_failed"), c("reads") / F.greatest(c("tools"), F.lit(1)), c("events"), c("committed"), c("edit_in_tail"), c("close_reason"))


def best_label(evidence: list[tuple[Column, Column]], behavior: Column) -> Column:
    """struct(outcome, source) of the first (outcome, source) that is known, in order of precedence, else by behavior; null without any."""
    one = lambda outcome, source: F.when(outcome.isNotNull(), F.struct(outcome.alias("outcome"), source.alias("source")))
    return F.coalesce(*[one(*x) for x in evidence], one(behavior, F.lit("behavior_inference")))


def tier(source: Column) -> Column:
    return functools.reduce(lambda w, t: w.when(source == t[0], t[1]), TIERS.items(), F).otherwise(1)


def with_labels(runs: DataFrame, now: int) -> DataFrame:
    """``runs`` after a labeling pass, with ``changed``.

    Columns: outcome, labeled_at, version, history (array of outcome, labeled_at, version, source) and
    features (map) as they were; new_outcome, new_source and signals (map) of this pass. A label of a
    lower tier never replaces one of a higher tier; a null label clears an inferred one only; equal
    labels change nothing; signals join the features in every case."""
    old_tier = tier(F.coalesce(F.try_element_at("history", F.lit(-1))["source"], F.lit("behavior_inference")))
    blocked = F.col("outcome").isNotNull() & (tier(F.col("new_source")) < old_tier)
    write = F.col("new_outcome").isNotNull() & ~blocked & ~F.col("outcome").eqNullSafe(F.col("new_outcome"))
    clear = F.col("new_outcome").isNull() & F.col("outcome").isNotNull() & (old_tier == 1)
    version = F.coalesce("version", F.lit(0)) + 1
    entry = F.struct(F.col("new_outcome").alias("outcome"), F.lit(now).alias("labeled_at"), version.cast("long").alias("version"), F.col("new_source").alias("source"))
    r = runs.withColumns({"_write": write, "_clear": clear, "_version": version.cast("long"), "_entry": entry})
    return r.select(
        *[c for c in runs.columns if c not in ("outcome", "labeled_at", "version", "history", "features", "new_outcome", "new_source", "signals")],
        F.when(F.col("_write"), F.col("new_outcome")).when(~F.col("_clear"), F.col("outcome")).alias("outcome"),
        F.when(F.col("_write"), F.lit(now)).when(~F.col("_clear"), F.col("labeled_at")).alias("labeled_at"),
        F.when(F.col("_write"), F.col("_version")).otherwise(F.col("version")).alias("version"),
        F.when(F.col("_write"), F.array_append("history", F.col("_entry"))).otherwise(F.col("history")).alias("history"),
        F.map_concat(F.map_filter("features", lambda k, _: ~F.array_contains(F.map_keys("signals"), k)), F.col("signals")).alias("features"),
        (F.col("_write") | F.col("_clear")).alias("changed"),
    )


def token_features(events: DataFrame) -> DataFrame:
    """Sums of tokens, errors and calls of each run, with its cache hit rate, error rate and primary model
    (of those used most the one seen first)."""
    m = events.filter(F.col("model").isNotNull()).groupBy("run_id", "model").agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("seen"))
    best = m.groupBy("run_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "model"))["model"].alias("primary_model"), F.count("*").alias("models"))
    e = events.groupBy("run_id").agg(
        F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.sum("cache_read").alias("cache_read"), F.sum("cache_write").alias("cache_write"),
        F.count_if(F.col("tool") != "").alias("calls"), F.count_if("is_error").alias("errors"), F.count_if(F.col("is_error") & (F.coalesce("error_type", F.lit("error")) == "timeout")).alias("timeouts"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return e.join(best, "run_id", "left").withColumns({"cache_hit_rate": rate("cache_read", "cache_write"), "error_rate": rate("errors", "calls")})


def classified(events: DataFrame) -> DataFrame:
    """``events`` with what each call is about (``about``) and its class of activity (``class``)."""
    e = events.withColumn("about", C.human_key(F.col("summary")))
    return e.withColumn("class", C.activity_class(F.col("tool"), F.col("about")))


def repeated_commands(events: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, pattern, n): commands of the same normal form that a run gives ``least`` times or more."""
    e = events.filter((F.col("tool") == "Bash") & (F.col("about") != ""))
    return e.groupBy("run_id", normal_command(F.col("about")).alias("pattern")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def redo_reads(events: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, file, n): files that a run reads ``least`` times or more, by their last three segments."""
    e = events.filter((F.col("tool") == "Read") & (F.col("about") != ""))
    g = e.groupBy("run_id", "about").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    short = F.regexp_extract("about", r"(?:[^/]*/){0,2}[^/]*$", 0)
    return g.select("run_id", F.when(F.size(F.split("about", "/")) > 3, short).otherwise(F.col("about")).alias("file"), "n")


def profiles(events: DataFrame, stall: int) -> DataFrame:
    """(run_id, events, span, active, polls, churn, big_repeats, redo, cycles, flags) from ``classified`` events."""
    w = Window.partitionBy("run_id").orderBy(*ORDER)
    c = F.col
    explore = c("class") == "explore"
    kind = c("tool").isin("Grep", "Glob", "Bash")
    pair = F.coalesce(F.lag(explore).over(w) & explore, F.lit(False))
    checked = F.coalesce(F.max(c("class").isin("build", "run-verify")).over(w.rowsBetween(1, 4)), F.lit(False))
    e = events.withColumns({"gap": F.lead("us").over(w) - c("us"), "pair": pair, "flip": pair & (F.lag(kind).over(w) != kind), "checked": checked})
    poll = (c("tool") == "Bash") & c("about").rlike(C.POLL) & c("about").rlike(C.PEEK)
    g = e.groupBy("run_id").agg(
        F.count("*").alias("events"), (F.max("us") - F.min("us")).alias("span"), F.coalesce(F.sum(F.when(c("gap") > stall, c("gap"))), F.lit(0)).alias("stalled"), F.count_if(poll).alias("polls"),
        F.count_if("pair").alias("pairs"), F.count_if("flip").alias("flips"), F.count_if((c("class") == "edit") & c("checked")).alias("cycles"),
    )
    big = repeated_commands(events, 5).groupBy("run_id").agg(F.count("*").alias("big_repeats"))
    redo = redo_reads(events).groupBy("run_id").agg(F.count("*").alias("redo"))
    g = g.join(big, "run_id", "left").join(redo, "run_id", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("big_repeats", "redo")})
    g = g.withColumns({"active": F.greatest(F.lit(0), c("span") - c("stalled")), "churn": F.when(c("pairs") > 0, F.round(c("flips") / c("pairs"), 2)).otherwise(0.0)})
    flags = F.array_compact(F.array(
        F.when(c("polls") > 0, F.concat(F.lit("busy_wait_polling x"), c("polls"))), F.when((c("churn") >= 0.6) & (c("events") >= 20), F.concat(F.lit("high_nav_churn="), c("churn"))),
        F.when(c("big_repeats") > 0, F.concat(F.lit("missing_tooling_smell x"), c("big_repeats"))), F.when(c("redo") > 0, F.concat(F.lit("redo_reads x"), c("redo"))),
        F.when((c("span") > 0) & (c("active") > 0) & (c("active") < 0.5 * c("span")), "wait_dominated"), F.when((c("cycles") == 0) & (c("events") >= 30), "no_edit_verify_cycle"),
    ))
    return g.select("run_id", "events", "span", "active", "polls", "churn", "big_repeats", "redo", "cycles", flags.alias("flags"))


def dispatches(events: DataFrame) -> DataFrame:
    """Dispatches of agents: run_id, us, event_id, child, prompt, model, name, isolation, description."""
    fields = C.dispatch_fields(F.col("summary"), F.col("response"))
    return events.filter(F.col("tool").isin(*DISPATCHES)).select("run_id", *ORDER, *[c.alias(k) for k, c in fields.items()])


def verify_status() -> Column:
    """failed, passed or unknown for a shell call that verifies; null for others."""
    said = F.length(C.output(F.col("response"))) > 1
    verifies = (F.col("tool") == "Bash") & C.verifies(F.coalesce(json_command(), F.lit("")))
    return F.when(verifies, F.when(C.failed_output(F.col("response")), "failed").when(said, "passed").otherwise("unknown"))


def json_command() -> Column:
    from tidewell.functions.text import json_field

    return json_field(F.col("summary"), "command")


def false_claims(events: DataFrame, window: int, reach: int = 200) -> DataFrame:
    """(run_id, cohort, claim, width): fan-outs that claim a clean baseline although the last verification
    before them, among the ``reach`` events before, had failed."""
    e = events.withColumn("verified", verify_status())
    e = sequences.last_before(e, "run_id", ORDER, F.col("verified").isNotNull(), F.col("verified"), reach, "status")
    d = e.filter(F.col("tool").isin(*DISPATCHES)).withColumn("claim", F.nullif(C.clean_claim(C.dispatch_fields(F.col("summary"), F.col("response"))["prompt"]), F.lit("")))
    w = Window.partitionBy("run_id").orderBy(*ORDER)
    far = F.coalesce(F.col("us") - F.lag("us").over(w) > window, F.lit(True))
    d = d.withColumn("cohort", F.sum(far.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*ORDER)
    g = d.groupBy("run_id", "cohort").agg(F.min_by(F.struct("status"), at)["status"].alias("status"), F.min_by("claim", F.when(F.col("claim").isNotNull(), at)).alias("claim"), F.count("*").alias("width"))
    return g.filter((F.col("status") == "failed") & F.col("claim").isNotNull()).drop("status")


def harness_changes(events: DataFrame) -> DataFrame:
    """(run_id, label, via, event_id): the first event of each run that touches a file that steers agents."""
    path = C.edited_path(F.col("summary"), F.col("response"))
    command = F.coalesce(C.command_of(F.col("summary")), F.lit(""))
    git = (F.col("tool") == "Bash") & C.has_word(command, ("git",))
    label = F.when(F.col("tool").isin(*EDITS), C.harness_label(path)).when(git, C.harness_label(F.concat_ws("\n", command, "response")))
    e = events.withColumns({"label": label, "via": F.when(F.col("tool") == "Bash", "git_diff_surface").otherwise("edit")}).filter(F.col("label").isNotNull())
    return e.groupBy("run_id", "label").agg(F.min_by(F.struct("via", "event_id"), F.struct(*ORDER)).alias("x")).select("run_id", "label", "x.*")


def worktree_outcomes(events: DataFrame) -> DataFrame:
    """One row per (run_id, slug): edits, code_edits, verifications, last_status, committed and class of what an agent did in its worktree."""
    c = F.col
    edit = c("tool").isin(*EDITS)
    e = events.withColumns({"slug": C.worktree_slug(F.lit(None).cast("string"), c("cwd")), "verified": verify_status()}).filter("slug IS NOT NULL")
    commit = (c("tool") == "Bash") & C.has_word(c("summary"), C.COMMIT_WORDS)
    status = F.when(c("verified") == "failed", "failed").when(c("verified").isNotNull(), "passed")
    g = e.withColumn("status", status).groupBy("run_id", "slug").agg(
        F.count("*").alias("events"), F.count_if(edit).alias("edits"), F.count_if(edit & C.is_code(C.edited_path(c("summary"), c("response")))).alias("code_edits"), F.count("verified").alias("verifications"),
        F.coalesce(F.max_by("status", F.when(c("status").isNotNull(), F.struct(*ORDER))), F.lit("none")).alias("last_status"), _yes(commit).alias("committed"),
    )
    kind = F.when(c("edits") == 0, "readonly").when(c("code_edits") == 0, "docs").when(c("last_status") == "failed", "left_red").when(c("last_status") == "none", "unverified").otherwise("verified")
    return g.withColumn("class", kind)


def dispatched_worktrees(sent: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Each dispatch with the worktree of the agent that it sent, if that can be told: slug agent-<child>."""
    of = worktrees.select("run_id", F.regexp_replace("slug", "^agent-", "").alias("child"), "slug", "class")
    return sent.join(of, ["run_id", "child"], "left")


def repeated_builds(events: DataFrame) -> DataFrame:
    """(run_id, command, n): builds that a run gives more than once in the same words."""
    command = F.trim(F.regexp_replace(F.coalesce(json_command(), F.lit("")), r"\s+", " "))
    e = events.filter(F.col("tool") == "Bash").withColumn("command", command).filter(C.is_build(F.col("command")))
    return e.groupBy("run_id", "command").agg(F.count("*").alias("n")).filter("n > 1")
