"""Queries over records of conversations, with their SQL twins.

A record's content is its turn's text, for odd turns as it is, for even ones as a list of parts with a
command and a result beside the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import transcripts
from tidewell.runtime import table

QUERIES, ORACLE = {}, {}
COMMANDS = ['git commit -m "fix lock {n}"', "git commit -a -m 'add part {n}'", 'bd close shop-{n} --reason="patched the lock"', "ls src/{n}", 'git commit -m "drain queue {n}" && bd update x{n} --notes=\'mitigated {n}\'']
RECORD = "rc AS (SELECT conv_id, turn, text, replace([" + ", ".join("'" + c.replace("'", "''") + "'" for c in COMMANDS) + "][1 + (conv_id + turn) % 5], '{n}', (conv_id % 7)::VARCHAR) AS command, CASE WHEN (conv_id + turn) % 4 = 0 THEN '[{\"type\": \"image\", \"source\": {\"type\": \"base64\"}}]' ELSE 'done ' || turn END AS result FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def records(spark, sf_dir) -> DataFrame:
    c, k = F.col, F.col("conv_id") + F.col("turn")
    d = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    command = F.replace(F.element_at(F.array(*map(F.lit, COMMANDS)), (1 + k % 5).cast("int")), F.lit("{n}"), (c("conv_id") % 7).cast("string"))
    result = F.when(k % 4 == 0, '[{"type": "image", "source": {"type": "base64"}}]').otherwise(F.concat(F.lit("done "), c("turn").cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    part = lambda t, text=None, content=None, args=None: F.struct(F.lit(t).alias("type"), (text if text is not None else none("string")).alias("text"), (content if content is not None else none("string")).alias("content"), (args if args is not None else none("map<string,string>")).alias("input"))
    listed = F.to_json(F.array(part("tool_use", args=F.create_map(F.lit("command"), command)), part("text", text=c("text")), part("tool_result", content=result)))
    return d.select("conv_id", "turn", F.when(c("turn") % 2 == 0, listed).otherwise(c("text")).alias("content"))


@query(f"WITH {RECORD} SELECT conv_id, turn, md5(text) AS digest, length(text) AS chars FROM rc")
def prompt_texts(spark, sf_dir):
    t = transcripts.prompt_text(F.col("content"))
    return records(spark, sf_dir).select("conv_id", "turn", F.md5(t).alias("digest"), F.length(t).cast("long").alias("chars"))


@query(f"WITH {RECORD} SELECT conv_id, turn, 'command' AS kind, md5(command) AS digest FROM rc WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'text', md5(text) FROM rc WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'result', md5(result) FROM rc WHERE turn % 2 = 0 AND (conv_id + turn) % 4 <> 0")
def transcript_blobs(spark, sf_dir):
    r = records(spark, sf_dir)  # contents that are plain texts have no parts
    return r.select("conv_id", "turn", F.inline(transcripts.blobs(F.col("content")))).select("conv_id", "turn", "kind", F.md5("text").alias("digest"))


@query(f"""WITH {RECORD}, m AS (SELECT conv_id, turn, 'commit' AS kind, unnest(regexp_extract_all(command, '(?is)git commit[^\\n]*?-m\\s*["''](.+?)["'']', 1)) AS message FROM rc WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'task', unnest(regexp_extract_all(command, '(?is)bd (?:close|update)\\s+\\S+[^\\n]*?--(?:reason|notes)=["''](.+?)["'']', 1)) FROM rc WHERE turn % 2 = 0)
SELECT * FROM m WHERE regexp_matches(message, '(?i)\\b(fix|fixed|harden|resolve|reclaim|drain|serial|mitigat|workaround|patch)\\w*')""")
def remediations(spark, sf_dir):
    r = records(spark, sf_dir).select("conv_id", "turn", F.inline(transcripts.blobs(F.col("content")))).filter("kind = 'command'")
    return r.select("conv_id", "turn", F.inline(transcripts.remedies(F.col("text"))))


@query(f"WITH {RECORD}, h AS (SELECT conv_id, turn, unnest([x FOR x IN [CASE WHEN contains(command, 'lock') THEN 'build_lock' END, CASE WHEN contains(command, 'queue') THEN 'queue_full' END] IF x IS NOT NULL]) AS class FROM rc WHERE turn % 2 = 0 AND (contains(command, 'lock') OR contains(command, 'queue'))) SELECT class, count(*) AS hits, count(DISTINCT conv_id) AS sessions, min(turn)::BIGINT AS first_turn FROM h GROUP BY 1")
def struggle_classes(spark, sf_dir):
    """Records by classes of struggles; a cheap look for their words comes before any JSON is parsed."""
    classes = {"build_lock": r"\block", "queue_full": r"\bqueue"}
    r = records(spark, sf_dir).filter(F.contains("content", F.lit("lock")) | F.contains("content", F.lit("queue")))
    b = r.select("conv_id", "turn", F.inline(transcripts.blobs(F.col("content")))).filter("kind = 'command'")
    hit = F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(rule), name) for name, rule in classes.items()])))
    h = b.select("conv_id", "turn", hit.alias("class"))
    return h.groupBy("class").agg(F.count("*").alias("hits"), F.countDistinct("conv_id").alias("sessions"), F.min("turn").cast("long").alias("first_turn"))
