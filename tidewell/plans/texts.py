"""Queries over texts: levels, questions, commands, similarity and drift of a problem corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_LEVEL = "CASE " + " ".join(f"WHEN {_has(words)} THEN '{name}'" for name, words in text.LEVELS) + " ELSE 'info' END"


@query(f"SELECT {_LEVEL} AS level, count(*) AS n FROM documents GROUP BY 1")
def level_infer(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(text.level(F.col("text")).alias("level")).agg(F.count("*").alias("n"))


@query(r"""WITH q AS (SELECT conv_id, turn, trim(regexp_replace(trim(coalesce(text, '')), '[?.:!]+$', '')) AS t FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(/[^\s,;"''()]+)', '<path>', 'g'), '\b[0-9A-Z]{26}\b', '<id>', 'g'), '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<id>', 'g'), '(?i)\b[0-9a-f]{7,40}\b', '<id>', 'g'), '\b[a-z][a-z0-9-]+-[a-z0-9]{4,}\b', '<id>', 'g'), '\b\d+\b', '<n>', 'g'), '\s{2,}', ' ', 'g'))) AS class FROM q)
SELECT conv_id, turn, sha256(class) AS class_sha, NOT regexp_matches(class, '<(path|id|n)>') AS deterministic FROM r""")
def question_class(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", text.question_class(F.col("text")).alias("class"))
    return c.select("conv_id", "turn", F.sha2("class", 256).alias("class_sha"), text.deterministic_question(F.col("class")).alias("deterministic"))


@query(r"""WITH c AS (SELECT 'cat ' || url || ' --id ' || page_id || ' | head' AS cmd FROM pages), f AS (SELECT trim(split_part(split_part(trim(cmd), '|', 1), '&&', 1)) AS s FROM c)
SELECT substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '/[\w./@~-]+', '<path>', 'g'), '\b[0-9a-f]{8,}\b', '<hex>', 'g'), '\b\d+\b', '<n>', 'g'), '"[^"]*"', '"<s>"', 'g'), '''[^'']*''', '''<s>''', 'g'), '\s+', ' ', 'g')), 1, 120) AS command, count(*) AS n FROM f GROUP BY 1""")
def normalise_cmd(spark, sf_dir):
    cmd = F.concat(F.lit("cat "), F.col("url"), F.lit(" --id "), F.col("page_id").cast("string"), F.lit(" | head"))
    return table(spark, sf_dir, "pages").groupBy(text.normal_command(cmd).alias("command")).agg(F.count("*").alias("n"))


def grams(spark, sf_dir) -> DataFrame:
    """(item_id, g): the character 5-grams of each benchmark item; the pairs below join on them."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.char_ngrams(F.col("text"))).alias("g"))


_GRAMS = r"""t AS (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark), g AS (SELECT DISTINCT item_id, unnest([substr(t, i, 5) FOR i IN generate_series(1, length(t) - 4)]) AS g FROM t WHERE length(t) >= 5),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.item_id < b.item_id GROUP BY 1, 2),
s AS (SELECT a, b, c, c::DOUBLE / (x.n + y.n - c) AS sim FROM c JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b)"""


def similar_items(spark, sf_dir) -> DataFrame:
    """(a, b, c, sim): pairs of items that share a 5-gram, by joining on the n-grams; all others have similarity 0."""
    g = grams(spark, sf_dir)
    n = g.groupBy("item_id").agg(F.count("*").alias("n"))
    c = g.withColumnRenamed("item_id", "a").join(g.withColumnRenamed("item_id", "b"), "g").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("c"))
    c = c.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return c.select("a", "b", "c", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("sim"))


@query(f"WITH {_GRAMS} SELECT a, b, c, round(sim, 9) AS sim FROM s")
def jaccard_5gram(spark, sf_dir):
    return similar_items(spark, sf_dir).withColumn("sim", F.round("sim", 9))


@query(f"""WITH {_GRAMS}, u AS (SELECT a AS item_id, c::DOUBLE AS c, sim FROM s UNION ALL SELECT b, c, sim FROM s), m AS (SELECT item_id, max(sim) AS nearest FROM u GROUP BY 1) SELECT item_id, round(1 - coalesce(nearest, 0), 9) AS novelty FROM benchmark LEFT JOIN m USING (item_id)""")
def novelty_rank(spark, sf_dir):
    s = similar_items(spark, sf_dir)
    m = s.select(F.col("a").alias("item_id"), "sim").unionByName(s.select(F.col("b").alias("item_id"), "sim")).groupBy("item_id").agg(F.max("sim").alias("nearest"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(m, "item_id", "left").select("item_id", F.round(1 - F.coalesce("nearest", F.lit(0.0)), 9).alias("novelty"))


_TFIDF = r"""w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark), tf AS (SELECT item_id, term, 1 + ln(count(*)::DOUBLE) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE AS n FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), v AS (SELECT item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n WHERE df <= 0.95 * n), l AS (SELECT item_id, sqrt(sum(v * v)) AS l FROM v GROUP BY 1)"""


@query(f"WITH {_TFIDF}, d AS (SELECT a.item_id AS a, b.item_id AS b, sum(a.v * b.v) AS dot FROM v a JOIN v b ON a.term = b.term AND a.item_id < b.item_id GROUP BY 1, 2) SELECT a, b, round(dot / (x.l * y.l), 6) AS cosine FROM d JOIN l x ON x.item_id = a JOIN l y ON y.item_id = b")
def tfidf_cosine(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    w = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("term"))
    tf = w.groupBy("item_id", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    v = tf.join(df, "term").crossJoin(F.broadcast(items.agg(F.count("*").cast("double").alias("n")))).filter(F.col("df") <= 0.95 * F.col("n"))
    v = v.select("item_id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("v"))
    length = v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    a, b = (v.select(F.col("item_id").alias(x), "term", F.col("v").alias(f"v{x}")) for x in "ab")
    d = a.join(b, "term").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    d = d.join(length.select(F.col("item_id").alias("a"), F.col("l").alias("la")), "a").join(length.select(F.col("item_id").alias("b"), F.col("l").alias("lb")), "b")
    return d.select("a", "b", F.round(F.col("dot") / (F.col("la") * F.col("lb")), 6).alias("cosine"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_COMPOSITE = rf"""{_GRAMS}, k AS (SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS k FROM benchmark),
w AS (SELECT item_id, unnest(list_concat(k, [k[i] || ' ' || k[i + 1] FOR i IN generate_series(1, len(k) - 1)])) AS term FROM k), tf AS (SELECT item_id, term, 1 + ln(count(*)::DOUBLE) AS tf FROM w GROUP BY 1, 2), size AS (SELECT count(*)::DOUBLE AS items FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), v AS (SELECT item_id, term, tf * (ln((1 + items) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), size WHERE df <= 0.95 * items), l AS (SELECT item_id, sqrt(sum(v * v)) AS l FROM v GROUP BY 1),
d AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.v * y.v) AS dot FROM v x JOIN v y ON x.term = y.term AND x.item_id < y.item_id GROUP BY 1, 2), cosines AS (SELECT a, b, dot / (x.l * y.l) AS cosine FROM d JOIN l x ON x.item_id = a JOIN l y ON y.item_id = b),
p AS (SELECT a, b, coalesce(cosine, 0) AS tfidf, coalesce(sim, 0) AS fivegram FROM cosines FULL JOIN s USING (a, b))"""


def tfidf_vectors(items: DataFrame) -> DataFrame:
    """(item_id, term, v): vectors of length 1 over words and word pairs; terms of more than 95 % of the items are left out."""
    w = items.select("item_id", F.explode(text.word_grams(F.col("text"))).alias("term"))
    tf = w.groupBy("item_id", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    v = tf.join(df, "term").crossJoin(F.broadcast(items.agg(F.count("*").cast("double").alias("n")))).filter(F.col("df") <= 0.95 * F.col("n"))
    v = v.select("item_id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("v"))
    length = v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return v.join(length, "item_id").select("item_id", "term", (F.col("v") / F.col("l")).alias("v"))


def cosines(spark, sf_dir) -> DataFrame:
    """(a, b, cosine) of the pairs of items that share a term; all others have 0."""
    v = tfidf_vectors(table(spark, sf_dir, "benchmark"))
    a, b = (v.select(F.col("item_id").alias(x), "term", F.col("v").alias(f"v{x}")) for x in "ab")
    return a.join(b, "term").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("cosine"))


@query(f"WITH {_COMPOSITE} SELECT a, b, round(cosine, 6) AS cosine FROM cosines")
def tfidf_cosine_pairs(spark, sf_dir):
    """TF-IDF cosine as in the reference: words and word pairs without stop words."""
    return cosines(spark, sf_dir).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_COMPOSITE} SELECT a, b, round(tfidf, 6) AS tfidf, round(fivegram, 6) AS fivegram, round(0.55 * tfidf + 0.35 * fivegram, 6) AS composite FROM p")
def composite_similarity(spark, sf_dir):
    """0.55 TF-IDF cosine + 0.35 5-gram Jaccard; the 0.10 for common skills is 0, as items have none."""
    s = similar_items(spark, sf_dir).select("a", "b", "sim")
    p = cosines(spark, sf_dir).join(s, ["a", "b"], "full").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("t"), F.coalesce("sim", F.lit(0.0)).alias("f"))
    return p.select("a", "b", F.round("t", 6).alias("tfidf"), F.round("f", 6).alias("fivegram"), F.round(0.55 * F.col("t") + 0.35 * F.col("f"), 6).alias("composite"))


@query(f"""WITH {_COMPOSITE}, u AS (SELECT a AS item_id, 0.55 * tfidf + 0.35 * fivegram AS c FROM p UNION ALL SELECT b, 0.55 * tfidf + 0.35 * fivegram FROM p), m AS (SELECT item_id, sum(c) AS c FROM u GROUP BY 1)
SELECT item_id, round(1 - coalesce(c, 0) / (items - 1), 9) AS novelty FROM benchmark LEFT JOIN m USING (item_id), size WHERE items > 1""")
def novelty_composite(spark, sf_dir):
    """1 - mean similarity to all other items, as in the reference, least novel first; the cosines of an item sum up by terms, without pairs."""
    items = table(spark, sf_dir, "benchmark")
    v, s = tfidf_vectors(items), similar_items(spark, sf_dir)
    t = v.join(v.groupBy("term").agg(F.sum("v").alias("all")), "term").groupBy("item_id").agg(F.sum(F.col("v") * (F.col("all") - F.col("v"))).alias("t"))
    f = s.select(F.col("a").alias("item_id"), "sim").unionByName(s.select(F.col("b").alias("item_id"), "sim")).groupBy("item_id").agg(F.sum("sim").alias("f"))
    n = items.agg(F.count("*").alias("n")).filter("n > 1")
    out = items.select("item_id").join(t, "item_id", "left").join(f, "item_id", "left").crossJoin(F.broadcast(n))
    like = 0.55 * F.coalesce("t", F.lit(0.0)) + 0.35 * F.coalesce("f", F.lit(0.0))
    return out.select("item_id", F.round(1 - like / (F.col("n") - 1), 9).alias("novelty")).orderBy("novelty", "item_id")


@query("""WITH d AS (SELECT lang, source, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1, 2) SELECT lang, count(*) AS sources, sum(n)::BIGINT AS n, min(lo) AS lo, max(hi) AS hi, sum(total)::BIGINT AS total FROM d GROUP BY 1""")
def corpus_day_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.sum("n_chars").alias("total"))
    return d


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(length(text))::BIGINT AS chars, max(turn) FILTER (role = 'assistant') AS last_answer FROM conversations GROUP BY 1")
def conversation_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).cast("long").alias("chars"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_answer"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, nullif(split_part(regexp_replace(url, '^https?://[^/]+/?', ''), '/', 1), '') AS area FROM pages")
def page_projects(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_replace("url", "^https?://[^/]+/?", "")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.nullif(F.split(rest, "/")[0], F.lit("")).alias("area"))
