"""Normal forms of messages, questions and commands."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a message fingerprint replaces, in this order.
FINGERPRINT = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*", "{ts}"),
    (r"0x[0-9a-fA-F]{4,}", "{hex}"),
    (r"\b[0-9A-Z]{26}\b", "{ulid}"),
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}"),
    (r"\b(?:pid|PID)[=: ]\d+", "pid={N}"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "{ip}"),
    (r"\d+", "{N}"),
    (r"\s+", " "),
]
#: What a question class replaces, in this order.
QUESTION = [
    (r"(/[^\s,;\"'()]+)", "<path>"),
    (r"\b[0-9A-Z]{26}\b", "<id>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"),
    (r"(?i)\b[0-9a-f]{7,40}\b", "<id>"),
    (r"\b[a-z][a-z0-9-]+-[a-z0-9]{4,}\b", "<id>"),
    (r"\b\d+\b", "<n>"),
    (r"\s{2,}", " "),
]
#: What a normal command replaces, in this order.
COMMAND = [
    (r"/[\w./@~-]+", "<path>"),
    (r"\b[0-9a-f]{8,}\b", "<hex>"),
    (r"\b\d+\b", "<n>"),
    (r'"[^"]*"', '"<s>"'),
    (r"'[^']*'", "'<s>'"),
    (r"\s+", " "),
]
#: Words by which a log level is inferred, the most severe first.
LEVELS = [
    ("critical", ("panic", "fatal", "oom killed", "out of memory", "killed process")),
    ("error", ("error", "err:", "failed", "failure", "exception", "traceback", "sigkill")),
    ("warn", ("warn", "warning", "deprecated", "retrying")),
    ("debug", ("debug", "trace", "verbose")),
]


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    return functools.reduce(lambda t, r: F.regexp_replace(t, r[0], r[1].replace("$", r"\$")), rules, text)


def fingerprint(message: Column) -> Column:
    """The structure of a message without its variable parts: at most 150 characters of the first 500."""
    return F.lower(F.substring(F.trim(_replaced(F.substring(message, 1, 500), FINGERPRINT)), 1, 150))


def fingerprint_hash(fp: Column) -> Column:
    return F.substring(F.sha2(fp, 256), 1, 16)


def question_class(text: Column) -> Column:
    """A question without what differs from run to run, in lower case."""
    t = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[?.:!]+$", ""))
    return F.trim(F.lower(_replaced(t, QUESTION)))


def deterministic_question(question: Column) -> Column:
    return ~question.rlike("<(path|id|n)>")


def normal_command(command: Column) -> Column:
    """The first stage of a command with its literals collapsed, so that like commands are equal."""
    first = F.trim(F.split(F.split(F.trim(command), r"\|")[0], "&&")[0])
    return F.substring(F.trim(_replaced(first, COMMAND)), 1, 120)


def level(message: Column) -> Column:
    """Log level by the words of a message; "info" without any."""
    m = F.lower(message)
    has = lambda words: functools.reduce(lambda a, b: a | b, [F.contains(m, F.lit(w)) for w in words])
    out = functools.reduce(lambda w, x: w.when(has(x[1]), x[0]), LEVELS, F)
    return out.otherwise(F.lit("info"))


def json_field(raw: Column, key: str) -> Column:
    """A string field of JSON that may be cut off: parsed if it parses, else by its pattern."""
    return F.coalesce(F.get_json_object(raw, f"$.{key}"), F.nullif(F.regexp_extract(raw, rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)', 1), F.lit("")))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """The set of character n-grams of a text in lower case with single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    starts = F.sequence(F.lit(1), F.length(t) - n + 1)
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


#: English stop words of the reference's vectorizer (scikit-learn's list, written from memory: the package is not at hand).
STOP_WORDS = """a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves""".split()


def word_grams(text: Column) -> Column:
    """Words of two characters or more without stop words, and the pairs of neighbours among what remains."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def diff_summary(diff: Column) -> Column:
    """struct(added, removed) lines of a unified diff."""
    of = lambda sign: F.size(F.filter(F.split(diff, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return F.struct(of("+").alias("added"), of("-").alias("removed"))
