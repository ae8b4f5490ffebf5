"""Records of conversations: what their content parts say, and the remedies that commands name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,content:string,input:map<string,string>>>"
#: Commits and closed tasks with their messages, and words of a remedy.
COMMIT = r"""(?is)git commit[^\n]*?-m\s*(?:"(.+?)"|'(.+?)')"""
CLOSED = r"""(?is)bd (?:close|update)\s+\S+[^\n]*?--(?:reason|notes)=(?:"(.+?)"|'(.+?)')"""
REMEDY = r"(?i)\b(fix|fixed|harden|resolve|reclaim|drain|serial|mitigat|workaround|patch)\w*"


def prompt_text(content: Column) -> Column:
    """The text of a content that is a plain text or a list of parts, of which the text parts count."""
    parts = F.filter(F.from_json(content, PARTS), lambda p: p["type"] == "text")
    listed = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return F.when(content.startswith("[") & parts.isNotNull(), listed).otherwise(content)


def blobs(content: Column) -> Column:
    """array<struct<kind, text>> of a list of parts: commands, results and texts; images in base64 are left out."""
    parts = F.from_json(content, PARTS)
    image = lambda t: F.ltrim(t).startswith('[{"type": "image"') | F.contains(F.substring(t, 1, 80), F.lit('"base64"'))
    blob = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    one = lambda p: (
        F.when(p["type"] == "tool_use", blob("command", F.coalesce(F.array_join(F.map_values(p["input"]), "\n"), F.lit(""))))
        .when((p["type"] == "tool_result") & ~image(F.coalesce(p["content"], F.lit(""))), blob("result", F.coalesce(p["content"], F.lit(""))))
        .when(p["type"] == "text", blob("text", F.coalesce(p["text"], F.lit(""))))
    )
    return F.array_compact(F.transform(parts, one))


def remedies(command: Column) -> Column:
    """array<struct<kind, message>> of the commits and closed tasks in a command whose message names a remedy, 200 characters each."""

    def found(rule: str, kind: str) -> Column:
        said = F.zip_with(F.regexp_extract_all(command, F.lit(rule), F.lit(1)), F.regexp_extract_all(command, F.lit(rule), F.lit(2)), lambda a, b: F.concat(a, b))
        said = F.filter(F.transform(said, lambda m: F.substring(m, 1, 200)), lambda m: m.rlike(REMEDY))
        return F.transform(said, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("message")))

    return F.concat(found(COMMIT, "commit"), found(CLOSED, "task"))
