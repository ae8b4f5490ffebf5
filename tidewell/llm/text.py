"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: ASCII space and the controls 9 to 13.
SPACE = r"\x20\x09-\x0D"
STRIP = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE}]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words, without building them: runs of characters that are not white space."""
    stripped = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.when(stripped == "", 0).otherwise(F.length(stripped) - F.length(F.replace(stripped, F.lit(" "), F.lit(""))) + 1).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it while ``taken`` has it in any letter case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
