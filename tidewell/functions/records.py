"""Records and their fields out of landed source text: structs by brackets, structs by the type keyword, classes by indentation.

A small scanner, not a grammar: it blanks comments and texts, finds the heads of records, takes each body to
its matching bracket (or by its indentation) and reads the declarations at the body's own depth. What it
takes for a record by mistake does no harm, as its fields then overlap with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of files of each family; other endings count as the first.
ENDINGS = {"go": (".go",), "python": (".py",)}
SCHEMA = "path string, record string, field string"

_NOISE = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*\"""", re.S)
_STRUCT = re.compile(r"\bstruct\s+(\w+)\s*\{")
_TYPE = re.compile(r"\btype\s+(\w+)\s+struct\s*\{")
_CLASS = re.compile(r"([ \t]*)class\s+(\w+)\s*(?:\([^)]*\))?\s*:")
_COLON = re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:(?!:)")
_LAST_NAME = re.compile(r"[\w:<>*&\]]\s*[\s*&]\s*(\w+)\s*(?:\[[^\]]*\]\s*)*(?:=.*)?$", re.S)
_GO_NAMES = re.compile(r"\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+[\w.*\[\]<>{}]")
_ANNOTATED = re.compile(r"\s*([A-Za-z_]\w*)\s*:\s*[^=\s]")


def _body(text: str, at: int) -> str:
    """From behind an opening bracket to its match, or to the end where it has none."""
    depth = 1
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return text[at : at + m.start()]
    return text[at:]


def _top(body: str, separators: str) -> Iterator[str]:
    """Pieces of a body between separators outside all inner brackets."""
    depth, start = 0, 0
    for i, c in enumerate(body):
        if c in "{([<":
            depth += 1
        elif c in "})]>" and not (c == ">" and i and body[i - 1] in "-="):
            depth = max(0, depth - 1)
        elif c in separators and not depth:
            yield body[start:i]
            start = i + 1
    if body[start:].strip():
        yield body[start:] if "\n" in separators or "," in separators else ""


def braced(text: str) -> Iterator[tuple[str, set[str]]]:
    """``struct Name { ... }``: declarations "type name;" and "name: type,"."""
    text = _NOISE.sub(" ", text)
    for m in _STRUCT.finditer(text):
        fields: set[str] = set()
        for piece in _top(_body(text, m.end()), ";,"):
            if colon := _COLON.match(piece):
                fields.add(colon.group(1))
            elif name := _LAST_NAME.search(piece.rstrip()):
                fields.add(name.group(1))
        yield m.group(1), fields


def typed(text: str) -> Iterator[tuple[str, set[str]]]:
    """``type Name struct { ... }``: lines "name type" and "name, name type"; a type alone is embedded and no field."""
    text = _NOISE.sub(" ", text)
    for m in _TYPE.finditer(text):
        lines = (_GO_NAMES.match(line) for line in _top(_body(text, m.end()), "\n"))
        yield m.group(1), {n.strip() for g in lines if g for n in g.group(1).split(",")}


def _width(line: str) -> int:
    return len(line) - len(line.lstrip())


def indented(text: str) -> Iterator[tuple[str, set[str]]]:
    """``class Name:`` with annotated names at the body's own indentation."""
    lines = [x for x in text.splitlines() if x.strip()]
    for i, line in enumerate(lines):
        if not (head := _CLASS.match(line)):
            continue
        fields, own = set(), None
        for below in lines[i + 1 :]:
            if _width(below) <= len(head.group(1)):
                break
            own = _width(below) if own is None else own
            if _width(below) == own and not below.lstrip().startswith(("def ", "async def ", "@", "class ")) and (name := _ANNOTATED.match(below)):
                fields.add(name.group(1))
        yield head.group(2), fields


def family(path: str) -> Callable[[str], Iterator[tuple[str, set[str]]]]:
    ending = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return typed if ending in ENDINGS["go"] else indented if ending in ENDINGS["python"] else braced


def record_fields(sources: DataFrame) -> DataFrame:
    """(path, record, field) of (path, text) files, a row for each field; records without fields give none, nor do null texts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, name, f) for p, t in zip(b["path"], b["text"], strict=True) for name, fields in family(p or "")(t) for f in sorted(fields)]
            yield pd.DataFrame(rows, columns=["path", "record", "field"]).astype(object)

    return sources.select("path", "text").filter(F.col("text").isNotNull()).mapInPandas(scan, SCHEMA)
