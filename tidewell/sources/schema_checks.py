"""JSON Schema as checks on a VARIANT: a text is parsed once, and every rule looks at the parsed value.

``violation(schema, v)`` is a column with the first broken rule of a value, or null. Said are types (one
or several), enum and const, bounds and lengths, patterns, required and dependent fields, properties and what
is not among them, items, uniqueItems and contains, and the combinators allOf, anyOf, oneOf, not and
if/then/else; ``$ref`` within the schema is followed. Titles, descriptions, formats and defaults say nothing
about a value, as in the standard's own reading.

Defined cases: a null column (no JSON) breaks nothing here, the caller tells it apart; a JSON null is a value of
type null and satisfies ``required``; a rule for another type than the value's is met, as in the standard; numbers
are compared as doubles, and 1.0 is an integer; a schema ``true`` allows everything, ``false`` nothing. A schema
with a rule that is not known here, or a reference that leads nowhere, raises ``UnknownRule`` when it is compiled.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.runtime import let

SILENT = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$comment", "version", "name"}
KNOWN = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "required", "dependentRequired", "properties", "patternProperties", "propertyNames",
         "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems", "contains", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref"}


class UnknownRule(ValueError):
    pass


def kind(v: Column) -> Column:
    """The JSON type of a value: null, boolean, integer, number, string, array or object."""
    s = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    is_number = s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT")
    return (
        F.when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(is_number & (number == F.floor(number)), "integer").when(is_number, "number").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("string")
    )


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, '$["' + name.replace('"', '\\"') + '"]', "variant")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _first(rules: list[Column]) -> Column:
    return F.coalesce(*rules) if rules else F.lit(None).cast("string")


def _same(v: Column, k: Column, value) -> Column:
    """Whether a value equals one of the schema's."""
    if value is None:
        return k == "null"
    if isinstance(value, bool):
        return (k == "boolean") & (_text(v) == str(value).lower())
    if isinstance(value, (int, float)):
        return k.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return (k == "string") & (_text(v) == value)
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def violation(schema: dict | bool, v: Column, path: str = "", root: dict | None = None) -> Column:
    """The first rule that ``v`` breaks, as "path: rule"."""
    return let(v, lambda x: let(kind(x), lambda k: _rules(schema, x, k, path, root if root is not None else schema if isinstance(schema, dict) else {})))


def _resolve(root: dict, ref: str) -> dict:
    here = root
    for part in ref.removeprefix("#").strip("/").split("/") if ref.startswith("#") else ["\0"]:
        if part:
            if not isinstance(here, dict) or part not in here:
                raise UnknownRule(f"$ref {ref}")
            here = here[part]
    return here


def _rules(schema: dict | bool, v: Column, k: Column, path: str, root: dict) -> Column:
    at = path or "value"
    broken = lambda rule, bad: F.when(F.coalesce(bad, F.lit(False)), f"{at}: {rule}")
    if isinstance(schema, bool):
        return F.lit(None).cast("string") if schema else F.when(v.isNotNull(), f"{at}: not allowed")
    if unknown := set(schema) - KNOWN - SILENT - {x for x in schema if x.startswith("x-")}:
        raise UnknownRule(", ".join(sorted(unknown)))
    out: list[Column] = []
    below = lambda s, value, p: violation(s, value, p, root)
    fits = lambda s: below(s, v, path).isNull()
    if "$ref" in schema:
        out.append(_rules(_resolve(root, schema["$ref"]), v, k, path, root))
    if types := schema.get("type"):
        allowed = set(types if isinstance(types, list) else [types])
        allowed |= {"integer"} if "number" in allowed else set()
        out.append(broken("type", ~k.isin(*sorted(allowed))))
    if "enum" in schema:
        out.append(broken("not allowed", ~functools.reduce(lambda a, x: a | x, [F.coalesce(_same(v, k, e), F.lit(False)) for e in schema["enum"]], F.lit(False))))
    if "const" in schema:
        out.append(broken("not allowed", ~F.coalesce(_same(v, k, schema["const"]), F.lit(False))))
    number, text = F.try_variant_get(v, "$", "double"), _text(v)
    members, elements = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    is_number, is_text, is_object, is_array = k.isin("integer", "number"), k == "string", k == "object", k == "array"
    limits: dict[str, Callable] = {
        "minimum": lambda x: is_number & (number < x), "maximum": lambda x: is_number & (number > x), "exclusiveMinimum": lambda x: is_number & (number <= x), "exclusiveMaximum": lambda x: is_number & (number >= x),
        "multipleOf": lambda x: is_number & (number / x != F.floor(number / x)),
        "minLength": lambda x: is_text & (F.length(text) < x), "maxLength": lambda x: is_text & (F.length(text) > x), "pattern": lambda x: is_text & ~text.rlike(x),
        "minItems": lambda x: is_array & (F.size(elements) < x), "maxItems": lambda x: is_array & (F.size(elements) > x),
        "minProperties": lambda x: is_object & (F.size(members) < x), "maxProperties": lambda x: is_object & (F.size(members) > x),
        "uniqueItems": lambda x: is_array & (F.size(F.array_distinct(F.transform(elements, lambda e: F.to_json(e)))) < F.size(elements)) if x else F.lit(False),
    }
    out += [broken(rule, bad(schema[rule])) for rule, bad in limits.items() if rule in schema]
    prefix = f"{path}." if path else ""
    for name in schema.get("required") or []:
        out.append(F.when(is_object & _field(v, name).isNull(), f"{prefix}{name}: required"))
    for name, needs in (schema.get("dependentRequired") or {}).items():
        out += [F.when(is_object & _field(v, name).isNotNull() & _field(v, n).isNull(), f"{prefix}{n}: required") for n in needs]
    properties, by_pattern = schema.get("properties") or {}, schema.get("patternProperties") or {}
    out += [F.when(is_object, below(s, _field(v, name), f"{prefix}{name}")) for name, s in properties.items()]
    entries = F.when(is_object, F.map_entries(members))
    found = lambda keep, s, what: F.try_element_at(F.array_compact(F.transform(F.filter(entries, lambda e: keep(e["key"])), lambda e: F.when(below(s, e["value"], what).isNotNull(), F.concat(F.lit(prefix), e["key"], F.lit(f": {what}"))))), F.lit(1))
    for p, s in by_pattern.items():
        out.append(found(lambda key, p=p: key.rlike(p), s, "patternProperties"))
    if "additionalProperties" in schema and schema["additionalProperties"] is not True:
        def other(key: Column) -> Column:
            named = ~key.isin(*properties) if properties else F.lit(True)
            return functools.reduce(lambda a, p: a & ~key.rlike(p), by_pattern, named)

        out.append(found(other, schema["additionalProperties"], "additionalProperties"))
    if "propertyNames" in schema:
        out.append(broken("propertyNames", is_object & F.exists(F.map_keys(members), lambda n: below(schema["propertyNames"], F.try_parse_json(F.concat(F.lit('"'), F.regexp_replace(n, r'(["\\])', r"\\$1"), F.lit('"'))), path).isNotNull())))
    if "items" in schema:
        each = F.array_compact(F.transform(F.when(is_array, elements), lambda e: below(schema["items"], e, f"{path}[]")))
        out.append(F.try_element_at(each, F.lit(1)))
    if "contains" in schema:
        out.append(broken("contains", is_array & ~F.exists(elements, lambda e: below(schema["contains"], e, path).isNull())))
    out += [_rules(s, v, k, path, root) for s in schema.get("allOf") or []]
    if "anyOf" in schema:
        out.append(broken("anyOf", ~functools.reduce(lambda a, s: a | fits(s), schema["anyOf"], F.lit(False))))
    if "oneOf" in schema:
        out.append(broken("oneOf", sum((fits(s).cast("int") for s in schema["oneOf"]), F.lit(0)) != 1))
    if "not" in schema:
        out.append(broken("not", fits(schema["not"])))
    if "if" in schema:
        yes, no = schema.get("then", True), schema.get("else", True)
        out.append(F.when(fits(schema["if"]), _rules(yes, v, k, path, root)).otherwise(_rules(no, v, k, path, root)))
    return F.when(v.isNotNull(), _first(out))


#: The five ends of a check, by the code that a command-line validator gives.
OUTCOMES = {"ok": 0, "parse_error": 1, "violation": 2, "error": 3, "skipped": 4}


def outcome(schemas: dict[str, dict], type_: Column, raw: Column, whole: Callable[[dict], bool]) -> Column:
    """(outcome, detail) of an envelope's text: ok; parse_error where it is no JSON; violation with the rule; error where the
    channel's schema can't be compiled, which says nothing against the event; skipped where the channel has none.

    The text is parsed once, and only its own channel's rules are evaluated."""
    say = lambda what, detail=None: F.struct(F.lit(what).alias("outcome"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))

    def of(channel: str, v: Column) -> Column:
        try:
            rule = violation(schemas[channel], v if whole(schemas[channel]) else F.coalesce(_field(v, "data"), F.parse_json(F.lit("{}"))))
        except UnknownRule as e:
            return say("error", F.lit(str(e)))
        return let(rule, lambda r: F.when(r.isNull(), say("ok")).otherwise(say("violation", F.substring(r, 1, 500))))

    def judge(v: Column) -> Column:
        known = functools.reduce(lambda w, c: w.when(type_ == c, of(c, v)), sorted(schemas), F.when(v.isNull(), say("parse_error")))
        return known.otherwise(say("skipped"))

    return let(F.try_parse_json(raw), judge)
