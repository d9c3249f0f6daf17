"""Validation of JSON documents by a JSON Schema: the schema becomes one column expression, compiled once.

Understood: type, properties, required, enum, minLength, maxLength, minItems, maxItems, items (with any of these),
minimum, maximum. A fault is ``path: word``; parts of a list are ``path[]``, and a fault there is told once however many
parts have it. What is absent (or JSON null) breaks ``required`` alone, and only where the part around it is an object.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How Spark names the kinds of JSON values.
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",)}
#: Order of faults: all of the first word, then all of the next.
ORDER = ("required", "type", "value", "length", "items", "parts", "range")
Check = tuple[str, int, str, Column]
#: What is read of a document: from a JSON path and ``kind`` or a type to its column.
Get = Callable[[str, str], Column]


def read_schema(spark: SparkSession, path: str) -> dict:
    """A JSON Schema file; a document, not a table."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _is(kind: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | kind.startswith(n)
    return F.coalesce(out, F.lit(False))


def _reader(doc: Column) -> Get:
    return lambda at, what: F.schema_of_variant(F.try_variant_get(doc, at, "variant")) if what == "kind" else F.try_variant_get(doc, at, what)


def _checks(get: Get, schema: dict, path: str, at: str) -> list[Check]:
    """word, depth, fault and test (true: it is broken) of a part of the document and all below it. at: its JSON path."""
    kind = get(at, "kind")
    there = F.coalesce(kind != "VOID", F.lit(False))
    depth, out = at.count("."), []

    def fault(word: str, broken: Column, name: str = "") -> None:
        out.append((word, depth + (word == "required"), f"{name or path or '(root)'}: {'value' if word == 'parts' else word}", there & broken))

    for name in schema.get("required", []):
        inner = get(f"{at}.{name}", "kind")
        fault("required", _is(kind, "OBJECT") & ~F.coalesce(inner != "VOID", F.lit(False)), f"{path}.{name}" if path else name)
    if "type" in schema:
        fault("type", ~_is(kind, *KINDS[schema["type"]]))
    if "enum" in schema:
        fault("value", ~(_is(kind, "STRING") & get(at, "string").isin(schema["enum"])))
    if "minLength" in schema or "maxLength" in schema:
        fault("length", ~(_is(kind, "STRING") & F.char_length(get(at, "string")).between(schema.get("minLength", 0), schema.get("maxLength", 2**31 - 1))))
    if "minItems" in schema or "maxItems" in schema:
        fault("items", ~(_is(kind, "ARRAY") & F.size(get(at, "array<variant>")).between(schema.get("minItems", 0), schema.get("maxItems", 2**31 - 1))))
    whole = _is(kind, "BIGINT", "DECIMAL", "DOUBLE")
    if "minimum" in schema:
        fault("range", ~(whole & (get(at, "double") >= schema["minimum"])))
    if "maximum" in schema:
        fault("range", ~(whole & (get(at, "double") <= schema["maximum"])))
    items = schema.get("items")
    if items is not None and set(items) == {"enum"}:  # a list of words has one fault of its own
        words = get(at, "array<string>")
        fault("parts", _is(kind, "ARRAY") & ~F.forall(words, lambda x: F.coalesce(x.isin(items["enum"]), F.lit(False))))
    elif items is not None:
        inside = lambda x: _checks(_reader(x), items, f"{path}[]", "$")
        nth = lambda i: lambda x: inside(x)[i][3]
        for i, (word, below, name, _) in enumerate(inside(F.lit(None))):
            out.append((word, depth + below + 1, name, there & _is(kind, "ARRAY") & F.exists(get(at, "array<variant>"), nth(i))))
    for name, inner in schema.get("properties", {}).items():
        out += _checks(get, inner, f"{path}.{name}" if path else name, f"{at}.{name}")
    return out


def compiled(schema: dict) -> Callable[[Column], Column]:
    """From a text column (JSON) to its faults: by word, the outer parts' missing ones first; a text that isn't an object has the one fault ``(root): object``."""

    asked: dict[tuple[str, str], str] = {}

    def note(at: str, what: str) -> Column:
        asked.setdefault((at, what), f"p{len(asked)}")
        return F.lit(None)

    _checks(note, schema, "", "$")

    def faults(read: Column) -> Column:
        found = _checks(lambda at, what: read[asked[at, what]], schema, "", "$")
        found.sort(key=lambda c: (ORDER.index(c[0]), c[1] if c[0] == "required" else 0))  # stable: else as the schema has them
        root = F.coalesce(read[asked["$", "kind"]].startswith("OBJECT"), F.lit(False))
        return F.when(root, F.array_compact(F.array(*[F.when(t, F.lit(n)) for *_, n, t in found], F.lit(None).cast("string")))).otherwise(F.array(F.lit("(root): object")))

    def parts(doc: Column) -> Column:
        return F.struct(*[_reader(doc)(at, what).alias(name) for (at, what), name in asked.items()])

    # The lambdas bind the parsed document and what is read of it, so it is parsed once and each part read once.
    return lambda text: F.transform(F.transform(F.array(F.try_parse_json(text)), parts), faults)[0]
