"""JSON inside text as VARIANT: replies of a judge, tool calls, documents of known gaps; null where it is no JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document(text: Column) -> Column:
    """A whole text as VARIANT; null where it is null, blank or no JSON. Never fails."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str) -> Column:
    """The value at a path ($.a.b, $.a[0]) as kind; null where it isn't there or can't be cast."""
    return F.try_variant_get(value, f"${path}", kind)


def judge_reply(text: Column, fields: dict[str, str]) -> Column:
    """Judge JSON parse: struct of fields (name: kind) of the widest {...} of a reply; null where that is no JSON object."""
    found = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    return F.when(found.isNotNull(), F.struct(*(field(found, f".{name}", kind).alias(name) for name, kind in fields.items())))


def tool_call(text: Column) -> Column:
    """Tool-call parse: struct(tool, args) of the first {...} of a text, braces one level deep inside; args is a VARIANT.

    Null where that is no JSON or has no tool name that is text.
    """
    body = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{(?:[^{}]|\{[^{}]*\})*\}", 0), F.lit("")))
    tool = F.when(F.schema_of_variant(F.try_variant_get(body, "$.tool", "variant")) == "STRING", field(body, ".tool", "string"))
    return F.when(tool.isNotNull(), F.struct(tool.alias("tool"), F.try_variant_get(body, "$.args", "variant").alias("args")))


def known_gaps(doc: Column) -> Column:
    """Known-gap list of a document of coverage: its array `gaps` as an array of VARIANT; empty where there is none."""
    return F.coalesce(field(doc, ".gaps", "array<variant>"), F.array().cast("array<variant>"))
