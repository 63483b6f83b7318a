"""Expressions that read structure out of model output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerleaf.functions.text import strip

# Strict JSON: what a standard JSON parser rejects is rejected here too.
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
_STRUCTURED = "intent string, slots map<string,string>, tool_plan array<string>, expression string"


def outer_object(text: Column) -> Column:
    """The part from the first ``{`` to the last ``}``."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parse_structured(text: Column) -> Column:
    """``struct<intent, slots, tool_plan, expression>``; unreadable text gives empty parts."""
    raw = F.from_json(outer_object(text), F.lit("map<string,string>"), _STRICT)
    slots = F.from_json(raw["slots"], F.lit("map<string,string>"), _STRICT)
    plan = F.from_json(raw["tool_plan"], F.lit("array<string>"), _STRICT)
    return F.struct(
        raw["intent"].alias("intent"),
        F.coalesce(slots, F.create_map().cast("map<string,string>")).alias("slots"),
        F.when(raw["tool_plan"].startswith("["), plan).otherwise(F.array().cast("array<string>")).alias("tool_plan"),
        F.coalesce(raw["expression"], F.lit("")).alias("expression"),
    )


def _key_value_lines(pairs: Column) -> Column:
    return F.array_join(
        F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))),
        "\n",
    )


def strip_json_fence(text: Column) -> Column:
    """Readable text from a fenced or bare JSON answer; other text comes back trimmed."""
    trimmed = strip(text)
    fence = r"(?s)```(?:json|JSON)?\s*\n?(.*?)```"
    body = F.when(trimmed.rlike(fence), strip(F.regexp_extract(trimmed, fence, 1))).otherwise(trimmed)
    obj = F.when(body.startswith("{"), F.from_json(body, F.lit("map<string,string>"), _STRICT))
    items = F.when(body.startswith("["), F.from_json(body, F.lit("array<string>"), _STRICT))
    item_lines = F.transform(
        items,
        lambda item: F.when(
            item.startswith("{"), _key_value_lines(F.from_json(item, F.lit("map<string,string>"), _STRICT))
        ).otherwise(item),
    )
    listed = F.array_join(F.filter(item_lines, lambda line: line != ""), "\n")
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(""))
        .when(F.length(obj["expression"]) > 3, obj["expression"])
        .when(F.size(obj) > 0, _key_value_lines(obj))
        .when(F.size(obj) == 0, text)
        .when(items.isNotNull() & (listed != ""), listed)
        .when(items.isNotNull(), text)
        .otherwise(body)
    )


_THINK = r"(?s)<think>(.*?)</think>(.*)"


def split_think(response: Column) -> Column:
    """``struct<thinking, output>`` of a response with an optional think block."""
    found = response.rlike(_THINK)
    thinking = F.when(found, strip(F.regexp_extract(response, _THINK, 1))).otherwise(F.lit(""))
    output = F.when(found, strip(F.regexp_extract(response, _THINK, 2))).otherwise(strip(response))
    return F.struct(thinking.alias("thinking"), output.alias("output"))
