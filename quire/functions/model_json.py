"""Reading JSON answers of outside models from a table column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let, non_empty, strip_ws


def _is_object(c: Column) -> Column:
    return c.startswith("{") & F.try_parse_json(c).isNotNull()


def clean_json(raw: Column) -> Column:
    """The answer as JSON object text: as given, else without code fence and ``json`` tag, else null."""

    def untagged(inner: Column) -> Column:
        tail = strip_ws(F.substring(inner, 5, 2**31 - 1))
        return F.when(F.lower(F.left(inner, F.lit(4))) == "json", tail).otherwise(inner)

    def read(bare: Column) -> Column:
        inner = strip_ws(F.regexp_replace(bare, "^`+|`+$", ""))
        unfenced = F.when(bare.startswith("```"), let(inner, untagged))
        return F.when(_is_object(bare), bare).otherwise(let(unfenced, lambda u: F.when(_is_object(u), u)))

    return let(strip_ws(raw), read)


def typed_field(raw: Column, path: str, kind: str, type_prefix: str) -> Column:
    """Field of the answer cast to ``kind``, only when the JSON type starts with ``type_prefix``."""

    def pick(v: Column) -> Column:
        held = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(held.startswith(type_prefix), F.try_variant_get(v, path, kind))

    return let(F.try_parse_json(clean_json(raw)), pick)


def summary_answer(raw: Column) -> Column:
    """The ``summary`` string, trimmed; empty when absent or of another type."""
    return F.coalesce(strip_ws(typed_field(raw, "$.summary", "string", "STRING")), F.lit(""))


def metatags(raw: Column) -> Column:
    """Struct of topics, entities and suggested keywords; each only when an array; null when none is."""
    topics = typed_field(raw, "$.topics", "array<string>", "ARRAY")
    entities = typed_field(raw, "$.entities", "array<struct<name:string,type:string>>", "ARRAY")
    keywords = typed_field(raw, "$.suggested_keywords", "array<string>", "ARRAY")
    found = F.struct(topics.alias("topics"), entities.alias("entities"), keywords.alias("suggested_keywords"))
    return let(found, lambda t: F.when(t["topics"].isNotNull() | t["entities"].isNotNull() | t["suggested_keywords"].isNotNull(), t))


def merged_keywords(found: Column, suggested: Column) -> Column:
    """Found keywords then suggested ones, first occurrence kept, at most 16."""
    extra = F.filter(F.coalesce(suggested, F.array().cast("array<string>")), lambda k: non_empty(k).isNotNull())
    return F.when(F.size(extra) > 0, F.slice(F.array_distinct(F.concat(found, extra)), 1, 16)).otherwise(found)
