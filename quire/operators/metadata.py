"""Metadata of a document: found values, keywords and the fields of its class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.dims import Taxonomy, class_schema
from quire.functions import extract as X
from quire.functions.model_json import clean_json, merged_keywords, metatags
from quire.functions.text import is_blank, let
from quire.operators.pages import last_of, ordered

HEURISTIC_FIELDS = ["Date", "Year", "Assembly", "Session", "Bulletin Parts"]
SCHEMA_TYPE = "array<struct<name:string,type:string,options:array<string>>>"


def schema_by_class(docs: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """``(doc_class, class_schema)``: fields in order. Taxonomy-sized."""
    fields = class_schema(docs.sparkSession, taxonomy)
    packed = F.array_sort(F.collect_list(F.struct("field_pos", "name", "type", "options")))
    return fields.groupBy("doc_class").agg(
        F.transform(packed, lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"), f["options"].alias("options")))
        .cast(SCHEMA_TYPE)
        .alias("class_schema")
    )


def with_class_schema(docs: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Adds ``class_schema``; null for a class that has none."""
    return docs.join(F.broadcast(schema_by_class(docs, taxonomy)), "doc_class", "left")


def document_schema_fields(docs: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """One row per document and field of its class; documents of other classes give none."""
    return docs.join(F.broadcast(class_schema(docs.sparkSession, taxonomy)), "doc_class")


def top_keywords(docs: DataFrame, keys: Sequence[str], text: str, n: int = X.TOP_KEYWORDS) -> DataFrame:
    """Most frequent capitalised words per document: ``(keys, rank, term, n, first_pos)``.

    Ties go to the word that appears first. Counts are combined before the shuffle,
    and the rank limit is applied on both sides of it.
    """
    words = docs.select(*keys, F.posexplode_outer(X.keyword_tokens(F.col(text))).alias("pos", "term")).where("term is not null")
    counted = words.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_pos")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def keyword_list(text: Column, n: int = X.TOP_KEYWORDS) -> Column:
    """The same top list inside the row, as an array: no shuffle for whole-record extraction.

    Words are sorted once with their positions; each run of a word gives its count and
    first position, and the runs are ranked.
    """

    def ranked(words: Column) -> Column:
        last = F.size(words) - 1
        starts = F.when(
            last >= 0,
            F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(words, i)["term"] != F.get(words, i - 1)["term"])),
        ).otherwise(F.array().cast("array<int>"))

        def runs(at: Column) -> Column:
            ends = F.slice(F.concat(at, F.array(F.size(words))), F.lit(2), F.greatest(F.size(at), F.lit(1)))
            return F.zip_with(
                at,
                ends,
                lambda a, b: F.struct(
                    (a - b).alias("less"), F.get(words, a)["pos"].alias("pos"), F.get(words, a)["term"].alias("term")
                ),
            )

        best = F.slice(F.sort_array(let(starts, runs)), 1, n)
        return F.filter(F.transform(best, lambda k: k["term"]), lambda t: t.isNotNull())

    tagged = F.transform(X.keyword_tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return let(F.sort_array(tagged), ranked)


def class_fields(text: Column, doc_class: Column, taxonomy: Taxonomy | None = None, head_chars: int | None = None) -> Column:
    """Pattern-only class fields as a map; only fields the class has and the text gives.

    The whole text is read, or its first ``head_chars`` characters (``extract.HEAD_CHARS`` as published).
    """
    t = taxonomy or Taxonomy()
    head = F.left(text, F.lit(head_chars)) if head_chars else text
    entries = []
    for name in HEURISTIC_FIELDS:
        owners = [c for c, fields in t.schema.items() if any(f[0] == name for f in fields)]
        value = F.when(doc_class.isin(owners), X.heuristic_field(name, head))
        entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def coerce_answer(raw: Column, schema: Column, strict: bool = False) -> Column:
    """A model's JSON answer as class fields; null when nothing usable is in it."""

    def fields_of(given: Column) -> Column:
        return F.transform(
            schema,
            lambda f: F.struct(
                f["name"].alias("key"),
                let(
                    F.try_element_at(given, f["name"]), lambda v: X.coerce_field(v, f["type"], f["options"], strict)
                ).alias("value"),
            ),
        )

    entries = let(F.from_json(let(raw, clean_json), "map<string,string>"), fields_of)
    found = let(F.filter(entries, lambda e: e["value"].isNotNull()), F.map_from_entries)
    return let(found, lambda m: F.when(F.size(m) > 0, m))


def extract_metadata(
    docs: DataFrame, text: str, doc_class: str = "doc_class", answer: str | None = None, tags: str | None = None,
    taxonomy: Taxonomy | None = None,
) -> DataFrame:
    """Adds ``index_metadata``, everything found in one pass over the text.

    ``answer`` and ``tags`` name columns with a model's JSON for class fields and for
    tags; both fall back to the pattern-only result.
    """
    t = taxonomy or Taxonomy()
    c = F.coalesce(F.col(text), F.lit(""))
    empty = c == ""
    strings = F.array().cast("array<string>")
    label = F.nullif(F.col(doc_class), F.lit(""))

    def found(values: Column) -> Column:
        return F.when(empty, strings).otherwise(values)

    prepared = with_class_schema(docs.withColumnRenamed(doc_class, "doc_class"), t)
    known = F.col("class_schema").isNotNull()
    heuristic = class_fields(c, F.col("doc_class"), t)
    fields = F.coalesce(coerce_answer(F.col(answer), F.col("class_schema")), heuristic) if answer else heuristic
    words = keyword_list(c)
    tag_struct = metatags(F.col(tags)) if tags else None
    no_fields = F.create_map().cast("map<string,string>")
    meta = F.struct(
        found(X.emails(c)).alias("emails"),
        found(X.phones(c)).alias("phones"),
        found(X.urls(c)).alias("urls"),
        found(X.amounts(c)).alias("amounts"),
        F.when(empty, F.array().cast("array<struct<raw:string,iso:string>>")).otherwise(X.dates(c)).alias("dates"),
        found(X.identifiers(c)).alias("identifiers"),
        found(merged_keywords(words, tag_struct["suggested_keywords"]) if tags else words).alias("keywords"),
        F.when(label.isNotNull() & (empty | known), label).alias("doc_class"),
        F.when(label.isNotNull() & empty, F.coalesce("class_schema", F.array().cast(SCHEMA_TYPE)))
        .when(known & ~empty, F.col("class_schema"))
        .alias("class_schema"),
        F.when(label.isNotNull() & empty, no_fields).when(known & ~empty, fields).alias("class_fields"),
        *([F.when(~empty, tag_struct).alias("metatags")] if tags else []),
    )
    return prepared.withColumn("index_metadata", meta).drop("class_schema")


def correct_metadata(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """A correction replaces the whole metadata, the last one by ``seq`` of several; empty field values are dropped from it."""
    cleaned = last_of(ordered(corrections, "document_id", "index_metadata"), ["document_id"]).select(
        "document_id",
        F.col("index_metadata")
        .withField(
            "class_fields", F.map_filter(F.col("index_metadata.class_fields"), lambda _, v: F.coalesce(v, F.lit("")) != "")
        )
        .alias("__new"),
        F.lit(True).alias("__hit"),
    )
    names = docs.schema["index_metadata"].dataType.names
    if cleaned.schema["__new"].dataType.names != names:
        corrected = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("index_metadata"))
    else:
        # Each field on its own, so that fields that nobody reads go neither through the join nor are they made.
        pick = lambda new, old: F.when(F.col("__hit"), new).otherwise(old)
        corrected = F.when(pick(F.col("__new").isNotNull(), F.col("index_metadata").isNotNull()), F.struct(*[F.lit(None).alias(c) for c in names]))
        for c in names:
            corrected = corrected.withField(f"`{c}`", pick(F.col("__new")[c], F.col("index_metadata")[c]))
    return docs.join(cleaned, "document_id", "left").withColumn("index_metadata", corrected).drop("__new", "__hit")


def completion(schema: Column, fields: Column) -> Column:
    """``struct<filled, total, pct, missing>`` of a class form; missing names in schema order."""
    names = F.transform(F.coalesce(schema, F.array().cast(SCHEMA_TYPE)), lambda f: f["name"])
    values = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    missing = F.filter(names, lambda n: is_blank(F.try_element_at(values, n)))
    total = F.size(names)
    filled = total - F.size(missing)
    pct = F.when(total == 0, 0).otherwise(F.round(F.try_divide(filled * 100, total)).cast("int"))
    return F.struct(filled.alias("filled"), total.alias("total"), pct.alias("pct"), missing.alias("missing"))


def missing_fields(schema_names: Column, filled_names: Column) -> Column:
    return F.array_except(schema_names, filled_names)


