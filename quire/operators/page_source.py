"""Which text a page or document contributes to each later step.

The fall-back orders differ by step, and so does what counts as missing (null,
empty, or blank), so each chain is spelled out on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import first_filled, is_blank, stripped_or_null
from quire.operators.pages import PAGE_KEY, split_marked_texts

NO_TEXT = "no_ocr_text"


def _with_slices(pages: DataFrame, docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Pages with their slice of each given document text as extra columns.

    Slices travel keyed by document *and* page, so a document with very many pages spreads over tasks. All texts are split in
    one pass over the documents and meet the pages in one join.
    """
    return pages.join(split_marked_texts(docs, columns), PAGE_KEY, "left")


def page_text(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``page_text``, the classifier's text: English first, page row before document slice.

    A corrected value of only blanks hides the raw value and then trims to nothing,
    so the chain moves to the next level, not to the raw text.
    """
    slices = {
        "__en_slice": first_filled(F.col("corrected_ocr_english"), F.col("raw_ocr_english")),
        "__native_slice": first_filled(F.col("corrected_ocr"), F.col("raw_ocr")),
    }
    text = F.coalesce(
        stripped_or_null(first_filled(F.col("corrected_ocr_text_english"), F.col("ocr_text_english"))),
        stripped_or_null(F.col("__en_slice")),
        stripped_or_null(first_filled(F.col("corrected_ocr_text"), F.col("ocr_text"))),
        stripped_or_null(F.col("__native_slice")),
        F.lit(""),
    )
    return _with_slices(pages, docs, slices).withColumn("page_text", text).drop(*slices)


def page_row_text(pages: DataFrame) -> DataFrame:
    """``page_text`` from the page rows alone, for tables whose documents carry no text."""
    text = F.coalesce(
        stripped_or_null(first_filled(F.col("corrected_ocr_text_english"), F.col("ocr_text_english"))),
        stripped_or_null(first_filled(F.col("corrected_ocr_text"), F.col("ocr_text"))),
        F.lit(""),
    )
    return pages.withColumn("page_text", text)


def translate_source(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``translate_source``: page abstract, page text, then slices of the document's."""
    fields = ["corrected_abstract", "abstract", "corrected_ocr", "raw_ocr"]
    slices = {f"__{f}": F.col(f) for f in fields}
    text = F.coalesce(
        stripped_or_null(first_filled(F.col("corrected_page_abstract"), F.col("page_abstract"))),
        stripped_or_null(first_filled(F.col("corrected_ocr_text"), F.col("ocr_text"))),
        *[stripped_or_null(F.col(f"__{f}")) for f in fields],
        F.lit(""),
    )
    return _with_slices(pages, docs, slices).withColumn("translate_source", text).drop(*slices)


def document_text() -> Column:
    """Text of a document without page rows; not trimmed."""
    return F.coalesce(
        first_filled(
            F.col("corrected_ocr_english"), F.col("raw_ocr_english"), F.col("corrected_ocr"), F.col("raw_ocr")
        ),
        F.lit(""),
    )


def summary_source() -> Column:
    return F.coalesce(first_filled(F.col("corrected_ocr"), F.col("raw_ocr")), F.lit(""))


def lingua_source() -> Column:
    return F.coalesce(
        first_filled(F.col("corrected_abstract"), F.col("abstract"), F.col("corrected_ocr"), F.col("raw_ocr")),
        F.lit(""),
    )


def lingua_preview_source() -> Column:
    """What the translation panel shows as its source (not what is translated)."""
    return F.coalesce(
        first_filled(
            F.col("corrected_overall_abstract"),
            F.col("overall_abstract"),
            F.col("corrected_abstract"),
            F.col("abstract"),
            F.col("corrected_ocr_english"),
            F.col("raw_ocr_english"),
            F.col("corrected_ocr"),
            F.col("raw_ocr"),
        ),
        F.lit(""),
    )


_EDITOR = {
    "ocr": (("corrected_ocr_text", "ocr_text"), ("corrected_ocr",)),
    "english": (("corrected_ocr_text_english", "ocr_text_english"), ("corrected_ocr_english", "raw_ocr_english")),
    "abstract": (("corrected_page_abstract", "page_abstract"), ("corrected_abstract", "abstract")),
}


def editor_page_text(docs: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """Adds ``editor_text``: what a reviewer sees for the page.

    The row value is the first non-null one, used unless blank; then the slices. The
    page shown comes as stored, untrimmed.
    """
    row_fields, doc_fields = _EDITOR[kind]
    slices = {f"__{f}": F.col(f) for f in doc_fields}
    row_value = F.coalesce(*[F.col(f) for f in row_fields])
    text = F.when(~is_blank(row_value), row_value).otherwise(
        F.coalesce(*[F.col(f"__{f}") for f in doc_fields], F.lit(""))
    )
    return _with_slices(pages, docs, slices).withColumn("editor_text", text).drop(*slices)


def skip_without_text(pages: DataFrame, text: str = "page_text") -> DataFrame:
    """Adds ``skipped`` and ``reason`` for pages that have no text."""
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    return pages.withColumn("skipped", empty).withColumn("reason", F.when(empty, F.lit(NO_TEXT)))


def documents_without_text(pages: DataFrame, text: str = "page_text") -> DataFrame:
    """Documents of which no page has text: the ones a step must refuse."""
    has_text = F.bool_or(F.coalesce(F.col(text), F.lit("")) != "")
    return pages.groupBy("document_id").agg(has_text.alias("has_text")).where(~F.col("has_text")).select("document_id")


def documents_with_text(pages: DataFrame, docs: DataFrame, text: str = "page_text") -> DataFrame:
    """Semi join: documents with at least one page that has text."""
    keep = pages.where(F.coalesce(F.col(text), F.lit("")) != "").select("document_id").distinct()
    return docs.join(keep, "document_id", "left_semi")
