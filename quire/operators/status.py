"""Readings of document and page state for dashboards and review panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.dims import STAGES
from quire.functions.cer import cer_preview
from quire.functions.text import is_blank, page_prefix
from quire.operators.pages import PAGE_KEY, split_marked_pages
from quire.operators.review import stage_position
from quire.operators.skew import salted_left_join


def status_tiles(docs: DataFrame) -> DataFrame:
    """Counts for the dashboard tiles, one row."""
    return docs.agg(
        F.count_if(F.col("status") == "qc_pending").alias("qc"),
        F.count_if(F.col("status") == "completed").alias("done"),
        F.count_if(F.col("status") == "processing").alias("run"),
        F.count(F.lit(1)).alias("total"),
    )


def progress_pct(stage: Column, status: Column) -> Column:
    """Share of the stages passed, in percent; half a stage for one waiting for review."""
    pos = F.coalesce(stage_position(stage), F.lit(-1))
    half = F.when(status == "qc_pending", 0.5).otherwise(0.0)
    part = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (pos + half) / len(STAGES) * 100))
    return F.when(status == "completed", 100.0).otherwise(part)


def _filled(c: str) -> Column:
    return ~is_blank(F.col(c))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def stage_completion(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Six booleans per page: whether each stage is done for it.

    Pages of multi-page documents use their own columns, a single page also its
    document's; the index stage is the document's alone. Document facts are reduced to
    flags before the join.
    """
    flags = docs.select(
        "document_id",
        _given("enhanced_path").alias("__d_enhancement"),
        (_filled("raw_ocr") | _filled("corrected_ocr")).alias("__d_ocr"),
        _filled("doc_class").alias("__d_doc_class"),
        F.coalesce(F.col("metadata_keys") > 0, F.lit(False)).alias("__d_index_genius"),
        (_filled("abstract") | _filled("corrected_abstract")).alias("__d_abstractor"),
        _filled("translation").alias("__d_lingua"),
    )
    counts = pages.groupBy("document_id").agg((F.count(F.lit(1)) > 1).alias("__multi"))
    page_flags = pages.select(
        *PAGE_KEY,
        _given("enhanced_path").alias("enhancement"),
        (_filled("ocr_text") | _filled("corrected_ocr_text")).alias("ocr"),
        _filled("page_doc_class").alias("doc_class"),
        (_filled("page_abstract") | _filled("corrected_page_abstract")).alias("abstractor"),
        _filled("page_translation").alias("lingua"),
    )
    joined = salted_left_join(page_flags, flags.join(counts, "document_id"), ["document_id"], ["page_index"])
    return joined.select(
        *PAGE_KEY,
        *[
            F.col("__d_index_genius").alias(s) if s == "index_genius" else (F.col(s) | (~F.col("__multi") & F.col(f"__d_{s}"))).alias(s)
            for s in STAGES
        ],
    )


def enhancement_ready(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether a document and all its pages have an enhanced file and a post score."""
    every = pages.groupBy("document_id").agg(
        F.bool_and(F.col("post_qs").isNotNull() & (F.coalesce("enhanced_path", F.lit("")) != "")).alias("__all")
    )
    ready = _given("enhanced_path") & F.col("post_qs").isNotNull() & F.coalesce("__all", F.lit(True))
    return docs.join(every, "document_id", "left").select("document_id", ready.alias("ready"))


def page_qs_display(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores shown for a page: its own, else its metric's, else (single or first page) the document's."""
    counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("__n"), F.min("page_index").alias("__first"))
    facts = docs.select("document_id", F.col("initial_qs").alias("__di"), F.col("post_qs").alias("__dp")).join(counts, "document_id")
    joined = salted_left_join(pages, facts, ["document_id"], ["page_index"])
    from_doc = (F.col("__n") == 1) | (F.col("page_index") == F.col("__first"))
    initial = F.coalesce("initial_qs", "metric_qs", F.when(from_doc, F.col("__di")))
    post = F.coalesce("post_qs", "post_metric_qs", F.when(from_doc, F.col("__dp")))
    band = F.when(post >= 90, "high").when(post >= 60, "mid").otherwise("low")
    return joined.select(*PAGE_KEY, initial.alias("initial"), post.alias("post"), (post - initial).alias("delta"), band.alias("band"))


def ocr_cer_display(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Error rate shown per page: correction against the model text, which falls back to the raw slice."""
    slices = split_marked_pages(docs.where("raw_ocr is not null"), "raw_ocr", out="__slice")
    model = F.when(~is_blank(F.col("ocr_text")), F.col("ocr_text")).otherwise(F.coalesce("__slice", F.lit("")))
    return pages.join(slices, PAGE_KEY, "left").select(*PAGE_KEY, cer_preview(F.col("corrected_ocr_text"), model).alias("cer"))


def document_cer_display(corrected: Column, raw: Column, stored: Column) -> Column:
    return F.when(raw.isNull(), F.lit(None)).otherwise(F.coalesce(stored, cer_preview(corrected, raw)))


def abstract_cer_display(corrected: Column, model: Column) -> Column:
    return F.when(~is_blank(model), cer_preview(corrected, model))


def event_progress(default_target: float = 95.0) -> Column:
    """Percent for a progress event; the same expression serves tables and streams."""

    def half_up(c: Column) -> Column:
        return F.floor(c + 0.5)

    target = F.greatest(F.coalesce("target_qs", F.lit(default_target)), F.lit(1.0))
    best = F.coalesce("best_qs", F.lit(0.0))
    band = F.col("pass") / F.greatest(F.lit(1), F.col("max_passes")) * 58
    in_pass = F.least(F.lit(93), half_up(7 + band + F.least(F.lit(28.0), best / target * 28)))
    in_try = F.least(F.lit(96), half_up(88 + best / target * 8))
    phase = F.col("phase")
    return (
        F.when(phase == "start", 5)
        .when(phase == "pass", in_pass)
        .when(phase.isin("polish", "polish_pass"), 91)
        .when(phase == "escalation", 92)
        .when(phase == "escalation_try", in_try)
        .when(phase == "write", 97)
        .when(phase.isin("page_complete", "document"), 100)
        .otherwise(50)
        .cast("int")
    )


def event_label() -> Column:
    """Short label of a progress event, with the page prefix for multi-page runs."""
    phase = F.col("phase")
    words = (
        F.when(phase == "start", "Starting")
        .when(phase == "pass", F.concat(F.lit("Pass "), F.col("pass").cast("string"), F.lit("/"), F.col("max_passes").cast("string")))
        .when(phase.isin("polish", "polish_pass"), "Polishing toward SOP")
        .when(phase == "escalation", F.coalesce("message", F.lit("SOP recovery…")))
        .when(phase == "escalation_try", F.coalesce("label", F.lit("try")))
        .when(phase == "write", "Saving enhanced image…")
        .when(phase == "document", "SOP run complete")
        .otherwise("Enhancing…")
    )
    return F.concat(page_prefix(F.col("page_index"), F.col("page_total")), words)
