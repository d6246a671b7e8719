"""Review corrections and stage state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.dims import STAGE_STATUS_FINISHED, STAGES
from quire.functions.cer import cer, cer_percent
from quire.functions.text import strip_ws
from quire.operators.pages import PAGE_KEY, fold_volumes, join_marked_pages, last_of, ordered, split_marked_pages


def stage_position(stage: Column) -> Column:
    """0-based position of a stage; null when unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0)) - 1


def normalize_stage(stage: Column) -> Column:
    name = F.lower(strip_ws(stage))
    return F.when(name.isin(STAGES), name)


def clamp_target_qs(target: Column, low: float = 80.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), target))


def successor(stage: Column) -> Column:
    """Next stage; null for the last and for unknown ones."""
    following = F.array(*[F.lit(s) for s in STAGES[1:]])
    return F.get(following, stage_position(stage).cast("int"))


def advance(docs: DataFrame) -> DataFrame:
    """Every document to its next stage, pending; the last stage completes; unknown stages stay as they are."""
    known = stage_position(F.col("current_stage")).isNotNull()
    nxt = successor(F.col("current_stage"))
    status = F.when(~known, F.col("status")).when(nxt.isNull(), F.lit("completed")).otherwise(F.lit("pending"))
    return docs.withColumn("status", F.coalesce(status, F.col("status"))).withColumn(
        "current_stage", F.coalesce(nxt, F.col("current_stage"))
    )


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    marks = ids.select("document_id").distinct().withColumn("__hit", F.lit(True))
    return docs.join(marks, "document_id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def approve(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Advance the listed documents. Adds no stage run."""
    columns = docs.columns
    known = stage_position(F.col("current_stage")).isNotNull()
    nxt = successor(F.col("current_stage"))
    act = F.col("__hit") & F.coalesce(known, F.lit(False))
    status = F.when(act, F.when(nxt.isNull(), F.lit("completed")).otherwise(F.lit("pending"))).otherwise(F.col("status"))
    stage = F.when(act, F.coalesce(nxt, F.col("current_stage"))).otherwise(F.col("current_stage"))
    return _chosen(docs, ids).withColumns({"status": status, "current_stage": stage}).select(*columns)


def reject(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Send the listed documents back to pending on the same stage. Adds no stage run."""
    status = F.when(F.col("__hit"), F.lit("pending")).otherwise(F.col("status"))
    return _chosen(docs, ids).withColumn("status", status).select(*docs.columns)


def stage_runs_for(docs: DataFrame, stage: str, status: str, now: Column, payload: Column | None = None) -> DataFrame:
    """Stage run rows to append: finished only for the three closing statuses."""
    return docs.select(
        "document_id",
        F.lit(stage).alias("stage"),
        F.lit(status).alias("status"),
        (payload if payload is not None else F.lit(None)).cast("string").alias("payload"),
        now.alias("started_at"),
        finished_at(F.lit(status), now).alias("finished_at"),
    )


def finished_at(status: Column, now: Column) -> Column:
    return F.when(status.isin(STAGE_STATUS_FINISHED), now)


def complete_stage(docs: DataFrame, stage: str, now: Column, payload: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents waiting for review after a stage, and the stage runs to append."""
    return docs.withColumn("status", F.lit("qc_pending")), stage_runs_for(docs, stage, "qc_pending", now, payload)


def last_given(requests: DataFrame, column: str) -> DataFrame:
    """``document_id`` and the last value that was given for a column."""
    return last_of(ordered(requests.where(F.col(column).isNotNull()), "document_id", column), ["document_id"])


def apply_page_patches(pages: DataFrame, patches: DataFrame, column: str) -> DataFrame:
    """Patch one text column by page. A patch wins even when empty, the last one by ``seq`` of several; unmatched ones are ignored."""
    new = last_of(ordered(patches, *PAGE_KEY, column), PAGE_KEY).select(*PAGE_KEY, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return pages.join(new, PAGE_KEY, "left").withColumn(
        column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))
    ).drop("__new", "__hit")


def apply_split_text(pages: DataFrame, texts: DataFrame, text: str, column: str) -> DataFrame:
    """Spread a page-marked text over the pages; a page it does not name keeps its value."""
    named = last_given(texts, text).withColumnRenamed(text, "__text")
    return apply_page_patches(pages, split_marked_pages(named, "__text", out=column), column)


def rejoined(pages: DataFrame, column: str, docs_touched: DataFrame, out: str) -> DataFrame:
    """Marked text cell of the touched documents, from all their pages."""
    touched = pages.join(docs_touched.select("document_id").distinct(), "document_id", "left_semi")
    return fold_volumes(join_marked_pages(touched, column, out=out), out)


def correct_class(
    docs: DataFrame, pages: DataFrame, corrections: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Class corrections ``(document_id, page_index?, doc_class)`` to pages and documents.

    With a page, that page is set and the document takes its first page's class and
    scores; without, only the document's class is set. Labels are free text.
    """
    by_page = last_of(ordered(corrections.where("page_index is not null"), *PAGE_KEY, "doc_class"), PAGE_KEY).withColumnRenamed("doc_class", "page_doc_class")
    new_pages = apply_page_patches(pages, by_page, "page_doc_class")
    # A page that does not exist changes nothing.
    effective = by_page.select(*PAGE_KEY).join(pages.select(*PAGE_KEY), PAGE_KEY, "left_semi").select("document_id").distinct()
    first = new_pages.join(effective, "document_id", "left_semi").groupBy("document_id").agg(
        F.min_by(F.struct("page_doc_class", "page_doc_class_scores"), "page_index").alias("__first")
    )
    whole = last_of(ordered(corrections.where("page_index is null"), "document_id", "doc_class"), ["document_id"])
    whole = whole.select("document_id", F.col("doc_class").alias("__label"), F.lit(True).alias("__whole"))
    merged = docs.join(first, "document_id", "left").join(whole, "document_id", "left")
    from_first = F.col("__first").isNotNull()
    new_docs = merged.withColumns(
        {
            "doc_class": F.when(F.col("__whole"), F.col("__label")).when(from_first, F.col("__first.page_doc_class")).otherwise(F.col("doc_class")),
            "doc_class_scores": F.when(from_first, F.col("__first.page_doc_class_scores")).otherwise(F.col("doc_class_scores")),
        }
    ).select(*docs.columns)
    return new_docs, new_pages


def correct_ocr(docs: DataFrame, pages: DataFrame, requests: DataFrame, patches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Text corrections: ``requests(document_id, corrected_text, corrected_english)`` and
    English page patches, which win over the English blob.

    The error rate takes the correction as reference and the raw text as hypothesis.
    """
    new_pages = apply_split_text(pages, requests, "corrected_text", "corrected_ocr_text")
    blobs = last_given(requests, "corrected_english")
    if patches is not None:
        blobs = blobs.join(patches.select("document_id").distinct(), "document_id", "left_anti")
    new_pages = apply_split_text(new_pages, blobs, "corrected_english", "corrected_ocr_text_english")
    english = blobs.select("document_id", F.col("corrected_english").alias("__english"))
    if patches is not None:
        new_pages = apply_page_patches(new_pages, patches, "corrected_ocr_text_english")
        joined = rejoined(new_pages, "corrected_ocr_text_english", patches, "__english")
        english = english.unionByName(joined)
    request = last_given(requests, "corrected_text").withColumnRenamed("corrected_text", "__text")
    merged = docs.join(request, "document_id", "left").join(english, "document_id", "left")
    given = F.col("__text").isNotNull()
    new_docs = merged.withColumns(
        {
            "corrected_ocr": F.coalesce("__text", "corrected_ocr"),
            "ocr_cer": F.when(given, cer_percent(F.col("__text"), F.col("raw_ocr"))).otherwise(F.col("ocr_cer")),
            "corrected_ocr_english": F.coalesce("__english", "corrected_ocr_english"),
        }
    ).select(*docs.columns)
    return new_docs, new_pages


def mean_abstract_cer(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``(document_id, abstract_cer)``: mean over pages with a model text, else of the whole, else null.

    Per-page rates are computed before the grouping; identical texts cost nothing. Whole texts are compared only where no
    page gives a rate: a function in Python runs for all rows, so what it is not needed for goes to it as null.
    """
    has_model = F.coalesce(F.col("page_abstract"), F.lit("")) != ""
    per_page = F.when(has_model, cer(F.when(has_model, F.col("corrected_page_abstract")), F.col("page_abstract")))
    means = pages.select("document_id", per_page.alias("__cer")).groupBy("document_id").agg(F.avg("__cer").alias("__mean"))
    needed = F.col("__mean").isNull() & (F.coalesce(F.col("abstract"), F.lit("")) != "")
    whole = F.when(needed, cer_percent(F.when(needed, F.col("corrected_abstract")), F.when(needed, F.col("abstract"))))
    return docs.join(means, "document_id", "left").select(
        "document_id", F.coalesce(F.round(F.col("__mean") * 100, 2), whole).alias("abstract_cer")
    )


def correct_abstract(docs: DataFrame, pages: DataFrame, requests: DataFrame, patches: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary corrections: documents, pages, and the requests that ask for nothing.

    ``requests(document_id, corrected_abstract, corrected_overall_abstract)``; page
    patches win over the blob.
    """
    empty = F.col("corrected_abstract").isNull() & F.col("corrected_overall_abstract").isNull()
    refused = requests.where(empty)
    if patches is not None:
        refused = refused.join(patches.select("document_id").distinct(), "document_id", "left_anti")
    blobs = last_given(requests, "corrected_abstract")
    if patches is not None:
        blobs = blobs.join(patches.select("document_id").distinct(), "document_id", "left_anti")
    new_pages = apply_split_text(pages, blobs, "corrected_abstract", "corrected_page_abstract")
    texts = blobs.select("document_id", F.col("corrected_abstract").alias("__abstract"))
    touched = requests.where(~empty).select("document_id")
    if patches is not None:
        new_pages = apply_page_patches(new_pages, patches, "corrected_page_abstract")
        joined = rejoined(new_pages, "corrected_page_abstract", patches, "__abstract")
        texts = texts.unionByName(joined)
        touched = touched.unionByName(patches.select("document_id"))
    overall = last_given(requests, "corrected_overall_abstract").withColumnRenamed("corrected_overall_abstract", "__overall")
    merged = docs.join(texts, "document_id", "left").join(overall, "document_id", "left")
    interim = merged.withColumns(
        {
            "corrected_abstract": F.coalesce("__abstract", "corrected_abstract"),
            "corrected_overall_abstract": F.coalesce("__overall", "corrected_overall_abstract"),
        }
    ).select(*docs.columns)
    touched = touched.distinct()
    rates = mean_abstract_cer(*[f.join(touched, "document_id", "left_semi") for f in (new_pages, interim)]).withColumnRenamed("abstract_cer", "__rate")
    new_docs = interim.join(rates, "document_id", "left").withColumn(
        "abstract_cer", F.coalesce("__rate", "abstract_cer")
    ).select(*docs.columns)
    return new_docs, new_pages, refused


def stage_view(docs: DataFrame, viewing: Column | None = None) -> DataFrame:
    """One row per document and stage: state, whether blocked, and whether a future stage is viewed.

    The six stages are a literal array, so this is an explode and not a join.
    """
    current = stage_position(F.col("current_stage"))
    stages = F.array(*[F.lit(s) for s in STAGES])
    rows = docs.select(
        "document_id", "current_stage", "status", (viewing if viewing is not None else F.lit(None).cast("string")).alias("__view"),
        F.posexplode(stages).alias("stage_pos", "stage"),
    )
    cur = F.coalesce(current, F.lit(-1))
    at_current = (
        F.when(F.col("status") == "processing", F.lit("running")).when(F.col("status") == "qc_pending", F.lit("qc")).otherwise(F.lit("pending"))
    )
    state = (
        F.when(F.col("status") == "completed", F.lit("done"))
        .when(F.col("stage_pos") < cur, F.lit("done"))
        .when(F.col("stage_pos") == cur, at_current)
        .otherwise(F.lit("future"))
    )
    blocked = (F.col("status") == "qc_pending") & (cur >= 0) & (F.col("stage_pos") > cur)
    future = (F.col("status") != "completed") & (cur >= 0) & (stage_position(F.col("__view")) > cur)
    return rows.select(
        "document_id", "stage_pos", "stage", state.alias("state"), blocked.alias("blocked"),
        F.coalesce(future, F.lit(False)).alias("viewing_future"),
    )


def current_state(stage_runs: DataFrame, order: Sequence[str] = ("started_at", "id")) -> DataFrame:
    """Last stage run of each document. Combined before the shuffle."""
    return stage_runs.groupBy("document_id").agg(
        F.max_by(F.struct("stage", "status"), F.struct(*order)).alias("__last")
    ).select("document_id", F.col("__last.stage").alias("stage"), F.col("__last.status").alias("status"))
