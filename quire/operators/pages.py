"""Page-marked text, and reading documents with their pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scores import mean_score
from quire.functions.text import is_blank, let, marked_block, marked_entries, strip_ws
from quire.operators.skew import VOLUME_PAGES, ordered_concat, salted_left_join

PAGE_KEY = ["document_id", "page_index"]
ORDER = "seq"


def last_of(changes: DataFrame, keys: Sequence[str], order: str = ORDER) -> DataFrame:
    """One change for each key, as if all were applied in turn: the one that is last by ``order``.

    Without that column, or where it ties, the largest by its values counts, so that the result does not depend on the order
    of rows. Combined before the shuffle. The order column is dropped.
    """
    values = [c for c in changes.columns if c not in keys and c != order]
    if not values:
        return changes.select(*keys).distinct()
    rank = F.struct(*([order] if order in changes.columns else []), F.to_json(F.struct(*values)).alias("__text"))
    last = F.max_by(F.struct(*values), rank).alias("__last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col("__last")[c].alias(c) for c in values])


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns, and the order of changes where there is one."""
    return df.select(*columns, *([ORDER] if ORDER in df.columns else []))


def split_marked_pages(df: DataFrame, text: str, keys: Sequence[str] = ("document_id",), out: str = "body") -> DataFrame:
    """One row ``(keys, page_index, body)`` per page of a page-marked text. No shuffle."""
    # The outer form keeps the optimiser from splitting the text a second time for a filter.
    entry = F.explode_outer(marked_entries(F.col(text))).alias("__e")
    return df.select(*keys, entry).where("__e is not null").select(*keys, F.col("__e.page_index").alias("page_index"), F.col("__e.body").alias(out))


def split_marked_texts(df: DataFrame, texts: dict[str, Column], keys: Sequence[str] = ("document_id",)) -> DataFrame:
    """One row ``(keys, page_index, *texts)`` per page that any of several page-marked texts names. No shuffle.

    All texts of a row are split and brought together page by page inside the row, so the pages leave it once, however many
    texts there are. A page that a text does not name is null there.
    """
    names = list(texts)

    def tagged(which: int, text: Column) -> Column:
        return F.transform(marked_entries(text), lambda e: F.struct(e["page_index"].alias("page_index"), F.lit(which).alias("which"), e["body"].alias("body")))

    def by_page(entries: Column) -> Column:
        # In page order a page's entries are neighbours, at most one of each text.
        def at_head(e: Column, i: Column) -> Column:
            near = [F.get(entries, i + j) for j in range(len(names))]
            own = lambda which: F.coalesce(*[F.when((x["page_index"] == e["page_index"]) & (x["which"] == which), x["body"]) for x in near])
            head = (i == 0) | (F.get(entries, i - 1)["page_index"] != e["page_index"])
            return F.when(head, F.struct(e["page_index"].alias("page_index"), *[own(w).alias(n) for w, n in enumerate(names)]))

        return F.filter(F.transform(entries, at_head), lambda p: p.isNotNull())

    entries = F.array_sort(F.concat(*[tagged(w, t) for w, t in enumerate(texts.values())]))
    page = F.explode_outer(let(entries, by_page)).alias("__p")
    return df.select(*keys, page).where("__p is not null").select(*keys, *[F.col("__p")[c].alias(c) for c in ("page_index", *names)])


def join_marked_pages(
    pages: DataFrame, body: Column | str, keys: Sequence[str] = ("document_id",), out: str = "text"
) -> DataFrame:
    """Page rows back to page-marked text, one row per document volume."""
    col = F.col(body) if isinstance(body, str) else body
    return ordered_concat(pages, keys, "page_index", marked_block(F.col("page_index"), col), "\n\n", out)


def fold_volumes(volumes: DataFrame, text: str, keys: Sequence[str] = ("document_id",), separator: str = "\n\n") -> DataFrame:
    """Volumes to the one text cell of a document row, for tables that store the text that way.

    The pages are already joined volume by volume; what meets here is the cell itself.
    """
    parts = F.array_sort(F.collect_list(F.struct("volume", text)))
    return volumes.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda v: v[text]), separator).alias(text))


def whole_document_text(pages: DataFrame, text: str, keys: Sequence[str] = ("document_id",), out: str = "text") -> DataFrame:
    """Non-blank page texts, trimmed, joined by a blank line in page order."""
    trimmed = strip_ws(F.col(text))
    return ordered_concat(pages, keys, "page_index", F.when(trimmed != "", trimmed), "\n\n", out)


def documents_with_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Left outer join of documents and pages that survives one giant document.

    Pages are the streamed side of an inner join (hot document ids salted); documents
    without any page come from an anti join.
    """
    matched = salted_left_join(pages, docs, ["document_id"], ["page_index"], how="inner")
    bare = docs.join(pages.select("document_id").distinct(), "document_id", "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def get_documents(docs: DataFrame, pages: DataFrame, volume_pages: int = VOLUME_PAGES) -> DataFrame:
    """Nested read: each document with its pages in order, and the mean of the page scores.

    A document without page rows gets one page 0 from its own path. Giant documents
    come back in volumes, like joined text.
    """
    page_fields = [c for c in pages.columns if c != "document_id"]
    ordered = ["page_index", *[c for c in page_fields if c != "page_index"]]
    nested = pages.groupBy("document_id", F.floor(F.col("page_index") / volume_pages).cast("int").alias("volume")).agg(
        F.array_sort(F.collect_list(F.struct(*ordered))).alias("pages")
    )
    mean_qs = pages.groupBy("document_id").agg(mean_score(F.col("initial_qs")).alias("__mean_qs"))
    page_type = nested.schema["pages"].dataType.elementType
    synthetic = F.array(
        F.struct(
            *[
                (
                    F.lit(0)
                    if f.name == "page_index"
                    else F.col("original_path")
                    if f.name == "image_path"
                    else F.col(f.name)
                    if f.name in docs.columns
                    else F.lit(None)
                )
                .cast(f.dataType)
                .alias(f.name)
                for f in page_type.fields
            ]
        )
    )
    joined = docs.join(mean_qs, "document_id", "left").join(nested, "document_id", "left")
    return joined.select(
        *[c for c in docs.columns if c != "initial_qs"],
        F.coalesce("__mean_qs", F.round("initial_qs", 2)).alias("initial_qs"),
        F.coalesce("volume", F.lit(0)).alias("volume"),
        F.coalesce("pages", synthetic).alias("pages"),
    )


def read_page(pages: DataFrame, document_id: int | Column, page_index: int | Column) -> DataFrame:
    """Point look-up; both conditions are plain column filters, so they reach the scan."""
    return pages.where((F.col("document_id") == document_id) & (F.col("page_index") == page_index))


def pick_raster(layer: Column, page_image: Column, page_enhanced: Column, doc_enhanced: Column) -> Column:
    """Raster path of a page for the asked layer; empty paths count as missing."""
    fallback = F.coalesce(F.nullif(page_enhanced, F.lit("")), F.nullif(doc_enhanced, F.lit("")))
    return F.when(layer == "original", F.nullif(page_image, F.lit(""))).otherwise(fallback)


def base_name(path: Column) -> Column:
    """Last path segment, with either kind of slash."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def resolve_paths(df: DataFrame, path: str, listing: DataFrame, storage_root: str, out: str = "resolved") -> DataFrame:
    """Path as stored when such a file is listed, else ``storage_root/<name>`` when that one is.

    ``listing`` has one column ``file_path``; both look-ups are equi-joins.
    """
    root = storage_root.rstrip("/")
    cleaned = F.regexp_replace(F.regexp_replace(strip_ws(F.col(path)), "/(\\./)+", "/"), "/{2,}", "/")
    files = listing.select(F.col("file_path")).distinct()
    as_is = files.select(F.col("file_path").alias("__direct"))
    moved = files.select(F.col("file_path").alias("__moved"))
    return (
        df.withColumn("__clean", cleaned)
        .withColumn("__alt", F.concat(F.lit(root + "/"), base_name(F.col("__clean"))))
        .join(as_is, F.col("__clean") == F.col("__direct"), "left")
        .join(moved, F.col("__alt") == F.col("__moved"), "left")
        .withColumn(out, F.when(~is_blank(F.col("__clean")), F.coalesce("__direct", "__moved")))
        .drop("__clean", "__alt", "__direct", "__moved")
    )
