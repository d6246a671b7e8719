"""Queries on tables, OCR runs, stage state, progress events, summaries, translation, chat."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.dims import INDIC_LANGUAGES, STAGES, WORLD_LANGUAGES, supported_target, translation_languages
from quire.functions.text import first_filled, let, strip_ws
from quire.operators import chat as H
from quire.operators import ocr_runs as O
from quire.operators import page_source as P
from quire.operators import pages as G
from quire.operators import review as V
from quire.operators import status as T
from quire.operators import summarize as Z
from quire.operators import translate as L
from quire.operators.skew import VOLUME_PAGES, fold_lists
from quire.plans.registry import (
    NL, NL2, NON_WS_SQL, WS_SQL, blank, cte, digest, digest_sql, filled, mean_sql, query, rnd, rows_where, sql_view, strip, stripped, table, view,
)
from quire.session import checkpoint_dir
from quire.sources import tables as B
from quire.sources.keyed import KeyedTable
from quire.sources.progress import read_progress_log, stream_progress_log
from quire.streaming import progress as R

# --- tables ---------------------------------------------------------------------------

@query("q_s5_list_documents", cte("v_docs") + " SELECT document_id, filename, status, CAST(created_at AS VARCHAR) AS created FROM v_docs ORDER BY created_at DESC, document_id DESC")
def s5(spark, sf):
    docs = B.newest_first(view(spark, sf, "v_docs"))
    return docs.select("document_id", "filename", "status", F.col("created_at").cast("string").alias("created"))


@query("q_k1_newest_first", cte("v_docs") + " SELECT document_id, row_number() OVER (ORDER BY created_at DESC, document_id DESC) AS place FROM v_docs")
def k1(spark, sf):
    docs = view(spark, sf, "v_docs").select("document_id", "created_at")
    return B.with_places(docs, F.desc("created_at"), F.desc("document_id")).select("document_id", "place")


@query(
    "q_s6_get_documents",
    cte("v_scored_docs", "v_scored_pages") + f""" SELECT d.document_id, coalesce(p.i, {rnd('d.initial_qs', 2)}) AS initial_qs, CAST(coalesce(p.n, 1) AS INT) AS n_pages,
      coalesce(p.paths, d.original_path) AS paths FROM v_scored_docs d LEFT JOIN (SELECT document_id, {mean_sql('initial_qs')} AS i, count(*) AS n,
      string_agg(image_path, ',' ORDER BY page_index) AS paths FROM v_scored_pages GROUP BY document_id) p USING (document_id)""",
)
def s6(spark, sf):
    nested = G.get_documents(view(spark, sf, "v_scored_docs"), view(spark, sf, "v_scored_pages"))
    volumes = nested.select("document_id", "initial_qs", "volume", F.size("pages").alias("n"), F.transform("pages", lambda p: p["image_path"]).alias("paths"))
    whole = fold_lists(volumes, ["document_id", "initial_qs"], ["paths"], F.sum("n").cast("int").alias("n_pages"))
    return whole.select("document_id", "initial_qs", "n_pages", F.array_join("paths", ",").alias("paths"))


@query("q_w6_page_order", cte("v_scored_pages") + " SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_index) - 1 AS INT) AS place, page_index FROM v_scored_pages")
def w6(spark, sf):
    nested = G.get_documents(view(spark, sf, "v_scored_docs"), view(spark, sf, "v_scored_pages"))
    # A volume's places go on where the volumes before it end; a volume may have gaps, so pages are counted.
    earlier = W.partitionBy("document_id").orderBy("volume").rowsBetween(W.unboundedPreceding, -1)
    counted = nested.withColumn("before", F.coalesce(F.sum(F.size("pages")).over(earlier), F.lit(0)).cast("int"))
    rows = counted.select("document_id", "before", F.posexplode("pages").alias("place", "p")).where("p.passes is not null")
    return rows.select("document_id", (F.col("before") + F.col("place")).alias("place"), F.col("p.page_index").alias("page_index"))


@query("q_s7_read_page", cte("v_scored_pages") + " SELECT document_id, page_index, image_path FROM v_scored_pages WHERE document_id = (SELECT max(l_orderkey) FROM lineitem) AND page_index = (SELECT min(l_linenumber) - 1 FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem))")
def s7(spark, sf):
    lines = table(spark, sf, "lineitem")
    newest = lines.agg(F.max("l_orderkey").alias("k"))
    first = lines.where(F.col("l_orderkey") == newest.scalar()).agg(F.min("l_linenumber") - 1)
    page = G.read_page(view(spark, sf, "v_scored_pages"), newest.scalar(), first.scalar())
    return page.select("document_id", "page_index", "image_path")


@query(
    "q_s8_pick_raster",
    cte("v_scored_docs", "v_scored_pages") + """ SELECT p.document_id, p.page_index, p.image_path AS original, coalesce(p.enhanced_path, d.enhanced_path) AS enhanced
      FROM v_scored_pages p JOIN v_scored_docs d USING (document_id)""",
)
def s8(spark, sf):
    docs = view(spark, sf, "v_scored_docs").select("document_id", F.col("enhanced_path").alias("doc_enhanced"))
    joined = view(spark, sf, "v_scored_pages").join(docs, "document_id")
    pick = lambda layer: G.pick_raster(F.lit(layer), F.col("image_path"), F.col("enhanced_path"), F.col("doc_enhanced"))
    return joined.select("document_id", "page_index", pick("original").alias("original"), pick("enhanced").alias("enhanced"))


_PATH = "CASE WHEN o_orderkey % 5 = 0 THEN concat('C:\\\\scan\\\\', CAST(o_orderkey AS STRING), '.png') WHEN o_orderkey % 5 = 1 THEN concat(' /scan//', CAST(o_orderkey AS STRING), '.png') WHEN o_orderkey % 5 = 2 THEN '' ELSE concat('/scan/./', CAST(o_orderkey AS STRING), '.png') END"
_PATH_SQL = _PATH.replace("\\\\", "\\")


@query(
    "q_s9_resolve_path",
    f"""WITH listing AS (SELECT '/scan/' || CAST(l_orderkey AS VARCHAR) || '.png' AS f FROM lineitem WHERE l_linenumber = 1 UNION SELECT '/store/' || CAST(l_orderkey AS VARCHAR) || '.png' FROM lineitem WHERE l_linenumber = 2),
    p AS (SELECT o_orderkey, regexp_replace(regexp_replace(trim({_PATH_SQL}), '/(\\./)+', '/', 'g'), '/+', '/', 'g') AS c FROM orders)
    SELECT o_orderkey, coalesce(a.f, b.f) AS resolved, string_split(replace(c, '\\', '/'), '/')[-1] AS file_name FROM p LEFT JOIN listing a ON a.f = c LEFT JOIN listing b ON b.f = '/store/' || string_split(replace(c, '\\', '/'), '/')[-1]""",
)
def s9(spark, sf):
    lines = table(spark, sf, "lineitem")
    number = F.concat(F.col("l_orderkey").cast("string"), F.lit(".png"))
    listing = lines.where("l_linenumber = 1").select(F.concat(F.lit("/scan/"), number).alias("file_path")).unionByName(
        lines.where("l_linenumber = 2").select(F.concat(F.lit("/store/"), number).alias("file_path"))
    )
    paths = table(spark, sf, "orders").select("o_orderkey", F.expr(_PATH).alias("path"))
    out = G.resolve_paths(paths, "path", listing, "/store")
    return out.select("o_orderkey", "resolved", G.base_name(strip_ws(F.col("path"))).alias("file_name"))


@query(
    "q_s10_upsert",
    """SELECT coalesce(o.o_orderkey, l.k) AS document_id, coalesce(l.s, o.o_orderstatus) AS status, o.o_custkey AS owner_id, CASE WHEN l.k IS NOT NULL THEN 1 ELSE 0 END AS updated_at
    FROM orders o FULL JOIN (SELECT l_orderkey + 100 AS k, CASE WHEN max(l_linenumber) < 4 THEN 'X' END AS s FROM lineitem GROUP BY l_orderkey) l ON l.k = o.o_orderkey""",
)
def s10(spark, sf):
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner_id"), F.lit(0).alias("updated_at")
    )
    changes = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") + 100).alias("document_id")).agg(
        F.when(F.max("l_linenumber") < 4, "X").alias("status")
    )
    merged = B.upsert(base, changes, ["document_id"], now=F.lit(1))
    return merged.select("document_id", "status", "owner_id", F.coalesce("updated_at", F.lit(1)).alias("updated_at"))


@query(
    "q_s10_keyed_table",
    """WITH changes AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS w, 0 AS q FROM orders
      UNION ALL SELECT l_orderkey + 100, 'X' || CAST(l_linenumber AS VARCHAR), NULL, 2 * l_linenumber FROM lineitem
      UNION ALL SELECT o_orderkey, NULL, -1, 3 FROM orders WHERE o_totalprice > 200000)
    SELECT k AS document_id, arg_max(s, q) FILTER (WHERE s IS NOT NULL) AS status, arg_max(w, q) FILTER (WHERE w IS NOT NULL) AS owner_id
    FROM changes WHERE q > 5 OR k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY k""",
)
def s10_keyed(spark, sf):
    """Batches out of order: a base, changes, a deletion at 5, and owners that come late, from 3."""
    table_ = KeyedTable(spark, f"{checkpoint_dir(spark)}/keyed-{uuid4().hex}", ["document_id"], "document_id bigint, status string, owner_id bigint", buckets=16)
    orders = table(spark, sf, "orders").withColumn("document_id", F.col("o_orderkey"))
    table_.put(orders.select("document_id", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner_id"), F.lit(0).alias("seq")))
    table_.compact(0.5)
    lines = table(spark, sf, "lineitem")
    table_.put(lines.select((F.col("l_orderkey") + 100).alias("document_id"), F.concat(F.lit("X"), "l_linenumber").alias("status"), (F.col("l_linenumber") * 2).alias("seq")))
    table_.put(orders.where("o_orderstatus = 'P'").select("document_id", F.lit(5).alias("seq"), F.lit(True).alias("deleted")))
    table_.put(orders.where("o_totalprice > 200000").select("document_id", F.lit(-1).alias("owner_id"), F.lit(3).alias("seq")))
    return table_.read()


@query("q_s11_evolve_schema", cte("v_docs") + " SELECT document_id, status, CAST(NULL AS VARCHAR) AS overall_abstract, CAST(NULL AS DOUBLE) AS ocr_cer FROM v_docs")
def s11(spark, sf):
    return B.evolve_schema(view(spark, sf, "v_docs"), B.DOCUMENTS).select("document_id", "status", "overall_abstract", "ocr_cer")


_DOOMED = "SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'P'"


@query(
    "q_s12_delete_documents",
    cte("v_docs", "v_scored_pages") + f""" SELECT document_id, CAST(-1 AS INT) AS page_index FROM v_docs WHERE document_id NOT IN ({_DOOMED})
      UNION ALL SELECT document_id, page_index FROM v_scored_pages WHERE document_id NOT IN ({_DOOMED})""",
)
def s12(spark, sf):
    docs = view(spark, sf, "v_docs")
    kept_pages, kept_docs = B.delete_documents(docs.where("status = 'processing'"), view(spark, sf, "v_scored_pages"), docs)
    return kept_docs.select("document_id", F.lit(-1).alias("page_index")).unionByName(kept_pages.select("document_id", "page_index"))


@query("q_s14_append_stage_run", cte("v_stage_runs") + " SELECT id, status, CASE WHEN status IN ('qc_pending', 'approved', 'rejected') THEN CAST(started_at AS VARCHAR) END AS finished FROM v_stage_runs")
def s14(spark, sf):
    runs = view(spark, sf, "v_stage_runs").withColumn("finished_at", V.finished_at(F.col("status"), F.col("started_at")))
    return runs.select("id", "status", F.col("finished_at").cast("string").alias("finished"))


@query(
    "q_s15_language_coverage",
    "WITH langs AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in {**WORLD_LANGUAGES, **INDIC_LANGUAGES}.items()) + ") AS t(code, name)) SELECT lang, name, count(*) AS n FROM documents JOIN langs ON lang = code GROUP BY lang, name",
)
def s15(spark, sf):
    langs = F.broadcast(translation_languages(spark).select(F.col("code").alias("lang"), "name"))
    return table(spark, sf, "documents").join(langs, "lang").groupBy("lang", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_u5_translation_target",
    "SELECT doc_id, CASE WHEN t IN (" + ", ".join(f"'{c}'" for c in {**WORLD_LANGUAGES, **INDIC_LANGUAGES}) + ") THEN t ELSE 'hi' END AS target FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS t FROM documents)",
)
def u5(spark, sf):
    wanted = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", supported_target(wanted).alias("target"))


@query("q_u4_union_batches", "SELECT o_orderkey AS document_id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS source FROM orders UNION ALL SELECT doc_id, NULL, source FROM documents")
def u4(spark, sf):
    first = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"))
    return B.union_batches(first, table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "source"))


@query(
    "q_s3_ingest_batch",
    """SELECT page_id, kind, CASE WHEN kind = 'empty' THEN 'Empty file' WHEN kind = 'unsupported' THEN 'Unsupported' END AS reason FROM (SELECT page_id,
      CASE WHEN page_id % 7 = 0 THEN 'empty' WHEN page_id % 7 = 1 OR page_id % 7 = 3 THEN 'pdf' WHEN page_id % 7 = 2 THEN 'image' ELSE 'unsupported' END AS kind FROM pages)""",
)
def s3(spark, sf):
    from quire.sources.files import file_kind, ingest_batch

    k = F.col("page_id") % 7
    content = F.when(k == 0, F.lit("").cast("binary")).when(k == 1, F.concat(F.lit("%PDF-1.7"), F.col("html")).cast("binary")).when(
        k == 2, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.col("html").cast("binary"))
    ).otherwise(F.col("html").cast("binary"))
    path = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.when(k == 3, ".PDF").otherwise(".bin"))
    files = table(spark, sf, "pages").select("page_id", path.alias("path"), F.length(content).cast("bigint").alias("length"), content.alias("content"))
    accepted, rejected = ingest_batch(files.withColumn("kind", file_kind(F.col("path"), F.col("length"), F.col("content"))))
    short = F.regexp_extract("reason", ": (Empty file|Unsupported)", 1)
    return accepted.select("page_id", "kind", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("page_id", "kind", short.alias("reason")))


# --- OCR runs ------------------------------------------------------------------------------

_WORDS_SQL = f"""SELECT doc_id, text, w, range(len(w)) AS pos FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)"""
sql_view("o_words", f"SELECT doc_id, unnest(w) AS word, unnest(pos) AS pos FROM ({_WORDS_SQL})")
sql_view("o_conf", f"SELECT doc_id, pos, word, ((length(word) * 7 + pos * 13) % 112 - 10) AS conf FROM o_words", "o_words")


def _engine_words(spark, sf):
    """Each document's words as an engine's word list; confidences from -10 to 101."""
    words = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(
            w.alias("text"), ((F.length(w) * 7 + i * 13) % 112 - 10).cast("double").alias("conf"), (i * 10).alias("left"),
            (i * 2).alias("top"), F.length(w).alias("width"), F.lit(9).alias("height"),
        ),
    )
    return table(spark, sf, "documents").select("doc_id", "text", words.alias("words"))


@query(
    "q_p9_usable_boxes",
    cte("o_conf") + f""" SELECT doc_id, count(*) AS n, CAST(sum(length({strip('word')})) AS BIGINT) AS chars, CAST(sum(conf) AS DOUBLE) AS conf_sum, CAST(sum(pos * 10 + length(word)) AS DOUBLE) AS right_sum
      FROM o_conf WHERE conf >= 0 AND NOT {blank('word')} GROUP BY doc_id""",
)
def p9(spark, sf):
    boxes = _engine_words(spark, sf).select("doc_id", O.usable_boxes(F.col("words")).alias("b"))
    rows = boxes.select("doc_id", F.explode_outer("b").alias("b")).where("b is not null")
    corner = F.col("b.box")[1][0]
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("b.text")).alias("chars"), F.round(F.sum(F.col("b.confidence") * 100), 3).alias("conf_sum"), F.sum(corner).alias("right_sum")
    )


@query(
    "q_a5_page_summary",
    cte("o_conf") + f""", b AS (SELECT doc_id, count(*) AS n, sum(conf) AS s FROM o_conf WHERE conf >= 0 AND NOT {blank('word')} GROUP BY doc_id)
    SELECT d.doc_id, coalesce({rnd('b.s / CAST(b.n AS DOUBLE)', 2)}, 0.0) AS avg_confidence, CAST(len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '{NON_WS_SQL}'))) AS INT) AS line_count
    FROM documents d LEFT JOIN b USING (doc_id)""",
)
def a5(spark, sf):
    summary = _engine_words(spark, sf).select("doc_id", O.page_summary(F.col("text"), O.usable_boxes(F.col("words"))).alias("s"))
    return summary.select("doc_id", "s.avg_confidence", "s.line_count")


sql_view(
    "o_shown",
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM o_conf WHERE conf >= 0 AND NOT {blank('word')}) WHERE r <= 1500",
    "o_conf",
)


@query(
    "q_a6_confidence_buckets",
    cte("o_shown") + f""" SELECT d.doc_id, CAST(count(*) FILTER (WHERE conf >= 85) AS INT) AS high, CAST(count(*) FILTER (WHERE conf >= 60 AND conf < 85) AS INT) AS mid,
      CAST(count(*) FILTER (WHERE conf < 60) AS INT) AS low, CAST(count(conf) AS INT) AS words, coalesce({rnd('CAST(sum(conf) AS DOUBLE) / (100 * count(conf))', 4)}, 0.0) AS mean FROM documents d LEFT JOIN o_shown USING (doc_id) GROUP BY d.doc_id""",
)
def a6(spark, sf):
    shown = O.shown_words(O.usable_boxes(F.col("words")))
    b = _engine_words(spark, sf).select("doc_id", O.confidence_buckets(shown).alias("b"))
    return b.select("doc_id", "b.high", "b.mid", "b.low", "b.words", F.round("b.mean", 4).alias("mean"))


@query("q_k5_first_words", cte("o_shown") + f" SELECT doc_id, CAST(count(*) AS INT) AS words, md5(string_agg({strip('word')}, '|' ORDER BY pos)) AS words_md5 FROM o_shown GROUP BY doc_id")
def k5(spark, sf):
    shown = O.shown_words(O.usable_boxes(F.col("words")))
    row = let(F.transform(shown, lambda b: b["text"]), lambda w: F.struct(F.size(w).alias("words"), F.md5(F.array_join(w, "|")).alias("words_md5")))
    return rows_where(_engine_words(spark, sf), ["doc_id"], row, lambda r: r["words"] > 0)


def _garbage_sql(x: str) -> str:
    t = f"regexp_extract_all({strip(x)}, '[A-Za-z]{{2,}}')"
    return f"(length({strip(x)}) >= 30 AND coalesce(len(list_filter({t}, lambda w: regexp_matches(w, '^[A-Z]{{2,5}}$'))) / CAST(nullif(len({t}), 0) AS DOUBLE), 0) > 0.55)"


@query("q_p19_garbage_latin", cte("v_ocr_runs") + f" SELECT page_id, engine, {_garbage_sql('text')} AS garbage FROM v_ocr_runs")
def p19(spark, sf):
    return view(spark, sf, "v_ocr_runs").select("page_id", "engine", O.looks_garbage_latin(F.col("text")).alias("garbage"))


@query(
    "q_p18_choose_ocr",
    cte("v_ocr_runs") + f""", w AS (SELECT page_id, max(CASE WHEN engine = 'tesseract' THEN text END) AS mt, max(CASE WHEN engine = 'tesseract' THEN avg_confidence END) AS mc,
        max(CASE WHEN engine = 'easyocr' THEN text END) AS st, max(CASE WHEN engine = 'easyocr' THEN avg_confidence END) AS sc FROM v_ocr_runs GROUP BY page_id),
      j AS (SELECT *, NOT {blank('mt')} AND (mc < 35 OR {_garbage_sql('mt')}) AS g FROM w)
      SELECT page_id, CASE WHEN (NOT {blank('mt')} AND NOT g) OR st IS NULL THEN 'tesseract' ELSE 'easyocr' END AS engine,
        md5(CASE WHEN (NOT {blank('mt')} AND NOT g) OR st IS NULL THEN mt ELSE st END) AS text_md5,
        CASE WHEN (NOT {blank('mt')} AND NOT g) OR st IS NULL THEN mc ELSE sc END AS avg_confidence,
        CASE WHEN g THEN 'Main engine output looked like garbage Latin (avg confidence ' || CAST(CAST(mc AS DECIMAL(38,1)) AS VARCHAR) || '%).' WHEN {blank('mt')} THEN 'Main engine returned empty text.' END AS hint FROM j""",
)
def p18(spark, sf):
    chosen = O.choose_ocr(view(spark, sf, "v_ocr_runs"))
    return chosen.select("page_id", "engine", F.md5("text").alias("text_md5"), "avg_confidence", "hint")


@query(
    "q_k6_first_usable",
    cte("v_ocr_runs") + f""" SELECT page_id, CAST(prio AS INT) AS prio, engine FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {blank('text')}, CASE WHEN {blank('text')} THEN -prio ELSE prio END) AS r FROM v_ocr_runs) WHERE r = 1""",
)
def k6(spark, sf):
    return O.first_usable_result(view(spark, sf, "v_ocr_runs"), "page_id").select("page_id", "prio", "engine")


_HINT = "CASE WHEN doc_id % 3 = 0 THEN concat('hint ', lang) WHEN doc_id % 3 = 1 THEN '' END"


@query(
    "q_a8_ocr_payload",
    f"""WITH r AS (SELECT doc_id // 4 AS document_id, doc_id % 4 AS p, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS e, nullif({_HINT}, '') AS h FROM documents),
      hints AS (SELECT document_id, string_agg(h, '|' ORDER BY p) AS hints FROM (SELECT document_id, h, min(p) AS p FROM r WHERE h IS NOT NULL GROUP BY ALL) GROUP BY document_id)
      SELECT document_id, count(*) AS pages, string_agg(e, '|' ORDER BY p) AS engines, coalesce(any_value(hints), '') AS hints, 'auto' AS lang FROM r LEFT JOIN hints USING (document_id) GROUP BY document_id""",
)
def a8(spark, sf):
    runs = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("document_id"), (F.col("doc_id") % 4).cast("int").alias("page_index"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("engine"), F.expr(_HINT).alias("hint"),
    )
    payload = fold_lists(O.ocr_payload(runs, F.lit(None).cast("string")), ["document_id", "lang"], ["engines", "hints"], F.sum("pages").alias("pages"))
    return payload.select("document_id", "pages", F.array_join("engines", "|").alias("engines"), F.array_join("hints", "|").alias("hints"), "lang")


# --- stage state ----------------------------------------------------------------------------

_STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_POS = f"(list_position({_STAGE_LIST}, current_stage) - 1)"


@query("q_j9_stage_successor", cte("v_docs") + f" SELECT document_id, {_STAGE_LIST}[list_position({_STAGE_LIST}, current_stage) + 1] AS next_stage FROM v_docs")
def j9(spark, sf):
    return view(spark, sf, "v_docs").select("document_id", V.successor(F.col("current_stage")).alias("next_stage"))


_APPROVED = "(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def _review_ids(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"))


@query(
    "q_g1_approve",
    cte("v_docs") + f""" SELECT document_id, CASE WHEN document_id IN {_APPROVED} THEN coalesce({_STAGE_LIST}[list_position({_STAGE_LIST}, current_stage) + 1], current_stage) ELSE current_stage END AS current_stage,
      CASE WHEN document_id IN {_APPROVED} THEN CASE WHEN current_stage = 'lingua' THEN 'completed' ELSE 'pending' END ELSE status END AS status FROM v_docs""",
)
def g1(spark, sf):
    return V.approve(view(spark, sf, "v_docs"), _review_ids(spark, sf)).select("document_id", "current_stage", "status")


@query("q_g2_reject", cte("v_docs") + f" SELECT document_id, current_stage, CASE WHEN document_id IN {_APPROVED} THEN 'pending' ELSE status END AS status FROM v_docs")
def g2(spark, sf):
    return V.reject(view(spark, sf, "v_docs"), _review_ids(spark, sf)).select("document_id", "current_stage", "status")


@query("q_g5_complete_stage", cte("v_docs") + " SELECT document_id, 'qc_pending' AS doc_status, 'ocr' AS stage, 'qc_pending' AS status, CAST(created_at AS VARCHAR) AS finished FROM v_docs")
def g5(spark, sf):
    docs, runs = V.complete_stage(view(spark, sf, "v_docs"), "ocr", F.col("created_at"))
    rows = runs.select("document_id", "stage", "status", F.col("finished_at").cast("string").alias("finished"))
    return docs.select("document_id", F.col("status").alias("doc_status")).join(rows, "document_id")


@query(
    "q_g6_stage_view",
    cte("v_docs") + f""", s AS (SELECT *, {_POS} AS cur, unnest({_STAGE_LIST}) AS stage, unnest(range(6)) AS pos FROM v_docs)
      SELECT document_id, CAST(pos AS INT) AS stage_pos, stage, CASE WHEN status = 'completed' OR pos < cur THEN 'done' WHEN pos = cur THEN CASE status WHEN 'processing' THEN 'running' WHEN 'qc_pending' THEN 'qc' ELSE 'pending' END ELSE 'future' END AS state,
      status = 'qc_pending' AND pos > cur AS blocked, status <> 'completed' AND 2 > cur AS viewing_future FROM s""",
)
def g6(spark, sf):
    return V.stage_view(view(spark, sf, "v_docs"), viewing=F.lit("doc_class"))


@query("q_p14_progress_pct", cte("v_docs") + f" SELECT document_id, {rnd(f'CASE WHEN status = {chr(39)}completed{chr(39)} THEN 100.0 ELSE ({_POS} + CASE WHEN status = {chr(39)}qc_pending{chr(39)} THEN 0.5 ELSE 0.0 END) / CAST(6 AS DOUBLE) * 100 END', 4)} AS pct FROM v_docs")
def p14(spark, sf):
    return view(spark, sf, "v_docs").select("document_id", F.round(T.progress_pct(F.col("current_stage"), F.col("status")), 4).alias("pct"))


@query("q_p17_clamp_normalize", cte("v_docs") + f" SELECT document_id, greatest(80.0, least(100.0, price / 2000.0)) AS target_qs, CASE WHEN owner_id % 2 = 0 THEN current_stage END AS stage FROM v_docs")
def p17(spark, sf):
    raw = F.when(F.col("owner_id") % 2 == 0, F.concat(F.lit(" "), F.upper("current_stage"), F.lit("\n"))).otherwise(F.col("status"))
    return view(spark, sf, "v_docs").select("document_id", V.clamp_target_qs(F.col("price") / 2000.0).alias("target_qs"), V.normalize_stage(raw).alias("stage"))


@query("q_a7_status_tiles", cte("v_docs") + " SELECT count(*) FILTER (WHERE status = 'qc_pending') AS qc, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'processing') AS run, count(*) AS total FROM v_docs")
def a7(spark, sf):
    return T.status_tiles(view(spark, sf, "v_docs"))


@query("q_w11_current_state", cte("v_stage_runs") + " SELECT document_id, stage, status FROM v_stage_runs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC, id DESC) = 1")
def w11(spark, sf):
    return V.current_state(view(spark, sf, "v_stage_runs"))


def _full(x: str) -> str:
    return f"NOT {blank(x)}"


@query(
    "q_p12_stage_complete",
    cte("v_text_pages", "v_text_docs") + f""", n AS (SELECT document_id, count(*) > 1 AS multi FROM v_text_pages GROUP BY document_id)
      SELECT p.document_id, p.page_index, p.enhanced_path IS NOT NULL OR (NOT multi AND d.enhanced_path IS NOT NULL) AS enhancement,
      {_full('p.ocr_text')} OR {_full('p.corrected_ocr_text')} OR (NOT multi AND ({_full('d.raw_ocr')} OR {_full('d.corrected_ocr')})) AS ocr,
      {_full('p.page_doc_class')} OR (NOT multi AND {_full('d.doc_class')}) AS doc_class, d.metadata_keys > 0 AS index_genius,
      {_full('p.page_abstract')} OR {_full('p.corrected_page_abstract')} OR (NOT multi AND ({_full('d.abstract')} OR {_full('d.corrected_abstract')})) AS abstractor,
      {_full('p.page_translation')} OR (NOT multi AND {_full('d.translation')}) AS lingua
      FROM v_text_pages p JOIN v_text_docs d USING (document_id) JOIN n USING (document_id)""",
)
def p12(spark, sf):
    return T.stage_completion(view(spark, sf, "v_text_docs"), view(spark, sf, "v_text_pages"))


# --- progress events --------------------------------------------------------------------------

_BEST = "coalesce(best_qs, 0) / greatest(coalesce(target_qs, 95.0), 1)"


@query(
    "q_r2_event_progress",
    cte("v_progress") + f""" SELECT seq, CAST(CASE phase WHEN 'start' THEN 5 WHEN 'pass' THEN least(93, floor(7 + pass / CAST(max_passes AS DOUBLE) * 58 + least(28.0, {_BEST} * 28) + 0.5))
      WHEN 'polish' THEN 91 WHEN 'escalation' THEN 92 WHEN 'escalation_try' THEN least(96, floor(88 + {_BEST} * 8 + 0.5)) WHEN 'write' THEN 97 WHEN 'page_complete' THEN 100 WHEN 'document' THEN 100 ELSE 50 END AS INT) AS pct FROM v_progress""",
)
def r2(spark, sf):
    return R.with_progress(view(spark, sf, "v_progress")).select("seq", "pct")


sql_view("e_done", "SELECT *, coalesce(page_index_zero, page_index - 1) AS pg FROM v_progress WHERE phase = 'page_complete'", "v_progress")


@query(
    "q_r3_page_results",
    cte("e_done") + f""" SELECT document_id, CAST(pg AS INT) AS page_index, max_by(enhanced_path, seq) FILTER (WHERE enhanced_path <> '') AS enhanced_path,
      {rnd('max_by(post_qs, seq) FILTER (WHERE post_qs IS NOT NULL)', 6)} AS post_qs, {rnd('max_by(initial_qs, seq) FILTER (WHERE initial_qs IS NOT NULL)', 6)} AS initial_qs FROM e_done GROUP BY document_id, pg""",
)
def r3(spark, sf):
    done = R.page_results(view(spark, sf, "v_progress"))
    return done.withColumn("post_qs", F.round("post_qs", 6)).withColumn("initial_qs", F.round("initial_qs", 6))


def _progress_log(spark, sf) -> str:
    """The progress events as NDJSON files in the shared folder, each event followed by a blank line and a broken one."""
    path = f"{checkpoint_dir(spark)}/progress-{uuid4().hex}"
    line = F.to_json(F.struct("*"))
    view(spark, sf, "v_progress").select(F.concat(line, F.lit("\n\n{"), line).alias("value")).write.text(path)
    return path


_LOG_SQL = cte("v_progress") + f" SELECT run_id, seq, document_id, phase, page_index, page_index_zero, pass, {rnd('post_qs', 6)} AS post_qs, message, enhanced_path FROM v_progress"
_LOG = ("run_id", "seq", "document_id", "phase", "page_index", "page_index_zero", "pass", "post_qs", "message", "enhanced_path")


@query("q_s13_read_progress_log", _LOG_SQL)
def s13(spark, sf):
    return read_progress_log(spark, _progress_log(spark, sf)).select(*_LOG).withColumn("post_qs", F.round("post_qs", 6))


@query("q_r1_stream_progress_log", _LOG_SQL)
def r1(spark, sf):
    """The log as a stream, a few files at a time, written where a batch job reads it."""
    log, out = _progress_log(spark, sf), f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"
    events = stream_progress_log(spark, log, max_files=2).select(*_LOG)
    run = events.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out).withColumn("post_qs", F.round("post_qs", 6))


# All passes of every page; those behind the stop are marked, those beyond the limit have no score.
@query(
    "q_r6_stall_monitor",
    cte("v_passes") + f""", g AS (SELECT page_key, pass, max(qs) OVER w AS best, max(qs) OVER w - coalesce(max(qs) OVER (PARTITION BY page_key ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gain
        FROM v_passes WHERE pass <= 16 AND qs IS NOT NULL WINDOW w AS (PARTITION BY page_key ORDER BY pass)),
      i AS (SELECT *, sum((gain >= 0.12)::INT) OVER (PARTITION BY page_key ORDER BY pass) AS island FROM g),
      c AS (SELECT *, sum((gain < 0.12)::INT) OVER (PARTITION BY page_key, island ORDER BY pass) AS stall FROM i),
      t AS (SELECT *, coalesce(bool_or(stall >= 2 OR best >= 90.0) OVER (PARTITION BY page_key ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM c)
      SELECT page_key, CAST(p.pass AS INT) AS pass, {rnd('best', 6)} AS best_qs, CAST(stall AS INT) AS stall_count, p.pass > 16 OR stopped AS after_stop
      FROM v_passes p LEFT JOIN t USING (page_key, pass) WHERE p.qs IS NOT NULL""",
)
def r6(spark, sf):
    return R.stall_monitor(view(spark, sf, "v_passes"), target_qs=90.0).drop("seen").withColumn("best_qs", F.round("best_qs", 6))


@query(
    "q_r4_run_outcomes",
    cte("v_progress") + """, f AS (SELECT run_id, min(seq) FILTER (WHERE phase = 'error') AS e, min(seq) FILTER (WHERE phase = 'document') AS d FROM v_progress GROUP BY run_id)
      SELECT run_id, CASE WHEN e IS NOT NULL AND (d IS NULL OR e < d) THEN 'failed' WHEN d IS NOT NULL THEN 'success' ELSE 'failed' END AS outcome FROM f""",
)
def r4(spark, sf):
    return R.closed_outcomes(R.run_outcomes(view(spark, sf, "v_progress"))).select("run_id", "outcome")


@query("q_r5_live_state", cte("v_stage_runs") + " SELECT document_id, stage AS current_stage, status FROM v_stage_runs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC, id DESC) = 1")
def r5(spark, sf):
    return R.live_state(view(spark, sf, "v_stage_runs"))


@query(
    "q_r7_page_board",
    cte("v_progress") + """, pg AS (SELECT l_orderkey AS document_id, l_linenumber - 1 AS page_index FROM lineitem GROUP BY ALL),
      multi AS (SELECT document_id FROM pg GROUP BY document_id HAVING count(*) > 1),
      own AS (SELECT *, page_index - 1 AS k FROM v_progress WHERE page_total > 1),
      last AS (SELECT document_id, k, max_by(phase, seq) AS phase FROM own GROUP BY ALL), far AS (SELECT document_id, max(k) AS k FROM own GROUP BY ALL),
      ended AS (SELECT DISTINCT document_id FROM v_progress WHERE phase = 'document')
      SELECT pg.document_id, CAST(pg.page_index AS INT) AS page_index, CASE WHEN e.document_id IS NOT NULL OR pg.page_index < far.k OR last.phase IN ('write', 'complete', 'page_complete') THEN 'done' WHEN last.phase IS NOT NULL THEN 'active' ELSE 'pending' END AS state
      FROM pg JOIN multi USING (document_id) LEFT JOIN far USING (document_id) LEFT JOIN ended e USING (document_id) LEFT JOIN last ON last.document_id = pg.document_id AND last.k = pg.page_index""",
)
def r7(spark, sf):
    pages = view(spark, sf, "v_scored_pages").select("document_id", "page_index")
    return R.page_board(view(spark, sf, "v_progress"), pages)


# --- summaries ----------------------------------------------------------------------------------

_STOP = "(" + ", ".join(f"'{w}'" for w in Z.STOP_WORDS) + ")"
_LINE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_B = "chr(2)"


def _sentences_sql(source: str, keys: str, text: str) -> str:
    kept = f"list_transform(string_split_regex({text}, '{_LINE}'), lambda l: CASE WHEN {strip('l')} = '' OR (upper({strip('l')}) = {strip('l')} AND lower({strip('l')}) <> {strip('l')}) THEN {_B} ELSE {strip('l')} END)"
    cut = f"regexp_replace(array_to_string({kept}, ' '), '([.!?]+[\"'')\\]]*){WS_SQL}+', '\\1' || {_B}, 'g')"
    return f"""SELECT {keys}, sentence, pos FROM (SELECT {keys}, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (
      SELECT {keys}, list_filter(list_transform(string_split({cut}, {_B}), lambda p: {strip('p')}), lambda p: p <> '') AS s FROM {source}))"""


sql_view("z_sent", _sentences_sql("documents", "doc_id", "text"))
_WORD_SQL = r"\pL[\pL''-]*"
sql_view(
    "z_tf",
    f"""SELECT doc_id, pos, w, count(*) AS tf FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '{_WORD_SQL}')) AS w FROM z_sent) WHERE w NOT IN {_STOP} GROUP BY ALL""",
    "z_sent",
)
sql_view(
    "z_vocab",
    f"SELECT doc_id, count(DISTINCT w) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD_SQL}')) AS w FROM documents) WHERE w NOT IN {_STOP} GROUP BY doc_id",
)
sql_view(
    "z_w",
    """SELECT s.doc_id, s.pos, s.sentence, coalesce(t.n, 0) AS n, coalesce(t.q, 0) AS q FROM z_sent s LEFT JOIN (
      SELECT doc_id, pos, count(*) AS n, sum(pow(0.4 + 0.6 * tf / m, 2)) AS q FROM (SELECT *, CAST(max(tf) OVER (PARTITION BY doc_id, pos) AS DOUBLE) AS m FROM z_tf) GROUP BY ALL) t USING (doc_id, pos)""",
    "z_sent", "z_tf",
)


@query("q_x1_sentences", cte("z_sent") + f" SELECT doc_id, CAST(pos AS INT) AS pos, {digest_sql('sentence')} FROM z_sent")
def x1(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode_outer(Z.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.where("pos is not null").select("doc_id", "pos", *digest(F.col("sentence")))


@query("q_x3_sentence_weights", cte("z_w") + f" SELECT doc_id, CAST(pos AS INT) AS pos, CAST(n AS INT) AS n_terms, {rnd('q', 5)} AS tf_weight FROM z_w")
def x3(spark, sf):
    return Z.sentence_weights(table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", "pos", "n_terms", F.round("tf_weight", 5).alias("tf_weight"))


@query(
    "q_x4_sentence_scores",
    cte("z_w", "z_vocab") + f" SELECT doc_id, CAST(pos AS INT) AS pos, {rnd('CASE WHEN n > 0 THEN sqrt(q + 0.16 * (v - n)) ELSE 0 END', 5)} AS score FROM z_w LEFT JOIN z_vocab USING (doc_id)",
)
def x4_scores(spark, sf):
    return Z.sentence_scores(table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", "pos", F.round("score", 5).alias("score"))


def _summary_sql(n: int) -> str:
    # Twelve decimals here would split ties the frame side rounds together; both sides rank at nine.
    return f"""SELECT doc_id, {digest_sql("coalesce(s, '')")} FROM documents LEFT JOIN (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n > 0 DESC, {rnd('q - 0.16 * n', 9)} DESC, pos) AS r FROM z_w) WHERE r <= {n} GROUP BY doc_id) USING (doc_id)"""


@query("q_x4_summaries", cte("z_w") + " " + _summary_sql(3))
def x4(spark, sf):
    return Z.summarize(table(spark, sf, "documents"), ["doc_id"], "text").select("doc_id", *digest(F.col("summary")))


@query("q_k3_top_sentence", cte("z_w") + " " + _summary_sql(1))
def k3(spark, sf):
    return Z.summarize(table(spark, sf, "documents"), ["doc_id"], "text", n=1).select("doc_id", *digest(F.col("summary")))


@query(
    "q_x11_overall_summaries",
    cte("z_w") + f""" SELECT document_id, {digest_sql("s")} FROM (SELECT doc_id // 4 AS document_id, string_agg(sentence, ' ' ORDER BY doc_id, pos) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY n > 0 DESC, {rnd('q - 0.16 * n', 9)} DESC, doc_id, pos) AS r FROM z_w) WHERE r <= 3 GROUP BY doc_id // 4)""",
)
def x11(spark, sf):
    pages = view(spark, sf, "v_pages").withColumnRenamed("ocr_text", "page_text")
    _, overall = Z.page_and_overall_summaries(pages)
    return overall.select("document_id", *digest(F.col("overall_abstract")))


# --- translation ----------------------------------------------------------------------------------
# The translation table holds upper-cased chunks of the documents; chunks of one source are
# missing from it, and one language is marked as failed.

_CHUNKS = "SELECT doc_id, lang, source, unnest(c) AS chunk, unnest(range(len(c))) AS no FROM (SELECT *, list_transform(range(0, CAST(ceil(length(TEXT) / 4500.0) AS BIGINT)), lambda i: substr(TEXT, i * 4500 + 1, 4500)) AS c FROM SRC WHERE NOT BLANK)"


def _translations(spark, sf, target):
    d = table(spark, sf, "documents").where("doc_id % 10 <> 3")
    chunks = L.chunk_rows(d, ["doc_id", "lang"], "text", F.lit(target))
    return chunks.groupBy("chunk_hash", "target").agg(
        F.max(F.when(F.col("lang") != "es", F.concat(F.lit("<"), F.replace("chunk", F.lit("e"), F.lit("E"))))).alias("translated"),
        F.max(F.when(F.col("lang") == "es", "quota")).alias("error"),
    )


def _chunk_sql(source: str, text: str) -> str:
    return _CHUNKS.replace("TEXT", text).replace("SRC", source).replace("BLANK", blank(text))


sql_view("t_table", f"SELECT chunk, max(CASE WHEN lang <> 'es' THEN '<' || replace(chunk, 'e', 'E') END) AS tr, max(CASE WHEN lang = 'es' THEN 'quota' END) AS err FROM ({_chunk_sql('documents', 'text')}) WHERE doc_id % 10 <> 3 GROUP BY chunk")
_TRANSLATED = """SELECT k, CASE WHEN count(*) > count(tr) THEN '[translation unavailable: ' || min_by(coalesce(err, 'no translation for chunk'), no) FILTER (WHERE tr IS NULL) || ']' ELSE string_agg(tr, '' ORDER BY no) END AS t
  FROM (SELECT c.doc_id AS k, c.no, x.tr, x.err FROM (CHUNKS) c LEFT JOIN t_table x USING (chunk)) GROUP BY k"""


@query(
    "q_x6_translate",
    cte("t_table") + f" SELECT doc_id, {digest_sql(chr(99) + 'oalesce(t, ' + chr(39) * 2 + ')')} FROM documents LEFT JOIN ({_TRANSLATED.replace('CHUNKS', _chunk_sql('documents', 'text'))}) ON k = doc_id",
)
def x6(spark, sf):
    d = table(spark, sf, "documents")
    out = L.translate(d, ["doc_id"], "text", F.lit("hi"), _translations(spark, sf, "hi"))
    return out.select("doc_id", *digest(F.col("translation")))


@query("q_j10_chunk_lookup", cte("t_table") + f" SELECT doc_id, CAST(no AS INT) AS chunk_no, md5(tr) AS tr_md5, err AS error FROM ({_chunk_sql('documents', 'text')}) LEFT JOIN t_table USING (chunk)")
def j10(spark, sf):
    found = L.look_up(table(spark, sf, "documents"), ["doc_id"], "text", F.lit("xx"), _translations(spark, sf, "hi"))
    return found.where("chunk_no is not null").select("doc_id", "chunk_no", F.md5("translated").alias("tr_md5"), "error")


_NATIVE = f"coalesce({filled('corrected_ocr_text', 'ocr_text')}, '')"
sql_view("t_pages", f"SELECT document_id * 4 + page_index AS doc_id, document_id, page_index, lang, source, {strip(_NATIVE)} AS src FROM v_pages", "v_pages")
sql_view("t_page_tr", f"SELECT p.document_id, p.page_index, coalesce(t, '') AS tr FROM t_pages p LEFT JOIN ({_TRANSLATED.replace('CHUNKS', _chunk_sql('t_pages', 'src'))}) ON k = p.doc_id", "t_pages", "t_table")

_TRANSLATED_VOLUMES = f"""SELECT document_id, CAST(page_index // {VOLUME_PAGES} AS INT) AS volume, string_agg('=== PAGE ' || CAST(page_index + 1 AS VARCHAR) || ' ===' || {NL} || {strip('tr')}, {NL2} ORDER BY page_index) AS t
  FROM t_page_tr GROUP BY document_id, page_index // {VOLUME_PAGES}"""


@query(
    "q_x8_ocr_to_english",
    cte("t_page_tr") + f" SELECT document_id, volume, {digest_sql('t')} FROM ({_TRANSLATED_VOLUMES})",
)
def x8(spark, sf):
    _, docs = L.ocr_to_english(view(spark, sf, "v_pages"), _translations(spark, sf, "en"))
    return docs.select("document_id", "volume", *digest(F.col("corrected_ocr_english")))


def _page_translations(spark, sf):
    source = strip_ws(F.coalesce(first_filled(F.col("corrected_ocr_text"), F.col("ocr_text")), F.lit("")))
    pages = view(spark, sf, "v_pages").select("document_id", "page_index", source.alias("translate_source"))
    return L.page_translations(pages, F.lit("hi"), _translations(spark, sf, "hi"))


@query("q_x7_document_translations", cte("t_page_tr") + f" SELECT document_id, volume, {digest_sql('t')} FROM ({_TRANSLATED_VOLUMES})")
def x7_documents(spark, sf):
    _, docs = _page_translations(spark, sf)
    return docs.select("document_id", "volume", *digest(F.col("translation")))


@query("q_x7_page_translations", cte("t_page_tr") + f" SELECT document_id, page_index, {digest_sql('tr')} FROM t_page_tr")
def x7(spark, sf):
    per_page, _ = _page_translations(spark, sf)
    return per_page.select("document_id", "page_index", *digest(F.col("page_translation")))


# --- chat --------------------------------------------------------------------------------------------

sql_view(
    "h_last",
    f"""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, first(role) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS l FROM (
      SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM v_chat WHERE NOT {blank('text')})) WHERE r <= 20 AND l = 'user'""",
    "v_chat",
)


@query("q_w7_last_turns", cte("h_last") + " SELECT conv_id, turn, role, md5(text) AS text_md5 FROM h_last")
def w7(spark, sf):
    return H.last_turns(view(spark, sf, "v_chat"), ["conv_id"]).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


sql_view(
    "h_merged",
    f"""SELECT conv_id, CAST(m AS INT) AS message_no, CASE role WHEN 'user' THEN 'user' ELSE 'model' END AS role, string_agg({strip('text')}, '|' ORDER BY turn) AS parts FROM (
      SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM h_last)) GROUP BY conv_id, m, role""",
    "h_last",
)


@query("q_w8_merged_turns", cte("h_merged") + " SELECT conv_id, message_no, role, md5(parts) AS parts_md5 FROM h_merged")
def w8(spark, sf):
    merged = H.merge_turns(H.last_turns(view(spark, sf, "v_chat"), ["conv_id"]), ["conv_id"])
    return merged.select("conv_id", "message_no", "role", F.md5(F.array_join("parts", "|")).alias("parts_md5"))


@query(
    "q_x10_chat_requests",
    cte("r_row_text", "v_text_docs", "h_merged") + f""", ctx AS (SELECT document_id, count(*) AS n, string_agg('--- PAGE ' || CAST(page_index + 1 AS VARCHAR) || ' ---' || {NL} || page_text, {NL2} ORDER BY page_index) AS t
        FROM r_row_text WHERE page_text <> '' GROUP BY document_id), cut AS (SELECT document_id, n, CASE WHEN length(t) > 30000 THEN substr(t, 1, 15000) || {NL2} || '[...content trimmed for length...]' || {NL2} || right(t, 15000) ELSE t END AS t FROM ctx),
      meta AS (SELECT document_id, concat_ws({NL}, 'Classification: ' || nullif(doc_class, ''), 'Filename: ' || nullif(filename, ''), 'Document-wide summary:' || {NL} || {stripped(filled('corrected_overall_abstract', 'overall_abstract'))}) AS m FROM v_text_docs),
      msg AS (SELECT conv_id, count(*) AS k FROM h_merged GROUP BY conv_id)
      SELECT c.document_id, md5(CASE WHEN m <> '' THEN '---' || {NL} || 'METADATA' || {NL} || m || {NL} ELSE '' END || '---' || {NL} || 'DOCUMENT TEXT (English when available)' || {NL} || t) AS system_md5,
      CAST(k AS INT) AS n_messages, n AS used_pages FROM cut c JOIN meta USING (document_id) JOIN msg ON conv_id = c.document_id""",
)
def x10(spark, sf):
    turns = H.merge_turns(H.last_turns(view(spark, sf, "v_chat"), ["conv_id"]), ["conv_id"]).withColumnRenamed("conv_id", "document_id")
    made = H.chat_requests(H.chat_context(view(spark, sf, "v_text_pages")), view(spark, sf, "v_text_docs"), turns)
    return made.select("document_id", F.md5("system").alias("system_md5"), F.size("messages").alias("n_messages"), "used_pages")


# --- the whole chain --------------------------------------------------------------------------------

@query("q_g7_auto_chain")
def g7(spark, sf):
    from quire.plans.chain import run_chain

    docs = view(spark, sf, "v_text_docs").select("document_id", "filename", F.lit("hi").alias("target_language"), F.lit("ocr").alias("current_stage"), F.lit("pending").alias("status"))
    pages = view(spark, sf, "v_text_pages").select("document_id", "page_index", "ocr_text", "corrected_ocr_text", "ocr_text_english", "corrected_ocr_text_english")
    result = run_chain(docs, pages, _translations(spark, sf, "en").union(_translations(spark, sf, "hi")))
    return result.documents.select(
        "document_id", "current_stage", "status", "doc_class", F.length("abstract").alias("abstract_chars"), F.length("overall_abstract").alias("overall_chars"),
        F.size("index_metadata.keywords").alias("n_keywords"), F.length("translation").alias("translation_chars"),
    )


# Documents with page rows, and the same texts once more as documents without any.
_BARE = 10_000_000


@query(
    "q_g7_stage_runs",
    cte("v_text_docs", "v_text_pages") + f""", d AS (
  SELECT document_id, raw_ocr FROM v_text_docs UNION ALL SELECT document_id + {_BARE}, raw_ocr FROM v_text_docs),
t AS (SELECT document_id, count(*) AS n, bool_or({stripped(filled('corrected_ocr_text', 'ocr_text'))} IS NOT NULL) AS has,
    string_agg('=== PAGE ' || CAST(page_index + 1 AS VARCHAR) || ' ===' || {NL} || {strip(f"coalesce({filled('corrected_ocr_text', 'ocr_text')}, '')")}, {NL2} ORDER BY page_index) AS j
  FROM v_text_pages GROUP BY document_id),
s AS (SELECT d.document_id, coalesce(t.n, 0) AS n, CASE WHEN t.n IS NULL THEN NOT {blank('d.raw_ocr')} ELSE t.has END AS goes, CASE WHEN t.n IS NULL THEN d.raw_ocr ELSE t.j END AS txt
  FROM d LEFT JOIN t USING (document_id)),
r AS (
  SELECT document_id, 'ocr' AS stage, 'qc_pending' AS status, '{{"pages":' || CAST(n AS VARCHAR) || '}}' AS note, goes, txt FROM s
  UNION ALL SELECT document_id, stage, CASE WHEN stage = 'lingua' THEN 'approved' ELSE 'qc_pending' END, NULL, goes, txt FROM s, (VALUES ('doc_class'), ('index_genius'), ('abstractor'), ('lingua')) AS x(stage) WHERE goes
  UNION ALL SELECT document_id, 'doc_class', 'error', CASE WHEN n = 0 THEN 'No OCR text yet' ELSE 'No OCR text on any page' END, goes, txt FROM s WHERE NOT goes)
SELECT document_id, stage, status, note, CASE WHEN goes THEN md5(txt) END AS text_md5 FROM r""",
)
def g7_runs(spark, sf):
    """Every stage run and refusal of the chain, with the text that each document went through with."""
    from quire.plans.chain import run_chain

    own = view(spark, sf, "v_text_docs").select("document_id", "raw_ocr")
    docs = own.select(F.explode(F.array("document_id", F.col("document_id") + _BARE)).alias("document_id"), "raw_ocr")
    pages = view(spark, sf, "v_text_pages").select("document_id", "page_index", "ocr_text", "corrected_ocr_text")
    result = run_chain(docs, pages, _translations(spark, sf, "en").union(_translations(spark, sf, "hi")))
    runs = result.runs.where("payload IS NULL OR payload NOT LIKE '%action%'").select("document_id", "stage", "status", F.col("payload").alias("note"))
    refused = result.errors.select("document_id", "stage", F.lit("error").alias("status"), F.col("message").alias("note"))
    return runs.union(refused).join(result.documents.select("document_id", F.md5("raw_ocr").alias("text_md5")), "document_id", "left")
