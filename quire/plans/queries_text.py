"""Queries on page text: splitting, joining, choosing, comparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.cer import cer, cer_percent, cer_preview
from quire.operators import page_source as P
from quire.operators import pages as G
from quire.operators import review as V
from quire.operators.chat import chat_context
from quire.plans.registry import (
    MARK_SQL, NL, NL2, NON_WS_SQL, blank, cte, digest, digest_sql, filled, query, rnd, slices_sql, sql_view, squash, strip,
    stripped, table, view,
)

sql_view("s_marked", slices_sql("v_marked", "text"), "v_marked")


@query("q_t1_split_pages", cte("s_marked") + f" SELECT document_id, page_index, {digest_sql('body')} FROM s_marked")
def t1(spark, sf):
    return G.split_marked_pages(view(spark, sf, "v_marked"), "text").select("document_id", "page_index", *digest(F.col("body")))


JOIN_SQL = f"""
SELECT document_id, CAST(0 AS INT) AS volume, {digest_sql('t')} FROM (
  SELECT document_id, string_agg('=== PAGE ' || CAST(page_index + 1 AS VARCHAR) || ' ===' || {NL} || {strip("coalesce(BODY, '')")}, {NL2} ORDER BY page_index) AS t
  FROM PAGES GROUP BY document_id)"""


@query("q_t2_join_pages", cte("v_pages") + JOIN_SQL.replace("BODY", "corrected_ocr_text").replace("PAGES", "v_pages"))
def t2(spark, sf):
    joined = G.join_marked_pages(view(spark, sf, "v_pages"), "corrected_ocr_text")
    return joined.select("document_id", "volume", *digest(F.col("text")))


@query(
    "q_t3_pad_pages",
    cte("s_marked")
    + f""", slots AS (SELECT document_id, unnest(range(6)) AS slot FROM v_marked)
SELECT document_id, CAST(slot AS INT) AS slot, {digest_sql("coalesce(body, '')")}
FROM slots LEFT JOIN s_marked USING (document_id) WHERE s_marked.page_index = slot
UNION ALL
SELECT document_id, CAST(slot AS INT), {digest_sql("''")} FROM slots
WHERE NOT EXISTS (SELECT 1 FROM s_marked m WHERE m.document_id = slots.document_id AND m.page_index = slots.slot)""",
)
def t3(spark, sf):
    padded = view(spark, sf, "v_marked").select(
        "document_id", F.posexplode(X.pad_pages(X.marked_entries(F.col("text")), F.lit(6))).alias("slot", "body")
    )
    return padded.select("document_id", "slot", *digest(F.col("body")))


@query("q_t4_squash", f"SELECT doc_id, {digest_sql('s')} FROM (SELECT doc_id, {squash('text')} AS s FROM documents)")
def t4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *digest(X.squash_ws(F.col("text"))))


@query(
    "q_t5_head_tail",
    f"""SELECT doc_id, {digest_sql('s')} FROM (SELECT doc_id, CASE WHEN length(text) > 3000
    THEN substr(text, 1, 1500) || ' ' || right(text, 1500) ELSE text END AS s FROM documents)""",
)
def t5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *digest(X.head_tail(F.col("text"), 3000, " ")))


# The SQL side counts bytes, so both of its arguments fold non-ASCII characters to one byte.
def _bytes(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '~', 'g')"


def _cer_sql(ref: str, hyp: str) -> str:
    r, h = f"coalesce({ref}, '')", f"coalesce({hyp}, '')"
    return f"""CASE WHEN {r} = '' AND {h} = '' THEN 0.0 WHEN {r} = '' THEN 1.0 WHEN {r} = {h} OR {blank(r)} THEN 0.0
    ELSE CAST(levenshtein({_bytes(strip(r))}, {_bytes(strip(h))}) AS DOUBLE) / nullif(length({strip(r)}), 0) END"""


@query("q_t6_cer", cte("v_pages") + f" SELECT document_id, page_index, {rnd('100 * ' + _cer_sql('corrected_ocr_text', 'ocr_text'), 2)} AS cer FROM v_pages")
def t6(spark, sf):
    pages = view(spark, sf, "v_pages")
    return pages.select("document_id", "page_index", cer_percent(F.col("corrected_ocr_text"), F.col("ocr_text")).alias("cer"))


def _preview_sql(ref: str, hyp: str) -> str:
    r, h = f"substr(coalesce({ref}, ''), 1, 16000)", f"substr(coalesce({hyp}, ''), 1, 16000)"
    return f"""CASE WHEN {r} = '' AND {h} = '' THEN 0.0 WHEN {r} = '' THEN 100.0
    WHEN {r} = {h} THEN 0.0 ELSE {rnd(f"100 * CAST(levenshtein({_bytes(r)}, {_bytes(h)}) AS DOUBLE) / greatest(length({r}), 1)", 2)} END"""


@query("q_t7_cer_preview", cte("v_pages") + f""" SELECT document_id, page_index, CAST({_preview_sql('corrected_ocr_text', 'ocr_text')} AS DOUBLE) AS cer
FROM v_pages""")
def t7(spark, sf):
    pages = view(spark, sf, "v_pages")
    return pages.select("document_id", "page_index", cer_preview(F.col("corrected_ocr_text"), F.col("ocr_text")).alias("cer"))


@query(
    "q_t8_counts",
    f"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '{NON_WS_SQL}'))) AS INT) AS sentences,
    CAST(length(text) AS INT) AS chars FROM documents""",
)
def t8(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.sentence_count(F.col("text")).alias("sentences"), X.char_count(F.col("text")).alias("chars")
    )


_VERDICT = "CASE WHEN event_id % 3 = 0 THEN concat('escalation:', event_type, '_try') WHEN event_id % 3 = 1 THEN concat('iterative_pass_', CAST(event_id % 16 AS STRING)) ELSE 'no_change' END"


@query("q_t9_verdict_label", f"""SELECT event_id, CASE WHEN v LIKE 'escalation:%' THEN substr(v, 12) ELSE replace(v, '_', ' ') END AS label
FROM (SELECT event_id, {_VERDICT} AS v FROM events)""")
def t9(spark, sf):
    return table(spark, sf, "events").select("event_id", X.verdict_label(F.expr(_VERDICT)).alias("label"))


@query(
    "q_t10_format_qs",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '—' ELSE CAST(CAST(round(CAST(value AS DECIMAL(38,12)), 2) AS DECIMAL(38,2)) AS VARCHAR) END AS shown,
    CASE WHEN user_id % 4 > 1 THEN 'Page ' || CAST(event_id % 4 + 1 AS VARCHAR) || '/' || CAST(user_id % 4 AS VARCHAR) || ' · ' ELSE '' END AS prefix FROM events""",
)
def t10(spark, sf):
    value = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    return table(spark, sf, "events").select(
        "event_id", X.format_qs(value).alias("shown"), X.page_prefix(F.col("event_id") % 4 + 1, F.col("user_id") % 4).alias("prefix")
    )


# --- choosing text -----------------------------------------------------------------

sql_view("s_en", slices_sql("v_text_docs", filled("corrected_ocr_english", "raw_ocr_english")), "v_text_docs")
sql_view("s_native", slices_sql("v_text_docs", filled("corrected_ocr", "raw_ocr")), "v_text_docs")
for _name, _field in (("s_cocr", "corrected_ocr"), ("s_rocr", "raw_ocr"), ("s_cabs", "corrected_abstract"), ("s_abs", "abstract"),
                      ("s_cen", "corrected_ocr_english"), ("s_ren", "raw_ocr_english")):
    sql_view(_name, slices_sql("v_text_docs", _field), "v_text_docs")


def _slice_joins(**named: str) -> str:
    return " ".join(
        f"LEFT JOIN {v} AS {a} ON {a}.document_id = p.document_id AND {a}.page_index = p.page_index" for a, v in named.items()
    )


P1_SQL = f"""SELECT p.document_id, p.page_index, coalesce(
  {stripped(filled('p.corrected_ocr_text_english', 'p.ocr_text_english'))}, {stripped('e.body')},
  {stripped(filled('p.corrected_ocr_text', 'p.ocr_text'))}, {stripped('n.body')}, '') AS page_text
FROM v_text_pages p {_slice_joins(e='s_en', n='s_native')}"""
sql_view("r_page_text", P1_SQL, "v_text_pages", "s_en", "s_native")


@query("q_p1_page_text", cte("r_page_text") + f" SELECT document_id, page_index, {digest_sql('page_text')} FROM r_page_text")
def p1(spark, sf):
    out = P.page_text(view(spark, sf, "v_text_docs"), view(spark, sf, "v_text_pages"))
    return out.select("document_id", "page_index", *digest(F.col("page_text")))


P2_SQL = f"""SELECT p.document_id, p.page_index, coalesce(
  {stripped(filled('p.corrected_page_abstract', 'p.page_abstract'))}, {stripped(filled('p.corrected_ocr_text', 'p.ocr_text'))},
  {stripped('a.body')}, {stripped('b.body')}, {stripped('c.body')}, {stripped('d.body')}, '') AS translate_source
FROM v_text_pages p {_slice_joins(a='s_cabs', b='s_abs', c='s_cocr', d='s_rocr')}"""
sql_view("r_translate_source", P2_SQL, "v_text_pages", "s_cabs", "s_abs", "s_cocr", "s_rocr")


@query("q_p2_translate_source", cte("r_translate_source") + f" SELECT document_id, page_index, {digest_sql('translate_source')} FROM r_translate_source")
def p2(spark, sf):
    out = P.translate_source(view(spark, sf, "v_text_docs"), view(spark, sf, "v_text_pages"))
    return out.select("document_id", "page_index", *digest(F.col("translate_source")))


def _doc_chain(name: str, fn, *fields: str) -> None:
    sql = cte("v_text_docs") + f" SELECT document_id, {digest_sql('coalesce(' + filled(*fields) + chr(44) + chr(39) * 2 + ')')} FROM v_text_docs"

    @query(name, sql)
    def run(spark, sf):
        return view(spark, sf, "v_text_docs").select("document_id", *digest(fn()))


_doc_chain("q_p3_document_text", P.document_text, "corrected_ocr_english", "raw_ocr_english", "corrected_ocr", "raw_ocr")
_doc_chain("q_p4_summary_source", P.summary_source, "corrected_ocr", "raw_ocr")
_doc_chain("q_p5_lingua_source", P.lingua_source, "corrected_abstract", "abstract", "corrected_ocr", "raw_ocr")
_doc_chain(
    "q_p20_preview_source", P.lingua_preview_source, "corrected_overall_abstract", "overall_abstract", "corrected_abstract",
    "abstract", "corrected_ocr_english", "raw_ocr_english", "corrected_ocr", "raw_ocr",
)


def _editor(kind: str, row: tuple[str, str], joins: dict[str, str]) -> None:
    value = f"coalesce(p.{row[0]}, p.{row[1]})"
    rest = ", ".join(f"{a}.body" for a in joins)
    sql = cte("v_text_pages", *joins.values()) + f""" SELECT p.document_id, p.page_index, {digest_sql(f"CASE WHEN NOT {blank(value)} THEN {value} ELSE coalesce({rest}, '') END")}
    FROM v_text_pages p {_slice_joins(**joins)}"""

    @query(f"q_p6_editor_{kind}", sql)
    def run(spark, sf):
        out = P.editor_page_text(view(spark, sf, "v_text_docs"), view(spark, sf, "v_text_pages"), kind)
        return out.select("document_id", "page_index", *digest(F.col("editor_text")))


_editor("ocr", ("corrected_ocr_text", "ocr_text"), {"a": "s_cocr"})
_editor("english", ("corrected_ocr_text_english", "ocr_text_english"), {"a": "s_cen", "b": "s_ren"})
_editor("abstract", ("corrected_page_abstract", "page_abstract"), {"a": "s_cabs", "b": "s_abs"})


ROW_TEXT_SQL = f"coalesce({stripped(filled('corrected_ocr_text_english', 'ocr_text_english'))}, {stripped(filled('corrected_ocr_text', 'ocr_text'))}, '')"
sql_view("r_row_text", f"SELECT *, {ROW_TEXT_SQL} AS page_text FROM v_text_pages", "v_text_pages")


@query(
    "q_p7_skip_without_text",
    cte("r_row_text") + """ SELECT document_id, page_index, page_text = '' AS skipped, CASE WHEN page_text = '' THEN 'no_ocr_text' END AS reason FROM r_row_text""",
)
def p7(spark, sf):
    pages = P.skip_without_text(P.page_row_text(view(spark, sf, "v_text_pages")))
    return pages.select("document_id", "page_index", "skipped", "reason")


@query("q_p7_documents_without_text", cte("v_marked") + f" SELECT document_id FROM v_marked WHERE {blank('text')}")
def p7_docs(spark, sf):
    return P.documents_without_text(view(spark, sf, "v_marked").withColumn("text", X.strip_ws(F.col("text"))), "text")


@query("q_p16_has_markers", cte("v_marked") + f" SELECT document_id, regexp_matches(text, '{MARK_SQL}') AS has_markers FROM v_marked")
def p16(spark, sf):
    return view(spark, sf, "v_marked").select("document_id", X.has_page_markers(F.col("text")).alias("has_markers"))


# --- joins ---------------------------------------------------------------------------

@query(
    "q_j1_documents_pages",
    cte("v_docs", "v_scored_pages") + """ SELECT d.document_id, d.status, p.page_index, p.passes FROM v_docs d LEFT JOIN v_scored_pages p ON d.document_id = p.document_id""",
)
def j1(spark, sf):
    joined = G.documents_with_pages(view(spark, sf, "v_docs"), view(spark, sf, "v_scored_pages"))
    return joined.select("document_id", "status", "page_index", "passes")


_PATCHES = "SELECT doc_id // 4 AS document_id, CAST(doc_id % 4 + CASE WHEN doc_id % 10 = 0 THEN 10 ELSE 0 END AS INT) AS page_index, CASE WHEN doc_id % 8 = 0 THEN '' ELSE upper(source) END AS t FROM documents WHERE quality_bit"


def _patches(spark, sf, column):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    page = F.col("doc_id") % 4 + F.when(F.col("doc_id") % 10 == 0, 10).otherwise(0)
    return d.select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("document_id"), page.cast("int").alias("page_index"),
        F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.upper("source")).alias(column),
    )


sql_view(
    "s_patches",
    _PATCHES.replace("WHERE quality_bit", "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
)
sql_view(
    "r_patched",
    """SELECT p.* REPLACE (CASE WHEN x.page_index IS NOT NULL THEN x.t ELSE p.corrected_ocr_text_english END AS corrected_ocr_text_english)
    FROM v_text_pages p LEFT JOIN s_patches x ON x.document_id = p.document_id AND x.page_index = p.page_index""",
    "v_text_pages", "s_patches",
)


@query("q_j2_apply_patches", cte("r_patched") + f" SELECT document_id, page_index, {digest_sql('corrected_ocr_text_english')} FROM r_patched")
def j2(spark, sf):
    out = V.apply_page_patches(view(spark, sf, "v_text_pages"), _patches(spark, sf, "corrected_ocr_text_english"), "corrected_ocr_text_english")
    return out.select("document_id", "page_index", *digest(F.col("corrected_ocr_text_english")))


@query("q_j2_rejoined_text", cte("r_patched") + (
    JOIN_SQL.replace("BODY", "corrected_ocr_text_english").replace("PAGES", "r_patched WHERE document_id IN (SELECT document_id FROM s_patches)").replace("CAST(0 AS INT) AS volume, ", "")))
def j2_rejoined(spark, sf):
    patches = _patches(spark, sf, "corrected_ocr_text_english")
    pages = V.apply_page_patches(view(spark, sf, "v_text_pages"), patches, "corrected_ocr_text_english")
    return V.rejoined(pages, "corrected_ocr_text_english", patches, "t").select("document_id", *digest(F.col("t")))


sql_view(
    "r_spread",
    """SELECT p.* REPLACE (CASE WHEN s.page_index IS NOT NULL THEN s.body ELSE p.corrected_ocr_text END AS corrected_ocr_text)
    FROM v_text_pages p LEFT JOIN s_marked s ON s.document_id = p.document_id AND s.page_index = p.page_index""",
    "v_text_pages", "s_marked",
)


@query("q_j3_apply_split", cte("r_spread") + f" SELECT document_id, page_index, {digest_sql('corrected_ocr_text')} FROM r_spread")
def j3(spark, sf):
    out = V.apply_split_text(view(spark, sf, "v_text_pages"), view(spark, sf, "v_marked"), "text", "corrected_ocr_text")
    return out.select("document_id", "page_index", *digest(F.col("corrected_ocr_text")))


@query(
    "q_j11_has_any_text",
    cte("r_row_text") + " SELECT document_id, filename FROM (SELECT DISTINCT document_id, 'scan_' || document_id || '.pdf' AS filename FROM r_row_text WHERE page_text <> '')",
)
def j11(spark, sf):
    pages = P.page_row_text(view(spark, sf, "v_text_pages"))
    return P.documents_with_text(pages, view(spark, sf, "v_text_docs")).select("document_id", "filename")


WHOLE_SQL = f"""
SELECT document_id, CAST(0 AS INT) AS volume, {digest_sql('t')} FROM (
  SELECT document_id, string_agg({strip('page_text')}, {NL2} ORDER BY page_index) AS t FROM r_row_text WHERE NOT {blank('page_text')} GROUP BY document_id)"""


@query("q_a13_whole_text", cte("r_row_text") + WHOLE_SQL)
def a13(spark, sf):
    pages = P.page_row_text(view(spark, sf, "v_text_pages"))
    return G.whole_document_text(pages, "page_text").select("document_id", "volume", *digest(F.col("text")))


def _context_sql(limit: int) -> str:
    half = limit // 2
    return f"""SELECT document_id, {digest_sql(f"CASE WHEN length(t) > {limit} THEN substr(t, 1, {half}) || {NL2} || '[...content trimmed for length...]' || {NL2} || right(t, {half}) ELSE t END")}, n AS used_pages
FROM (SELECT document_id, count(*) AS n, string_agg('--- PAGE ' || CAST(page_index + 1 AS VARCHAR) || ' ---' || {NL} || page_text, {NL2} ORDER BY page_index) AS t
      FROM r_row_text WHERE page_text <> '' GROUP BY document_id)"""


@query("q_x9_chat_context", cte("r_row_text") + " " + _context_sql(30000))
def x9(spark, sf):
    return chat_context(view(spark, sf, "v_text_pages")).select("document_id", *digest(F.col("context")), "used_pages")


@query("q_a14_used_pages", cte("r_row_text") + " " + _context_sql(4000))
def a14(spark, sf):
    return chat_context(view(spark, sf, "v_text_pages"), max_chars=4000).select("document_id", *digest(F.col("context")), "used_pages")


@query(
    "q_x5_first_sentences",
    f"""SELECT doc_id, {digest_sql("array_to_string(p[1:3], '. ') || CASE WHEN len(p) > 0 THEN '.' ELSE '' END")}
FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, {NL}, ' '), '.'), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM documents)""",
)
def x5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *digest(X.first_sentences(F.col("text"), 3)))


@query("q_k4_first_sentence", f"""SELECT doc_id, {digest_sql("array_to_string(p[1:1], '. ') || CASE WHEN len(p) > 0 THEN '.' ELSE '' END")}
FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, {NL}, ' '), '.'), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM documents)""")
def k4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *digest(X.first_sentences(F.col("text"), 1)))


# --- text corrections ------------------------------------------------------------------

def _requests(spark, sf):
    """Correction blobs: marked text for some documents, plain for others."""
    m = view(spark, sf, "v_marked")
    return m.where("document_id % 3 <> 1").select(
        "document_id", F.when(F.col("document_id") % 2 == 0, F.col("text")).alias("corrected_text"),
        F.when(F.col("document_id") % 3 == 0, F.col("text")).alias("corrected_english"),
    )


sql_view("s_requests", """SELECT document_id, CASE WHEN document_id % 2 = 0 THEN text END AS corrected_text,
  CASE WHEN document_id % 3 = 0 THEN text END AS corrected_english FROM v_marked WHERE document_id % 3 <> 1""", "v_marked")
sql_view("s_req_text", slices_sql("s_requests", "corrected_text"), "s_requests")
sql_view("s_req_en", slices_sql("(SELECT * FROM s_requests WHERE document_id NOT IN (SELECT document_id FROM s_patches))", "corrected_english"), "s_requests", "s_patches")
sql_view(
    "r_corrected_pages",
    """SELECT p.* REPLACE (
      CASE WHEN t.page_index IS NOT NULL THEN t.body ELSE p.corrected_ocr_text END AS corrected_ocr_text,
      CASE WHEN x.page_index IS NOT NULL THEN x.t WHEN e.page_index IS NOT NULL THEN e.body ELSE p.corrected_ocr_text_english END AS corrected_ocr_text_english)
    FROM v_text_pages p LEFT JOIN s_req_text t ON t.document_id = p.document_id AND t.page_index = p.page_index
    LEFT JOIN s_req_en e ON e.document_id = p.document_id AND e.page_index = p.page_index
    LEFT JOIN s_patches x ON x.document_id = p.document_id AND x.page_index = p.page_index""",
    "v_text_pages", "s_req_text", "s_req_en", "s_patches",
)


@query(
    "q_g3_corrected_pages",
    cte("r_corrected_pages") + f""" SELECT document_id, page_index, md5(corrected_ocr_text) AS ocr_md5, md5(corrected_ocr_text_english) AS english_md5 FROM r_corrected_pages""",
)
def g3_pages(spark, sf):
    _, pages = V.correct_ocr(view(spark, sf, "v_text_docs"), view(spark, sf, "v_text_pages"), _requests(spark, sf), _patches(spark, sf, "corrected_ocr_text_english"))
    return pages.select("document_id", "page_index", F.md5("corrected_ocr_text").alias("ocr_md5"), F.md5("corrected_ocr_text_english").alias("english_md5"))


@query(
    "q_g3_corrected_documents",
    cte("r_corrected_pages", "s_requests", "v_text_docs") + f""", joined AS (
  SELECT document_id, string_agg('=== PAGE ' || CAST(page_index + 1 AS VARCHAR) || ' ===' || {NL} || {strip("coalesce(corrected_ocr_text_english, '')")}, {NL2} ORDER BY page_index) AS j
  FROM r_corrected_pages WHERE document_id IN (SELECT document_id FROM s_patches) GROUP BY document_id)
SELECT d.document_id, md5(coalesce(r.corrected_text, d.corrected_ocr)) AS ocr_md5,
  md5(coalesce(j.j, r.corrected_english, d.corrected_ocr_english)) AS english_md5,
  CASE WHEN r.corrected_text IS NOT NULL THEN {rnd('100 * ' + _cer_sql('r.corrected_text', 'd.raw_ocr'), 2)} ELSE d.ocr_cer END AS ocr_cer
FROM v_text_docs d LEFT JOIN s_requests r USING (document_id) LEFT JOIN joined j USING (document_id)""",
)
def g3_docs(spark, sf):
    docs, _ = V.correct_ocr(view(spark, sf, "v_text_docs"), view(spark, sf, "v_text_pages"), _requests(spark, sf), _patches(spark, sf, "corrected_ocr_text_english"))
    return docs.select("document_id", F.md5("corrected_ocr").alias("ocr_md5"), F.md5("corrected_ocr_english").alias("english_md5"), "ocr_cer")


# Model and corrected abstracts are whole page texts that differ by the blank before some sentences.
_ABSTRACT_PAGES = f"""
SELECT document_id, page_index, CASE WHEN page_index = 2 OR document_id % 5 = 4 THEN '' ELSE ocr_text END AS page_abstract,
  CASE WHEN page_index = 1 THEN NULL ELSE replace(ocr_text, '. T', '.T') END AS corrected_page_abstract FROM v_pages"""
sql_view("v_abs", _ABSTRACT_PAGES, "v_pages")


def _abstract_pages(spark, sf):
    return spark.sql(_ABSTRACT_PAGES.replace("v_pages", "{v_pages}"), v_pages=view(spark, sf, "v_pages"))


@query(
    "q_a4_mean_cer",
    cte("v_abs", "v_text_docs") + f""" SELECT d.document_id, coalesce({rnd('100 * m', 2)}, CASE WHEN coalesce(d.abstract, '') <> '' THEN {rnd('100 * ' + _cer_sql('d.corrected_abstract', 'd.abstract'), 2)} END) AS abstract_cer
FROM v_text_docs d LEFT JOIN (SELECT document_id, avg(CASE WHEN coalesce(page_abstract, '') <> '' THEN {_cer_sql('corrected_page_abstract', 'page_abstract')} END) AS m
  FROM v_abs GROUP BY document_id) USING (document_id)""",
)
def a4(spark, sf):
    return V.mean_abstract_cer(_abstract_pages(spark, sf), view(spark, sf, "v_text_docs"))


@query(
    "q_p22_cer_display",
    cte("v_pages", "v_text_docs", "s_rocr") + f""" SELECT p.document_id, p.page_index, CAST({_preview_sql('p.corrected_ocr_text', f"CASE WHEN NOT {blank('p.ocr_text')} THEN p.ocr_text ELSE coalesce(s.body, '') END")} AS DOUBLE) AS cer
FROM v_pages p LEFT JOIN s_rocr s ON s.document_id = p.document_id AND s.page_index = p.page_index""",
)
def p22(spark, sf):
    from quire.operators.status import ocr_cer_display

    return ocr_cer_display(view(spark, sf, "v_text_docs"), view(spark, sf, "v_pages"))


@query(
    "q_g4_corrected_abstracts",
    cte("v_abs", "v_text_docs", "s_patches") + f""", pages AS (
  SELECT a.document_id, a.page_index, a.page_abstract, CASE WHEN x.page_index IS NOT NULL THEN x.t ELSE a.corrected_page_abstract END AS corrected_page_abstract
  FROM v_abs a LEFT JOIN s_patches x ON x.document_id = a.document_id AND x.page_index = a.page_index),
touched AS (SELECT DISTINCT document_id FROM s_patches),
texts AS (SELECT document_id, string_agg('=== PAGE ' || CAST(page_index + 1 AS VARCHAR) || ' ===' || {NL} || {strip("coalesce(corrected_page_abstract, '')")}, {NL2} ORDER BY page_index) AS j
  FROM pages WHERE document_id IN (SELECT document_id FROM touched) GROUP BY document_id),
rates AS (SELECT document_id, avg(CASE WHEN coalesce(page_abstract, '') <> '' THEN {_cer_sql('corrected_page_abstract', 'page_abstract')} END) AS m FROM pages GROUP BY document_id)
SELECT d.document_id, md5(coalesce(t.j, d.corrected_abstract)) AS abstract_md5,
  CASE WHEN d.document_id % 6 = 0 THEN 'reviewed' ELSE d.corrected_overall_abstract END AS overall,
  CASE WHEN d.document_id % 6 = 0 OR d.document_id IN (SELECT document_id FROM touched) THEN coalesce({rnd('100 * r.m', 2)},
    CASE WHEN coalesce(d.abstract, '') <> '' THEN {rnd('100 * ' + _cer_sql('coalesce(t.j, d.corrected_abstract)', 'd.abstract'), 2)} END) END AS abstract_cer
FROM v_text_docs d LEFT JOIN texts t USING (document_id) LEFT JOIN rates r USING (document_id)""",
)
def g4(spark, sf):
    docs = view(spark, sf, "v_text_docs").withColumn("abstract_cer", F.lit(None).cast("double"))
    pages = _abstract_pages(spark, sf)
    requests = docs.where("document_id % 6 = 0").select(
        "document_id", F.lit(None).cast("string").alias("corrected_abstract"), F.lit("reviewed").alias("corrected_overall_abstract")
    )
    new_docs, _, _ = V.correct_abstract(docs, pages, requests, _patches(spark, sf, "corrected_page_abstract"))
    return new_docs.select("document_id", F.md5("corrected_abstract").alias("abstract_md5"), F.col("corrected_overall_abstract").alias("overall"), "abstract_cer")
