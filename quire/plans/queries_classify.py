"""Queries on classification. The SQL side fits the 13-text corpus of each page outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.dims import CLASS_HINTS, CLASS_PROTOTYPES
from quire.functions.model_json import clean_json, metatags, summary_answer
from quire.functions.text import let
from quire.operators import classify as C
from quire.operators import review as V
from quire.plans.registry import cte, digest, digest_sql, query, rnd, rows_where, sql_view, squash, strip, view

KEY = ["document_id", "page_index"]
_TOKEN_SQL = r"[\pL\pN_]{2,}"
_q = lambda s: "'" + s.replace("'", "''") + "'"

sql_view("c_prep", f"SELECT document_id, page_index, low FROM (SELECT document_id, page_index, {squash('ocr_text')} AS low FROM v_pages)", "v_pages")
sql_view("c_class", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(c)}, {_q(t)})" for i, (c, t) in enumerate(CLASS_PROTOTYPES.items())) + ") AS t(class_pos, class_name, proto)")
sql_view("c_hint", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(h)})" for i, hs in enumerate(CLASS_HINTS.values()) for h in hs) + ") AS t(class_pos, hint)")


def _terms(source: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, term, count(*) AS tf FROM (
      SELECT {keys}, unnest(list_concat(w, list_transform(list_zip(w[1:-2], w[2:]), lambda g: g[1] || ' ' || g[2]))) AS term
      FROM (SELECT {keys}, regexp_extract_all({text}, '{_TOKEN_SQL}') AS w FROM {source})) GROUP BY {keys}, term"""


sql_view("c_tf", _terms("c_prep", "document_id, page_index", "low"), "c_prep")
sql_view("c_ptf", _terms("c_class", "class_pos", "proto"), "c_class")
sql_view("c_df", "SELECT term, count(*) AS df FROM c_ptf GROUP BY term", "c_ptf")
# Weights of the page's terms in its own corpus of 13 texts.
sql_view(
    "c_page_w",
    """SELECT t.document_id, t.page_index, t.term, t.tf, (1 + ln(t.tf)) * (ln(14.0 / (2.0 + coalesce(d.df, 0))) + 1) AS w
    FROM c_tf t LEFT JOIN c_df d USING (term) WHERE coalesce(d.df, 0) + 1 <= 0.98 * 13""",
    "c_tf", "c_df",
)
# Weights of every class term against every page.
sql_view(
    "c_class_w",
    """SELECT p.document_id, p.page_index, c.class_pos, c.term,
      (1 + ln(c.tf)) * (ln(14.0 / (1.0 + d.df + CASE WHEN t.term IS NULL THEN 0 ELSE 1 END)) + 1) AS w
    FROM (SELECT DISTINCT document_id, page_index FROM c_prep) p CROSS JOIN c_ptf c JOIN c_df d USING (term)
    LEFT JOIN c_tf t ON t.document_id = p.document_id AND t.page_index = p.page_index AND t.term = c.term
    WHERE d.df + CASE WHEN t.term IS NULL THEN 0 ELSE 1 END <= 0.98 * 13""",
    "c_prep", "c_ptf", "c_df", "c_tf",
)
sql_view(
    "c_cos",
    """SELECT n.document_id, n.page_index, n.class_pos, coalesce(d.dot / nullif(n.norm * p.norm, 0), 0.0) AS cosine
    FROM (SELECT document_id, page_index, class_pos, sqrt(sum(w * w)) AS norm FROM c_class_w GROUP BY ALL) n
    LEFT JOIN (SELECT document_id, page_index, sqrt(sum(w * w)) AS norm FROM c_page_w GROUP BY ALL) p USING (document_id, page_index)
    LEFT JOIN (SELECT a.document_id, a.page_index, b.class_pos, sum(a.w * b.w) AS dot FROM c_page_w a
      JOIN c_class_w b ON a.document_id = b.document_id AND a.page_index = b.page_index AND a.term = b.term GROUP BY ALL) d USING (document_id, page_index, class_pos)""",
    "c_class_w", "c_page_w",
)
sql_view(
    "c_kw",
    """SELECT p.document_id, p.page_index, h.class_pos, least(1.0, count(*) FILTER (WHERE contains(p.low, h.hint)) / greatest(4.0, 0.35 * count(*))) AS keyword
    FROM c_prep p CROSS JOIN c_hint h GROUP BY ALL""",
    "c_prep", "c_hint",
)
sql_view(
    "c_comb",
    """SELECT c.document_id, c.page_index, c.class_pos, CAST(greatest(0.68 * c.cosine + 0.32 * k.keyword, 0) AS DOUBLE) AS combined
    FROM c_cos c JOIN c_kw k USING (document_id, page_index, class_pos)""",
    "c_cos", "c_kw",
)
sql_view(
    "c_prob",
    f"""SELECT document_id, page_index, class_pos, total, {rnd("100 * e / sum(e) OVER (PARTITION BY document_id, page_index)", 2)} AS score FROM (
      SELECT *, exp(14.0 * (combined - max(combined) OVER (PARTITION BY document_id, page_index))) AS e, sum(combined) OVER (PARTITION BY document_id, page_index) AS total FROM c_comb)""",
    "c_comb",
)
sql_view(
    "c_top",
    """SELECT p.document_id, p.page_index, CASE WHEN b.total > 0 THEN c.class_name ELSE 'Unknown' END AS doc_class,
      CASE WHEN p.low = '' OR b.total IS NULL THEN NULL WHEN b.total > 0 THEN b.score ELSE 0.0 END AS score FROM c_prep p
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, page_index ORDER BY score DESC, class_pos) AS r FROM c_prob) b
      ON b.document_id = p.document_id AND b.page_index = p.page_index AND b.r = 1
    LEFT JOIN c_class c ON c.class_pos = b.class_pos""",
    "c_prep", "c_prob", "c_class",
)


def _pages(spark, sf):
    return view(spark, sf, "v_pages")


def _similar(spark, sf):
    return C.class_similarities(_pages(spark, sf), KEY, "ocr_text")


@query("q_c1_tokens", cte("c_tf") + " SELECT document_id, page_index, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, md5(string_agg(term || ':' || CAST(tf AS VARCHAR), '|' ORDER BY term)) AS terms_md5 FROM c_tf GROUP BY document_id, page_index")
def c1(spark, sf):
    prepared = _pages(spark, sf).select(*KEY, C.prepare_text(F.col("ocr_text")).alias("low"))

    def spelled(terms):
        total = F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + t["tf"])
        text = F.array_join(F.transform(terms, lambda t: F.concat(t["term"], F.lit(":"), t["tf"].cast("string"))), "|")
        return F.struct(F.size(terms).cast("bigint").alias("n_terms"), total.alias("n_tokens"), F.md5(text).alias("terms_md5"))

    return rows_where(C.term_counts(prepared, "low"), KEY, let(F.col("terms"), spelled), lambda r: r["n_terms"] > 0)


@query("q_c2_page_norm", cte("c_page_w") + f" SELECT document_id, page_index, {rnd('sqrt(sum(w * w))', 6)} AS norm FROM c_page_w GROUP BY document_id, page_index")
def c2(spark, sf):
    weighted = C.page_norms(_pages(spark, sf), KEY, "ocr_text")
    return weighted.where("norm > 0").select(*KEY, F.round("norm", 6).alias("norm"))


@query("q_c3_cosine", cte("c_cos") + f" SELECT document_id, page_index, CAST(class_pos AS INT) AS class_pos, {rnd('cosine', 6)} AS cosine FROM c_cos")
def c3(spark, sf):
    return _similar(spark, sf).select(*KEY, F.posexplode("cosine").alias("class_pos", "c")).select(*KEY, "class_pos", F.round("c", 6).alias("cosine"))


@query("q_c4_keyword_intent", cte("c_kw") + f" SELECT document_id, page_index, CAST(class_pos AS INT) AS class_pos, {rnd('keyword', 6)} AS keyword FROM c_kw")
def c4(spark, sf):
    # The outer form: from the plain one a filter on the array is derived, which computes it once more, over the unspread scan.
    return _similar(spark, sf).select(*KEY, F.posexplode_outer("keyword").alias("class_pos", "k")).select(*KEY, "class_pos", F.round("k", 6).alias("keyword"))


@query("q_c5_fused", cte("c_comb") + f" SELECT document_id, page_index, CAST(class_pos AS INT) AS class_pos, {rnd('combined', 6)} AS combined FROM c_comb")
def c5(spark, sf):
    fused = _similar(spark, sf).select(*KEY, C.fuse(F.col("cosine"), F.col("keyword")).alias("c"))
    return fused.select(*KEY, F.posexplode("c").alias("class_pos", "c")).select(*KEY, "class_pos", F.round("c", 6).alias("combined"))


def _classified(spark, sf):
    return C.classify(_pages(spark, sf), KEY, "ocr_text")


@query("q_c6_classify", cte("c_top") + f" SELECT document_id, page_index, doc_class, {rnd('score', 1)} AS best_score FROM c_top")
def c6(spark, sf):
    return _classified(spark, sf).select(*KEY, "doc_class", F.round(F.array_max("score_list"), 1).alias("best_score"))


@query("q_w5_softmax_scores", cte("c_prob", "c_class") + f" SELECT document_id, page_index, class_name, {rnd('CASE WHEN total > 0 THEN score ELSE 0 END', 1)} AS score FROM c_prob JOIN c_class USING (class_pos)")
def w5(spark, sf):
    return C.long_scores(_classified(spark, sf), KEY).select(*KEY, "class_name", F.round("score", 1).alias("score"))


@query(
    "q_w10_ranked_classes",
    cte("c_prob", "c_class") + f""", s AS (SELECT document_id, page_index, class_pos, class_name, CASE WHEN total > 0 THEN score ELSE 0 END AS score FROM c_prob JOIN c_class USING (class_pos))
    SELECT document_id, page_index, class_name, CAST(row_number() OVER (PARTITION BY document_id, page_index ORDER BY score DESC, class_pos) AS INT) AS rank,
    {rnd('score / coalesce(nullif(max(score) OVER (PARTITION BY document_id, page_index), 0), 1)', 2)} AS bar FROM s""",
)
def w10(spark, sf):
    ranked = C.ranked_classes(C.long_scores(_classified(spark, sf), KEY), KEY)
    return ranked.select(*KEY, "class_name", "rank", F.round("bar", 2).alias("bar"))


@query(
    "q_a15_class_argmax",
    cte("c_top") + " SELECT doc_class, count(*) AS n FROM c_top GROUP BY doc_class",
)
def a15(spark, sf):
    return _classified(spark, sf).groupBy("doc_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_a3_document_class",
    cte("v_text_pages") + """ SELECT document_id, doc_class FROM (SELECT document_id, min_by(page_doc_class, page_index) FILTER (WHERE coalesce(page_doc_class, '') <> '') AS doc_class FROM v_text_pages GROUP BY document_id)""",
)
def a3(spark, sf):
    pages = view(spark, sf, "v_text_pages").withColumn("page_doc_class_scores", F.create_map(F.lit("x"), F.lit(1.0)))
    return C.rollup_document_class(pages).select("document_id", "doc_class")


# A document's hint phrases, as an explicit text-contains-phrase test over another table.
@query(
    "q_j6_hint_hits",
    "WITH c_hint AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(h)})" for i, hs in enumerate(CLASS_HINTS.values()) for h in hs)
    + f""") AS t(class_pos, hint)), low AS (SELECT page_id, {squash('html')} AS low FROM pages)
    SELECT page_id, CAST(class_pos AS INT) AS class_pos, {rnd('least(1.0, count(*) FILTER (WHERE contains(low, hint)) / greatest(4.0, 0.35 * count(*)))', 6)} AS keyword
    FROM low CROSS JOIN c_hint GROUP BY page_id, class_pos""",
)
def j6(spark, sf):
    from quire.plans.registry import table

    low = table(spark, sf, "pages").select("page_id", C.prepare_text(F.col("html")).alias("low"))
    hits = F.array(*[C.keyword_intent(F.col("low"), hs) for hs in CLASS_HINTS.values()])
    return low.select("page_id", F.posexplode(hits).alias("class_pos", "k")).select("page_id", "class_pos", F.round("k", 6).alias("keyword"))


@query(
    "q_j5_shared_terms",
    cte("c_tf", "c_ptf") + " SELECT document_id, page_index, CAST(class_pos AS INT) AS class_pos, count(*) AS shared FROM c_tf JOIN c_ptf USING (term) GROUP BY ALL",
)
def j5(spark, sf):
    return C.shared_terms(_pages(spark, sf), KEY, "ocr_text").groupBy(*KEY, "class_pos").agg(F.count(F.lit(1)).alias("shared"))


# --- labels and model answers ---------------------------------------------------------------

_LABEL = """CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN ' gazette' WHEN 1 THEN 'Budget Speech ' WHEN 2 THEN 'LIST OF BUSINESS' WHEN 3 THEN 'Memo'
  WHEN 4 THEN 'Unknown' WHEN 5 THEN '' ELSE l_shipmode END"""
_CLASSES = "(" + ", ".join(_q(c) for c in CLASS_PROTOTYPES) + ")"
_LABEL = _LABEL.replace("l_shipmode", "l_returnflag")


@query(
    "q_p10_validate_class",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, {strip(_LABEL)} AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN v.v = 'Unknown' THEN v.v END, c.name, 'Unknown') AS label
    FROM v LEFT JOIN (SELECT unnest([{', '.join(_q(c) for c in CLASS_PROTOTYPES)}]) AS name) c ON lower(c.name) = lower(v.v)""",
)
def p10(spark, sf):
    from quire.plans.registry import table

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.validate_class(F.expr(_LABEL)).alias("label"))


def _expected_answers() -> str:
    """What each of the nine answer shapes must come to."""
    return """SELECT document_id,
      CASE CAST(document_id % 9 AS INT) WHEN 0 THEN 'Budget Speech' WHEN 1 THEN 'Election' WHEN 2 THEN 'Gazette' WHEN 6 THEN 'Bulletin' WHEN 8 THEN 'Calendar' END AS model_class,
      CASE CAST(document_id % 9 AS INT) WHEN 0 THEN CAST(document_id % 100 AS DOUBLE) WHEN 1 THEN 100.0 WHEN 2 THEN 60.0 WHEN 6 THEN 100.0 WHEN 8 THEN 3.5 END AS model_score,
      CAST(CASE CAST(document_id % 9 AS INT) WHEN 0 THEN 2 WHEN 1 THEN 12 WHEN 2 THEN 2 WHEN 6 THEN 12 WHEN 8 THEN 2 END AS INT) AS n_scores FROM v_answers"""


@query("q_c7_model_class", cte("v_answers") + " " + _expected_answers())
def c7(spark, sf):
    parsed = C.parse_model_class(view(spark, sf, "v_answers"), "raw")
    n = F.when(F.col("model_scores").isNotNull(), F.size("model_scores"))
    score = F.try_element_at(F.col("model_scores"), F.col("model_class"))
    return parsed.select("document_id", "model_class", score.alias("model_score"), n.alias("n_scores"))


@query(
    "q_c8_model_json",
    cte("v_answers") + f""", c AS (SELECT document_id, CASE WHEN raw LIKE '```%' THEN {strip("regexp_replace(regexp_replace(raw, '^`+|`+$', '', 'g'), '^json', '')")} ELSE {strip('raw')} END AS j FROM v_answers)
    SELECT document_id, {digest_sql("CASE WHEN j LIKE '{%' AND json_valid(j) THEN j END")} FROM c""",
)
def c8(spark, sf):
    return view(spark, sf, "v_answers").select("document_id", *digest(clean_json(F.col("raw"))))


@query(
    "q_c9_metatags",
    cte("v_answers") + """ SELECT document_id, document_id % 9 = 6 AS has_tags,
      CASE WHEN document_id % 9 = 6 THEN 'a ' || d.lang END AS topics, CASE WHEN document_id % 9 = 6 THEN 'Speaker ' || d.source || ' ' END AS keywords
      FROM v_answers JOIN documents d ON d.doc_id = document_id""",
)
def c9(spark, sf):
    tagged = view(spark, sf, "v_answers").select("document_id", metatags(F.col("raw")).alias("t"))
    return tagged.select("document_id", F.col("t").isNotNull().alias("has_tags"), F.array_join("t.topics", " ").alias("topics"), F.array_join("t.suggested_keywords", " ").alias("keywords"))


@query(
    "q_x2_model_summary",
    cte("v_answers") + """ SELECT document_id, CASE CAST(document_id % 9 AS INT) WHEN 1 THEN 'about ' || d.lang WHEN 6 THEN 's' ELSE '' END AS summary
      FROM v_answers JOIN documents d ON d.doc_id = document_id""",
)
def x2(spark, sf):
    return view(spark, sf, "v_answers").select("document_id", summary_answer(F.col("raw")).alias("summary"))


# --- class corrections ------------------------------------------------------------------------

_CORR = """SELECT doc_id // 4 AS document_id, CASE WHEN doc_id % 8 < 4 THEN CAST(doc_id % 4 AS INT) END AS page_index, 'set ' || source AS doc_class
  FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM labels WHERE toxic = 0 GROUP BY doc_id // 4)"""
sql_view("s_corr", _CORR)
sql_view(
    "r_class_pages",
    """SELECT p.document_id, p.page_index, CASE WHEN c.document_id IS NOT NULL THEN c.doc_class ELSE p.page_doc_class END AS page_doc_class
    FROM v_text_pages p LEFT JOIN s_corr c ON c.document_id = p.document_id AND c.page_index = p.page_index""",
    "v_text_pages", "s_corr",
)


def _corrections(spark, sf):
    from quire.plans.registry import table

    chosen = table(spark, sf, "labels").where("toxic = 0").groupBy(F.floor(F.col("doc_id") / 4)).agg(F.min("doc_id").alias("doc_id"))
    d = table(spark, sf, "documents").join(chosen.select("doc_id"), "doc_id", "left_semi")
    return d.select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("document_id"),
        F.when(F.col("doc_id") % 8 < 4, (F.col("doc_id") % 4).cast("int")).alias("page_index"),
        F.concat(F.lit("set "), F.col("source")).alias("doc_class"),
    )


def _corrected(spark, sf):
    docs = view(spark, sf, "v_text_docs").withColumn("doc_class_scores", F.lit(None).cast("map<string,double>"))
    pages = view(spark, sf, "v_text_pages").withColumn("page_doc_class_scores", F.lit(None).cast("map<string,double>"))
    return V.correct_class(docs, pages, _corrections(spark, sf))


@query("q_j4_class_correction_pages", cte("r_class_pages") + " SELECT * FROM r_class_pages")
def j4_pages(spark, sf):
    return _corrected(spark, sf)[1].select("document_id", "page_index", "page_doc_class")


@query(
    "q_j4_class_correction_documents",
    cte("r_class_pages", "v_text_docs") + """ SELECT d.document_id, CASE WHEN c.document_id IS NULL THEN d.doc_class WHEN c.page_index IS NULL THEN c.doc_class
      ELSE f.page_doc_class END AS doc_class FROM v_text_docs d LEFT JOIN s_corr c USING (document_id)
      LEFT JOIN (SELECT document_id, page_doc_class FROM r_class_pages QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page_index) = 1) f USING (document_id)""",
)
def j4_docs(spark, sf):
    return _corrected(spark, sf)[0].select("document_id", "doc_class")
