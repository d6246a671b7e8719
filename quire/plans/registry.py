"""Registry of named queries with their SQL twins, and the derived input views.

Views are given twice: as Spark frames over a data folder, and as common table
expressions for the SQL side. Plain projections share one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip_ws

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- SQL text helpers -----------------------------------------------------------

_WS_IN = r"\s\x0B\x1C-\x1F\x{85}\pZ"
WS_SQL = f"[{_WS_IN}]"
NON_WS_SQL = f"[^{_WS_IN}]"
MARK_SQL = rf"(?m)^=== PAGE (\d+) ==={WS_SQL}*$"
NL = "chr(10)"
NL2 = "chr(10) || chr(10)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def blank(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, '{NON_WS_SQL}'), false))"


def rnd(x: str, n: int) -> str:
    """Half-up rounding of a double's shortest decimal form, as Spark rounds."""
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {n}) AS DOUBLE)"


def mean_sql(x: str, n: int = 2) -> str:
    """Mean of two-decimal scores, half up, in whole numbers throughout."""
    cents = f"CAST(sum(CAST(round({rnd(x, 2)} * 100) AS BIGINT)) AS BIGINT)"
    return f"CASE WHEN count({x}) > 0 THEN CAST((2 * {cents} * {10 ** (n - 2)} + count({x})) // (2 * count({x})) AS DOUBLE) / {10 ** n} END"


def squash(x: str) -> str:
    return f"lower(regexp_replace({strip(x)}, '{WS_SQL}+', ' ', 'g'))"


def filled(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ")"


def stripped(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def ascii_words(x: str) -> str:
    """Each non-ASCII letter or digit as an underscore, for the SQL side's word boundaries.

    Those know ASCII only. An underscore is a word character but in none of the
    captured classes, so boundaries fall where a Unicode-aware engine puts them.
    """
    letters = r"\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{370}-\x{52F}"
    return f"regexp_replace({x}, '[{letters}]', '_', 'g')"


# --- views ------------------------------------------------------------------------

SHARED = {
    "v_pages": """
SELECT CAST(floor(doc_id / 4.0) AS BIGINT) AS document_id, CAST(doc_id % 4 AS INT) AS page_index, text AS ocr_text,
       CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN '   '
            WHEN doc_id % 5 = 3 THEN replace(text, 'the', 'teh') ELSE text END AS corrected_ocr_text,
       CASE WHEN lang <> 'en' AND doc_id % 2 = 0 THEN concat('translated ', text) END AS ocr_text_english,
       CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN lang <> 'en' AND doc_id % 3 = 0 THEN concat('checked ', text) END AS corrected_ocr_text_english,
       lang, source
FROM {documents}""",
    # Page rows with gaps, so the document-level slices are reached.
    "v_text_pages": """
SELECT CAST(floor(doc_id / 4.0) AS BIGINT) AS document_id, CAST(doc_id % 4 AS INT) AS page_index,
       CASE WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN ' ' ELSE text END AS ocr_text,
       CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN '   '
            WHEN doc_id % 5 = 3 AND doc_id % 3 = 0 THEN replace(text, 'the', 'teh') END AS corrected_ocr_text,
       CASE WHEN lang <> 'en' AND doc_id % 8 = 0 THEN concat('translated ', text) END AS ocr_text_english,
       CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN lang <> 'en' AND doc_id % 9 = 0 THEN concat('checked ', text) END AS corrected_ocr_text_english,
       CASE WHEN doc_id % 4 = 0 THEN text END AS page_abstract,
       CASE WHEN doc_id % 16 = 0 THEN '  ' WHEN doc_id % 16 = 4 THEN concat('summary ', text) END AS corrected_page_abstract,
       CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' ELSE lang END AS page_doc_class,
       CASE WHEN doc_id % 5 > 1 THEN concat('translated: ', text) END AS page_translation,
       CASE WHEN doc_id % 4 < 3 THEN concat('/scan/enh_', CAST(doc_id AS STRING), '.png') END AS enhanced_path
FROM {documents}""",
    "v_docs": """
SELECT o_orderkey AS document_id, concat('scan_', CAST(o_orderkey AS STRING), '.pdf') AS filename,
       CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'enhancement' WHEN 1 THEN 'ocr' WHEN 2 THEN 'doc_class'
            WHEN 3 THEN 'index_genius' WHEN 4 THEN 'abstractor' ELSE 'lingua' END AS current_stage,
       CASE o_orderstatus WHEN 'O' THEN 'qc_pending' WHEN 'F' THEN 'completed'
            WHEN 'P' THEN 'processing' ELSE 'pending' END AS status,
       o_orderdate AS created_at, o_custkey AS owner_id, o_totalprice AS price
FROM {orders}""",
    "v_raster_stats": """
SELECT l_orderkey AS document_id, l_linenumber - 1 AS page_index,
       max(l_quantity) * 5.1 AS mean_gray, max(l_discount) * 900.0 AS std_gray,
       max(l_extendedprice) / 40.0 AS laplacian_variance, max(l_tax) * 400.0 AS noise_std
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # Scored pages: upload score, post score, files and passes.
    "v_scored_pages": """
SELECT l_orderkey AS document_id, CAST(l_linenumber - 1 AS INT) AS page_index,
       concat('/scan/', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '.png') AS image_path,
       CASE WHEN max(l_suppkey) % 9 = 0 THEN NULL ELSE max(l_quantity) * 1.37 END AS initial_qs,
       CASE WHEN max(l_partkey) % 5 = 0 THEN NULL
            ELSE concat('/scan/enh_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '.png') END AS enhanced_path,
       CASE WHEN max(l_partkey) % 7 = 0 THEN NULL ELSE 50.0 + max(l_discount) * 431.0 END AS post_qs,
       CAST(max(l_partkey) % 16 AS INT) AS passes,
       concat('report ', CAST(max(l_suppkey) AS STRING)) AS report
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_scored_docs": """
SELECT o_orderkey AS document_id, concat('/scan/', CAST(o_orderkey AS STRING), '.png') AS original_path,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice / 5000.0 END AS initial_qs,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice / 4000.0 END AS post_qs,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('/scan/enh_', CAST(o_orderkey AS STRING), '.png') END AS enhanced_path
FROM {orders}""",
    # At most 26 candidates per page can ever run (16 passes, 2 clips, 8 recipes): 26 events that follow each other are a page.
    "v_passes": """
SELECT CAST(floor(event_id / 26.0) AS BIGINT) AS page_key, CAST(event_id % 26 + 1 AS INT) AS pass, value / 5.0 AS qs
FROM {events}""",
    "v_stage_runs": """
SELECT event_id AS id, user_id AS document_id,
       CASE event_type WHEN 'view' THEN 'enhancement' WHEN 'click' THEN 'ocr' WHEN 'signup' THEN 'doc_class'
            WHEN 'purchase' THEN 'index_genius' ELSE 'abstractor' END AS stage,
       CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_id % 3 = 0 THEN 'approved'
            WHEN event_id % 3 = 1 THEN 'qc_pending' ELSE 'running' END AS status,
       props AS payload, ts AS started_at
FROM {events}""",
    "v_progress": """
SELECT CAST(user_id AS STRING) AS run_id, event_id AS seq, user_id AS document_id,
       CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'start' WHEN event_type = 'view' THEN 'pass'
            WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'polish' WHEN event_type = 'click' THEN 'escalation_try'
            WHEN event_type = 'purchase' THEN 'page_complete' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'write'
            WHEN event_type = 'signup' THEN 'escalation' WHEN event_id % 40 = 0 THEN 'document'
            WHEN event_id % 5 = 0 THEN 'error' ELSE 'note' END AS phase,
       CAST(event_id % 5 + 1 AS INT) AS page_index,
       CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS INT) END AS page_index_zero,
       CAST(CASE WHEN user_id % 4 = 0 THEN 1 ELSE 5 END AS INT) AS page_total,
       CAST(event_id % 16 + 1 AS INT) AS pass, CAST(16 AS INT) AS max_passes,
       value / 5.0 AS best_qs, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 95.0 END AS target_qs,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 4.0 END AS post_qs,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 6.0 END AS initial_qs,
       CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('/scan/', CAST(event_id AS STRING), '.png') END AS enhanced_path,
       CASE WHEN event_id % 2 = 0 THEN event_type END AS label, concat('message ', CAST(event_id AS STRING)) AS message
FROM {events}""",
    "v_meta_text": """
SELECT o_orderkey AS document_id,
       CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Bulletin' WHEN 1 THEN 'Resolutions'
            WHEN 2 THEN 'Government Bill' ELSE 'Memo' END AS doc_class,
       concat('Eighth Legislative Assembly (Eleventh Session) Bulletin Part - ',
              CASE WHEN o_orderkey % 3 = 0 THEN 'II' ELSE '3' END, ' dated ',
              CASE CAST(o_orderkey % 4 AS INT)
                WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
                WHEN 1 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
                WHEN 2 THEN concat(CAST(day(o_orderdate) AS STRING), 'th January, ', CAST(year(o_orderdate) AS STRING))
                ELSE concat('March ', CAST(day(o_orderdate) AS STRING), ', ', CAST(year(o_orderdate) AS STRING)) END,
              ' INV-', CAST(o_orderkey + 10000 AS STRING),
              ' amount INR 1,234.50 mail clerk', CAST(o_custkey AS STRING), '@example.org see https://example.org/d/', CAST(o_orderkey AS STRING),
              ' Speaker Minister Speaker Member ', o_orderpriority) AS text
FROM {orders}""",
    "v_chat": """
SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role,
       CASE WHEN conv_id % 10 = 0 AND turn = 1 THEN '   ' ELSE text END AS text
FROM {conversations}""",
    "v_ocr_runs": """
SELECT doc_id AS page_id, 1 AS prio, 'tesseract' AS engine,
       CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 4 = 0 THEN 'KNR TH OGX SRK MLA ABC DEF GHI JKL' ELSE text END AS text,
       CAST((doc_id * 37) % 101 AS DOUBLE) AS avg_confidence
FROM {documents}
UNION ALL
SELECT doc_id, 2, 'easyocr', CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE text END, CAST((doc_id * 53) % 101 AS DOUBLE)
FROM {documents} WHERE doc_id % 6 <> 0""",
    # Answers of an outside model about documents, some fenced, some broken.
    "v_answers": """
SELECT doc_id AS document_id, text,
       CASE CAST(doc_id % 9 AS INT)
         WHEN 0 THEN concat('{"top":"Budget Speech","scores":{"Budget Speech":', CAST(doc_id % 100 AS STRING), ',"Election":"x","Gazette":12.345}}')
         WHEN 1 THEN concat('```json', chr(10), '{"top":" election ","summary":" about ', lang, ' "}', chr(10), '```')
         WHEN 2 THEN '{"top":"Memo","scores":{"Calendar":40,"Gazette":60}}'
         WHEN 3 THEN '{"top":"Memo"}'
         WHEN 4 THEN 'not json at all'
         WHEN 5 THEN '{"top":7,"summary":12,"topics":"none"}'
         WHEN 6 THEN concat('{"top":"BULLETIN","topics":["a","', lang, '"],"suggested_keywords":["Speaker","', source, '",""],"summary":"s"}')
         WHEN 7 THEN '[1,2]'
         ELSE '```{"top":"Unknown","scores":{"Proceedings":1,"Calendar":3.5}}```' END AS raw
FROM {documents}""",
    # Class field answers for the metadata texts.
    "v_field_answers": """
SELECT o_orderkey AS document_id,
       CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Bulletin' WHEN 1 THEN 'Resolutions'
            WHEN 2 THEN 'Government Bill' ELSE 'Memo' END AS doc_class,
       CASE CAST(o_orderkey % 7 AS INT)
         WHEN 0 THEN concat('{"Assembly":"', CAST(o_custkey % 5 AS STRING), 'th","Session":"session 2","Bulletin Parts":"Part II","Year":"of ', CAST(year(o_orderdate) AS STRING), '"}')
         WHEN 1 THEN '{"Assembly":"unknown","Session":null,"Bulletin Parts":"part","Type Beat":"private","Subject":"  Roads  "}'
         WHEN 2 THEN concat('{"Date":"13/02/2020","Year":', CAST(year(o_orderdate) AS STRING), ',"Title":"T ', CAST(o_orderkey AS STRING), '","Subject":" "}')
         WHEN 3 THEN '{"Date":"31/02/2020","Title":"","Member Name":"A. B.","Assembly":3}'
         WHEN 4 THEN 'broken {'
         WHEN 5 THEN '{"Bulletin Parts":"iii","Session":"Session 9","Type Beat":"gov"}'
         ELSE '{}' END AS raw
FROM {orders}""",
}

TABLES = ("documents", "orders", "lineitem", "events", "conversations", "pages", "benchmark", "labels", "embeddings", "customer", "part")


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a text table that comes in fewer splits than there are cores, spread by key.

    Work on text is bound by computing; a table of many splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _spread(df) if name in ("documents", "pages") else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SHARED:
        text = SHARED[name]
        used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
        df = spark.sql(_escape_braces(text, used), **used)
        return _spread(df) if name in ("v_meta_text", "v_field_answers") else df
    return _BUILT[name](spark, sf_dir)


def _escape_braces(text: str, used: dict) -> str:
    """Braces of JSON literals doubled, so only table names are placeholders."""
    marked = text
    for t in used:
        marked = marked.replace("{" + t + "}", f"\0{t}\1")
    marked = marked.replace("{", "{{").replace("}", "}}")
    for t in used:
        marked = marked.replace(f"\0{t}\1", "{" + t + "}")
    return marked


def cte(*names: str) -> str:
    """``WITH`` clause for the SQL side; each name brings the views it is built on."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in _NEEDS.get(name, ()):
            add(dep)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_sql_of(n)})" for n in order)


def _sql_of(name: str) -> str:
    text = SHARED.get(name) or _BUILT_SQL[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


# Views that need ordered aggregation, which the two dialects spell differently.

def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents folded to one marked text, with the irregularities the splitter must bear."""
    d = table(spark, sf_dir, "documents")
    doc = F.floor(F.col("doc_id") / 4).cast("bigint")
    number = F.when(F.col("doc_id") % 11 == 0, 2).when(F.col("doc_id") % 13 == 0, 9).otherwise(F.col("doc_id") % 4 + 1)
    marker = F.concat(F.lit("=== PAGE "), number.cast("string"), F.lit(" ==="), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(""))
    part = F.when(doc % 7 == 0, F.col("text")).otherwise(F.concat(marker, F.lit("\n"), F.col("text"), F.lit("\n")))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p"))))
    folded = d.groupBy(doc.alias("document_id")).agg(F.array_join(F.transform(parts, lambda s: s["p"]), "\n").alias("t"))
    return folded.select(
        "document_id",
        F.when(F.col("document_id") % 10 == 9, " \n ").when(F.col("document_id") % 5 == 0, F.concat(F.lit("preface\n"), F.col("t"))).otherwise(F.col("t")).alias("text"),
    )


_MARKED_SQL = """
SELECT document_id, CASE WHEN document_id % 10 = 9 THEN ' ' || chr(10) || ' ' WHEN document_id % 5 = 0 THEN 'preface' || chr(10) || t ELSE t END AS text
FROM (SELECT doc_id // 4 AS document_id,
        string_agg(CASE WHEN (doc_id // 4) % 7 = 0 THEN text ELSE
          '=== PAGE ' || CAST(CASE WHEN doc_id % 11 = 0 THEN 2 WHEN doc_id % 13 = 0 THEN 9 ELSE doc_id % 4 + 1 END AS VARCHAR) || ' ===' ||
          CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE '' END || chr(10) || text || chr(10) END, chr(10) ORDER BY doc_id) AS t
      FROM documents GROUP BY doc_id // 4)"""


def _text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document-level texts in marked form, with nulls, empties and blanks among them."""
    from quire.operators.pages import fold_volumes, join_marked_pages

    d = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("document_id"), (F.col("doc_id") % 4).cast("int").alias("page_index"), "text"
    )
    marked = fold_volumes(join_marked_pages(d, "text", out="m"), "m")
    short = fold_volumes(join_marked_pages(d, F.concat(F.lit("en "), "text"), out="s"), "s")
    k = F.col("document_id")
    return marked.join(short, "document_id").select(
        "document_id",
        F.concat(F.lit("scan_"), k.cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(k % 3 == 0, F.concat(F.lit("lead\n"), F.col("m"))).when(k % 3 == 1, "").when(k % 6 == 2, "  ").alias("corrected_ocr"),
        F.when(k % 8 != 7, F.col("m")).alias("raw_ocr"),
        F.when(k % 5 == 0, F.col("s")).when(k % 5 == 1, " ").alias("corrected_ocr_english"),
        F.when(k % 4 == 1, F.col("s")).when(k % 4 == 2, "").alias("raw_ocr_english"),
        F.when(k % 7 == 0, F.col("s")).when(k % 7 == 1, "").alias("corrected_abstract"),
        F.when(k % 3 == 1, F.col("s")).when(k % 3 == 2, "plain abstract").alias("abstract"),
        F.when(k % 9 == 0, " overall ").when(k % 9 == 1, "").alias("corrected_overall_abstract"),
        F.when(k % 6 == 1, "overall text").alias("overall_abstract"),
        F.when(k % 4 != 3, F.concat(F.lit("Class "), (k % 4).cast("string"))).alias("doc_class"),
        F.when(k % 3 == 0, F.concat(F.lit("/scan/enh_"), k.cast("string"), F.lit(".png"))).alias("enhanced_path"),
        F.when(k % 5 == 2, "done").alias("translation"),
        (k % 3).cast("int").alias("metadata_keys"),
        F.when(k % 4 == 0, F.col("document_id") * 1.0).alias("ocr_cer"),
    )


def _text_docs_sql() -> str:
    return f"""
SELECT document_id, 'scan_' || CAST(document_id AS VARCHAR) || '.pdf' AS filename,
  CASE WHEN document_id % 3 = 0 THEN 'lead' || chr(10) || m WHEN document_id % 3 = 1 THEN '' WHEN document_id % 6 = 2 THEN '  ' END AS corrected_ocr,
  CASE WHEN document_id % 8 <> 7 THEN m END AS raw_ocr,
  CASE WHEN document_id % 5 = 0 THEN s WHEN document_id % 5 = 1 THEN ' ' END AS corrected_ocr_english,
  CASE WHEN document_id % 4 = 1 THEN s WHEN document_id % 4 = 2 THEN '' END AS raw_ocr_english,
  CASE WHEN document_id % 7 = 0 THEN s WHEN document_id % 7 = 1 THEN '' END AS corrected_abstract,
  CASE WHEN document_id % 3 = 1 THEN s WHEN document_id % 3 = 2 THEN 'plain abstract' END AS abstract,
  CASE WHEN document_id % 9 = 0 THEN ' overall ' WHEN document_id % 9 = 1 THEN '' END AS corrected_overall_abstract,
  CASE WHEN document_id % 6 = 1 THEN 'overall text' END AS overall_abstract,
  CASE WHEN document_id % 4 <> 3 THEN 'Class ' || CAST(document_id % 4 AS VARCHAR) END AS doc_class,
  CASE WHEN document_id % 3 = 0 THEN '/scan/enh_' || CAST(document_id AS VARCHAR) || '.png' END AS enhanced_path,
  CASE WHEN document_id % 5 = 2 THEN 'done' END AS translation,
  CAST(document_id % 3 AS INT) AS metadata_keys,
  CASE WHEN document_id % 4 = 0 THEN CAST(document_id AS DOUBLE) END AS ocr_cer
FROM (SELECT doc_id // 4 AS document_id,
        string_agg('=== PAGE ' || CAST(doc_id % 4 + 1 AS VARCHAR) || ' ===' || chr(10) || {strip('text')}, {NL2} ORDER BY doc_id) AS m,
        string_agg('=== PAGE ' || CAST(doc_id % 4 + 1 AS VARCHAR) || ' ===' || chr(10) || {strip("'en ' || text")}, {NL2} ORDER BY doc_id) AS s
      FROM documents GROUP BY doc_id // 4)"""


_BUILT = {"v_marked": _marked, "v_text_docs": _text_docs}
_BUILT_SQL = {"v_marked": _MARKED_SQL, "v_text_docs": _text_docs_sql()}
_NEEDS: dict[str, tuple[str, ...]] = {}


def sql_view(name: str, text: str, *needs: str) -> None:
    """Add a view only the SQL side needs."""
    _BUILT_SQL[name] = text
    _NEEDS[name] = needs


def slices_sql(docs: str, expr: str) -> str:
    """Page slices of a document text: the last body of a repeated page number wins."""
    return f"""
SELECT document_id, page_index, body FROM (
  SELECT document_id, page_index, body, row_number() OVER (PARTITION BY document_id, page_index ORDER BY i DESC) AS last
  FROM (
    SELECT document_id, i, CASE WHEN len(nums) = 0 THEN 0 ELSE CAST(nums[i] AS INT) - 1 END AS page_index,
           {strip("CASE WHEN len(nums) = 0 THEN t ELSE parts[i + 1] END")} AS body
    FROM (SELECT *, unnest(range(1, greatest(len(nums), 1) + 1)) AS i FROM (
      SELECT document_id, t, regexp_extract_all(t, '{MARK_SQL}', 1) AS nums, string_split_regex(t, '{MARK_SQL}') AS parts
      FROM (SELECT document_id, {expr} AS t FROM {docs}) WHERE NOT {blank('t')}))))
WHERE last = 1"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rows_where(df: DataFrame, keys, row, keep) -> DataFrame:
    """Keys and the fields of the struct ``row`` where ``keep`` holds for it, each row computed once.

    A plain filter is pushed below the projection, where it computes the whole row a second time.
    """
    kept = F.explode_outer(F.filter(F.array(row), keep)).alias("__row")
    return df.select(*keys, kept).where("__row is not null").select(*keys, "__row.*")


def digest(c) -> list:
    """A text column as digest and length: the whole text is compared, little is carried."""
    return [F.md5(c).alias("text_md5"), F.length(c).cast("bigint").alias("n_chars")]


def digest_sql(x: str) -> str:
    return f"md5({x}) AS text_md5, CAST(length({x}) AS BIGINT) AS n_chars"


__all__ = [
    "QUERIES", "SQL", "ascii_words", "MARK_SQL", "NL", "NL2", "NON_WS_SQL", "WS_SQL", "blank", "cte", "digest", "digest_sql", "filled", "mean_sql",
    "query", "rnd", "rows_where", "slices_sql", "sql_view", "squash", "strip", "strip_ws", "stripped", "table", "view",
]
