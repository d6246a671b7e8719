"""Queries on metadata extraction and class fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.dims import CLASS_SCHEMA, ORDINAL_WORDS
from quire.functions import extract as X
from quire.functions.model_json import merged_keywords, metatags
from quire.operators import metadata as M
from quire.plans.registry import ascii_words, cte, query, sql_view, strip, table, view

_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
EMAIL_SQL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_SQL = r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{3,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
URL_SQL = r'https?://[^\s<>"]+'
MONEY_SQL = r"(?i)(?:USD|EUR|GBP|INR|\$|€|£|₹)\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d{1,2})?"
ID_SQL = r"(?i)\b(?:INV|PO|REF|ID|NO|#)[\s:#-]*([A-Z0-9-]{4,})\b"
YEAR_SQL = r"\b(?:19|20)\d{2}\b"
DATE_SQL = (
    r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?\s+{_MON},?\s+\d{{2,4}}|{_MON}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{2,4}})\b"
)
KEYWORD_SQL = r"\b[A-Z][a-zA-Z]{3,}\b"


def _found(x: str, pattern: str, group: int = 0) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '{pattern}', {group})))"


def _joined(x: str, pattern: str, group: int = 0) -> str:
    return f"array_to_string({_found(x, pattern, group)}, ' | ')"


def _join(c):
    return F.array_join(c, " | ")


# Both the mail-rich order texts and the whole document table.
_TEXTS = "SELECT document_id, text FROM v_meta_text UNION ALL SELECT -1 - doc_id, text FROM documents"
sql_view("s_texts", _TEXTS, "v_meta_text")


def _texts(spark, sf):
    d = table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("document_id"), "text")
    return view(spark, sf, "v_meta_text").select("document_id", "text").unionByName(d)


# The same with a class; every document ends with a passage of its class's fields, so they stand at the end of long texts too.
_CLASSED_DOCUMENTS = """SELECT -1 - doc_id AS document_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'Bulletin' WHEN 1 THEN 'Resolutions' WHEN 2 THEN 'Government Bill' ELSE 'Memo' END AS doc_class,
  CASE WHEN text <> '' THEN concat(text, ' Tenth Legislative Assembly (Third Session) Part - ', CASE WHEN doc_id % 2 = 0 THEN 'I' ELSE '2' END, ' of 3rd May, 2011') ELSE '' END AS text FROM {documents}"""
sql_view("s_classed", "SELECT document_id, doc_class, text FROM v_meta_text UNION ALL " + _CLASSED_DOCUMENTS.replace("{documents}", "documents"), "v_meta_text")


def _classed(spark, sf):
    d = spark.sql(_CLASSED_DOCUMENTS, documents=table(spark, sf, "documents"))
    return view(spark, sf, "v_meta_text").select("document_id", "doc_class", "text").unionByName(d)


def _pattern_query(name, fn, pattern, group=0, ascii_boundaries=False):
    text = ascii_words("text") if ascii_boundaries else "text"
    sql = cte("s_texts") + f" SELECT document_id, {_joined(text, pattern, group)} AS found, CAST(len({_found(text, pattern, group)}) AS INT) AS n FROM s_texts"

    @query(name, sql)
    def run(spark, sf):
        c = fn(F.col("text"))
        return _texts(spark, sf).select("document_id", _join(c).alias("found"), F.size(c).alias("n"))


_pattern_query("q_m1_emails", X.emails, EMAIL_SQL)
_pattern_query("q_m1_phones", X.phones, PHONE_SQL)
_pattern_query("q_m1_urls", X.urls, URL_SQL)
_pattern_query("q_m2_amounts", X.amounts, MONEY_SQL)
_pattern_query("q_m3_identifiers", X.identifiers, ID_SQL, 1, ascii_boundaries=True)
_pattern_query("q_m4_date_strings", X.date_strings, DATE_SQL, ascii_boundaries=True)
_pattern_query("q_a10_distinct_years", lambda c: X.distinct_matches(c, X.YEAR), YEAR_SQL, ascii_boundaries=True)

# Dates in many spellings, made from order and ship dates.
_DATE_TEXT = """CASE CAST(l_orderkey % 9 AS INT)
  WHEN 0 THEN concat(CAST(month(l_shipdate) AS STRING), '/', CAST(day(l_shipdate) AS STRING), '/', CAST(year(l_shipdate) AS STRING))
  WHEN 1 THEN concat(CAST(day(l_shipdate) AS STRING), '-', CAST(month(l_shipdate) AS STRING), '-', CAST(year(l_shipdate) AS STRING))
  WHEN 2 THEN concat(CAST(year(l_shipdate) AS STRING), '-', CAST(month(l_shipdate) AS STRING), '-', CAST(day(l_shipdate) AS STRING))
  WHEN 3 THEN concat(CAST(day(l_shipdate) AS STRING), 'th March, ', CAST(year(l_shipdate) AS STRING))
  WHEN 4 THEN concat('Sept ', CAST(day(l_shipdate) AS STRING), ' ', CAST(year(l_shipdate) AS STRING))
  WHEN 5 THEN concat(CAST(day(l_shipdate) AS STRING), '/02/', CAST(year(l_shipdate) AS STRING))
  WHEN 6 THEN concat(CAST(month(l_shipdate) AS STRING), '/', CAST(day(l_shipdate) AS STRING), '/', substr(CAST(year(l_shipdate) AS STRING), 3, 2))
  WHEN 7 THEN concat(CAST(day(l_shipdate) AS STRING), ' Juneish ', CAST(year(l_shipdate) AS STRING))
  ELSE concat('June ', CAST(day(l_shipdate) AS STRING), 'st, ', CAST(year(l_shipdate) AS STRING)) END"""


def iso_sql(raw: str) -> str:
    """ISO date of a raw date string, spelled with list look-ups and a tolerant cast."""
    plain = f"regexp_replace(lower({raw}), '(\\d)(st|nd|rd|th)\\b', '\\1', 'g')"
    a, b, c = (f"nullif(regexp_extract({plain}, '^(\\d{{1,4}})[/-](\\d{{1,2}})[/-](\\d{{1,4}})$', {g}), '')" for g in (1, 2, 3))
    dm = [f"regexp_extract({plain}, '^(\\d{{1,2}})\\s+([a-z]+),?\\s+(\\d{{2,4}})$', {g})" for g in (1, 2, 3)]
    md = [f"regexp_extract({plain}, '^([a-z]+)\\s+(\\d{{1,2}}),?\\s+(\\d{{2,4}})$', {g})" for g in (1, 2, 3)]
    short = "['" + "','".join(X.MONTHS) + "']"
    long = "['" + "','".join(X.MONTH_NAMES) + "']"

    def month(m):
        return f"coalesce(nullif(list_position({short}, {m}), 0), nullif(list_position({long}, {m}), 0), CASE WHEN {m} = 'sept' THEN 9 END)"

    lead = f"(length({a}) > 2 OR CAST({a} AS INT) > 31)"
    y = f"CASE WHEN {a} IS NOT NULL THEN CASE WHEN {lead} THEN {a} ELSE {c} END WHEN {dm[1]} <> '' THEN {dm[2]} ELSE {md[2]} END"
    m = f"CASE WHEN {a} IS NOT NULL THEN CASE WHEN {lead} OR CAST({a} AS INT) > 12 THEN CAST({b} AS INT) ELSE CAST({a} AS INT) END WHEN {dm[1]} <> '' THEN {month(dm[1])} ELSE {month(md[0])} END"
    d = f"CASE WHEN {a} IS NOT NULL THEN CASE WHEN {lead} THEN CAST({c} AS INT) WHEN CAST({a} AS INT) > 12 THEN CAST({a} AS INT) ELSE CAST({b} AS INT) END WHEN {dm[1]} <> '' THEN TRY_CAST({dm[0]} AS INT) ELSE TRY_CAST({md[1]} AS INT) END"
    year = f"CASE WHEN length({y}) <= 2 THEN TRY_CAST({y} AS INT) + CASE WHEN TRY_CAST({y} AS INT) + 2000 >= {X.PIVOT_YEAR + 50} THEN 1900 ELSE 2000 END ELSE TRY_CAST({y} AS INT) END"
    return (
        f"CAST(TRY_CAST(lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE) AS VARCHAR)"
    )


@query(
    "q_m5_normalize_date",
    f"SELECT l_orderkey, l_linenumber, raw, {iso_sql('raw')} AS iso FROM (SELECT l_orderkey, l_linenumber, {_DATE_TEXT} AS raw FROM lineitem)",
)
def m5(spark, sf):
    raw = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_DATE_TEXT).alias("raw"))
    return raw.withColumn("iso", X.normalize_date(F.col("raw")))


_YEAR_TEXT = "CASE WHEN o_custkey % 4 = 0 THEN concat('in ', CAST(year(o_orderdate) AS STRING), '.') WHEN o_custkey % 4 = 1 THEN CAST(o_orderkey AS STRING) WHEN o_custkey % 4 = 2 THEN concat('no', CAST(year(o_orderdate) AS STRING)) ELSE concat(CAST(o_custkey AS STRING), ' 1999-', CAST(year(o_orderdate) AS STRING)) END"


@query("q_m6_coerce_year", f"SELECT o_orderkey, nullif(regexp_extract(v, '{YEAR_SQL}', 0), '') AS year FROM (SELECT o_orderkey, {_YEAR_TEXT} AS v FROM orders)")
def m6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.coerce_year(F.expr(_YEAR_TEXT)).alias("year"))


# Assembly and session numbers, in digits, words, with fillers, and absent.
_NUMBER_TEXT = """CASE CAST(o_orderkey % 8 AS INT)
  WHEN 0 THEN concat('The ', CAST(o_custkey % 30 + 1 AS STRING), 'th Legislative Assembly, Session-', CAST(o_custkey % 9 + 1 AS STRING))
  WHEN 1 THEN 'the Twenty-Second Legislative Assembly (the Third Session)'
  WHEN 2 THEN 'Hon''ble Eighth Assembly. Eleventh Session of the house'
  WHEN 3 THEN concat(CAST(o_custkey % 20 + 1 AS STRING), 'rd Session of State Assembly; sixth Mizoram Legislative Assembly')
  WHEN 4 THEN 'Legislative Assembly of the state, opening session and closing Session'
  WHEN 5 THEN 'joint morning Session, 4; tenth Session. Ninth Assembly'
  WHEN 6 THEN o_orderpriority
  ELSE 'Of the twenty first assembly and its fifth session' END"""

_ORDINALS_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in ORDINAL_WORDS.items()) + "}"


def _word_number(x: str, pattern: str, filler: str) -> str:
    phrase = f"lower({strip('regexp_replace(' + strip('p') + f', {chr(39)}{filler}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})"
    last = f"regexp_extract({phrase}, '([^\\s]+)$', 1)"
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '{pattern}', 1), lambda p: coalesce({_ORDINALS_SQL}[{phrase}], {_ORDINALS_SQL}[{last}])), lambda n: n IS NOT NULL)[1]"
    )


def assembly_sql(x: str) -> str:
    digit = f"TRY_CAST(nullif(regexp_extract({x}, '(?i)\\b(\\d{{1,3}})(?:st|nd|rd|th)?\\s+(?:Legislative\\s+)?Assembly\\b', 1), '') AS INT)"
    return f"coalesce({digit}, {_word_number(x, chr(40) + '?i)' + chr(92) + 'b([A-Za-z' + chr(92) + '- ]+?)' + chr(92) + 's+(?:Legislative' + chr(92) + 's+)?Assembly' + chr(92) + 'b', '(?i)' + chr(92) + 'b(the|hon' + chr(92) + '.?ble|honourable|honorable|of|state|mizoram|legislative)' + chr(92) + 'b')})"


def session_sql(x: str) -> str:
    pattern = r"(?i)\bSession[-\s]*(\d{1,3})\b|\b(\d{1,3})(?:st|nd|rd|th)?\s+Session\b"
    digit = f"TRY_CAST(coalesce(nullif(regexp_extract({x}, '{pattern}', 1), ''), nullif(regexp_extract({x}, '{pattern}', 2), '')) AS INT)"
    words = r"(?i)\(?\s*([A-Za-z\- ]+?)\s+Session\s*\)?"
    filler = r"(?i)\b(the|of|hon\.?ble|honourable|honorable)\b"
    return f"coalesce({digit}, {_word_number(x, words, filler)})"


@query("q_m7_assembly_session", f"SELECT o_orderkey, CAST({assembly_sql('v')} AS INT) AS assembly, CAST({session_sql('v')} AS INT) AS session FROM (SELECT o_orderkey, {_NUMBER_TEXT} AS v FROM orders)")
def m7(spark, sf):
    head = F.expr(_NUMBER_TEXT.replace("Hon''ble", "Hon\\'ble"))
    return table(spark, sf, "orders").select("o_orderkey", head.alias("v")).select(
        "o_orderkey", X.assembly_number(F.col("v")).alias("assembly"), X.session_number(F.col("v")).alias("session")
    )


# Free values against the options of two select fields.
_OPTION_VALUE = """CASE CAST(l_linenumber + l_partkey % 5 AS INT) WHEN 1 THEN concat(CAST(l_suppkey % 5 AS STRING), 'st') WHEN 2 THEN 'SESSION 2' WHEN 3 THEN ' part - ii '
  WHEN 4 THEN 'iii' WHEN 5 THEN 'unknown' WHEN 6 THEN 'Part' WHEN 7 THEN 'part' WHEN 8 THEN '' WHEN 9 THEN NULL ELSE l_returnflag END"""


def select_sql(v: str, opts: str, strict: bool) -> str:
    s = strip(v)
    digits = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    low = f"regexp_replace({strip(f'replace(lower({s}), {chr(39)}part{chr(39)}, {chr(39)}{chr(39)})')}, '^[- ]+|[- ]+$', '', 'g')"
    known = f"{low} IN ('i', 'ii', 'iii')"
    loose = "false" if strict else f"NOT ({known})"
    return f"""CASE WHEN {s} <> '' THEN coalesce(
      list_filter({opts}, lambda o: lower(o) = lower({s}))[1],
      CASE WHEN {digits} <> '' THEN list_filter({opts}, lambda o: regexp_replace(o, '[^0-9]', '', 'g') = {digits})[1] END,
      CASE WHEN {low} <> '' THEN list_filter({opts}, lambda o: contains(lower(o), {low}) OR ({known} AND contains(replace(lower(o), 'bulletin part ', ''), {low})) OR {loose})[1] END) END"""


_SESSIONS = ["Session 1", "Session 2", "Session 3"]
_PARTS = ["Bulletin Part I", "Bulletin Part II", "Bulletin Part III"]
_lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(
    "q_m8_select_match",
    f"""SELECT l_orderkey, l_linenumber, {select_sql('v', _lst(_SESSIONS), False)} AS session, {select_sql('v', _lst(_PARTS), False)} AS part,
    {select_sql('v', _lst(_PARTS), True)} AS strict_part FROM (SELECT l_orderkey, l_linenumber, {_OPTION_VALUE} AS v FROM lineitem)""",
)
def m8(spark, sf):
    v = F.col("v")
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_OPTION_VALUE).alias("v"))
    return rows.select(
        "l_orderkey", "l_linenumber", X.select_match(v, arr(_SESSIONS)).alias("session"),
        X.select_match(v, arr(_PARTS)).alias("part"), X.select_match(v, arr(_PARTS), strict=True).alias("strict_part"),
    )


PART_SQL = r"(?i)\bPart\s*-?\s*(I{1,3}|IV|V|1|2|3)\b"


def part_sql(x: str) -> str:
    t = f"upper(nullif(regexp_extract({x}, '{PART_SQL}', 1), ''))"
    return f"'Bulletin Part ' || CASE {t} WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' ELSE {t} END"


@query("q_m9_bulletin_part", cte("s_classed") + f" SELECT document_id, {part_sql(ascii_words('text'))} AS part FROM s_classed")
def m9(spark, sf):
    return _classed(spark, sf).select("document_id", X.bulletin_part(F.col("text")).alias("part"))


def _owners(field: str) -> str:
    return "(" + ", ".join(f"'{c}'" for c, fs in CLASS_SCHEMA.items() if any(f[0] == field for f in fs)) + ")"


_HEAD = ascii_words("text")
_FIELD_SQL = {
    "Date": iso_sql(f"nullif(regexp_extract({_HEAD}, '{DATE_SQL}', 0), '')"),
    "Year": f"nullif(regexp_extract({_HEAD}, '{YEAR_SQL}', 0), '')",
    "Assembly": f"CAST({assembly_sql(_HEAD)} AS VARCHAR)",
    "Session": f"'Session ' || CAST({session_sql(_HEAD)} AS VARCHAR)",
    "Bulletin Parts": part_sql(_HEAD),
}
sql_view(
    "r_fields",
    "SELECT document_id, doc_class, text, "
    + ", ".join(f"CASE WHEN doc_class IN {_owners(n)} THEN {e} END AS f_{n.lower().replace(' ', '_')}" for n, e in _FIELD_SQL.items())
    + " FROM s_classed",
    "s_classed",
)


@query(
    "q_m10_class_fields",
    cte("r_fields") + " SELECT document_id, f_date, f_year, f_assembly, f_session, f_bulletin_parts FROM r_fields",
)
def m10(spark, sf):
    fields = _classed(spark, sf).withColumn("m", M.class_fields(F.col("text"), F.col("doc_class")))
    return fields.select(
        "document_id", *[F.try_element_at("m", F.lit(n)).alias("f_" + n.lower().replace(" ", "_")) for n in _FIELD_SQL]
    )


# --- keywords -------------------------------------------------------------------------

for _name, _of in (("r_keywords", "s_texts"), ("r_class_keywords", "s_classed")):
    sql_view(
        _name,
        f"""SELECT document_id, term, n, first_pos, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first_pos) AS rank FROM (
      SELECT document_id, term, count(*) AS n, min(pos) AS first_pos FROM (
        SELECT document_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT document_id, regexp_extract_all({ascii_words('text')}, '{KEYWORD_SQL}') AS w FROM {_of}))
      GROUP BY document_id, term)""",
        _of,
    )


@query("q_a9_top_keywords", cte("r_keywords") + " SELECT document_id, term, n, CAST(first_pos AS INT) AS first_pos, CAST(rank AS INT) AS rank FROM r_keywords WHERE rank <= 8")
def a9(spark, sf):
    return M.top_keywords(_texts(spark, sf), ["document_id"], "text")


@query("q_k2_keyword_list", cte("r_keywords") + " SELECT document_id, string_agg(term, ' ' ORDER BY rank) AS keywords FROM r_keywords WHERE rank <= 8 GROUP BY document_id")
def k2(spark, sf):
    listed = _texts(spark, sf).select("document_id", F.array_join(M.keyword_list(F.col("text")), " ").alias("keywords"))
    return listed.where("keywords <> ''")


@query(
    "q_u1_merged_keywords",
    cte("v_answers") + f""", t AS (SELECT document_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT document_id, regexp_extract_all({ascii_words('text')}, '{KEYWORD_SQL}') AS w FROM v_answers)),
r AS (SELECT document_id, term, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, min(pos)) AS rank FROM t GROUP BY document_id, term),
l AS (SELECT document_id, list(term ORDER BY rank) AS own FROM r WHERE rank <= 8 GROUP BY document_id),
k AS (SELECT document_id, raw, coalesce(own, []) AS w FROM v_answers LEFT JOIN l USING (document_id))
SELECT document_id, CASE WHEN document_id % 9 = 6 THEN array_to_string((list_distinct_keep(w, src))[1:16], ' ') ELSE array_to_string(w, ' ') END AS keywords FROM
(SELECT k.document_id, k.w, d.source AS src FROM k JOIN documents d ON d.doc_id = k.document_id)""".replace(
        "(list_distinct_keep(w, src))[1:16]",
        "list_filter(list_concat(w, ['Speaker', src]), lambda x, i: list_position(list_concat(w, ['Speaker', src]), x) = i)[1:16]",
    ),
)
def u1(spark, sf):
    first = M.keyword_list(F.col("text"))
    return view(spark, sf, "v_answers").select(
        "document_id", F.array_join(merged_keywords(first, metatags(F.col("raw"))["suggested_keywords"]), " ").alias("keywords")
    )


# --- schema and completion ---------------------------------------------------------------

_SCHEMA_VALUES = "VALUES " + ", ".join(
    f"('{c}', {i}, '{f[0]}', '{f[1]}', {_lst(f[2]) if f[2] else 'CAST(NULL AS VARCHAR[])'})" for c, fs in CLASS_SCHEMA.items() for i, f in enumerate(fs)
)
sql_view("d_schema", f"SELECT * FROM ({_SCHEMA_VALUES}) AS t(doc_class, field_pos, name, type, options)")


@query("q_j7_schema_fields", cte("v_meta_text", "d_schema") + " SELECT document_id, CAST(field_pos AS INT) AS field_pos, name, type FROM v_meta_text JOIN d_schema USING (doc_class)")
def j7(spark, sf):
    return M.document_schema_fields(view(spark, sf, "v_meta_text").select("document_id", "doc_class")).select("document_id", "field_pos", "name", "type")


_value = "json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.\"' || name || '\"')"
sql_view(
    "r_coerced",
    f"""SELECT document_id, name, field_pos, CASE type WHEN 'select' THEN {select_sql('v', 'options', False)}
      WHEN 'date' THEN {iso_sql('v')} WHEN 'year' THEN nullif(regexp_extract(v, '{YEAR_SQL}', 0), '') ELSE nullif({strip('v')}, '') END AS value
    FROM (SELECT a.document_id, s.name, s.type, s.options, s.field_pos, {_value} AS v FROM v_field_answers a JOIN d_schema s USING (doc_class))""",
    "v_field_answers", "d_schema",
)


def _coerced(spark, sf):
    return M.with_class_schema(view(spark, sf, "v_field_answers")).withColumn("m", M.coerce_answer(F.col("raw"), F.col("class_schema")))


@query("q_m11_coerce_fields", cte("r_coerced") + " SELECT document_id, name, value FROM r_coerced WHERE value IS NOT NULL")
def m11(spark, sf):
    return _coerced(spark, sf).select("document_id", F.explode("m").alias("name", "value"))


@query("q_j8_allowed_options", cte("r_coerced", "d_schema") + " SELECT document_id, name, value FROM r_coerced JOIN (SELECT DISTINCT name, type FROM d_schema) t USING (name) WHERE t.type = 'select' AND value IS NOT NULL")
def j8(spark, sf):
    fields = F.filter("class_schema", lambda f: f["type"] == "select")
    rows = _coerced(spark, sf).select("document_id", "m", F.explode(F.transform(fields, lambda f: f["name"])).alias("name"))
    return rows.select("document_id", "name", F.try_element_at("m", F.col("name")).alias("value")).where("value is not null")


@query(
    "q_p11_completion",
    cte("r_coerced", "v_field_answers") + """ SELECT a.document_id, CAST(coalesce(c.filled, 0) AS INT) AS filled, CAST(coalesce(c.total, 0) AS INT) AS total,
    CAST(coalesce(floor(100.0 * c.filled / c.total + 0.5), 0) AS INT) AS pct, coalesce(c.missing, '') AS missing
    FROM v_field_answers a LEFT JOIN (SELECT document_id, count(*) AS total, count(value) AS filled,
      coalesce(string_agg(name, ',' ORDER BY field_pos) FILTER (WHERE value IS NULL), '') AS missing FROM r_coerced GROUP BY document_id) c USING (document_id)""",
)
def p11(spark, sf):
    done = _coerced(spark, sf).withColumn("c", M.completion(F.col("class_schema"), F.col("m")))
    return done.select("document_id", "c.filled", "c.total", "c.pct", F.array_join("c.missing", ",").alias("missing"))


@query("q_u3_missing_fields", cte("r_coerced") + " SELECT document_id, name FROM r_coerced WHERE value IS NULL")
def u3(spark, sf):
    names = F.transform("class_schema", lambda f: f["name"])
    have = F.coalesce(F.map_keys("m"), F.array().cast("array<string>"))
    return _coerced(spark, sf).where("class_schema is not null").select("document_id", F.explode(M.missing_fields(names, have)).alias("name"))


# --- whole records --------------------------------------------------------------------------

_KNOWN = "(" + ", ".join(f"'{c}'" for c in CLASS_SCHEMA) + ")"


@query(
    "q_m12_metadata",
    cte("r_fields", "r_class_keywords") + f""" SELECT f.document_id, {_joined('text', EMAIL_SQL)} AS emails, {_joined('text', PHONE_SQL)} AS phones, {_joined('text', URL_SQL)} AS urls,
    {_joined('text', MONEY_SQL)} AS amounts, {_joined(ascii_words('text'), ID_SQL, 1)} AS identifiers,
    array_to_string(list_transform({_found(ascii_words('text'), DATE_SQL)}, lambda r: r || '=' || coalesce({iso_sql('r')}, '?')), ' | ') AS dates, k.keywords,
    CASE WHEN doc_class IN {_KNOWN} OR text = '' THEN doc_class END AS known_class, f_date, f_year, f_assembly, f_session, f_bulletin_parts
    FROM r_fields f LEFT JOIN (SELECT document_id, string_agg(term, ' ' ORDER BY rank) AS keywords FROM r_class_keywords WHERE rank <= 8 GROUP BY document_id) k USING (document_id)""",
)
def m12(spark, sf):
    found = M.extract_metadata(_classed(spark, sf), "text").select("document_id", "index_metadata.*")
    shown = F.transform("dates", lambda d: F.concat(d["raw"], F.lit("="), F.coalesce(d["iso"], F.lit("?"))))
    return found.select(
        "document_id", *[_join(F.col(c)).alias(c) for c in ("emails", "phones", "urls", "amounts", "identifiers")],
        _join(shown).alias("dates"), F.array_join("keywords", " ").alias("keywords"), F.col("doc_class").alias("known_class"),
        *[F.try_element_at("class_fields", F.lit(n)).alias("f_" + n.lower().replace(" ", "_")) for n in _FIELD_SQL],
    )


@query(
    "q_m13_correct_metadata",
    cte("r_fields") + """ SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'corrected' ELSE coalesce(f_assembly, f_date, f_year, '') END AS first_field,
    CASE WHEN document_id % 3 = 0 THEN 1 ELSE (f_date IS NOT NULL)::INT + (f_year IS NOT NULL)::INT + (f_assembly IS NOT NULL)::INT + (f_session IS NOT NULL)::INT + (f_bulletin_parts IS NOT NULL)::INT END AS n_fields FROM r_fields""",
)
def m13(spark, sf):
    docs = M.extract_metadata(_classed(spark, sf), "text")
    fields = F.create_map(F.lit("Assembly"), F.lit("corrected"), F.lit("Title"), F.lit(""))
    fixed = docs.where("document_id % 3 = 0").select("document_id", F.col("index_metadata").withField("class_fields", fields).alias("index_metadata"))
    out = M.correct_metadata(docs, fixed).select("document_id", F.coalesce("index_metadata.class_fields", F.create_map().cast("map<string,string>")).alias("m"))
    first = F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in ("Assembly", "Date", "Year")], F.lit(""))
    return out.select("document_id", first.alias("first_field"), F.size("m").alias("n_fields"))
