"""Traps of page text, error rates, extraction and class values on literal rows."""

import random
import time

from pyspark.sql import functions as F

from quire.functions import extract as X
from quire.functions import text as T
from quire.functions.cer import cer, cer_preview, edit_distance
from quire.operators import metadata as M
from quire.operators import page_source as P
from quire.operators import pages as G


def one(spark, ddl, row, **cols):
    return spark.createDataFrame([row], ddl).select(*[c.alias(n) for n, c in cols.items()]).first()


def split(spark, text):
    rows = G.split_marked_pages(spark.createDataFrame([(1, text)], "document_id bigint, text string"), "text").collect()
    return {r.page_index: r.body for r in rows}


def test_split_traps(spark):
    assert split(spark, "no marker here ") == {0: "no marker here"}
    assert split(spark, "dropped\n=== PAGE 1 ===\n a \n=== PAGE 3 ===  \nc") == {0: "a", 2: "c"}
    assert split(spark, "=== PAGE 2 ===\nold\n=== PAGE 1 ===\nx\n=== PAGE 2 ===\nnew") == {0: "x", 1: "new"}
    assert split(spark, " \n\t ") == {} and split(spark, None) == {}
    assert split(spark, "=== PAGE 0 ===\nz") == {-1: "z"}
    assert split(spark, "not === PAGE 1 === inline") == {0: "not === PAGE 1 === inline"}


def test_split_and_join_are_inverse(spark):
    rng = random.Random(7)
    pages = [(d, p, "".join(rng.choice("ab c\n.é") for _ in range(rng.randint(1, 60))).strip() or "x") for d in range(20) for p in range(rng.randint(1, 7))]
    df = spark.createDataFrame(pages, "document_id bigint, page_index int, body string")
    back = G.split_marked_pages(G.join_marked_pages(df, "body"), "text")
    assert sorted(map(tuple, back.collect())) == sorted(pages)


def test_joined_volumes_are_bounded_and_whole(spark):
    from quire.operators.skew import ordered_concat

    df = spark.range(25).select(F.lit(1).alias("document_id"), F.col("id").cast("int").alias("page_index"))
    out = ordered_concat(df, ["document_id"], "page_index", F.col("page_index").cast("string"), ",", "t", volume_pages=10)
    rows = {r.volume: r.t for r in out.collect()}
    assert sorted(rows) == [0, 1, 2] and ",".join(rows[v] for v in sorted(rows)) == ",".join(map(str, range(25)))
    assert G.fold_volumes(out, "t", separator=",").first().t == ",".join(map(str, range(25)))


def test_blank_correction_hides_raw_text(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, "=== PAGE 1 ===\nslice")], "document_id bigint, corrected_ocr_english string, raw_ocr_english string, corrected_ocr string, raw_ocr string"
    )
    pages = spark.createDataFrame(
        [(1, 0, "  ", "raw", None, None), (1, 1, "", " raw1 ", None, None), (1, 2, None, None, None, " en ")],
        "document_id bigint, page_index int, corrected_ocr_text string, ocr_text string, corrected_ocr_text_english string, ocr_text_english string",
    )
    got = {r.page_index: r.page_text for r in P.page_text(docs, pages).collect()}
    assert got == {0: "slice", 1: "raw1", 2: "en"}


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance_is_exact(spark):
    rng = random.Random(3)
    pairs = [("", "abc"), ("abc", ""), ("same", "same"), ("abcd", "abXcd"), ("aa", "aaa"), ("é€x", "ex")]
    for n in (5, 40, 300):
        for _ in range(15):
            a = "".join(rng.choice("abé") for _ in range(rng.randint(1, n)))
            b = list(a)
            for _ in range(rng.randint(0, n // 2)):
                b.insert(rng.randint(0, len(b)), rng.choice("abc"))
                b.pop(rng.randint(0, len(b) - 1))
            pairs.append((a, "".join(b)))
            pairs.append((a, "".join(rng.choice("abé") for _ in range(rng.randint(0, n)))))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d"))
    assert all(r.d == brute_distance(r.a, r.b) for r in df.collect())


def test_cer_edges(spark):
    pairs = {("", ""): 0.0, (None, None): 0.0, ("", "x"): 1.0, ("  ", "abc"): 0.0, ("ab", "ab"): 0.0, ("a", "xyz"): 3.0, (" ab ", "ab"): 0.0}
    df = spark.createDataFrame(list(pairs), "r string, h string").select("r", "h", cer(F.col("r"), F.col("h")).alias("c"), cer_preview(F.col("r"), F.col("h")).alias("p"))
    for r in df.collect():
        assert r.c == pairs[(r.r, r.h)]
        if r.r == "" and r.h == "x":
            assert r.p == 100.0


def test_padding_counts_and_labels(spark):
    r = one(
        spark, "t string, n int", ("=== PAGE 2 ===\nb", 3), pad=T.pad_pages(T.marked_entries(F.col("t")), F.col("n")),
        qs=T.format_qs(F.lit(None).cast("double")), two=T.format_qs(F.lit(7.0)), v=T.verdict_label(F.lit("escalation:a_b")), w=T.verdict_label(F.lit("a_b")),
        s=T.sentence_count(F.lit("A. B! ... C")), f=T.first_sentences(F.lit("a.b\nc. .d.e"), 3), e=T.first_sentences(F.lit(" . "), 3),
        ht=T.head_tail(F.lit("abcdefghij"), 4, "|"), p=T.page_prefix(F.lit(2), F.lit(3)), q=T.page_prefix(F.lit(1), F.lit(1)),
    )
    assert r.pad == ["", "b", ""] and (r.qs, r.two) == ("—", "7.00") and (r.v, r.w) == ("a_b", "a b")
    assert r.s == 3 and r.f == "a. b c. d." and r.e == "" and r.ht == "ab|ij" and (r.p, r.q) == ("Page 2/3 · ", "")


def test_dates_agree_with_dateutil(spark):
    from dateutil import parser

    raws = ["13/02/2020", "02/13/2020", "12/11/2019", "31/02/2020", "2020-13-02", "2020-1-5", "25th January, 2023", "January 25, 2023",
            "3 Sept 1999", "1st May 05", "5-6-99", "45/10/20", "10/12/200", "Feb 30, 2020", "June 7th 21"]
    df = spark.createDataFrame([(r,) for r in raws], "r string").select("r", X.normalize_date(F.col("r")).alias("iso"))
    for row in df.collect():
        try:
            want = parser.parse(row.r, fuzzy=True).date().isoformat()
        except Exception:
            want = None
        assert row.iso == want, (row.r, row.iso, want)


def test_select_traps(spark):
    opts = F.array(*[F.lit(o) for o in ("Bulletin Part I", "Bulletin Part II", "Bulletin Part III")])
    want = {"bulletin part ii": "Bulletin Part II", "whatever": "Bulletin Part I", "part": None, "": None, None: None, " - iii": "Bulletin Part III", "Part I": "Bulletin Part I"}
    df = spark.createDataFrame([(v,) for v in want], "v string").select("v", X.select_match(F.col("v"), opts).alias("m"), X.select_match(F.col("v"), opts, strict=True).alias("s"))
    for r in df.collect():
        assert r.m == want[r.v], r
        assert r.s == (None if r.v == "whatever" else want[r.v])
    nums = F.array(F.lit("1"), F.lit("2"))
    assert one(spark, "v string", ("2nd",), m=X.select_match(F.col("v"), nums)).m == "2"


def test_ordinals(spark):
    texts = {"the EIGHTH Legislative Assembly (ELEVENTH Session)": (8, 11), "12th Assembly Session-3": (12, 3), "Twenty-Second Assembly": (22, None),
             "some Assembly": (None, None), "no numbers": (None, None), "Hon'ble third session": (None, 3)}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.assembly_number(F.col("t")).alias("a"), X.session_number(F.col("t")).alias("s"))
    assert {r.t: (r.a, r.s) for r in df.collect()} == texts


def test_keywords_tie_order_and_in_row_form(spark):
    text = "Zeta Alpha Beta Alpha Zeta Gamma " + " ".join(f"Word{chr(97 + i)}" for i in range(10))
    df = spark.createDataFrame([(1, text)], "document_id bigint, text string")
    ranked = [r.term for r in M.top_keywords(df, ["document_id"], "text").orderBy("rank").collect()]
    assert ranked[:4] == ["Zeta", "Alpha", "Beta", "Gamma"] and len(ranked) == 8
    assert df.select(M.keyword_list(F.col("text")).alias("k")).first().k == ranked


def test_metadata_of_empty_text(spark):
    df = spark.createDataFrame([(1, "", "Bulletin"), (2, "", "Memo"), (3, "x", "Memo"), (4, None, None)], "document_id bigint, text string, doc_class string")
    got = {r.document_id: r.index_metadata for r in M.extract_metadata(df, "text").collect()}
    assert len(got[1].class_schema) == 3 and got[1].class_fields == {} and got[1].doc_class == "Bulletin"
    assert got[2].class_schema == [] and got[2].doc_class == "Memo"
    assert got[3].doc_class is None and got[3].class_schema is None
    assert got[4].doc_class is None and got[4].emails == []


def test_completion_without_schema(spark):
    r = one(spark, "x int", (1,), c=M.completion(F.lit(None).cast(M.SCHEMA_TYPE), F.create_map().cast("map<string,string>")))
    assert (r.c.filled, r.c.total, r.c.pct, r.c.missing) == (0, 0, 0, [])


def test_guarded_patterns_find_what_plain_ones_find(spark):
    """Patterns that tell by one character where they cannot begin, against the same ones without that."""
    month = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    plain = {
        X.EMAIL: (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0),
        X.PHONE: (r"(?U)(?:\+?\d{1,3}[\s.-]?)?\(?\d{3,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}", 0),
        X.MONEY: (r"(?iU)(?:USD|EUR|GBP|INR|\$|€|£|₹)\s?\d{1,3}(?:[,\s]\d{3})*(?:\.\d{1,2})?", 0),
        X.DATE: (
            rf"(?iU)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{month},?\s+\d{{2,4}}|{month}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{2,4}})\b", 0,
        ),
        X.IDENTIFIER: (r"(?iU)\b(?:INV|PO|REF|ID|NO|#)[\s:#-]*([A-Z0-9-]{4,})\b", 1),
        X.YEAR: (r"(?U)\b(?:19|20)\d{2}\b", 0),
        X.KEYWORD: (r"(?U)\b[A-Z][a-zA-Z]{3,}\b", 0),
        X.ASSEMBLY_DIGIT: (r"(?iU)\b(\d{1,3})(?:st|nd|rd|th)?\s+(?:Legislative\s+)?Assembly\b", 1),
        X.SESSION_DIGIT: (r"(?iU)\bSession[-\s]*(\d{1,3})\b|\b(\d{1,3})(?:st|nd|rd|th)?\s+Session\b", 2),
        X.PART: (r"(?iU)\bPart\s*-?\s*(I{1,3}|IV|V|1|2|3)\b", 1),
    }
    assert len(plain) == 10 and not [p for p, (q, _) in plain.items() if p == q]
    bits = [
        "a", "b.com", "@", "@x.org", ".", "_", "%", "-", "+", " ", "  ", "\n", " ", "1", "12", "1234", "٣", "é", "K", "ſep", "ı", "ınr", "İ", "\u212a", "\u0130nv", "USD", "usd ", "$", "€", "1,234", ".5", "(", ")", "(022)", "555", "6789", "Jan", "sept",
        "MARCH", "3rd", "/", "1/2/2003", "1999", "2010", "INV", "ınv", "po", "ref#", "#", "ID", "AB-12", "Speaker", "Roads", "éRoad", "Session", "ſession", "session-", "3 ", " Assembly", "12th Assembly", "Legislative ", "Part", "part-", "ii", "IV", ",",
    ]
    r = random.Random(5)
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(12_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    both = [(X._all(t, p, g), X._all(t, q, g), X._first(t, p, g).eqNullSafe(X._first(t, q, g))) for p, (q, g) in plain.items()]
    bad = df.select(t, *[F.when((a != b) | ~first, F.struct(a.alias("guarded"), b.alias("plain"))).alias(f"p{i}") for i, (a, b, first) in enumerate(both)])
    assert bad.where(" OR ".join(f"p{i} IS NOT NULL" for i in range(len(both)))).limit(5).collect() == []
    found = df.agg(*[F.sum(F.size(a)).alias(f"p{i}") for i, (a, _, _) in enumerate(both)]).first()
    assert min(found) > 20


def test_one_long_run_is_searched_once(spark):
    text = F.concat(F.repeat(F.lit("x"), F.col("n")), F.lit("@@ a@b.org"))
    df = spark.createDataFrame([(10,)], "n int").select(X.emails(text).alias("e"))
    assert df.first()["e"] == ["a@b.org"]
    start = time.time()
    long = spark.createDataFrame([(400_000,)], "n int").select(X.emails(text).alias("e"))
    assert long.first()["e"] == ["a@b.org"]
    assert time.time() - start < 15


_META = "document_id long, index_metadata struct<emails:array<string>,class_fields:map<string,string>>"


def test_corrected_metadata_is_whole(spark):
    docs = spark.createDataFrame([(1, (["a"], {"Year": "2001"})), (2, (["b"], {"Year": "2002"})), (3, (["c"], None)), (4, None), (5, None), (6, (None, {}))], _META)
    fixes = spark.createDataFrame([(2, (None, {"Title": "t", "Year": "", "Date": None})), (3, None), (5, (["n"], None)), (9, (["x"], {}))], _META)
    want = {1: (["a"], {"Year": "2001"}), 2: (None, {"Title": "t"}), 3: None, 4: None, 5: (["n"], None), 6: (None, {})}
    out = M.correct_metadata(docs, fixes)
    assert out.columns == docs.columns and out.schema["index_metadata"].dataType.names == ["emails", "class_fields"]
    assert {r["document_id"]: r["index_metadata"] and tuple(r["index_metadata"]) for r in out.collect()} == want
    read = out.select("document_id", "index_metadata.class_fields", F.col("index_metadata").isNull().alias("none")).collect()
    assert {r["document_id"]: (r["class_fields"], r["none"]) for r in read} == {k: (v and v[1], v is None) for k, v in want.items()}


def test_only_fields_that_are_read_go_through_a_correction(spark):
    docs = M.extract_metadata(spark.createDataFrame([(1, "Memo", "mail a@b.org of 2001")], "document_id long, doc_class string, text string"), "text")
    fixes = spark.createDataFrame([(2,)], "document_id long").join(docs.select("index_metadata").limit(0), how="left")
    out = M.correct_metadata(docs, fixes)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = lambda df: plan(df).count(X.EMAIL) - plan(fixes).count(X.EMAIL)
    assert made(out) > 0 and made(out.select("index_metadata.class_fields")) == 0
    assert out.select("index_metadata.*").first()["emails"] == ["a@b.org"]
