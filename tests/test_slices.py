"""All texts of a document split in one pass, and one join for their slices."""

from pyspark.sql import functions as F

from quire.operators.page_source import page_text, translate_source
from quire.operators.pages import PAGE_KEY, split_marked_pages, split_marked_texts

M = "=== PAGE {} ===\n"
ROWS = [
    (1, M.format(1) + " one \n" + M.format(2) + "two", "plain", None),
    (2, M.format(3) + "c\n" + M.format(1) + "a\n" + M.format(3) + "last c", M.format(2) + "B\n" + M.format(3) + "C", ""),
    (3, None, "  ", "\n"),
    (4, M.format(1) + "\n" + M.format(2), M.format(99999999999) + "too large a number", M.format(0) + "before the first"),
    (5, "only", "other", "third"),
]


def test_equal_to_splitting_each_text_alone(spark):
    docs = spark.createDataFrame(ROWS, "document_id long, x string, y string, z string")
    got = split_marked_texts(docs, {c: F.col(c) for c in "xyz"})
    want = None
    for c in "xyz":
        one = split_marked_pages(docs, c, out=c)
        want = one if want is None else want.join(one, PAGE_KEY, "full")
    as_rows = lambda df: sorted(tuple(r) for r in df.select(*PAGE_KEY, F.struct("x", "y", "z").cast("string")).collect())
    assert as_rows(got) == as_rows(want) and got.count() == got.select(*PAGE_KEY).distinct().count() == 9


def test_many_pages_in_one_text(spark):
    docs = spark.range(1).select(
        F.col("id").alias("document_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("=== PAGE "), i.cast("string"), F.lit(" ===\nbody "), i.cast("string"))), "\n").alias("x"),
    ).withColumn("y", F.col("x"))
    got = split_marked_texts(docs, {"x": F.col("x"), "y": F.col("y")})
    assert got.where("x = concat('body ', page_index + 1) AND x = y").count() == 20_000


def joins(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines())


def test_one_join_for_all_slices(spark):
    fields = "corrected_ocr_english raw_ocr_english corrected_ocr raw_ocr corrected_abstract abstract".split()
    docs = spark.createDataFrame([(1, *["t"] * 6)], "document_id long, " + ", ".join(f"{f} string" for f in fields))
    names = "corrected_ocr_text_english ocr_text_english corrected_ocr_text ocr_text corrected_page_abstract page_abstract".split()
    pages = spark.createDataFrame([(1, 0, *[None] * 6)], "document_id long, page_index int, " + ", ".join(f"{f} string" for f in names))
    assert joins(page_text(docs, pages)) == joins(translate_source(docs, pages)) == 1
    assert page_text(docs, pages).first()["page_text"] == "t"
