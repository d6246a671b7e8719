"""Places over ranges, and chat context from one read."""

from pyspark.sql import functions as F

from quire.operators import chat as H
from quire.plans.registry import view
from quire.sources.tables import newest_first, with_places


def test_places_follow_the_whole_order(spark):
    """Nulls, one time that holds a third of all rows, and a table of nothing."""
    df = spark.range(0, 3000, numPartitions=7).select(
        F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 11 != 0, F.col("id") % 97).alias("created_at")
    )
    placed = with_places(df, F.desc("created_at"), F.desc("document_id"))
    got = [(r.document_id, r.created_at) for r in placed.orderBy("place").collect()]
    assert got == [(r.document_id, r.created_at) for r in newest_first(df).collect()]
    assert sorted(r.place for r in placed.collect()) == list(range(1, 3001))
    assert with_places(df.where("false"), F.asc("document_id")).collect() == []


def test_no_window_over_all_rows(spark):
    docs = view(spark, "/root/testdata/sf0.001", "v_docs").select("document_id", "created_at")
    plan = with_places(docs, F.desc("created_at"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_pages_are_read_once(spark):
    pages = view(spark, "/root/testdata/sf0.001", "v_text_pages")
    plan = H.chat_context(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_context_of_a_long_document_is_bounded(spark):
    """20 000 pages, some longer than the context, some given twice: the same as the whole text cut."""
    rows = [(1, p // 2 * 2 if p < 10 else p, f"t{p} " + "y" * (5000 if p % 9999 == 1 else p % 13)) for p in range(20000)]
    schema = "document_id bigint, page_index int, ocr_text string"
    df = spark.createDataFrame(rows, schema).selectExpr(
        "*", "cast(null as string) corrected_ocr_text", "cast(null as string) ocr_text_english", "cast(null as string) corrected_ocr_text_english"
    ).repartition(5)
    r = H.chat_context(df, max_chars=3000).first()
    blocks = sorted((p, f"--- PAGE {p + 1} ---\n{t.strip()}") for _, p, t in rows)
    # Texts of one page follow their order after the cut to the context's two halves.
    whole = "\n\n".join(b for _, b in blocks)
    assert r.used_pages == 20000 and r.context == whole[:1500] + H.TRIM_NOTE + whole[-1500:]
