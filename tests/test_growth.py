"""Work that must follow the length of a text, and what must not be computed at all."""

import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from quire.functions import cer, extract
from quire.operators import review

# The patterns as they read before they were bound to the heads of runs.
PLAIN_ASSEMBLY = r"(?iU)\b([A-Za-z\- ]+?)\s+(?:Legislative\s+)?Assembly\b"
PLAIN_SESSION = r"(?iU)\(?\s*([A-Za-z\- ]+?)\s+Session\s*\)?"


def test_phrases_are_those_of_the_plain_patterns(spark):
    rng = random.Random(4)
    pieces = ["Assembly", "Legislative", "Session", "Sessions", " ", "  ", "\n", " \n ", "(", ")", "-", "é", "ſ", "5", "third", "of", ".", "_", "a"]
    rows = [("".join(rng.choices(pieces, k=rng.randint(1, 25))),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string")
    for plain, now in ((PLAIN_ASSEMBLY, extract.ASSEMBLY_WORDS), (PLAIN_SESSION, extract.SESSION_WORDS)):
        found = [F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in (plain, now)]
        assert df.where(found[0] != found[1]).count() == 0
        assert df.where(F.size(found[0]) > 0).count() > 100


def test_phrases_in_a_long_run_of_letters(spark):
    df = spark.createDataFrame([("ab cd " * 20_000 + "; Ninth Assembly (Second Session)",)], "t string")
    start = time.time()
    got = df.select(extract.assembly_number(F.col("t")).alias("a"), extract.session_number(F.col("t")).alias("s")).first()
    assert (got["a"], got["s"]) == (9, 2) and time.time() - start < 15


def test_many_deletions_and_a_short_other_text():
    a = "".join(random.Random(7).choices("abcdefgh ", k=200_000))
    start = time.time()
    assert cer.distance(a, "".join(c for i, c in enumerate(a) if i % 40)) == 5000
    assert cer.distance(a, "zzz") == len(a)
    assert time.time() - start < 0.4


def test_whole_abstracts_are_compared_only_where_needed(spark, monkeypatch, tmp_path):
    seen = str(tmp_path)

    def noted(a, b):
        if a is not None and b is not None:
            open(f"{seen}/{a}", "w").close()
        return 1

    def distances(a, b):
        return pd.Series([None if x is None or y is None else noted(x, y) for x, y in zip(a, b)], dtype="Int32")

    monkeypatch.setattr(cer, "_distances", distances)
    docs = spark.createDataFrame([(1, "wa", "x", None, None, None), (2, "wb", "x", None, None, None), (3, "wc", "x", None, None, None)], "document_id long, corrected_abstract string, abstract string, corrected_overall_abstract string, overall_abstract string, abstract_cer double")
    pages = spark.createDataFrame([(1, 0, "pa", "y"), (2, 0, "pb", ""), (3, 0, "pc", "y")], "document_id long, page_index int, corrected_page_abstract string, page_abstract string")
    requests = spark.createDataFrame([(1, None, "o"), (2, None, "o")], "document_id long, corrected_abstract string, corrected_overall_abstract string")
    got = {r["document_id"]: r["abstract_cer"] for r in review.correct_abstract(docs, pages, requests)[0].select("document_id", "abstract_cer").collect()}
    assert got == {1: 50.0, 2: 50.0, 3: None} and sorted(os.listdir(seen)) == ["pa", "wb"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, tmp_path) -> str:
    rows = [(i, ["The budget of the house", "", " \n ", "Gazette  notice\tof the house  the house"][i % 4]) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'x' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_rows_are_computed_once(spark, tmp_path):
    from quire.plans import all_queries

    sf = documents(spark, tmp_path)
    counted, intents, words = (all_queries()[0][n](spark, sf) for n in ("q_c1_tokens", "q_c4_keyword_intent", "q_k5_first_words"))
    assert plan_of(counted).count("regexp_extract_all") == 1
    assert plan_of(words).count("split(text") == 1
    assert plan_of(intents).lower().count("contains(") == 1
    assert (counted.count(), intents.count(), words.count()) == (6, 144, 6)


def test_only_terms_of_the_taxonomy_leave_the_row(spark):
    from quire.operators import classify

    pages = spark.createDataFrame([(1, "the gazette " + " ".join(f"w{i}" for i in range(500)))], "page long, text string")
    matched = classify._matched_terms(pages, ["page"], "text", classify.Taxonomy())
    assert " IN (" in plan_of(matched) or "INSET" in plan_of(matched)
    assert matched.where("term is null").count() == 1 and matched.where("term = 'gazette'").count() > 0


def test_stall_monitor_calls_python_for_batches_of_pages(spark):
    from quire.streaming.progress import stall_monitor

    rows = [(1, 1, 50.0), (1, 2, 50.05), (1, 3, 50.1), (1, 4, 70.0), (1, 17, 80.0), (2, 1, 95.0), (2, 2, 96.0), (None, 1, 10.0), (2, 1, 90.0)]
    df = stall_monitor(spark.createDataFrame(rows, "page_key long, pass int, qs double"), target_qs=92.0)
    assert "FlatMapGroupsInPandas" not in plan_of(df)
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(
        [(1, 1, 50.0, 0, False, 4), (1, 2, 50.05, 1, False, 4), (1, 3, 50.1, 2, False, 4), (1, 4, 70.0, 0, True, 4), (1, 17, None, None, True, 0),
         (2, 1, 95.0, 0, False, 2), (2, 2, 96.0, 0, True, 2), (None, 1, 10.0, 0, False, 1)], key=str)
