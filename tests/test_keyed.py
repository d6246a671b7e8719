"""The keyed table: newest value by seq whatever the order of arrival, buckets left alone, no shuffle of the base."""

import os
import tempfile
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quire.sources.keyed import KeyedTable

SCHEMA = "id bigint, name string, score double, tags map<string,string>"
CHANGES = "id bigint, name string, score double, tags map<string,string>, seq bigint, deleted boolean"


def fresh() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/table"


def rows(table):
    return sorted((r.id, r.name, r.score) for r in table.read().collect())


def files(path):
    return {os.path.join(at, f) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


BATCHES = [
    [(1, "a", 1.0, None, 10, False), (2, "b", None, {"k": "v"}, 10, None), (3, "c", 3.0, None, 10, False)],
    [(1, "late", None, None, 5, False), (2, None, 2.0, None, 20, False), (3, None, None, None, 15, True)],
    [(3, "back", None, None, 12, False), (4, "d", None, None, 1, False), (4, "e", None, None, 2, False), (1, None, 9.0, None, 30, None)],
]
WANTED = [(1, "a", 9.0), (2, "b", 2.0), (4, "e", None)]


def test_any_order_of_arrival(spark):
    for order in list(permutations(BATCHES))[2:6:3]:
        table = KeyedTable(spark, fresh(), ["id"], SCHEMA, buckets=4)
        for i, batch in enumerate(order):
            table.put(spark.createDataFrame(batch, CHANGES))
            if i == 1:
                table.compact(0.0)
        assert rows(table) == WANTED
        assert {r.id: r.tags for r in table.read().collect()}[2] == {"k": "v"}


def test_repeated_batch_and_reopening(spark):
    path = fresh()
    table = KeyedTable(spark, path, ["id"], SCHEMA, buckets=4)
    for i, batch in enumerate(BATCHES):
        assert table.put(spark.createDataFrame(batch, CHANGES), batch=i) == i
    before = files(path)
    table.put(spark.createDataFrame(BATCHES[0], CHANGES), batch=0)
    assert files(path) == before and rows(table) == WANTED
    wider = KeyedTable(spark, path, ["id"], SCHEMA + ", lang string", buckets=4)
    wider.put(spark.createDataFrame([(2, "sa", 1)], "id bigint, lang string, seq bigint"))
    assert {r.id: r.lang for r in wider.read().collect()} == {1: None, 2: "sa", 4: None}
    assert rows(wider) == WANTED
    with pytest.raises(ValueError, match="4 buckets"):
        KeyedTable(spark, path, ["id"], SCHEMA, buckets=8)


def test_interrupted_writes_are_not_seen(spark, monkeypatch):
    path = fresh()
    table = KeyedTable(spark, path, ["id"], SCHEMA, buckets=4)
    table.put(spark.createDataFrame(BATCHES[0], CHANGES))
    before = rows(table)

    def dies(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(RuntimeError):
            table.put(spark.createDataFrame([(i, "x", None, None, 99, False) for i in range(50)], CHANGES))
        with pytest.raises(RuntimeError):
            table.compact(0.0)
    assert rows(table) == before and table.last_batch() == 0
    table.put(spark.createDataFrame([(1, "y", None, None, 50, False)], CHANGES))
    assert rows(table) == sorted([(1, "y", 1.0), *before[1:]])
    assert table.compact(0.0) and rows(table) == sorted([(1, "y", 1.0), *before[1:]])


def test_small_change_rewrites_only_its_buckets(spark):
    path = fresh()
    table = KeyedTable(spark, path, ["id"], "id bigint, name string", buckets=32)
    table.put(spark.range(20000).select("id", F.lit("old").alias("name"), F.lit(1).alias("seq")))
    assert len(table.compact(0.1)) == 32
    base = files(f"{path}/base")
    assert len(base) == 32

    one_bucket = F.pmod(F.hash("id"), F.lit(32)) == 5
    small = spark.range(20000).where(one_bucket).limit(200)
    table.put(small.select("id", F.lit("new").alias("name"), F.lit(2).alias("seq")))
    assert table.compact(0.9) == []
    assert files(f"{path}/base") == base
    assert table.compact(0.1) == [5]
    assert len(files(f"{path}/base") - base) == 1 and base <= files(f"{path}/base")
    assert {r["name"]: r["count"] for r in table.read().groupBy("name").count().collect()} == {"old": 19800, "new": 200}
    assert [f.rsplit("/", 1)[1] for f in table.stale() if "/base/" in f] == ["bucket=5"]
    assert len([f for f in table.stale() if "/changes/" in f]) == 33


def test_no_shuffle_when_read(spark):
    table = KeyedTable(spark, fresh(), ["id", "page"], "id bigint, page int, name string", buckets=16)
    pages = spark.range(3000).select((F.col("id") % 100).alias("id"), (F.col("id") / 100).cast("int").alias("page"), F.lit("a").alias("name"), F.lit(1).alias("seq"))
    table.put(pages)
    table.compact(0.0)
    table.put(pages.limit(30).withColumn("seq", F.lit(2)).withColumn("name", F.lit("b")))
    got = table.read()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r["name"]: r["count"] for r in got.groupBy("name").count().collect()} == {"a": 2970, "b": 30}


def test_marks_null_keys_and_hot_keys(spark):
    path = fresh()
    table = KeyedTable(spark, path, ["id"], "id bigint, name string", buckets=4)
    table.put(spark.createDataFrame([], "id bigint, name string, seq bigint"))
    assert rows_of(table) == []
    table.put(spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("id"), F.col("id").cast("string").alias("name"), F.col("id").alias("seq")))
    assert dict(rows_of(table))[7] == "19998" and len(rows_of(table)) == 13333
    table.put(spark.createDataFrame([(7, 30000, True)], "id bigint, seq bigint, deleted boolean"))
    table.compact(0.0)
    table.put(spark.createDataFrame([(7, "late", 29999)], "id bigint, name string, seq bigint"))
    assert 7 not in dict(rows_of(table))
    table.compact(0.0, forget_before=30001)
    table.put(spark.createDataFrame([(7, "again", 29999)], "id bigint, name string, seq bigint"))
    assert dict(rows_of(table))[7] == "again"
    with pytest.raises(Exception, match="null in key id"):
        table.put(spark.createDataFrame([(None, "x", 1)], "id bigint, name string, seq bigint"))
    with pytest.raises(ValueError, match="no such columns"):
        table.put(spark.createDataFrame([(1, "x", 1)], "id bigint, other string, seq bigint"))


def rows_of(table):
    return sorted((r.id, r.name) for r in table.read().collect())
