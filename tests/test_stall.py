"""The stall monitor over late, repeated and interrupted streams equals the batch loop."""

import glob
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.selection import executed_passes
from quire.streaming.progress import stall_monitor

SCHEMA = "document_id bigint, page_index int, pass int, qs double"
KEYS = ("document_id", "page_index")


@pytest.fixture(scope="module")
def passes():
    rng = np.random.default_rng(8)
    return [(d, p, n, float(round(x, 3))) for d in range(3) for p in range(2) for n, x in enumerate(rng.uniform(0, 90, 12), 1)]


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(("document_id", "page_index", "pass", "qs"), r))) + "\n" for r in rows)


def run(spark, tmp_path, **options):
    """One start of the query from its checkpoint until all files are read."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = stall_monitor(events, target_qs=95.0, keys=KEYS, **options)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(120) is not False and query.exception() is None


def settled(spark, tmp_path):
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = rows.groupBy(*KEYS, "pass").agg(F.max_by(F.struct("best_qs", "stall_count", "after_stop"), "seen").alias("r"))
    return sorted(map(tuple, last.select(*KEYS, "pass", "r.*").collect()), key=str)


def want(spark, passes):
    return sorted(map(tuple, stall_monitor(spark.createDataFrame(passes, SCHEMA), 95.0, keys=KEYS).drop("seen").collect()), key=str)


def test_restart_late_and_repeated_events(spark, tmp_path, passes):
    folder = str(tmp_path / "in")
    put(folder, "a", [r for r in passes if r[2] % 3 == 0])
    run(spark, tmp_path)
    put(folder, "b", [r for r in passes if r[2] % 3 == 1][::-1])  # late: before passes that are known
    put(folder, "c", [r for r in passes if r[2] % 3 == 1])  # repeated
    run(spark, tmp_path)  # starts again from the checkpoint
    put(folder, "d", [r for r in passes if r[2] % 3 == 2] + [(0, 0, 17, 99.0)])
    run(spark, tmp_path)
    beyond = (0, 0, 17, None, None, True)
    assert settled(spark, tmp_path) == sorted([*want(spark, passes), beyond], key=str)


def test_batch_form_equals_the_loop(spark, passes):
    pages = spark.createDataFrame(passes, SCHEMA)
    live = stall_monitor(pages, 95.0, keys=KEYS).where("not after_stop")
    keyed = pages.select((F.col("document_id") * 10 + F.col("page_index")).alias("page_key"), "pass", "qs")
    loop = executed_passes(keyed, target_qs=95.0)
    assert sorted((r.document_id * 10 + r.page_index, r["pass"], r.best_qs, r.stall_count) for r in live.collect()) == sorted(
        (r.page_key, r["pass"], r.best_qs, r.stall_count) for r in loop.collect()
    )


def test_idle_pages_are_given_up(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(folder, "a", [(1, 0, 1, 50.0), (1, 0, 2, 60.0)])
    events = spark.readStream.schema(SCHEMA).json(folder)
    monitor = stall_monitor(events, target_qs=95.0, keys=KEYS, idle_ms=1)
    query = monitor.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(out)

    def wait_for(passes):
        for _ in range(240):
            if glob.glob(f"{out}/_spark_metadata/*") and spark.read.schema("pass int").parquet(out).where(F.col("pass").isin(passes)).count() == len(passes):
                return
            time.sleep(0.25)
        raise AssertionError(query.lastProgress)

    try:
        wait_for([1, 2])
        put(folder, "b", [(1, 0, 3, 10.0)])
        wait_for([3])
    finally:
        query.stop()
    last = spark.read.parquet(out).where("pass = 3").first()
    assert (last.best_qs, last.seen) == (10.0, 1)


def test_unusable_events(spark):
    rows = [(1, 0, None, 5.0), (1, 0, 1, None), (1, 0, 2, float("nan")), (None, 0, 1, 7.0), (None, 0, 1, 6.0)]
    got = stall_monitor(spark.createDataFrame(rows, SCHEMA), 95.0, keys=KEYS).collect()
    assert [(r.document_id, r["pass"], r.best_qs, r.seen) for r in got] == [(None, 1, 7.0, 1)]
    assert stall_monitor(spark.createDataFrame([], SCHEMA), 95.0, keys=KEYS).count() == 0
