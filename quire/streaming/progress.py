"""Following stage and progress events, as tables or with Structured Streaming.

The folds are plain aggregates, so the same function serves a batch table and a
stream in update or complete mode.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.selection import MAX_PASSES, MIN_GAIN, STALL_WINDOW
from quire.operators.skew import salted_left_join
from quire.operators.status import event_label, event_progress
from quire.sources.tables import upsert


def with_progress(events: DataFrame, default_target: float = 95.0) -> DataFrame:
    """Adds ``pct`` and ``event_text``; stateless."""
    return events.withColumn("pct", event_progress(default_target)).withColumn("event_text", event_label())


def page_index_of(events_zero: Column, events_one: Column) -> Column:
    """0-based page of an event: the 0-based field, else the 1-based one less 1, else 0."""
    return F.coalesce(events_zero, F.greatest(F.lit(0), events_one - 1), F.lit(0))


def page_results(events: DataFrame) -> DataFrame:
    """Latest completion per page: the path only if non-empty, scores only if non-null."""
    done = events.where(F.col("phase") == "page_complete").withColumn(
        "__page", page_index_of(F.col("page_index_zero"), F.col("page_index"))
    )

    def latest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))

    return done.groupBy("document_id", F.col("__page").alias("page_index")).agg(
        latest(F.nullif("enhanced_path", F.lit(""))).alias("enhanced_path"),
        latest(F.col("post_qs")).alias("post_qs"),
        latest(F.col("initial_qs")).alias("initial_qs"),
    )


def patch_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Page table with the completed pages' new values; null ones keep the old."""
    return upsert(pages, results, ["document_id", "page_index"]).join(
        pages.select("document_id", "page_index"), ["document_id", "page_index"], "left_semi"
    )


def run_outcomes(events: DataFrame) -> DataFrame:
    """``(run_id, outcome, message)``: success, failed, or ``running`` with no closing event yet."""
    return events.groupBy("run_id").agg(
        F.bool_or(F.col("phase") == "document").alias("__ok"),
        F.min(F.when(F.col("phase") == "error", F.col("seq"))).alias("__err"),
        F.min(F.when(F.col("phase") == "document", F.col("seq"))).alias("__doc"),
        F.min_by("message", F.when(F.col("phase") == "error", F.col("seq"))).alias("__message"),
    ).select(
        "run_id",
        F.when(F.col("__err").isNotNull() & (F.col("__doc").isNull() | (F.col("__err") < F.col("__doc"))), "failed")
        .when(F.col("__ok"), "success")
        .otherwise("running")
        .alias("outcome"),
        F.col("__message").alias("message"),
    )


def closed_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes once the logs have ended: a run with no closing event is an error."""
    ended = F.col("outcome") == "running"
    return outcomes.withColumn("message", F.when(ended, "Stream ended without result").otherwise(F.col("message"))).withColumn(
        "outcome", F.when(ended, "failed").otherwise(F.col("outcome"))
    )


def live_state(stage_runs: DataFrame) -> DataFrame:
    """Latest stage and status per document; one state row per document on a stream."""
    return stage_runs.groupBy("document_id").agg(
        F.max_by(F.struct("stage", "status"), F.struct("started_at", "id")).alias("__last")
    ).select("document_id", F.col("__last.stage").alias("current_stage"), F.col("__last.status").alias("status"))


def page_board(events: DataFrame, pages: DataFrame, ended_runs: DataFrame | None = None) -> DataFrame:
    """Progress per page of multi-page documents: pending, active or done.

    An event for a page marks it active (done once written) and every earlier page
    done; the end of the run marks all done. ``events`` carry a 1-based page index.
    """
    written = ("write", "complete", "page_complete")
    own = events.where("page_index is not null and page_total > 1").withColumn("__page", F.col("page_index") - 1)
    per_page = own.groupBy("document_id", F.col("__page").alias("page_index")).agg(F.max_by("phase", "seq").alias("__phase"))
    furthest = own.groupBy("document_id").agg(F.max("__page").alias("__furthest"))
    ended = events.where(F.col("phase") == "document").select("document_id") if ended_runs is None else ended_runs.select("document_id")
    facts = furthest.join(ended.distinct().withColumn("__ended", F.lit(True)), "document_id", "full")
    multi = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").join(facts, "document_id", "left")
    joined = salted_left_join(pages.select("document_id", "page_index"), multi, ["document_id"], ["page_index"], how="inner")
    status = (
        F.when(F.col("__ended") | (F.col("page_index") < F.col("__furthest")) | F.col("__phase").isin(*written), "done")
        .when(F.col("__phase").isNotNull(), "active")
        .otherwise("pending")
    )
    return joined.join(per_page, ["document_id", "page_index"], "left").select("document_id", "page_index", status.alias("state"))


class _StallProcessor(StatefulProcessor):
    """Keeps the passes of a page, at most ``max_passes`` numbers, and walks them anew from the first one that changed."""

    def __init__(self, keys: list[str], target_qs: float, min_gain: float, window: int, max_passes: int, start_qs: float, idle_ms: int | None):
        self.keys, self.idle_ms = keys, idle_ms
        self.target_qs, self.min_gain, self.window, self.max_passes, self.start_qs = target_qs, min_gain, window, max_passes, start_qs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passes = handle.getMapState("passes", "pass int", "qs double", self.idle_ms)

    def walk(self, passes: list[tuple[int, float]]) -> Iterator[tuple[int, float, int, bool]]:
        best, stall, stopped = self.start_qs, 0, self.start_qs >= self.target_qs
        for number, qs in passes:
            gain = max(0.0, qs - best)
            best = max(best, qs)
            stall = stall + 1 if gain < self.min_gain else 0
            yield number, best, stall, stopped
            stopped = stopped or stall >= self.window or best >= self.target_qs

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).groupby("number")["qs"].max()
        known = {int(k[0]): float(v[0]) for k, v in self.passes.iterator()} if self.passes.exists() else {}
        changed = {}
        for number, qs in arrived.items():
            if number <= self.max_passes and qs > known.get(int(number), float("-inf")):
                changed[int(number)] = float(qs)
        known |= changed
        # The whole of a live page is written again, so that all its passes are given up together.
        for number, qs in (known if self.idle_ms else changed).items():
            self.passes.updateValue((number,), (qs,))
        out = [(*key, *r, len(known)) for r in self.walk(sorted(known.items())) if r[0] >= min(changed, default=self.max_passes + 1)]
        yield self.table(out + [(*key, int(n), None, None, True, 0) for n in arrived.index if n > self.max_passes])

    def table(self, rows: list[tuple]) -> pd.DataFrame:
        columns = [*self.keys, "pass", "best_qs", "stall_count", "after_stop", "seen"]
        kinds = {"pass": "int32", "best_qs": "float64", "stall_count": "Int32", "after_stop": "bool", "seen": "int32"}
        return pd.DataFrame(rows, columns=columns).astype(kinds)

    def fold(self, numbers: pd.Series, scores: pd.Series) -> pd.Series:
        """The same for pages whose passes are all there, each once and in order: a list of rows for each page."""
        names = ("pass", "best_qs", "stall_count", "after_stop")
        pages = ([(int(n), float(q)) for n, q in zip(*page)] for page in zip(numbers, scores))
        return pd.Series([[dict(zip(names, r)) for r in self.walk(page)] for page in pages], dtype=object)

    def close(self) -> None:
        pass


def stall_monitor(
    events: DataFrame, target_qs: float, min_gain: float = MIN_GAIN, stall_window: int = STALL_WINDOW,
    max_passes: int = MAX_PASSES, start_qs: float = 0.0, idle_ms: int | None = None, keys: Sequence[str] = ("page_key",),
) -> DataFrame:
    """Best score, stall count and stop flag per page as pass events arrive; a table of events gives the same rows.

    The state of a page is its passes, so a late one corrects those behind it: they are given again, and of the rows of a pass
    the one with the largest ``seen``, the number of known passes, holds. Repeated events change nothing; of two scores of one pass
    the higher counts. The result so does not depend on the order of arrival. Passes beyond ``max_passes`` are not run: they
    are marked ``after_stop``, without score, and leave no state. Events without a pass or a score are left out. ``start_qs`` is
    the score before the first pass. With ``idle_ms`` the state of a page is given up when it has had no event for that long;
    without, it lasts as long as the query. ``keys`` name a page, by one or several columns.

    Streams need ``spark.sql.streaming.stateStore.providerClass`` set to Spark's RocksDB provider, and with ``idle_ms`` a trigger
    that goes on: state that runs out keeps ``availableNow`` from ending.
    """
    by = [events.schema[k] for k in keys]
    schema = T.StructType(by + T.StructType.fromDDL("pass int, best_qs double, stall_count int, after_stop boolean, seen int").fields)
    usable = events.where("pass is not null and qs is not null and not isnan(qs)").select(*keys, F.col("pass").cast("int").alias("number"), F.col("qs").cast("double").alias("qs"))
    processor = _StallProcessor(list(keys), target_qs, min_gain, max(2, stall_window), max_passes, start_qs, idle_ms)
    if not events.isStreaming:
        # All passes are known, so a table needs no state: one row for each pass, and at most ``max_passes`` of them to a page.
        # A call of Python takes a batch of pages, since a call for each page costs far more than its few passes.
        once = usable.groupBy(*keys, "number").agg(F.max("qs").alias("qs"))
        fold = F.pandas_udf(processor.fold, "array<struct<pass:int,best_qs:double,stall_count:int,after_stop:boolean>>")
        paged = once.where(F.col("number") <= max_passes).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "qs"))).alias("__passes"))
        walked = paged.select(*keys, F.size("__passes").alias("seen"), F.explode_outer(fold("__passes.number", "__passes.qs")).alias("__row"))
        known = walked.select(*keys, "__row.*", "seen")
        beyond = [F.lit(None).cast("double").alias("best_qs"), F.lit(None).cast("int").alias("stall_count"), F.lit(True).alias("after_stop")]
        return known.unionByName(once.where(F.col("number") > max_passes).select(*keys, F.col("number").alias("pass"), *beyond, F.lit(0).alias("seen")))
    return usable.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if idle_ms else "None")


def upsert_sink(path: str, epoch: int = 0):
    """``foreachBatch`` function that keeps a log of changes: a batch is written once and nothing is rewritten.

    Batches are named by ``epoch`` and batch id, so a repeated batch writes the same files again, and skipped or late ids do
    no harm. Batch ids begin anew with a new checkpoint: raise ``epoch`` then. ``read_upserted`` gives the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}/batch={batch_id}")

    return write


def read_upserted(spark: SparkSession, path: str, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """A table as it stands after a change log, on top of ``base``: in each column the last value that is not null.

    One aggregation, combined before the shuffle. Write the result as the next ``base`` from time to time.
    """
    log = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(path)
    changes = log.withColumn("__at", F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("batch").cast("long").alias("batch"))).drop("epoch", "batch")
    if base is not None:
        first = F.struct(F.lit(-1).cast("long").alias("epoch"), F.lit(-1).cast("long").alias("batch"))
        changes = base.withColumn("__at", first).unionByName(changes, allowMissingColumns=True)
    columns = [c for c in changes.columns if c not in keys and c != "__at"]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in columns]
    return changes.groupBy(*keys).agg(*last) if last else changes.select(*keys).distinct()


def settle_failed(docs: DataFrame, events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents of failed runs put back to pending; the last run of a document by its first event counts."""
    runs = events.groupBy("run_id", "document_id").agg(F.min("seq").alias("__seq")).join(outcomes.select("run_id", "outcome"), "run_id")
    last = runs.groupBy("document_id").agg(F.max_by("outcome", F.struct("__seq", "run_id")).alias("__outcome"))
    status = F.when(F.col("__outcome") == "failed", F.lit("pending")).otherwise(F.col("status"))
    return docs.join(last, "document_id", "left").withColumn("status", status).select(*docs.columns)
