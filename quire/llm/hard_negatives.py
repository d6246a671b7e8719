"""Hard negatives by the threshold algorithm: candidates near an anchor, of another label, scoring within a window below a positive.

Vectors are read as integers ``floor(256 * c)``, and a score is the integer inner product. Candidates are taken in blocks; a block
keeps, for each dimension, its rows sorted by that component. An anchor walks all lists side by side, each from the end that its
own component's sign prefers; what it meets gets its exact score by random access. The sum of the anchor's components times the
last values met bounds every score not met yet: once it falls strictly below the lowest score that still counts in each of the
anchor's windows, nothing more can enter. That score is the window's k-th best so far, or its lower end while it is not full.

The first pass has one window for each anchor: the best rows of its own label, which are its positives. The second has one for each
positive: rows of other labels between ``LOW`` and ``HIGH`` percent of the positive's score. A task carries the best of its earlier
blocks along, so later ones stop sooner, and passes on at most k rows a window; a rank within the window merges the tasks.

Anchors are a stated query set (ids divisible by ``EVERY``). They are dealt into groups of about ``GROUP`` by a hash, and one group
after another is broadcast and compared with all candidates where these lie, so the broadcast does not grow with the data.

Rows with a null label or vector, with a null or non-finite component, or whose inner product with themselves exceeds a long take
no part. Shorter vectors end in zeros. Each row is a candidate and, where its id fits, an anchor of its own, repeated rows
included; an anchor row is not its own positive, but another row with its id may be. Null ids are candidates, after all others at
equal scores. Ties go by the smaller id; among equal ids by the row's place in the stored table, which changes nothing that is
returned. A positive score below 0 leaves an empty window, 0 one of score 0. An empty table gives no rows. Other columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import fresh_dir, store
from quire.llm.vectors import finite, integers, matrix

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
LOW, HIGH = 30, 90
GROUP, BLOCK, FIRST_DEPTH = 4096, 4096, 32
_LAST = np.iinfo(np.int64).max


class Block:
    """Candidate rows with their sorted lists. ``x`` are vectors, ``label`` labels, ``tie`` ids and ``row`` row numbers."""

    def __init__(self, x: np.ndarray, label: np.ndarray, tie: np.ndarray, row: np.ndarray) -> None:
        self.x, self.label, self.tie, self.row = x, label, tie, row
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, 0).astype(float)
        self.reals = x.astype(float)
        self.most = float(np.abs(self.reals).max(initial=0))

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where no sum can pass 2**53, else in longs, whose overflows cancel out."""
        if self.most * np.abs(anchor.astype(float)).sum() < 2.0**53:
            return (self.reals[rows] @ anchor.astype(float)).astype(np.int64)
        return self.x[rows] @ anchor


class Windowed:
    """The best ``k`` rows of one window so far: scores between ``low`` and ``high``, by falling score, rising id and row."""

    def __init__(self, low: int, high: int, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.score = self.tie = self.row = np.zeros(0, np.int64)

    def bar(self) -> int:
        """A row that scores below this can no longer enter."""
        return int(self.score[-1]) if len(self.score) == self.k else self.low

    def add(self, score: np.ndarray, tie: np.ndarray, row: np.ndarray) -> None:
        fits = (score >= self.bar()) & (score <= self.high)
        if fits.any():
            score, tie, row = (np.concatenate(p) for p in ((self.score, score[fits]), (self.tie, tie[fits]), (self.row, row[fits])))
            best = np.lexsort((row, tie, -score))[: self.k]
            self.score, self.tie, self.row = score[best], tie[best], row[best]


def walk(block: Block, anchor: np.ndarray, allowed: np.ndarray, windows: list[Windowed]) -> int:
    """The threshold algorithm for one anchor over one block; gives the number of rows scored. ``allowed`` marks rows that may count."""
    used = np.flatnonzero(anchor)
    up = anchor[used] > 0
    size, weight = len(block.x), anchor[used].astype(float)
    seen = np.zeros(size, bool)
    depth, done = FIRST_DEPTH, 0
    slack = 1e-9 * np.abs(weight).sum() * block.most if np.abs(weight).sum() * block.most >= 2.0**53 else 0.0
    while True:
        depth = min(depth, size)
        met = np.zeros(size, bool)
        if done < depth and len(used):
            met[block.order[size - depth : size - done, used[up]].ravel()] = True
            met[block.order[done:depth, used[~up]].ravel()] = True
        else:
            met[:] = True
        rows = np.flatnonzero(met & ~seen & allowed)
        seen |= met
        if len(rows):
            score = block.scores(rows, anchor)
            for w in windows:
                w.add(score, block.tie[rows], block.row[rows])
        if depth >= size or seen.all() or not len(used):
            return int((seen & allowed).sum())
        last = np.where(up, block.sorted[size - depth, used], block.sorted[depth - 1, used])
        if last @ weight + slack < min(w.bar() for w in windows):
            return int((seen & allowed).sum())
        done, depth = depth, depth * 2


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Block]:
    """Blocks of about ``BLOCK`` rows whatever the size of the batches."""
    waiting: list[pa.RecordBatch] = []
    n = 0

    def make() -> Block:
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        tie = np.asarray(whole.column(1).fill_null(_LAST))
        return Block(matrix(whole.column(3), dims), np.asarray(whole.column(2)), tie, np.asarray(whole.column(0)))

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            waiting.append(part)
            n += part.num_rows
            if n >= BLOCK:
                yield make()
                waiting, n = [], 0
    if n:
        yield make()


def usable(embeddings: DataFrame) -> DataFrame:
    """``row``, ``vec_id``, ``label`` and the integer vector ``x`` of rows that take part, written to the shared folder."""
    vec, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label)
    whole = F.aggregate("embedding", F.lit(0.0), lambda t, c: t + F.pow(F.floor(c.cast("double") * 256).cast("double"), F.lit(2)))
    rows = embeddings.where(finite() & F.col("label").isNotNull()).where(whole < 2.0**62)
    return store(rows.select(F.monotonically_increasing_id().alias("row"), vec.alias("vec_id"), moved.alias("label"), integers().alias("x")), "vectors")


def _search(rows: DataFrame, windows: dict, dims: int, same: bool, k: int) -> DataFrame:
    """``window``, ``row``, ``vec_id`` and ``score``: at most ``k`` rows of each task for each window of one group of anchors.

    ``windows`` has arrays ``x``, ``label`` and ``own`` (row) of the anchors, and for each window its ``anchor`` (by place), ``low`` and ``high``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        kept = [Windowed(int(a), int(b), k) for a, b in zip(w["low"], w["high"])]
        first = np.searchsorted(w["anchor"], np.arange(len(w["own"]) + 1))
        for block in _blocks(batches, dims):
            by_label = {y: block.label == y for y in np.unique(block.label).tolist()}
            none = np.zeros(len(block.label), bool)
            for i in range(len(w["own"])):
                own = [x for x in kept[first[i] : first[i + 1]] if x.low <= x.high]
                if own:
                    alike = by_label.get(int(w["label"][i]), none)
                    allowed = alike & (block.row != w["own"][i]) if same else ~alike
                    walk(block, w["x"][i], allowed, own)
        sizes = [len(x.row) for x in kept]
        if sum(sizes):
            tie = np.concatenate([x.tie for x in kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(kept)), sizes)), pa.array(np.concatenate([x.row for x in kept])), pa.array(tie, mask=tie == _LAST), pa.array(np.concatenate([x.score for x in kept]))],
                names=["window", "row", "vec_id", "score"],
            )

    return rows.select("row", "vec_id", "label", "x").mapInArrow(run, "window long, row long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window, with their ``rank``."""
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``anchors`` is a condition on ``vec_id`` (divisible by ``EVERY`` unless given).
    """
    spark = embeddings.sparkSession
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(embeddings)
    chosen = store(rows.where(F.col("vec_id") % EVERY == 0 if anchors is None else anchors), "anchors")
    total = chosen.agg(F.count("*")).first()[0]
    if not total:
        return spark.createDataFrame([], shape)
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    groups, out = -(-total // GROUP), fresh_dir(spark, "negatives")
    spark.createDataFrame([], shape).write.parquet(out)
    for g in range(groups):
        own = chosen.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        own = own.sort_by("row")
        x = matrix(own.column("x").combine_chunks(), dims)
        about = {"x": x, "label": np.asarray(own.column("label")), "own": np.asarray(own.column("row"))}
        n, ids = own.num_rows, np.asarray(own.column("vec_id"))
        each = about | {"anchor": np.arange(n), "low": np.full(n, -(1 << 63)), "high": np.full(n, (1 << 63) - 1)}
        best = _first(_search(rows, each, dims, True, positives), positives).toArrow().sort_by([("window", "ascending"), ("rank", "ascending")])
        if not best.num_rows:
            continue
        anchor, score = np.asarray(best.column("window")), [int(s) for s in best.column("score").to_pylist()]
        # The bounds in whole numbers: low * score <= 100 * negative <= high * score.
        wide = about | {"anchor": anchor, "low": np.array([-(-low * s // 100) for s in score], np.int64), "high": np.array([high * s // 100 for s in score], np.int64)}
        named = spark.createDataFrame(
            pa.table({"window": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": best.column("vec_id"), "positive_score": np.array(score, np.int64)})
        )
        mined = _first(_search(rows, wide, dims, False, negatives), negatives).join(F.broadcast(named), "window")
        mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(shape).parquet(out)
