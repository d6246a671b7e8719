"""Quality scores from naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a linear machine over them.

A text is the set of its n-grams, hashed into ``2 ** BITS`` places: single words, pairs of neighbouring words, and runs of three
bytes with their case. A word that repeats the one before it reads as one common sign, and so does a line that repeats an
earlier line of the text; so repetition itself is an n-gram, whatever it repeats.

For each n-gram the log-count ratio compares how often the documents of either class hold it. A document becomes the vector of
its n-grams' ratios, of unit length. The linear machine over these vectors has hinge loss and is trained by dual coordinate
descent; its weights are mixed with their mean size, so that n-grams the machine did not need keep some of their Bayes weight.
Scores are a logistic function of the margin, fitted on margins of documents that the machine did not see (``FOLDS`` parts),
with each class weighted by its share among all labelled documents that are not held out.

Training takes a bounded sample of labelled documents: ``per_class`` of each class by a hash of their id, and of those as many
as hold ``max_grams`` n-grams in all. N-grams are found on the executors; texts do not reach the driver. Scoring uses no
shuffle and reads whole texts.

Null and empty texts have no n-grams and get the score of a margin equal to the bias. Rows are scored alone, so repeated rows
score alike. Several labels of one id count as the lowest; several texts of one id count as one, the one of the least digest;
null labels and ids are not learnt from. Without labelled rows of both classes every score is the share of label 1 (0.5 without
labels). An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import lower, mix, slices, word_hashes, words
from quire.llm.shared import store

BITS = 18
PER_CLASS, MAX_GRAMS = 4000, 12_000_000
FOLDS, EPOCHS, COST, BAYES = 4, 12, 1.0, 0.25
LIMIT = 0.3
_PLACES = 1 << BITS
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False
_SAME_WORD, _SAME_LINE = np.uint64(0x51ED270B7A64D5A1), np.uint64(0xC2B2AE3D27D4EB4F)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _same_lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows in which a line with a word equals an earlier line."""
    start, end, first = words(data, off, ~_NEWLINE)
    if not len(start):
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    _, _, first_word = words(data, np.append(start, len(data)))
    inked = np.diff(first_word) > 0
    line, row = word_hashes(data, start, end)[inked], row[inked]
    order = np.lexsort((line, row))
    line, row = line[order], row[order]
    return np.unique(row[1:][(line[1:] == line[:-1]) & (row[1:] == row[:-1])])


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of each row, repeats included, and the first of each row (one more than rows)."""
    n = len(off) - 1
    start, end, first = words(data, off)
    word = word_hashes(lower(data), start, end)
    row = np.repeat(np.arange(n), np.diff(first))
    after = np.zeros(len(word), bool)
    after[1:] = row[1:] == row[:-1]
    same = after.copy()
    same[1:] &= word[1:] == word[:-1]
    sign = np.where(same, _SAME_WORD, word)
    pair = np.flatnonzero(after)
    byte_row = np.repeat(np.arange(n), np.diff(off))
    wide = data.astype(np.uint64)
    three = np.flatnonzero(byte_row[2:] == byte_row[:-2]) if len(data) > 2 else np.zeros(0, np.int64)
    lines = _same_lines(data, off)
    parts = [
        (row, _places(mix(sign))),
        (row[pair], _places(mix(mix(sign[pair - 1]) * np.uint64(3) + sign[pair]))),
        (byte_row[three], _places(mix((wide[three] << np.uint64(16) | wide[three + 1] << np.uint64(8) | wide[three + 2]) + np.uint64(0x9E3779B97F4A7C15)))),
        (lines, np.full(len(lines), _places(mix(np.array([_SAME_LINE])))[0])),
    ]
    size = sum(np.bincount(r, minlength=n) for r, _ in parts) if n else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out, at = np.empty(begin[-1], np.int64), begin[:-1].copy()
    for r, place in parts:
        count = np.bincount(r, minlength=n)
        out[np.repeat(at - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(r))] = place
        at += count
    return out, begin


def gram_sets(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct places of each row."""
    places, begin = grams(data, off)
    seen = np.zeros(_PLACES, bool)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a < 4096:
            yield np.unique(places[a:b])
        else:
            seen[places[a:b]] = True
            yield np.flatnonzero(seen)
            seen[:] = False


def log_count_ratios(sets: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """For each place, the logarithm of its smoothed share in good documents over that in bad ones."""
    count = np.ones((2, _PLACES))
    for s, y in zip(sets, good.astype(int).tolist()):
        count[y, s] += 1
    count /= count.sum(1, keepdims=True)
    return np.log(count[1] / count[0])


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, least: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights (the last place is the bias) with the least hinge loss, by dual coordinate descent.

    ``x`` holds places and values of each row, ``y`` is 1 or -1, ``cost`` bounds each row's dual variable. A step moves one
    variable to its best value with all others fixed; rows are visited in a fresh random order in each epoch, and an epoch that
    moves no variable by ``least`` ends the training.
    """
    w = np.zeros(_PLACES + 1)
    alpha = np.zeros(len(x))
    length = np.array([v @ v + 1.0 for _, v in x])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)).tolist():
            at, v = x[i]
            slope = y[i] * (w[at] @ v + w[-1]) - 1.0
            fresh = min(max(alpha[i] - slope / length[i], 0.0), cost[i])
            step = (fresh - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = fresh
        if moved < least:
            break
    return w


def platt(margin: np.ndarray, good: np.ndarray, mass: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic function of the margin, by damped Newton steps with a small ridge."""
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (mass * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (mass * (p - good)) + 1e-6 * w)
        w -= step / max(1.0, np.abs(step).max() / 3)
    return float(max(w[0], 0.0)), float(w[1])


class Model:
    """``used`` and ``square`` hold, for each place, what it adds to a margin and to the squared length of a document's vector."""

    def __init__(self, sets: list[np.ndarray], good: np.ndarray, share: float) -> None:
        self.share, self.used = share, None
        if not len(good) or good.min() == good.max():
            return
        order = np.random.default_rng(11).permutation(len(good))
        part = np.empty(len(good), int)
        for y in (0, 1):
            own = order[good[order] == y]
            part[own] = np.arange(len(own)) % FOLDS
        margin = np.zeros(len(good))
        for fold in range(FOLDS):
            seen, other = np.flatnonzero(part != fold), np.flatnonzero(part == fold)
            if len(np.unique(good[seen])) < 2:
                seen = np.arange(len(good))
            self._fit([sets[i] for i in seen], good[seen])
            margin[other] = [self.margin(sets[i]) for i in other]
        self._fit(sets, good)
        mass = np.where(good == 1, share / (good == 1).sum(), (1 - share) / (good == 0).sum()) * len(good)
        self.slope, self.shift = platt(margin, good, mass)

    def _fit(self, sets: list[np.ndarray], good: np.ndarray) -> None:
        ratio = log_count_ratios(sets, good)
        x = []
        for s in sets:
            v = ratio[s]
            x.append((s, v / max(np.sqrt(v @ v), 1e-12)))
        y = np.where(good == 1, 1.0, -1.0)
        cost = COST * np.where(good == 1, 0.5 * len(good) / (good == 1).sum(), 0.5 * len(good) / (good == 0).sum())
        w = dual_descent(x, y, cost)
        mean = np.abs(w[:-1]).sum() / max((w[:-1] != 0).sum(), 1)
        self.used = ((1 - BAYES) * w[:-1] + BAYES * mean) * ratio
        self.square, self.bias = ratio * ratio, float(w[-1])

    def margin(self, places: np.ndarray) -> float:
        length = self.square[places].sum()
        return self.bias + (float(self.used[places].sum() / np.sqrt(length)) if length > 1e-24 else 0.0)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.used is None:
            return np.full(len(off) - 1, self.share)
        margin = np.array([self.margin(s) for s in gram_sets(data, off)])
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_grams: int = MAX_GRAMS) -> Model:
    """A model from at most ``per_class`` labelled documents of each class, none of them held out, with ``max_grams`` n-grams in all."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"))
    known = known.where(~is_held_out()).withColumn("place", F.xxhash64("doc_id"))
    total = known.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    share = total["good"] / total["n"] if total["n"] else 0.5
    part = lambda y: known.where(F.col("good") == y).orderBy("place", "doc_id").limit(per_class)
    sample = F.broadcast(part(1).union(part(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id").select("place", "doc_id", "good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                sets = [s.astype(np.int32) for s in gram_sets(data, off)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["place", "doc_id", "good", "grams"])

    found = rows.mapInArrow(run, "place long, doc_id long, good int, grams array<int>")
    one = store(found.groupBy("place", "doc_id", "good").agg(F.min_by("grams", F.xxhash64("grams")).alias("grams")), "grams")
    by_place = [("place", "ascending"), ("doc_id", "ascending")]
    sizes = one.select("place", "doc_id", F.size("grams").alias("n")).toArrow().sort_by(by_place)
    fit = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), max_grams, side="right"))
    last = F.struct(F.lit(sizes.column("place")[fit - 1].as_py()).alias("place"), F.lit(sizes.column("doc_id")[fit - 1].as_py()).alias("doc_id")) if fit else None
    taken = one.where(F.struct("place", "doc_id") <= last if fit else F.lit(False)).toArrow().sort_by(by_place)
    sets = [np.asarray(x.values) for x in taken.column("grams")]
    return Model(sets, taken.column("good").to_numpy().astype(int), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.scores(data, off).astype(float))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
