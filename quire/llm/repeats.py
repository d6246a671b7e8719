"""Long byte strings that occur more than once in a corpus, removed from every place where they stand.

A byte goes where a string of ``length`` bytes that covers it begins anywhere else too, in the same document or another.
Judging every position by its own suffix would shuffle the corpus several times over, so positions are first gathered by content:

1. Every window of ``length`` bytes has an anchor, the ``gram``-byte string inside it with the least hash. Equal windows have
   equal anchors. Neighbouring windows with one anchor form a run; runs go to the shuffle as a few numbers.
2. Runs whose whole text is equal to another run's are repeated as they stand. Runs whose anchor occurs nowhere else, themselves included, cannot be.
3. What is left, runs that share an anchor but not their text, goes to index tasks by anchor, with its text. There batches of
   windows get suffix arrays, cut at ``length`` bytes; a new suffix array is a level of the index, two levels of equal size are
   merged, and equal neighbours in a merge are long matches. At the end of a group of anchors the levels are merged into one.

Runs with an anchor that more than ``hot`` different runs share are compared by a digest of each window instead, counted before
the shuffle, so that no index task gets an unbounded group. Digests are 64 bits for runs and 128 bits for windows.

Null and empty texts, and texts shorter than ``length``, lose nothing. Repeated rows are copies of each other. Spans of rows
with equal doc_id and text are equal. Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.arrays import mix, prefix_hash, range_hash, slices
from quire.llm.shared import parallelism, row_key, store

LENGTH, GRAM = 400, 200
RUN = 256
HOT = 800
BATCH, GROUP = 8192, 65536
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each full window, from running minima forward and backward in blocks of the window's width."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-n // width) * width, _FULL)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, most: int = RUN) -> tuple[np.ndarray, ...]:
    """Row, first window (place in its row), number of windows, anchor, digest, and whether the anchor stands there twice, of every run."""
    n = len(data)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    if n < length:
        return empty
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    width = length - gram + 1
    hashes = range_hash(prefix, at, at + gram)
    least = window_minima(hashes, width)
    sizes = np.diff(off)
    row_of = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    valid = np.arange(len(least)) + length <= off[1:][row_of]
    if not valid.any():
        return empty
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (row_of[1:] != row_of[:-1])
    start = np.flatnonzero(head)
    ends = np.flatnonzero(valid & ~np.append(valid[1:] & ~head[1:], False)) + 1
    count = ends - start
    parts = -(-count // most)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, count = np.repeat(start, parts) + within * most, np.minimum(np.repeat(count, parts) - within * most, most)
    digest = range_hash(prefix, start, start + count - 1 + length) + mix(count.astype(np.uint64))
    row = row_of[start]
    # First place of the anchor in the first window, and its last place in the last one.
    look = np.lib.stride_tricks.sliding_window_view(hashes, width)
    first = start + (look[start] == least[start][:, None]).argmax(1)
    stop = start + count - 1
    last = stop + width - 1 - (look[stop] == least[stop][:, None])[:, ::-1].argmax(1)
    return row, start - off[row], count, least[start], digest, first != last


def find_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``anchor``, ``digest``, ``row_key``, ``start``, ``windows`` and ``twice`` of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                row, start, count, anchor, digest, twice = runs(data, off, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice)],
                    names=["anchor", "digest", "row_key", "start", "windows", "twice"],
                )

    return docs.mapInArrow(run, "anchor long, digest long, row_key long, start int, windows int, twice boolean")


def sort_runs(found: DataFrame, hot: int = HOT) -> DataFrame:
    """Runs with ``repeated`` (an equal run exists), ``asked`` (its windows are to be compared) and ``crowded`` (by digest).

    A run is asked where another text has its anchor, or the run itself has it twice; of equal runs the first stands for all.
    """
    by = W.partitionBy("anchor").orderBy("digest")
    every = W.partitionBy("anchor")
    seen = found.withColumn("before", F.lag("digest").over(by)).withColumn("after", F.lead("digest").over(by))
    seen = seen.withColumn("others", F.min("digest").over(every) != F.max("digest").over(every))
    first = F.col("before").isNull() | (F.col("before") != F.col("digest"))
    seen = seen.withColumn("crowd", F.sum(first.cast("int")).over(every))  # runs that differ: copies are told by their digest
    repeated = F.coalesce(F.col("before") == F.col("digest"), F.lit(False)) | F.coalesce(F.col("after") == F.col("digest"), F.lit(False))
    out = seen.select("anchor", "row_key", "start", "windows", repeated.alias("repeated"), ((F.col("others") | F.col("twice")) & first).alias("asked"), (F.col("crowd") > hot).alias("crowded"))
    return out.where("repeated OR asked")


class SuffixLevels:
    """Suffix arrays of batches of windows, merged level by level as they grow equal in size.

    A level holds the places of its windows in one text, in the order of the windows' bytes. Windows themselves are made only
    for the blocks of a merge, so memory follows the text and not ``length`` times the text. Of equal windows a level keeps
    one: the others are known to be repeated.
    """

    def __init__(self, text: np.ndarray, length: int, block: int = BATCH) -> None:
        # A window is compared by its bytes, each raised by one so that none is zero, as numpy strings end at zeros.
        self.windows = np.lib.stride_tricks.sliding_window_view(text + np.uint8(1), length)
        self.length, self.block = length, block
        self.levels: list[tuple[np.ndarray, int]] = []
        self.found: list[np.ndarray] = []

    def _keys(self, places: np.ndarray) -> np.ndarray:
        return self.windows[places].view(f"S{self.length}").ravel()

    def _ordered(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places in the order of their windows, one of each window; those with an equal neighbour are noted."""
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        same = keys[1:] == keys[:-1]
        if same.any():
            self.found += [places[1:][same], places[:-1][same]]
            places = places[np.append(True, ~same)]
        return places

    def add(self, places: np.ndarray) -> None:
        """Windows, in batches of a block."""
        for at in range(0, len(places), self.block):
            part = places[at : at + self.block]
            self.levels.append((self._ordered(self._keys(part), part), 1))
            while len(self.levels) > 1 and self.levels[-1][1] == self.levels[-2][1]:
                self._merge()

    def _merge(self) -> None:
        """One merge scan in blocks: each goes as far as the lesser of the two blocks' ends, so equal windows meet in one."""
        (p1, n1), (p2, n2) = self.levels[-2:]
        out, a, b = [], 0, 0
        while a < len(p1) and b < len(p2):
            k1, k2 = self._keys(p1[a : a + self.block]), self._keys(p2[b : b + self.block])
            end = min(k1[-1:].tolist()[0], k2[-1:].tolist()[0])
            n, m = np.searchsorted(k1, end, side="right"), np.searchsorted(k2, end, side="right")
            # Stable sorting of two sorted runs is a merge; equal neighbours are matches between the levels.
            out.append(self._ordered(np.concatenate([k1[:n], k2[:m]]), np.concatenate([p1[a : a + n], p2[b : b + m]])))
            a, b = a + n, b + m
        self.levels[-2:] = [(np.concatenate([*out, p1[a:], p2[b:]]), n1 + n2)]

    def repeated(self) -> np.ndarray:
        """Places of windows that are equal to others."""
        while len(self.levels) > 1:
            self._merge()
        return np.concatenate([*self.found, np.zeros(0, np.int64)])


def join_flags(keys: list[int], starts: list[int], counts: list[int], flags: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans covered by the flagged windows of some runs."""
    counts_ = np.array(counts, np.int64)
    first = np.concatenate([[0], np.cumsum(counts_)])
    head, tail = flags.copy(), flags.copy()
    head[1:] &= ~flags[:-1]
    tail[:-1] &= ~flags[1:]
    edge = first[:-1]
    head[edge] = flags[edge]
    tail[first[1:] - 1] = flags[first[1:] - 1]
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    run = np.searchsorted(first, a, side="right") - 1
    begin = np.array(starts, np.int64)[run] - first[run]
    return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[run]), pa.array((begin + a).astype(np.int32)), pa.array((begin + b + length).astype(np.int32))], names=["row_key", "start", "stop"])


def compare_runs(held: list[tuple[int, int, int, bytes]], length: int = LENGTH, batch: int = BATCH) -> pa.RecordBatch:
    """What is repeated among runs, given as row key, first window, number of windows and text."""
    text = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
    counts = np.array([h[2] for h in held], np.int64)
    # Windows of a run follow one another in the joined texts; the next run's begin length - 1 bytes further on.
    places = np.arange(counts.sum()) + np.repeat(np.arange(len(held)) * (length - 1), counts)
    index = SuffixLevels(text, length, batch)
    index.add(places)
    flags = np.zeros(len(text), bool)
    flags[index.repeated()] = True
    return join_flags([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], flags[places], length)


def compare(bodies: DataFrame, length: int = LENGTH, batch: int = BATCH, group: int = GROUP) -> DataFrame:
    """``row_key``, ``start``, ``stop`` of what is repeated among runs that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(4)]
            for (anchor, key, start, n), body in zip(zip(*columns), b.column(4)):
                if anchor != last and size >= group:
                    yield compare_runs(held, length, batch)
                    held, size = [], 0
                held.append((key, start, n, body.as_py()))
                size, last = size + n, anchor
        if held:
            yield compare_runs(held, length, batch)

    tasks = parallelism(bodies.sparkSession)
    dealt = bodies.select("anchor", "row_key", "start", "windows", "body").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "row_key long, start int, stop int")


def compare_digests(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same by a digest of every window, for anchors that very many different runs share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, start, n, body in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                digests = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([key] * n, pa.int64()), pa.array(range(start, start + n), pa.int32())], names=["digest", "row_key", "start"])

    each = store(bodies.select("anchor", "row_key", "start", "windows", "body").mapInArrow(run, "digest binary, row_key long, start int"), "digests")
    often = each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return each.join(often, "digest").select("row_key", "start", (F.col("start") + length).alias("stop"))


def find_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``row_key``, ``start``, ``stop`` of byte spans that are repeated; spans of a row may overlap."""
    texts = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text"))
    sorted_runs = store(sort_runs(find_runs(texts, length, gram), hot), "runs")
    whole = sorted_runs.where("repeated").select("row_key", "start", (F.col("start") + F.col("windows") - 1 + length).alias("stop"))
    asked = sorted_runs.where("asked").groupBy("row_key").agg(F.collect_list(F.struct("anchor", "start", "windows", "crowded")).alias("asked"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                lists = part.column(2)
                runs_ = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                start, n = runs_.field("start").to_numpy(), runs_.field("windows").to_numpy()
                begin = off[row] + start
                raw = data.tobytes()
                body = pa.array([raw[a:b] for a, b in zip(begin.tolist(), (begin + n - 1 + length).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([runs_.field("anchor"), part.column(0).take(pa.array(row)), runs_.field("start"), runs_.field("windows"), runs_.field("crowded"), body], names=["anchor", "row_key", "start", "windows", "crowded", "body"])

    kept = store(texts.join(asked, "row_key").select("row_key", "text", "asked").mapInArrow(bodies, "anchor long, row_key long, start int, windows int, crowded boolean, body binary"), "bodies")
    return whole.union(compare(kept.where("NOT crowded"), length)).union(compare_digests(kept.where("crowded"), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row; ``with_bytes`` adds what is left, ``kept_bytes``."""
    spans = find_spans(docs, length, gram, hot).groupBy("row_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # equal rows have equal spans
    texts = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                size = np.diff(off)
                lists = part.column(2)
                each = lists.flatten()
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), counts)
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, off[row] + each.field("start").to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, off[row] + each.field("stop").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(edge[:-1]) > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                starts = off[:-1][size > 0]
                head[starts] = gone[starts]
                total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
                removed, raw = total(gone), data.tobytes()
                left, place = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(size - removed)])
                kept = [raw[a:b] if not r else left[c:d] for a, b, r, c, d in zip(off[:-1].tolist(), off[1:].tolist(), removed.tolist(), place[:-1].tolist(), place[1:].tolist())]
                columns = [part.column(0), pa.array(size), pa.array(removed), pa.array(total(head)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_bytes:
                    columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: len(columns)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_bytes else "")
    return texts.join(spans, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
