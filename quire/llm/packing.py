"""Packing of documents into sequences of a fixed number of tokens by best-fit decreasing.

A document's ids are cut into full windows first; each of those is a sequence of its own. What is left of each document
is shorter than a window, and these rests are packed in order of decreasing length, each into the open window with the
least room that still holds it. A segment tree over the possible amounts of room finds that window in a number of steps
that depends on the window size alone.

Rests are dealt to packing tasks by a hash of their document, as rows of a few numbers; the tasks get them already sorted,
and keep only the open windows. A task's sequences are numbered within the task's own range, so a task that runs again
gives the same numbers.

Null and empty texts are one end token long. Repeated rows are packed as often as they occur. An empty table gives no rows.
Columns of the input other than the two named ones do not matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import slices
from quire.llm.shared import parallelism, store
from quire.llm.tokens import Pieces, with_end

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by their room, in a segment tree: a node tells whether any window with room in its range is open."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int, offset: int) -> None:
        self.at[room].append((sequence, offset))
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int, int] | None:
        """The window with the least room of at least ``length``: its room, number and fill."""
        count, node = self.count, self.leaves + length
        while not count[node]:
            while node & 1:  # a right child: the ranges to the right begin above
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        sequence, offset = self.at[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, sequence, offset


def best_fit(lengths: list[int], window: int, tree: OpenWindows, used: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each length, in the given order; ``used`` is the number of sequences so far."""
    sequence, offset = [], []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, s, o = window, used, 0
            used += 1
        else:
            room, s, o = found
        sequence.append(s)
        offset.append(o)
        if room > n:
            tree.add(room - n, s, o + n)
    return sequence, offset, used


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every document's pieces of at most ``window`` ids; ``with_ids`` adds the ids themselves."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(tokenizer)
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                ids, rows = with_end(*pieces.encode(data, off), end_id)
                ids, total = ids.astype("<u4"), np.diff(rows)
                cuts = (total + window - 1) // window
                row = np.repeat(np.arange(len(total)), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
                length = np.minimum(total[row] - start, window)
                raw, first = ids.tobytes(), rows[row] + start
                crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())], np.int64)
                salt = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())], np.int64)
                columns = [part.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, total[row], salt[row]))]
                if with_ids:
                    # Pieces lie one after another in the ids.
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def assign_sequences(pieces: DataFrame, window: int = WINDOW, tasks: int | None = None) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece, by best-fit decreasing within each of ``tasks`` shares of the documents."""
    tasks = tasks or parallelism(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, used, base = OpenWindows(window), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_pylist()
            sequence, offset, used = best_fit(length, window, tree, used)
            yield batch.append_column("sequence_id", pa.array(np.array(sequence, np.int64) + base)).append_column("offset", pa.array(offset, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    # The salt splits rows of one document id; the order is total but for rows that are equal throughout.
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "salt", "start")).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32", "salt")
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False, tasks: int | None = None) -> DataFrame:
    """Pieces of ``doc_id`` and ``text`` with their place in sequences of ``window`` ids.

    A piece lies at ``offset`` of sequence ``sequence_id``; offsets leave no gaps. Only rows of numbers are shuffled,
    unless ``with_ids`` asks for the ids too.
    """
    pieces = cut_documents(docs, tokenizer, end_id, window, with_ids)
    if with_ids:
        pieces = store(pieces, "pieces")
    return assign_sequences(pieces, window, tasks).drop("salt")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id``, ``tokens`` and ``ids`` of each sequence of ``pack(..., with_ids=True)``, padded to the window."""
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return whole.select("sequence_id", "tokens", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - F.col("tokens").cast("int"))).alias("ids"))
