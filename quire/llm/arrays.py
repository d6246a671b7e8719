"""Byte-level numpy helpers shared by the operators that work inside Arrow batches.

Texts are read from the Arrow buffers without making Python strings. A null text counts as an empty one.
Batches are cut into slices of a few megabytes of text, so that the eight-byte arrays made from them stay small
whatever the number of rows in an Arrow batch; one very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE_INV)]))


_POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[i] the sum of (byte + 1) * base**position over the first i bytes."""
    _POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of data[start:end] for each pair; equal contents have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _POWERS.down[start])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each row (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``limit`` bytes of text each (or one longer row), with their text buffer."""
    data, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield batch.slice(row, last - row), data[off[row] : off[last]], off[row : last + 1] - off[row]
        row = last


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than those of ``gap`` (ASCII white space), and the first word of each row (one more than rows)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    ink = ~gap[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[off] = True
    head = ink.copy()
    head[1:] &= ~ink[:-1] | fresh[1:-1]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:] | fresh[1:-1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(start, off)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(data), start, end)


def gram_hashes(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window inside a row, and the first window of each row (one more than rows).

    A row with fewer than k words, but some, has one window: its whole sequence.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    size = np.minimum(n, k)[row]
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    for j in range(k):
        step = np.uint64((2 * j + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
        part = mix(padded[at + j] + step)
        out += part if j == 0 else np.where(size > j, part, np.uint64(0))
    return mix(out), begin


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def pass_through(docs: DataFrame, column: str, kind: str, make) -> DataFrame:
    """All columns of ``docs`` and one more, made from slices of ``text`` by ``make(data, offsets) -> pa.Array``; nothing is shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), make(data, off)], names=["row", "made"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("made", _parse_datatype_string(kind))]))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("made").alias(column))


def read_words(batch: pa.RecordBatch, column: str, fold: bool = True, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the hash of each word and the first word of each row."""
    for part, data, off in slices(batch, column, limit):
        start, end, first = words(data, off)
        yield part, word_hashes(lower(data) if fold else data, start, end), first
