"""Integer vectors from a table of embeddings, and folds of small partial results; shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import store

SCALE = 256
FAN = 32


def finite(vector: str = "embedding") -> Column:
    """Whether the vector is there and each of its components is a finite number."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def integers(vector: str = "embedding", scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of each component, taken as a double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers; shorter lists end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def fold(parts: DataFrame, combine: Callable[[list[bytes]], bytes], fan: int = FAN) -> bytes | None:
    """One result from a column ``part`` of partial ones, combined ``fan`` at a time on the executors; None without any.

    Each round is written to the shared folder and leaves a ``fan``-th of the rows, so neither a task nor the driver holds many.
    """

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([combine(table.column("part").to_pylist())], pa.binary())})

    parts = store(parts.select("part"), "parts")
    n = parts.count()
    while n > fan:
        n = -(-n // fan)
        parts = store(parts.withColumn("at", F.pmod(F.monotonically_increasing_id(), F.lit(n))).groupBy("at").applyInArrow(run, "part binary"), "parts")
    last = parts.toArrow().column("part").to_pylist()
    return combine(last) if last else None


def per_task(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> DataFrame:
    """One ``part`` for each task, made from its batches; none where ``make`` gives None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = make(batches)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])

    return df.mapInArrow(run, "part binary")
