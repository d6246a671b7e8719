"""A keyed table that takes in changes: bucketed base and change files, merged bucket by bucket.

A batch of changes is written once, in the buckets of its keys. Reading joins the change files to the base by
equal buckets, so neither side is shuffled. Compaction folds changes into new base files of the buckets that
have gathered many and leaves all other buckets as they are.

Each value carries the ``(seq, batch)`` of the change that set it, and the newest wins whatever the order of arrival:
late batches, repeated batches and a compaction that ran twice all lead to the same rows.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP = "struct<seq:bigint,batch:bigint>"
STATE = "step bigint, buckets array<struct<base:bigint,folded:bigint>>, live array<bigint>, batch bigint"
OLDEST = -(2**63)


def _later(a: Column, b: Column) -> Column:
    return a.isNotNull() & (b.isNull() | (a > b))


class KeyedTable:
    """Rows that are unique by ``keys``, kept under ``path`` (a folder that driver and executors share).

    ``schema`` is DDL text or a schema of keys and further columns. A table opened with more columns than before reads the new ones
    as null. The number of ``buckets`` stays as the table was first opened with. One writer at a time; any number of readers.

    Two external tables of the current database, named by a hash of path and columns, tell Spark of the buckets;
    dropping them leaves the files, and opening the table makes them anew.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str | T.StructType, buckets: int = 64):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in self.schema if f.name not in self.keys]
        if missing := set(self.keys) - {f.name for f in self.schema}:
            raise ValueError(f"no such key columns: {sorted(missing)}")
        self.buckets = buckets
        step, of, live, _ = self._state()
        if len(of) != buckets:
            raise ValueError(f"the table has {len(of)} buckets, not {buckets}")
        types = {f.name: f.dataType.simpleString() for f in self.schema}
        stored = [f"`{c}` {types[c]}" for c in [*self.keys, *self.columns]]
        stamps = ",".join(f"`{c}`:{STAMP}" for c in self.columns)
        stored += [*([f"stamps struct<{stamps}>"] if stamps else []), f"seen {STAMP}", f"gone {STAMP}"]
        name = "keyed_" + hashlib.sha256(f"{path} {buckets} {stored}".encode()).hexdigest()[:24]
        by = ", ".join(f"`{k}`" for k in self.keys)
        self._names = {}
        for kind, there in (("base", max(of)[0] >= 0), ("changes", step > 0)):
            self._names[kind] = f"{name}_{kind}"
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name}_{kind} ({', '.join(stored)}, number BIGINT, bucket INT) USING parquet "
                f"PARTITIONED BY (number, bucket) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{kind}'"
            )
            if there:
                spark.catalog.recoverPartitions(f"{name}_{kind}")

    # State: which write each bucket's base comes from and up to which write changes are folded into it; the writes
    # of change batches that are still read; the last batch taken in. Writes are numbered by time, so a write
    # that never came to its commit is never read and never written into.

    def _state(self) -> tuple[int, list[tuple[int, int]], list[int], int]:
        """The newest committed state; that of an empty table before the first batch."""
        try:
            log = self.spark.read.schema(STATE).parquet(f"{self.path}/state")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return 0, [(-1, -1)] * self.buckets, [], -1
        row = log.agg(F.max_by(F.struct(*log.columns), "step").alias("row")).first()["row"]
        return row["step"], [(b["base"], b["folded"]) for b in row["buckets"]], list(row["live"]), row["batch"]

    def _commit(self, step: int, of: list[tuple[int, int]], live: list[int], batch: int) -> None:
        """One row in one file by one rename: a state is there as a whole or not at all."""
        self.spark.createDataFrame([(step, of, live, batch)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/at={step}")

    def _number(self, of: list[tuple[int, int]], live: list[int]) -> int:
        """A new number, above all before it also where clocks differ."""
        return max([time.time_ns(), *(n + 1 for pair in of for n in pair), *(n + 1 for n in live)])

    def last_batch(self) -> int:
        """The last batch taken in; -1 for a new table."""
        return self._state()[3]

    # Writing

    def put(self, changes: DataFrame, batch: int | None = None) -> int:
        """Take in a batch of changes and return its number.

        ``changes`` holds the keys, ``seq`` (null counts as oldest), any of the columns (null leaves a value as it is) and, if rows
        are to go, a boolean ``deleted``. In each column the greatest ``seq`` wins, ties go to the later batch and in one batch to the
        greater hash; a deletion takes all values up to its own ``seq``. Batches are numbered upwards; give ``batch`` where the caller numbers
        them, as ``foreachBatch`` does: one that was taken in before is not taken in again. A null key is an error.
        The batch is combined by key before it is shuffled, so many changes of one key are one row.
        """
        step, of, live, last = self._state()
        if batch is not None and batch <= last:
            return batch
        batch = last + 1 if batch is None else batch
        types = {f.name: f.dataType for f in self.schema}
        given = set(changes.columns)
        if unknown := given - set(types) - {"seq", "deleted"}:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        key = [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in key {k}"))).otherwise(F.col(k)).cast(types[k]).alias(k) for k in self.keys]
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in given else F.lit(False)
        at = F.struct(F.coalesce(F.col("seq").cast("long"), F.lit(OLDEST)).alias("seq"), F.lit(batch).cast("long").alias("batch"))
        value = [(F.col(c) if c in given else F.lit(None)).cast(types[c]).alias(c) for c in self.columns]
        rows = changes.select(*key, *value, at.alias("at"), deleted.alias("deleted"))
        aggregates = [F.max(F.when(~F.col("deleted"), F.col("at"))).alias("seen"), F.max(F.when(F.col("deleted"), F.col("at"))).alias("gone")]
        for c in self.columns:
            plain = F.to_json(F.struct(c)) if "map<" in types[c].simpleString() else F.col(c)
            stamp = F.when(~F.col("deleted") & F.col(c).isNotNull(), F.struct("at", F.xxhash64(plain)))
            aggregates += [F.max_by(c, stamp).alias(c), F.max(stamp)["at"].alias(f"at {c}")]
        number = self._number(of, live)
        self._write("changes", number, rows.groupBy(*self.keys).agg(*aggregates).repartition(self.buckets, *self.keys))
        self._commit(step + 1, of, [*live, number], batch)
        return batch

    def compact(self, share: float = 0.1, forget_before: int | None = None) -> list[int]:
        """Fold changes into the base in the buckets whose change rows are at least ``share`` of their base rows; the buckets folded.

        Base files of other buckets are not read or written. Deleted keys stay as marks, so that late changes don't bring
        them back; marks with a ``seq`` below ``forget_before`` go. Files that are no longer read stay until ``stale`` ones are removed.
        """
        step, of, live, last = self._state()
        counts = lambda df: {r["bucket"]: r["count"] for r in df.groupBy("bucket").count().collect()}  # noqa: E731  one row per bucket
        new, old = counts(self._changes(of, live)), counts(self._base(of))
        chosen = sorted(b for b, n in new.items() if n >= share * old.get(b, 0))
        if not chosen:
            return []
        merged = self._merge(of, live, chosen)
        if forget_before is not None:
            merged = merged.where(_later(F.col("seen"), F.col("gone")) | (F.col("gone.seq") >= forget_before))
        number = self._number(of, live)
        self._write("base", number, merged)
        for b in chosen:
            of[b] = number, max(live)
        self._commit(step + 1, of, [n for n in live if n > min(folded for _, folded in of)], last)
        return chosen

    def stale(self) -> list[str]:
        """Folders that no reader of the newest state needs, for the caller's clean-up."""
        _, of, live, _ = self._state()
        folders = []
        for kind in self._names:
            for row in self.spark.sql(f"SHOW PARTITIONS {self._names[kind]}").collect():
                number, bucket = (int(part.split("=")[1]) for part in row[0].split("/"))
                base, folded = of[bucket]
                if (kind == "base" and number != base) or (kind == "changes" and (number not in live or number <= folded)):
                    folders.append(f"{self.path}/{kind}/{row[0]}")
        return sorted(folders)

    def _write(self, kind: str, number: int, rows: DataFrame) -> None:
        stamps = [F.struct(*[F.col(f"at {c}").alias(c) for c in self.columns]).alias("stamps")] if self.columns else []
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")  # as the writer places rows
        view = f"{self._names[kind]}_rows"
        rows.select(*self.keys, *self.columns, *stamps, "seen", "gone", bucket).createOrReplaceTempView(view)
        self.spark.sql(f"INSERT INTO {self._names[kind]} PARTITION (number = {number}, bucket) SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    # Reading

    def _stored(self, kind: str) -> DataFrame:
        df = self.spark.table(self._names[kind])
        return df.select(*self.keys, *self.columns, *[F.col(f"stamps.`{c}`").alias(f"at {c}") for c in self.columns], "seen", "gone", "number", "bucket")

    def _base(self, of: list[tuple[int, int]]) -> DataFrame:
        return self._stored("base").where(F.col("number") == F.array(*[F.lit(base) for base, _ in of])[F.col("bucket")])

    def _changes(self, of: list[tuple[int, int]], live: list[int]) -> DataFrame:
        unfolded = F.col("number") > F.array(*[F.lit(folded) for _, folded in of])[F.col("bucket")]
        return self._stored("changes").where(F.col("number").isin(live) & unfolded)

    def _merge(self, of: list[tuple[int, int]], live: list[int], chosen: list[int] | None = None) -> DataFrame:
        """Base and changes as one row per key with its stamps, deleted keys included; both sides are read by bucket."""
        base, changes = self._base(of), self._changes(of, live)
        if chosen is not None:
            base, changes = base.where(F.col("bucket").isin(chosen)), changes.where(F.col("bucket").isin(chosen))
        aggregates = [F.max(c).alias(f"new {c}") for c in ("seen", "gone")]
        for c in self.columns:
            aggregates += [F.max_by(c, f"at {c}").alias(f"new {c}"), F.max(f"at {c}").alias(f"new at {c}")]
        joined = base.drop("number", "bucket").join(changes.groupBy(*self.keys).agg(*aggregates), self.keys, "full")

        def newest(c: str, by: str) -> Column:
            return F.when(_later(F.col(f"`new {by}`"), F.col(f"`{by}`")), F.col(f"`new {c}`")).otherwise(F.col(f"`{c}`")).alias(c)

        values = [newest(c, by) for column in self.columns for c, by in ((column, f"at {column}"), (f"at {column}", f"at {column}"))]
        return joined.select(*self.keys, *values, newest("seen", "seen"), newest("gone", "gone"))

    def read(self) -> DataFrame:
        """The table as it stands: keys and columns of all rows that are not deleted."""
        _, of, live, _ = self._state()
        rows = self._merge(of, live).where(_later(F.col("seen"), F.col("gone")))
        values = [F.when(_later(F.col(f"`at {c}`"), F.col("gone")), F.col(c)).alias(c) for c in self.columns]
        return rows.select(*self.keys, *values)
