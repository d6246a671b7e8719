"""Folders that the driver and all executors share, and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows written as Parquet into the shared folder and read again: later steps neither repeat nor lose them."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's contents; rows with equal contents share it, nulls count as values."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns])


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def put_file(folder: str, name: str, data: bytes) -> None:
    """A whole file written under another name first, so that a task which runs again leaves one whole file."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    waiting = f"{path}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(waiting) as out:
        out.write(data)
    where.move(waiting, f"{path}/{name}")


def get_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """One row for each file: ``path`` and ``content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")
