"""Joins and folds that stay spread out when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001  # a key above this share of the rows is hot: at most 1000 keys can be
SALTS = 64
VOLUME_PAGES = 4096


def hot_keys(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, so fewer than ``1 / share`` rows.

    The count is combined before the shuffle; the size bound is what makes the
    result safe to broadcast.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg((F.sum("__n") * share).alias("__floor"))
    return counts.where(F.col("__n") > total.scalar()).select(*on)


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    salts: int = SALTS,
    how: str = "left",
) -> DataFrame:
    """Join a many-side that may be skewed to a side that is unique per key.

    Rows of a hot key are spread over ``salts`` tasks by the ``spread`` columns and
    only the matching right rows of hot keys are repeated. Every other row joins
    once, and no row is dropped.
    """
    on = list(on)
    hot = F.broadcast(hot_keys(left.select(*on), on).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted_left = left.join(hot, on, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted_left.join(salted_right, [*on, "__salt"], how).drop("__salt")


def fold_lists(volumes: DataFrame, keys: Sequence[str], lists: Sequence[str], *more: Column) -> DataFrame:
    """One row per key with its volumes' lists joined in their order; ``more`` are aggregates over its volumes."""
    parts = F.array_sort(F.collect_list(F.struct("volume", *lists)))
    gathered = volumes.groupBy(*keys).agg(parts.alias("__parts"), *more)
    whole = [F.flatten(F.col("__parts")[c]).alias(c) for c in lists]
    return gathered.select(*[c for c in gathered.columns if c != "__parts"], *whole)


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    separator: str,
    out: str,
    volume_pages: int = VOLUME_PAGES,
) -> DataFrame:
    """Join a text per row into one text per key, in page order.

    One key is folded in volumes of ``volume_pages`` pages, so a task never gathers
    more than one volume: a usual document is exactly one row (volume 0), a giant one
    is several rows whose concatenation is the whole. Null values are left out.
    """
    parts = df.select(*keys, F.col(order).alias("__pos"), value.alias("__value")).where("__value is not null")
    volume = F.floor(F.col("__pos") / F.lit(volume_pages)).cast("int").alias("volume")
    gathered = F.array_sort(F.collect_list(F.struct("__pos", "__value")))
    return (
        parts.groupBy(*keys, volume)
        .agg(gathered.alias("__parts"))
        .select(*keys, "volume", F.array_join(F.transform("__parts", lambda p: p["__value"]), separator).alias(out))
    )
