"""Page-image quality: raster statistics, scores, reports and document rollups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import scores as S
from quire.functions.text import fixed_decimals

# Fixed values.
AUTO_ENHANCE_THRESHOLD = 75.0
HISTOGRAM_BINS = 16
PAPER_GRAY, INK_GRAY = 230, 100

# Pixels of a strip: what one step of the measuring holds, however large the page is.
STRIP_PIXELS = 1 << 20


def _strips(images: DataFrame, keys: list[str], image: str, border: int = 0) -> DataFrame:
    """Rows ``first`` to ``last`` (exclusive) of each raster with up to ``border`` rows around them, as ``data`` from row ``top`` on.

    A raster that could not be decoded is one strip without data, number 0 as every first strip.
    """
    height, width, channels, data = (F.col(f"{image}.{f}") for f in ("height", "width", "nChannels", "data"))
    readable = (height > 0) & (width > 0)
    rows = F.greatest(F.lit(1), F.floor(F.lit(STRIP_PIXELS) / F.greatest(width, F.lit(1)))).cast("int")

    def cut(first: Column) -> Column:
        last = F.least(first + rows, height)
        top, bottom = F.greatest(first - border, F.lit(0)), F.least(last + border, height)
        part = F.substring(data, top * width * channels + 1, (bottom - top) * width * channels)
        return F.struct(
            F.floor(first / rows).cast("int").alias("__strip"), first.alias("__first"), last.alias("__last"), top.alias("__top"), part.alias("__data")
        )

    fields = "array<struct<__strip int, __first int, __last int, __top int, __data binary>>"
    nothing = F.array(F.struct(F.lit(0), *[F.lit(None)] * 4)).cast(fields)
    strips = F.transform(F.sequence(F.lit(0), F.greatest(height, F.lit(1)) - 1, rows), cut).cast(fields)
    sizes = [F.when(readable, c).alias(n) for c, n in ((height, "__height"), (width, "__width"), (channels, "__channels"))]
    return images.select(*keys, *sizes, F.inline(F.when(readable, strips).otherwise(nothing)))


def _gray(width: int, channels: int, data: bytes) -> np.ndarray:
    """8-bit luminance of BGR(A) or gray rows, in the usual 15-bit fixed point."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(-1, int(width), int(channels))
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    b, g, r = (pixels[:, :, i].astype(np.int32) for i in range(3))
    return ((b * 3735 + g * 19235 + r * 9798 + (1 << 14)) >> 15).astype(np.uint8)


def _mirrored(start: int, stop: int, size: int) -> np.ndarray:
    """Indices ``start`` to ``stop`` of a side that mirrors at its ends without repeating the edge; a side of one repeats it."""
    if size == 1:
        return np.zeros(stop - start, dtype=np.int64)
    at = np.arange(start, stop) % (2 * size - 2)
    return np.minimum(at, 2 * size - 2 - at)


def _laplacian(p: np.ndarray) -> np.ndarray:
    return p[1:-3, 2:-2] + p[3:-1, 2:-2] + p[2:-2, 1:-3] + p[2:-2, 3:-1] - 4 * p[2:-2, 2:-2]


def _blurred(p: np.ndarray) -> np.ndarray:
    """5x5 binomial blur, rounded to whole gray levels."""
    kernel = (1, 4, 6, 4, 1)
    rows = sum(k * p[i : len(p) - 4 + i, :] for i, k in enumerate(kernel))
    full = sum(k * rows[:, i : p.shape[1] - 4 + i] for i, k in enumerate(kernel))
    return (full + 128) >> 8


def _bins(gray: np.ndarray) -> list[int]:
    return [int(n) for n in np.bincount(gray.ravel() >> 4, minlength=HISTOGRAM_BINS)]


def _powers(values: np.ndarray) -> list[int]:
    """Sum and sum of squares."""
    return [int(values.sum(dtype=np.int64)), int(np.square(values, dtype=np.int64).sum())]


def _moments(height: int, width: int, channels: int, first: int, last: int, top: int, data: bytes) -> list[int]:
    """Whole-number sums over the pixels of a strip: those of any cut of a raster add up to the raster's."""
    gray = _gray(width, channels, data)
    across = _mirrored(-2, int(width) + 2, int(width))
    around = gray[_mirrored(int(first) - 2, int(last) + 2, int(height)) - int(top)][:, across].astype(np.int32)
    own = around[2:-2, 2:-2]
    return [
        own.size, *_powers(own), *_powers(_laplacian(around)), *_powers(own - _blurred(around)),
        int((own > PAPER_GRAY).sum()), int((own < INK_GRAY).sum()), *_bins(own),
    ]


def _bin_names(tag: str) -> list[str]:
    return [f"__{tag}_{i}" for i in range(HISTOGRAM_BINS)]


def _shares(tag: str) -> Column:
    """Histogram from summed bins; null without pixels."""
    counts = F.array(*[F.round(F.col(c) / F.col("__n"), 6) for c in _bin_names(tag)])
    return F.when(F.col("__n") > 0, counts)


def _variance(tag: str) -> Column:
    """Population variance from exact sums: only the last division rounds."""
    n, s1, s2 = (F.col(c).cast("decimal(19,0)") for c in ("__n", f"__{tag}1", f"__{tag}2"))
    return F.when(F.col("__n") > 0, (n * s2 - s1 * s1).cast("double") / F.col("__n") / F.col("__n"))


def _sums(strips: DataFrame, keys: list[str], names: list[str], measure: Callable, inputs: list[str]) -> DataFrame:
    """Rows of ``names``, one for each strip, by ``measure`` over ``inputs``; zeros where it gives nothing."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [measure(*values) or [0] * len(names) for values in zip(*[batch[c] for c in inputs])]
            yield pd.concat([batch[kept].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype="int64")], axis=1)

    kept = [*keys, "__height", "__width"]
    for c in ("__height", "__width"):
        strips = strips.withColumn(c, F.col(c).cast("double"))
    schema = T.StructType([strips.schema[k] for k in kept] + [T.StructField(n, T.LongType()) for n in names])
    return strips.mapInPandas(compute, schema)


def raster_stats(images: DataFrame, keys: list[str], image: str = "image", spread: bool = False) -> DataFrame:
    """Statistics of each raster; null throughout for one that could not be decoded.

    Rasters are measured in strips of about STRIP_PIXELS pixels with two rows around them. Strips give whole-number sums, which
    are combined in their task before the shuffle: one row of numbers for each raster, and results do not depend on the cut.
    ``spread`` deals the strips of each raster over the tasks first, for few and very large pages. ``keys`` name one raster;
    repeated rows of one count as one.
    """
    strips = _strips(images, keys, image, border=2)
    if spread:
        strips = strips.repartition(*keys, "__strip")
    names = ["__n", "__g1", "__g2", "__l1", "__l2", "__r1", "__r2", "__paper", "__ink", *_bin_names("h")]

    def measure(height, width, channels, first, last, top, data) -> list[int] | None:
        return None if data is None else _moments(height, width, channels, first, last, top, data)

    inputs = ["__height", "__width", "__channels", "__first", "__last", "__top", "__data"]
    total = _sums(strips, keys, names, measure, inputs).groupBy(*keys).agg(
        F.max("__height").cast("int").alias("height_px"), F.max("__width").cast("int").alias("width_px"), *[F.sum(n).alias(n) for n in names]
    )

    def share(name: str) -> Column:
        return F.when(F.col("__n") > 0, F.col(name) / F.col("__n"))

    return total.select(
        *keys, "width_px", "height_px", share("__g1").alias("mean_gray"), F.sqrt(_variance("g")).alias("std_gray"),
        _variance("l").alias("laplacian_variance"), F.sqrt(_variance("r")).alias("noise_std"),
        share("__paper").alias("paper_share"), share("__ink").alias("ink_share"), _shares("h").alias("histogram"),
    )


def page_profile(stats: DataFrame, lenient: bool = False) -> DataFrame:
    """Adds ``qs_metrics`` and rounded ``image_params``; both null for an unreadable raster."""
    score = S.qs_lenient if lenient else S.qs_strict
    readable = F.col("mean_gray").isNotNull()
    metrics = score(F.col("laplacian_variance"), F.col("mean_gray"), F.col("std_gray"), F.col("noise_std"))
    params = F.struct(
        "width_px",
        "height_px",
        *[F.round(c, 2).alias(c) for c in ("mean_gray", "std_gray", "laplacian_variance")],
    )
    return stats.withColumn("qs_metrics", F.when(readable, metrics)).withColumn("image_params", F.when(readable, params))


def page_flags(stats: DataFrame) -> DataFrame:
    """Adds ``is_clean`` and ``is_washed``."""
    return stats.withColumn(
        "is_clean", S.is_clean(F.col("paper_share"), F.col("ink_share"), F.col("noise_std"))
    ).withColumn("is_washed", S.is_washed(F.col("mean_gray"), F.col("std_gray")))


def _gray_strips(images: DataFrame, keys: list[str], image: str) -> DataFrame:
    """``(keys, __strip, __height, __width, __gray)``: a third of the bytes of a colour raster, made where the raster lies."""
    strips = _strips(images, keys, image).select(*keys, "__strip", "__height", "__width", "__channels", "__data")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = zip(batch["__width"], batch["__channels"], batch["__data"])
            batch["__gray"] = [None if d is None else _gray(w, c, d).tobytes() for w, c, d in parts]
            for c in ("__height", "__width"):
                batch[c] = batch[c].astype("Int32")
            yield batch.drop(columns=["__channels", "__data"])

    schema = T.StructType([f for f in strips.schema.fields if f.name not in ("__channels", "__data")] + [T.StructField("__gray", T.BinaryType())])
    return strips.mapInPandas(compute, schema)


def _changes(before: bytes | None, after: bytes | None) -> list[int] | None:
    """Whole-number sums over the pixels of two strips of one shape."""
    if before is None or after is None:
        return None
    old, new = (np.frombuffer(d, dtype=np.uint8) for d in (before, after))
    diff = new.astype(np.int32) - old
    paper, ink = old >= PAPER_GRAY, old < INK_GRAY
    tones = [int(v) for mask in (paper, ink) for v in (mask.sum(), diff[mask].sum(dtype=np.int64))]
    return [old.size, int((diff != 0).sum()), *tones, int(diff.sum(dtype=np.int64)), *_bins(old), *_bins(new)]


def enhancement_report(before: DataFrame, after: DataFrame, keys: list[str], image: str = "image") -> DataFrame:
    """What changed between two rasters of a page; null for different sizes or unreadable files.

    Both sides become gray in strips where they lie; gray strips meet by key and strip number, and their sums by key. ``keys``
    name one raster on each side.
    """
    size = ["__height", "__width"]
    sides = [
        _gray_strips(df, keys, image).select(*keys, "__strip", *[F.col(c).alias(c + tag) for c in (*size, "__gray")])
        for df, tag in ((before, ""), (after, "_after"))
    ]
    # Every raster has a strip 0, so a page of two sizes meets at least there.
    differ = ~(F.col("__height").eqNullSafe(F.col("__height_after")) & F.col("__width").eqNullSafe(F.col("__width_after")))
    joined = sides[0].join(sides[1], [*keys, "__strip"]).withColumn("__other", differ)
    # A size of -1 marks the strips of a page that cannot be compared.
    marked = joined.withColumns({c: F.when(F.col("__other"), F.lit(-1)).otherwise(F.col(c)) for c in size}).withColumn(
        "__gray_after", F.when(~F.col("__other"), F.col("__gray_after"))
    )
    names = ["__n", "__changed", "__paper", "__lift", "__ink", "__deepen", "__shift", *_bin_names("a"), *_bin_names("b")]
    total = _sums(marked, keys, names, _changes, ["__gray", "__gray_after"]).groupBy(*keys).agg(
        F.min("__height").alias("__height"), *[F.sum(n).alias(n) for n in names]
    ).withColumn("__n", F.when(F.col("__height") > 0, F.col("__n")))

    def mean(value: str, count: str, digits: int) -> Column:
        share = F.when(F.col(count) > 0, F.col(value) / F.col(count)).otherwise(0.0)
        return F.when(F.col("__n") > 0, F.round(share, digits))

    return total.select(
        *keys, mean("__changed", "__n", 4).alias("pct_pixels_changed"), mean("__lift", "__paper", 2).alias("paper_lift"),
        mean("__deepen", "__ink", 2).alias("ink_deepen"), mean("__shift", "__n", 2).alias("mean_shift"),
        _shares("a").alias("hist_before"), _shares("b").alias("hist_after"),
    )


def register_documents(pages: DataFrame) -> DataFrame:
    """A document per upload: first page's path, mean page score, first stage, pending."""
    return pages.groupBy("document_id").agg(
        F.min_by("image_path", "page_index").alias("original_path"),
        S.mean_score(F.col("initial_qs")).alias("initial_qs"),
        F.lit("enhancement").alias("current_stage"),
        F.lit("pending").alias("status"),
    )


def auto_enhance_decision(docs: DataFrame, pages: DataFrame, threshold: float = AUTO_ENHANCE_THRESHOLD) -> DataFrame:
    """Whether a document's mean page score is below the threshold, with the reason in words."""
    th = F.lit(float(max(0.0, min(100.0, threshold))))
    per_doc = pages.groupBy("document_id").agg(S.mean_score(F.col("initial_qs")).alias("__mean"))
    qs = F.coalesce(F.col("__mean"), F.round("initial_qs", 2), F.lit(0.0))
    joined = docs.select("document_id", "initial_qs").join(per_doc, "document_id", "left").select("document_id", qs.alias("initial_qs"))
    enhance = F.col("initial_qs") < th
    reason = F.concat(
        F.lit("Initial QS "),
        F.col("initial_qs").cast("string"),
        F.when(enhance, F.lit(" is below threshold ")).otherwise(F.lit(" already meets threshold ")),
        th.cast("string"),
        F.when(enhance, F.lit(" — enhancement recommended.")).otherwise(F.lit(" — enhancement skipped.")),
    )
    return joined.select("document_id", "initial_qs", th.alias("threshold"), enhance.alias("should_enhance"), reason.alias("reason"))


def qs_rollup(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Document scores after enhancement: mean upload score, the first page's post score, most passes.

    ``last_report`` is the report of the last page.
    """
    per_doc = pages.groupBy("document_id").agg(
        S.mean_score(F.col("initial_qs")).alias("__initial"),
        F.min_by(F.struct(F.round("post_qs", 2).alias("post_qs"), "enhanced_path"), "page_index").alias("__first"),
        F.max("passes").alias("enhancement_passes"),
        F.max_by("report", "page_index").alias("last_report"),
    )
    return docs.select("document_id", "initial_qs").join(per_doc, "document_id").select(
        "document_id",
        F.coalesce("__initial", F.round("initial_qs", 2)).alias("initial_qs"),
        F.col("__first.post_qs").alias("post_qs"),
        F.col("__first.enhanced_path").alias("enhanced_path"),
        "enhancement_passes",
        "last_report",
    )


def mean_metrics(pages: DataFrame, metrics: str = "qs_metrics") -> DataFrame:
    """Mean of each score component, over the pages that have scores."""
    names = ("qs", "sharpness", "brightness", "contrast", "noise")
    return pages.where(F.col(metrics).isNotNull()).groupBy("document_id").agg(
        *[S.mean_score(F.col(f"{metrics}.{n}"), 6).alias(n) for n in names]
    )


def gauge_scores(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Scores on the review gauges. Unlike the rollup, the post score is a mean over pages,
    and it is shown only when every page is enhanced."""
    per_doc = pages.groupBy("document_id").agg(
        F.avg("initial_qs").alias("__initial"),
        F.avg("post_qs").alias("__post"),
        F.bool_and(F.col("post_qs").isNotNull() & (F.coalesce("enhanced_path", F.lit("")) != "")).alias("__all"),
    )
    ready = (
        (F.coalesce(docs["enhanced_path"], F.lit("")) != "") & docs["post_qs"].isNotNull() & F.coalesce("__all", F.lit(True))
    )
    return docs.join(per_doc, "document_id", "left").select(
        "document_id",
        F.coalesce("__initial", docs["initial_qs"]).alias("gauge_initial"),
        F.when(ready, F.when(F.col("__all").isNull(), docs["post_qs"]).otherwise(F.col("__post"))).alias("gauge_post"),
        ready.alias("ready"),
    )


def tune_notice(post: Column, before: Column, upload: Column) -> Column:
    """Notice after a manual adjustment that lowered the score; null when it did not."""
    lower = F.concat(
        F.lit("Applied your adjustment; post QS is "), fixed_decimals(post, 2), F.lit(" vs "), fixed_decimals(before, 2),
        F.lit(" on the image before this tweak. QS rewards sharpness, gray-level spread, and clean tone: very low "
              "Contrast or Gamma (far from 50) often flattens the scan and drops the score even if it looks brighter. "
              "Try Contrast and Gamma nearer 50, or add a little Sharpen; ease heavy Denoise if QS fell."),
    )
    below_upload = F.concat(
        F.lit("Post QS "), fixed_decimals(post, 2), F.lit(" is below the original upload ("), fixed_decimals(upload, 2),
        F.lit("); the tuned image is still saved."),
    )
    return F.when(post + 0.2 < before, lower).when(post + 0.2 < upload, below_upload)


def gray_histogram(pixels: DataFrame, keys: list[str], gray: str = "gray") -> DataFrame:
    """Share of pixels per 16-level bin, from a pixel table."""
    counted = pixels.groupBy(*keys, F.floor(F.col(gray) / 16).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("__n"))
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    return counted.join(totals, keys).select(*keys, "bin", F.round(F.col("__n") / F.col("__total"), 6).alias("share"))
