"""Page-image quality scores as column arithmetic over raster statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component weights and the bounds of the two scales.
WEIGHTS = {"sharpness": 0.32, "brightness": 0.18, "contrast": 0.35, "noise": 0.15}
STRICT = {"sharpness": (50.0, 1300.0), "contrast": (20.0, 82.0), "noise": (2.0, 20.0)}
LENIENT = {"sharpness": (80.0, 600.0), "contrast": (18.0, 42.0), "noise": (18.0, 40.0)}
CLEAN_PAPER_SHARE, CLEAN_INK_SHARE, CLEAN_NOISE = 0.55, 0.003, 12.0
WASHED_MEAN, WASHED_STD = 218.0, 55.0
QS_STRUCT = "struct<qs:double,sharpness:double,brightness:double,contrast:double,noise:double>"


def unit_range(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - low) / (high - low)))


def _triangle(c: Column, peak: float, width: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(c - peak) / width)


def brightness_strict(mean: Column) -> Column:
    return F.greatest(_triangle(mean, 127.0, 127.0), _triangle(mean, 200.0, 72.0))


def brightness_lenient(mean: Column) -> Column:
    rising = F.greatest(_triangle(mean, 127.0, 127.0), F.greatest(F.lit(0.0), 1.0 - (195.0 - mean) / 90.0))
    falling = F.greatest(F.lit(0.0), 1.0 - (mean - 248.0) / 7.0)
    return F.when(mean.between(195.0, 248.0), 1.0).when(mean < 195.0, rising).otherwise(falling)


def _score(laplacian: Column, mean: Column, std: Column, noise: Column, bounds: dict, brightness: Column) -> Column:
    parts = {
        "sharpness": unit_range(laplacian, *bounds["sharpness"]),
        "brightness": brightness,
        "contrast": unit_range(std, *bounds["contrast"]),
        "noise": 1.0 - unit_range(noise, *bounds["noise"]),
    }
    total = sum(parts[name] * weight for name, weight in WEIGHTS.items()) * 100.0
    fields = [F.round(total, 2).alias("qs")] + [F.round(p * 100, 2).alias(n) for n, p in parts.items()]
    zeros = F.struct(*[F.lit(0.0).alias(n) for n in ("qs", *parts)])
    return F.when(mean.isNull(), zeros).otherwise(F.struct(*fields)).cast(QS_STRUCT)


def qs_strict(laplacian: Column, mean: Column, std: Column, noise: Column) -> Column:
    """Upload score; an unreadable raster (null statistics) scores zero throughout."""
    return _score(laplacian, mean, std, noise, STRICT, brightness_strict(mean))


def qs_lenient(laplacian: Column, mean: Column, std: Column, noise: Column) -> Column:
    """Score of an enhanced page, on the easier scale."""
    return _score(laplacian, mean, std, noise, LENIENT, brightness_lenient(mean))


def mean_score(c: Column, digits: int = 2) -> Column:
    """Mean of page scores. They have two decimals, so the sum is kept exact: the result does
    not depend on the order in which tasks finish, nor fall on either side of a rounding tie."""
    return F.round(F.avg(F.round(c, 2).cast("decimal(14,2)")), digits).cast("double")


def is_clean(paper_share: Column, ink_share: Column, noise: Column) -> Column:
    return (paper_share > CLEAN_PAPER_SHARE) & (ink_share > CLEAN_INK_SHARE) & (noise < CLEAN_NOISE)


def is_washed(mean: Column, std: Column) -> Column:
    return (mean >= WASHED_MEAN) & (std <= WASHED_STD)
