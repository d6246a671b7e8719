"""Uploaded files and page rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.pages import base_name

MAX_BATCH_FILES = 40  # fixed value
UNSUPPORTED = "Unsupported file. Upload an image (e.g. PNG, JPG, WEBP, TIFF, GIF) or a PDF."

# Leading bytes of the image formats.
IMAGE_SIGNATURES = {
    "png": "89504E47",
    "jpg": "FFD8FF",
    "gif": "47494638",
    "bmp": "424D",
    "tiff_le": "49492A00",
    "tiff_be": "4D4D002A",
}


def file_kind(path: Column, length: Column, content: Column) -> Column:
    """empty, pdf, image or unsupported; the content decides before the extension does."""
    lead = F.hex(F.substring(content, 1, 12))
    webp = lead.startswith("52494646") & lead.endswith("57454250")
    image = webp
    for signature in IMAGE_SIGNATURES.values():
        image = image | lead.startswith(signature)
    return (
        F.when(length == 0, "empty")
        .when(lead.startswith(F.hex(F.lit("%PDF"))), "pdf")
        .when(image, "image")
        .when(F.lower(path).endswith(".pdf"), "pdf")
        .otherwise("unsupported")
    )


def scan_files(spark: SparkSession, path: str, glob: str | None = None, uploads: DataFrame | None = None) -> DataFrame:
    """``(path, modified, length, content, kind)`` of every file under a folder.

    Spark's file listing leaves out files of no bytes. ``uploads`` (a table with the
    ``path`` of every upload) brings those back as kind ``empty``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")
    kinds = files.withColumn("kind", file_kind(F.col("path"), F.col("length"), F.col("content")))
    if uploads is None:
        return kinds
    unread = uploads.select("path").join(files.select("path"), "path", "left_anti")
    return kinds.unionByName(
        unread.select("path", F.lit(0).cast("bigint").alias("length"), F.lit("empty").alias("kind")), allowMissingColumns=True
    )


def scan_page_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """``(path, image)`` with BGR rasters; an undecodable file has height -1 unless dropped."""
    images = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
    return images.select(F.col("image.origin").alias("path"), "image")


def ingest_batch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with the reason. The caller checks ``batch_is_valid``."""
    name = base_name(F.col("path"))
    reason = (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("skipped: missing filename"))
        .when(F.col("kind") == "empty", F.concat(name, F.lit(": Empty file")))
        .when(F.col("kind") == "unsupported", F.concat(name, F.lit(": " + UNSUPPORTED)))
    )
    tagged = files.withColumn("filename", name).withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null").drop("content")


def batch_summary(files: DataFrame, limit: int = MAX_BATCH_FILES) -> DataFrame:
    """One row: counts, and whether the batch as a whole is refused."""
    bad = F.col("kind").isin("empty", "unsupported") | (F.coalesce(base_name(F.col("path")), F.lit("")) == "")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected")
    ).select(
        "*",
        ((F.col("files") == 0) | (F.col("files") > limit) | ((F.col("accepted") == 0) & (F.col("rejected") > 0))).alias("refused"),
    )
