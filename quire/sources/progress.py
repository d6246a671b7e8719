"""NDJSON progress logs, as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROGRESS = (
    "run_id string, seq bigint, document_id bigint, phase string, page_index int, page_index_zero int, page_total int, "
    "pass int, max_passes int, best_qs double, candidate_qs double, trial_qs double, target_qs double, label string, "
    "message string, enhanced_path string, post_qs double, initial_qs double, stall_count int, met_target boolean, "
    "verdict string, updated_at string"
)


def _valid(lines: DataFrame) -> DataFrame:
    """Lines that parse; blank and broken ones are skipped."""
    fields = T.StructType.fromDDL(PROGRESS).fields
    schema = T.StructType(fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.where(F.trim("value") != "").select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e")
    )
    return parsed.where("e is not null and e._corrupt_record is null").select(*[f"e.{f.name}" for f in fields])


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    return _valid(spark.read.text(path))


def stream_progress_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _valid(reader.load(path))
