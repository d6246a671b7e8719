"""Document tables: schemas, reading, upserts, deletes, appends."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.scores import QS_STRUCT
from quire.operators.ocr_runs import BOX_TYPE
from quire.operators.pages import last_of
from quire.session import checkpoint_dir

SCORES = "map<string,double>"
REPORT = (
    "struct<verdict:string,pct_pixels_changed:double,paper_lift:double,ink_deepen:double,mean_shift:double,"
    "hist_before:array<double>,hist_after:array<double>>"
)
METADATA = (
    "struct<emails:array<string>,phones:array<string>,urls:array<string>,amounts:array<string>,"
    "dates:array<struct<raw:string,iso:string>>,identifiers:array<string>,keywords:array<string>,doc_class:string,"
    "class_schema:array<struct<name:string,type:string,options:array<string>>>,class_fields:map<string,string>>"
)

# Schemas as DDL text: parsing needs a session, which an import must not.
DOCUMENTS = (
    "document_id bigint, filename string, original_path string, enhanced_path string, initial_qs double, post_qs double, "
    "target_qs double, enhancement_passes int, raw_ocr string, corrected_ocr string, ocr_cer double, "
    "raw_ocr_english string, corrected_ocr_english string, doc_class string, "
    f"doc_class_scores {SCORES}, index_metadata {METADATA}, abstract string, corrected_abstract string, "
    "abstract_cer double, overall_abstract string, corrected_overall_abstract string, target_language string, "
    "translation string, current_stage string, status string, created_at timestamp, updated_at timestamp"
)

DOCUMENT_PAGES = (
    "document_id bigint, page_index int, image_path string, initial_qs double, enhanced_path string, post_qs double, "
    f"qs_metrics {QS_STRUCT}, enhancement_report {REPORT}, ocr_text string, corrected_ocr_text string, "
    f"ocr_text_english string, corrected_ocr_text_english string, ocr_boxes {BOX_TYPE}, page_abstract string, "
    f"corrected_page_abstract string, page_translation string, page_doc_class string, page_doc_class_scores {SCORES}"
)

STAGE_RUNS = (
    "document_id bigint, stage string, status string, payload string, started_at timestamp, finished_at timestamp"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def newest_first(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("created_at"), F.desc("document_id"))


def with_places(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds the place of each row, from 1, in the order of all rows; ties stand in any order.

    Rows are sorted over ranges and written to the shared folder with their number in their range, so the ranges are the same
    for all that follows. The counts of the ranges, at most one for each shuffle partition, then give how many rows come
    before a range. No task sees more than its range. Number the keys of a wide table and join the places to it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/places-{uuid4().hex}"
    # The id holds the number of the range above 33 bits, and that of the row in it below.
    df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__range", F.shiftright("__id", 33)).withColumn("__row", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    ranges = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("__range", "n"))).alias("r"))
    start = F.struct(F.lit(0).cast("bigint").alias("rows"), F.array().cast("array<struct<range:bigint,before:bigint>>").alias("list"))
    added = F.aggregate("r", start, lambda acc, r: F.struct(
        (acc["rows"] + r["n"]).alias("rows"), F.concat(acc["list"], F.array(F.struct(r["__range"].alias("range"), acc["rows"].alias("before")))).alias("list")
    ))
    before = ranges.select(F.inline(added["list"]))
    placed = rows.join(F.broadcast(before), F.col("__range") == F.col("range"))
    return placed.select(*df.columns, (F.col("before") + F.col("__row") + 1).alias(name))


def evolve_schema(df: DataFrame, target: T.StructType | str) -> DataFrame:
    """Add the columns of ``target`` (a schema or its DDL) that ``df`` lacks, as typed nulls; extra columns stay."""
    if isinstance(target, str):
        target = T.StructType.fromDDL(target)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in target.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def union_batches(*batches: DataFrame) -> DataFrame:
    """Documents of several uploads as one table; columns absent in one are null."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], now=None) -> DataFrame:
    """Changed columns win where non-null, the rest is kept, new keys are added.

    With ``now`` the touched rows get a new ``updated_at``. Several changes of one key count
    as the last by ``seq``, so both sides are unique per key and the join does not skew.
    Write the result to a new path, never over the one being read.
    """
    keys = list(keys)
    changes = last_of(changes, keys)
    changed = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in changed], F.lit(True).alias("__hit"))
    joined = base.join(new, keys, "full")
    out = joined.select(
        *keys,
        *[
            (F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in changed else F.col(c)).alias(c)
            for c in base.columns
            if c not in keys
        ],
        *[F.col(f"__new_{c}").alias(c) for c in changed if c not in base.columns],
        "__hit",
    )
    if now is not None and "updated_at" in base.columns:
        out = out.withColumn("updated_at", F.when(F.col("__hit"), now).otherwise(F.col("updated_at")))
    return out.drop("__hit")


def write_version(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def delete_documents(ids: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each table without the rows of the listed documents."""
    doomed = ids.select("document_id").distinct()
    return tuple(t.join(doomed, "document_id", "left_anti") for t in tables)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
