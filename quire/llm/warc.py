"""WARC archives in which a payload is stored once.

Payloads are compared by digest and length. Only headers (row number, digest, length) go through the comparing shuffle;
of each group of equal payloads the row with the largest ``page_id`` becomes the ``response`` and the others become
``revisit`` records that name it. Records are then written as gzip members of ``.warc.gz`` files of bounded size, with
fresh headers, and can be read back by any WARC reader.

Null and empty payloads are responses of no bytes. Payloads shorter than ``least`` bytes are all responses. Rows that share
both page_id and payload are all the response or all revisits, since nothing tells them apart. A null ``page_id`` is smaller
than any other. Other columns of the input are not stored, whatever their names. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import fresh_dir, get_files, put_file

LEAST = 1000
FILE_BYTES = 8 << 20
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.gz"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (bytes) with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    heads = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n"))
    shared = heads.where("n > 1").drop("n")
    same_id = F.col("page_id").eqNullSafe(F.col("kept_id"))
    revisit = F.col("kept_id").isNotNull() & ~same_id
    return rows.join(shared, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept_id")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(row: dict, date: str) -> bytes:
    """One WARC record, as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    response = row["record_type"] == "response"
    block = http + row["payload"] if response else http
    head = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"])), ("WARC-Date", date),
        ("WARC-Target-URI", " ".join(row["url"].split())), ("WARC-Payload-Digest", "sha1:" + base32(row["payload_digest"])),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if row["page_id"] is not None:
        head.append(("X-Page-Id", str(row["page_id"])))
    if not response:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["payload_digest"])), ("X-Refers-To-Page-Id", str(row["refers_to"]))]
    text = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def write(resolved: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives below ``folder``; returns one row for each file: name, records, bytes. Nothing is written before an action."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, parts, size
            name = f"pages-{task:06d}-{number:05d}{SUFFIX}"
            put_file(folder, name, b"".join(parts))
            done = pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([len(parts)], pa.int64()), "bytes": pa.array([size], pa.int64())})
            number, parts, size = number + 1, [], 0
            return done

        for batch in batches:
            for at in range(batch.num_rows):
                parts.append(record(batch.slice(at, 1).to_pylist()[0], date))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield flush()
        if parts:
            yield flush()

    return resolved.mapInArrow(run, "file string, records long, bytes long")


def members(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one after another."""
    at = 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            part = data[at : at + step]
            if not len(part):
                raise ValueError("the archive ends inside a record")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record: {lines[0][:40]}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives below ``folder``; digest and length of a response are taken from its payload, not its header."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for raw in members(memoryview(content.as_buffer())):
                    fields, block = parse(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["warc-type"]
                    declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response":
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        if digest != declared:
                            raise ValueError(f"payload digest of {fields['warc-record-id']} differs from its header")
                    else:
                        digest, size = declared, int(http.rpartition(b"Content-Length: ")[2])
                    number = lambda k: int(fields[k]) if k in fields else None
                    out.append((number("x-page-id"), fields["warc-target-uri"], size, digest, kind, number("x-refers-to-page-id"), payload if kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    files = get_files(spark, folder, SUFFIX).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple[str, DataFrame]:
    """Writes deduplicated archives and returns their folder and the records read back from them."""
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    written = write(resolve(pages, least), folder).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    if not written:
        return folder, spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return folder, read(spark, folder)
