"""Token-id files compressed by grammar: Re-Pair per shard.

Documents are put in ascending ``doc_id`` order, encoded, and cut into shards of whole documents. In each shard frequent
pairs of neighbouring symbols are replaced by new symbols, round after round: a round takes all pairs that occur at least
``least`` times, most frequent first, up to ``batch`` of them, replaces their occurrences from left to right, and the next
round counts again. Pairs never span two documents, so a document is a range of symbols that can be decoded alone. The
shard stores its rules and the number of ids each rule expands to, so that the position of any id can be found without
expanding what lies before it.

File layout, little-endian: magic ``QRP1``, a JSON header of its length and names, kinds and sizes of the arrays, then the
arrays. ``symbols`` are 16-bit where base and rules allow it and 32-bit otherwise; ``rules`` holds left and right symbol of
rule r, which is symbol ``base + r``; ``spans`` the expansion lengths.

Null and empty texts hold the end id alone. Rows that share a doc_id follow one another, in the order of a hash of their
text. A null doc_id comes first. Other columns do not matter. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.arrays import slices
from quire.llm.shared import fresh_dir, get_files, parallelism, put_file, store
from quire.llm.tokens import Pieces, with_end

MAGIC = b"QRP1"
SUFFIX = ".repair"
SHARD_IDS = 2_000_000
LEAST, BATCH, RULES = 24, 4096, 15_000
_BITS = 18


def _spots(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash bucket of the pair that begins at each position; pairs over a document's end go to an extra bucket."""
    h = symbols[:-1] * np.uint32(0x9E3779B1)
    h ^= symbols[1:] * np.uint32(0x85EBCA6B)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - _BITS)
    h[last[:-1]] = 1 << _BITS
    return h


def replace_round(symbols: np.ndarray, last: np.ndarray, base: int, least: int, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One round: new symbols, new end-of-document marks, and the pairs that became symbols base, base + 1, ..."""
    if len(symbols) < 2:
        return None
    spot = _spots(symbols, last)
    counts = np.bincount(spot, minlength=(1 << _BITS) + 1)
    counts[1 << _BITS] = 0
    often = counts >= least
    at = np.flatnonzero(often[spot])
    if not len(at):
        return None
    pair = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
    kinds, n = np.unique(pair, return_counts=True)
    order = np.lexsort((kinds, -n))[:batch]
    order = order[n[order] >= least]
    if not len(order):
        return None
    chosen = np.sort(kinds[order])
    where = np.searchsorted(chosen, pair)
    hit = chosen[np.minimum(where, len(chosen) - 1)] == pair
    at, which = at[hit], where[hit]
    # Of occurrences that follow one another position by position, every second one stays: they overlap.
    head = np.ones(len(at), bool)
    head[1:] = at[1:] != at[:-1] + 1
    place = np.arange(len(at))
    keep = (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0
    at, which = at[keep], which[keep]
    symbols = symbols.copy()
    symbols[at] = (base + which).astype(np.uint32)
    last = last.copy()
    last[at] |= last[at + 1]
    stays = np.ones(len(symbols), bool)
    stays[at + 1] = False
    return symbols[stays], last[stays], chosen


def compress(ids: np.ndarray, rows: np.ndarray, least: int = LEAST, batch: int = BATCH, most: int = RULES) -> dict[str, np.ndarray]:
    """Arrays of a shard: symbols, first symbol of each document, rules, spans, base."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[rows[1:] - 1] = True
    base = int(symbols.max()) + 1 if len(symbols) else 1
    rules: list[np.ndarray] = []
    made = 0
    while made < most:
        done = replace_round(symbols, last, base + made, least, min(batch, most - made))
        if done is None:
            break
        symbols, last, pairs = done
        rules.append(pairs)
        made += len(pairs)
    flat = np.concatenate([np.zeros(0, np.uint64), *rules])
    table = np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
    kind = np.uint16 if base + made <= 1 << 16 else np.uint32
    spans = np.ones(made, np.uint32)
    at = 0
    for pairs in rules:  # a round's rules use symbols of earlier rounds only
        known = np.concatenate([np.ones(base, np.uint32), spans[:at]])
        spans[at : at + len(pairs)] = known[table[at : at + len(pairs)]].sum(1)
        at += len(pairs)
    first = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.uint32)
    return {"symbols": symbols.astype(kind), "first": first, "rules": table, "spans": spans, "base": np.array([base], np.uint32)}


def expansions(shard: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every symbol, joined, and the first of each (one more than symbols)."""
    base, rules, spans = int(shard["base"][0]), shard["rules"], shard["spans"]
    size = np.concatenate([np.ones(base, np.int64), spans.astype(np.int64)])
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], np.uint32)
    out[:base] = np.arange(base)
    done = 0
    while done < len(rules):
        # All further rules whose parts are known by now.
        ready = done + int(np.argmax(np.append((rules[done:] >= base + done).any(1), True)))
        left, right = rules[done:ready, 0], rules[done:ready, 1]
        to = begin[base + done : base + ready]
        for part, shift in ((left, 0), (right, size[left])):
            n = size[part]
            stop = np.cumsum(n)
            step = np.arange(stop[-1]) - np.repeat(stop - n, n)
            out[np.repeat(to + shift, n) + step] = out[np.repeat(begin[part], n) + step]
        done = ready
    return out, begin


def expand(shard: dict[str, np.ndarray], document: int | None = None) -> np.ndarray:
    """Ids of one document, or of the whole shard."""
    symbols = shard["symbols"]
    if document is not None:
        symbols = symbols[shard["first"][document] : shard["first"][document + 1]]
    if not len(symbols):
        return np.zeros(0, np.uint32)
    ids, begin = expansions(shard)
    n = np.diff(begin)[symbols]
    stop = np.cumsum(n)
    return ids[np.repeat(begin[symbols] - (stop - n), n) + np.arange(stop[-1])]


def lengths(shard: dict[str, np.ndarray]) -> np.ndarray:
    """Number of ids of each document, from the expansion lengths alone."""
    base = int(shard["base"][0])
    size = np.concatenate([np.ones(base, np.int64), shard["spans"].astype(np.int64)])
    total = np.concatenate([[0], np.cumsum(size[shard["symbols"]])])
    return np.diff(total[shard["first"]])


def locate(shard: dict[str, np.ndarray], document: int, position: int) -> int:
    """The id at a position of a document, by walking down one rule after another."""
    base, spans, rules = int(shard["base"][0]), shard["spans"], shard["rules"]
    symbols = shard["symbols"][shard["first"][document] : shard["first"][document + 1]].astype(np.int64)
    size = np.where(symbols < base, 1, spans[np.maximum(symbols - base, 0)] if len(spans) else 1)
    stop = np.cumsum(size)
    at = int(np.searchsorted(stop, position, side="right"))
    rest, symbol = position - int(stop[at] - size[at]), int(symbols[at])
    while symbol >= base:
        left, right = map(int, rules[symbol - base])
        span = 1 if left < base else int(spans[left - base])
        symbol, rest = (left, rest) if rest < span else (right, rest - span)
    return symbol


def to_bytes(shard: dict[str, np.ndarray], doc_ids: np.ndarray, known: np.ndarray) -> bytes:
    arrays = shard | {"doc_ids": doc_ids.astype("<i8"), "known": known.astype(np.uint8)}
    arrays = {k: np.ascontiguousarray(v, v.dtype.newbyteorder("<")) for k, v in arrays.items()}
    head = json.dumps([[k, v.dtype.str, list(v.shape)] for k, v in arrays.items()]).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(v.tobytes() for v in arrays.values())])


def from_bytes(data: bytes | memoryview) -> dict[str, np.ndarray]:
    data = memoryview(data)
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a shard of token ids")
    at = 8 + int.from_bytes(data[4:8], "little")
    out = {}
    for name, kind, shape in json.loads(bytes(data[8:at])):
        n = int(np.prod(shape))
        out[name] = np.frombuffer(data, kind, n, at).reshape(shape)
        at += n * np.dtype(kind).itemsize
    return out


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS, tasks: int | None = None) -> DataFrame:
    """Shards below ``folder``; returns one row for each: task, shard, documents, ids, symbols. Nothing is written before an action."""
    tasks = tasks or parallelism(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, task = Pieces.load(tokenizer), TaskContext.get().partitionId()
        number, held, ids, sizes = 0, 0, [], []
        doc_ids: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held, ids, sizes, doc_ids
            whole = np.concatenate(ids)
            rows = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            own = pa.concat_arrays(doc_ids)
            shard = compress(whole, rows)
            put_file(folder, f"ids-{task:06d}-{number:05d}{SUFFIX}", to_bytes(shard, own.fill_null(0).to_numpy(), own.is_valid().to_numpy(False)))
            done = {"task": task, "shard": number, "documents": len(own), "ids": len(whole), "symbols": len(shard["symbols"])}
            number, held, ids, sizes, doc_ids = number + 1, 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in done.values()], names=list(done))

        for batch in batches:
            for part, data, off in slices(batch, "text"):
                got, rows = with_end(*pieces.encode(data, off), end_id)
                ids.append(got)
                sizes.append(np.diff(rows))
                doc_ids.append(part.column(0))
                held += len(got)
                if held >= shard_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    ordered = rows.repartitionByRange(tasks, F.asc_nulls_first("doc_id"), "text_hash").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text_hash")
    return ordered.drop("text_hash").mapInArrow(run, "task long, shard long, documents long, ids long, symbols long")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = from_bytes(memoryview(content.as_buffer()))
                n = lengths(shard)
                raw, stop = expand(shard).astype("<u4").tobytes(), 4 * np.cumsum(n)
                crc = [zlib.crc32(memoryview(raw)[a:b]) for a, b in zip((stop - 4 * n).tolist(), stop.tolist())]
                task, number = map(int, path.rpartition("/ids-")[2].removesuffix(SUFFIX).split("-"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard["doc_ids"], mask=shard["known"] == 0), pa.array(np.full(len(n), task)), pa.array(np.full(len(n), number)), pa.array(stop // 4 - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["doc_id", "task", "shard", "own_start", "n_tokens", "ids_crc32"],
                )

    docs = get_files(spark, folder, SUFFIX).mapInArrow(run, "doc_id long, task long, shard long, own_start long, n_tokens long, ids_crc32 long")
    # One total for each writing task, of which there are as many as shuffle partitions; then each shard's place within its task.
    totals, base = sorted((r["task"], r["n"]) for r in shards.groupBy("task").agg(F.sum("ids").alias("n")).collect()), 0
    bases = []
    for task, n in totals:
        bases.append((task, base))
        base += n
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("ids").over(W.partitionBy("task").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = shards.select("task", "shard", before.alias("before")).join(spark.createDataFrame(bases, "task long, base long"), "task")
    return docs.join(places, ["task", "shard"]).select("doc_id", (F.col("base") + F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> tuple[str, DataFrame]:
    """Writes the files and returns their folder and what they hold."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "ids")
    shards = store(write(docs, folder, tokenizer, end_id), "shards")
    if shards.isEmpty():
        return folder, spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return folder, read(spark, folder, shards)
