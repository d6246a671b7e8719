"""Near-duplicate documents by SuperMinHash, banding, verification on full shingle sets, and connected components.

A document is the set of its ``k``-word shingles over A-Z lower-cased words. Documents with equal sets form a class at once,
so copies never meet in pairs. Each class has a SuperMinHash signature: every element draws a random permutation of the
slots step by step, and its value at step j lies in [j, j + 1); once all slots are below j + 1 no later step can lower
any, which ends the work early for all but short documents. Classes that share a band of the signature are candidates.

Candidates are verified on their full sets, and only verified pairs link. In a band's bucket the class that meets the
most others is compared with all of them. Most buckets are then one component. Members of the others go to an exact prefix-filter
join, which pairs only members of different components, and compares those around one pivot by their differences from it; so
no link within a bucket is lost, no pairs within a component are emitted, and neither passages that many texts share nor
large groups just below the limit make pairs of all their members.

Texts without words link with nothing and are their own component. Null texts count as empty. Rows that share a doc_id keep
their own sets; a null doc_id never names a component unless nothing else is in it. Repeated rows are one class. An empty
table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import free_name, gram_hashes, mix, read_words
from quire.llm.components import components
from quire.llm.shared import row_key, store

SLOTS, BANDS = 128, 32
PERCENT = 80
MAPS = 4
PLACES = 1 << 21
HOPS = 3
SLICE = 1 << 20  # permutations of short texts' elements take more room than other arrays
_STEP = 0x9E3779B97F4A7C15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_minhash(grams: np.ndarray, begin: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of all rows; row i has the elements grams[begin[i]:begin[i + 1]]. Step in the upper, fraction in the lower bits."""
    n = len(begin) - 1
    out = np.full(n * slots, _FULL, np.uint64)
    row = np.repeat(np.arange(n), np.diff(begin))
    live, deal = grams, None
    for j in range(slots):
        if not len(live):
            break
        draw = mix(live + np.uint64(_STEP * (2 * j + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = j + (((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - j)) >> np.uint64(24)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(40)) | (draw >> np.uint64(24))
        if deal is None:
            slot = pick
        else:
            each = np.arange(len(live))
            slot = deal[each, pick].astype(np.int64)
            deal[each, pick] = deal[:, j]
        np.minimum.at(out, row * slots + slot, value)
        open_row = out.reshape(n, slots).max(1) >= np.uint64((j + 1) << 40)
        stay = open_row[row]
        if deal is None:
            live, row, pick = live[stay], row[stay], pick[stay]
            deal = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(live), 1))
            deal[np.arange(len(live)), pick] = 0
        elif not stay.all():
            live, row, deal = live[stay], row[stay], deal[stay]
    return out.reshape(n, slots)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signatures.shape[1] // bands
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for j in range(rows):
        out = mix(out + parts[:, :, j] * np.uint64(2 * j + 3))
    return out


def shingle_sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each row."""
    for part, word, first in read_words(batch, column, limit=SLICE):
        grams, begin = gram_hashes(word, first, k)
        sets = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            own = np.sort(grams[a:b])
            sets.append(own[np.append(True, own[1:] != own[:-1])] if b > a else own)
        yield part, sets


def signed(docs: DataFrame, k: int, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``row_key``, ``n_shingles``, ``cls`` (a digest of the set, null without words) and ``bands`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in shingle_sets(batch, "text", k):
                size = np.array([len(s) for s in sets], np.int64)
                flat, begin = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)])
                digest = np.zeros((len(sets), 2), np.uint64)
                for at, step in ((0, 0x51), (1, 0xA7)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(step * _STEP & 0xFFFFFFFFFFFFFFFF)))])
                    digest[:, at] = mix(total[begin[1:]] - total[begin[:-1]] + size.astype(np.uint64))
                raw = digest.tobytes()
                cls = pa.array([raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(size.tolist())], pa.binary())
                hashes = band_hashes(super_minhash(flat, begin, slots), bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands), pa.int32()), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), cls, lists], names=["doc_id", "row_key", "n_shingles", "cls", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, n_shingles long, cls binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(0).to_pylist()
            head = [i for i, x in enumerate(name) if not i or name[i - 1] != x]
            which = np.searchsorted(head, np.arange(batch.num_rows), side="right") - 1
            firsts = pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(head))], names=["text"])
            left = [s for _, sets in shingle_sets(firsts, "text", k) for s in sets]
            right = [s for _, sets in shingle_sets(batch.select(["text_b"]), "text_b", k) for s in sets]
            good = []
            for i, s in zip(which.tolist(), right):
                t = left[i]
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([s, t]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _levels(texts: DataFrame, k: int, places: int = PLACES) -> np.ndarray:
    """How frequent shingles are, as a logarithm, for each of ``places`` hashed places; counted over all the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(places, np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch, "text", k):
                count += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(places)).astype(np.int64), minlength=places)
        used = np.flatnonzero(count)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[part])], names=["place", "n"])

    often = texts.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where("n > 1")
    often = often.select(F.col("place").cast("int").alias("place"), F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()
    level = np.zeros(places, np.uint8)
    level[often.column("place").to_numpy()] = often.column("level").to_numpy()
    return level


def _tokens(open_: DataFrame, k: int, percent: int, level: np.ndarray) -> DataFrame:
    """Rare-first shingles of every open text: of its own set (``own``), and of its difference from its pivot's set."""
    shared, maps = open_.sparkSession.sparkContext.broadcast(level), [f"map{i}" for i in range(MAPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value

        def by_rank(s: np.ndarray) -> np.ndarray:
            return s[np.lexsort((s, level[(s % np.uint64(len(level))).astype(np.int64)]))]

        for batch in batches:
            right = [s for _, sets in shingle_sets(batch.select(["text"]), "text", k) for s in sets]
            pivot = batch.column(2).to_pylist()
            head = [i for i, x in enumerate(pivot) if not i or pivot[i - 1] != x]
            heads = pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(head))], names=["text"])
            left = [s for _, sets in shingle_sets(heads, "text", k) for s in sets]
            which = np.searchsorted(head, np.arange(batch.num_rows), side="right") - 1
            grams, row, own, place, size, bits = [], [], [], [], [], []
            for i, s in enumerate(right):
                n = len(s)
                differ = np.setxor1d(s, left[which[i]], assume_unique=True)
                far = (100 - percent) * (n + n * 100 // percent + 1) // (100 + percent)
                for is_own, whole, most in ((True, s, n - -(-percent * n // 100) + 1), (False, differ, far + 1)):
                    part = by_rank(whole)[:most]
                    grams.append(part)
                    row.append(np.full(len(part), i))
                    own.append(np.full(len(part), is_own))
                    place.append(np.arange(len(part), dtype=np.int32))
                    size.append(np.full((len(part), 2), (n, len(whole)), np.int32))
                    marks = np.zeros(64 * MAPS, np.uint8)
                    marks[(whole >> np.uint64(20)) % np.uint64(64 * MAPS)] = 1
                    bits.append(np.repeat(np.packbits(marks).view(np.int64)[None], len(part), 0))
            at, sizes = pa.array(np.concatenate(row)), np.concatenate(size)
            taken = [batch.column(c).take(at) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), *taken, *map(pa.array, (np.concatenate(own), np.concatenate(place), sizes[:, 0].copy(), sizes[:, 1].copy(), *np.concatenate(bits).T.copy()))], names=["gram", "cls", "root", "pivot", "own", "place", "n", "d", *maps])

    rows = open_.select("cls", "root", "pivot", "text", "pivot_text")
    return rows.mapInArrow(run, "gram long, cls binary, root binary, pivot binary, own boolean, place int, n int, d int, " + ", ".join(f"{m} long" for m in maps))


def prefix_pairs(open_: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """Pairs of open texts with different roots that may be similar; none that is gets lost.

    Under any one order of all shingles, two similar sets share one among the first n - ceil(percent * n / 100) + 1 of each,
    and at the first that they share, what follows must still suffice. The order puts rare shingles first, so that passages
    which many texts share come last. It is taken from a bounded sample, which affects the number of pairs, not what is found.

    Texts that lie around the same pivot are alike in most of their shingles, so those are compared by their differences from
    the pivot instead: the distance of two texts follows from what their differences share, and it is at most
    (100 - percent) / (100 + percent) of the two sizes. Where one of the two is not linked with the pivot, as is so for any pair
    with different roots, similar texts share at least one difference.
    """
    tokens = store(_tokens(open_, k, percent, _levels(open_, k)), "prefixes")
    several = tokens.groupBy("own", F.when(~F.col("own"), F.col("pivot")).alias("around"), "gram").agg(*[f(c).alias(f"{c}_{n}") for c in ("root", "pivot") for n, f in (("least", F.min), ("most", F.max))])
    # Only different roots make pairs; texts around one pivot meet by their differences, so own shingles need two pivots.
    several = several.where("root_least < root_most AND (NOT own OR pivot_least < pivot_most)")
    own, differ = tokens.where("own").join(several.where("own").select("gram"), "gram"), tokens.where("NOT own").join(several.where("NOT own").select(F.col("around").alias("pivot"), "gram"), ["pivot", "gram"])
    # Not more is common than what follows the shared shingle on either side, nor than a side has without those of its elements
    # whose bit the other side lacks.
    lacks = lambda x, y: sum(F.bit_count(F.col(f"{x}.map{i}").bitwiseAND(F.bitwise_not(f"{y}.map{i}"))) for i in range(MAPS))
    rest = F.least(F.col("a.d") - F.col("a.place"), F.col("b.d") - F.col("b.place"), F.col("a.d") - lacks("a", "b"), F.col("b.d") - lacks("b", "a"))
    both = (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.gram") == F.col("b.gram")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    sizes = F.col("a.n") + F.col("b.n")
    apart = (F.col("a.pivot") != F.col("b.pivot")) & ((100 + percent) * rest >= percent * sizes)
    around = (F.col("a.pivot") == F.col("b.pivot")) & (2 * (100 + percent) * rest >= (100 + percent) * (F.col("a.d") + F.col("b.d")) - (100 - percent) * sizes)
    pairs = own.alias("a").join(own.alias("b"), both & apart).select("a.cls", F.col("b.cls").alias("b")).union(differ.alias("a").join(differ.alias("b"), both & around).select("a.cls", F.col("b.cls").alias("b")))
    return pairs.select(F.col("cls").alias("a"), "b").distinct()


def links(docs: DataFrame, per_doc: DataFrame, k: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``node`` and ``root`` of the classes that are linked, and the verified pairs."""
    classes = per_doc.where("cls IS NOT NULL").groupBy("cls").agg(F.min("row_key").alias("row_key"), F.first("bands").alias("bands"))
    banded = classes.select("cls", "row_key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = store(banded.join(buckets, "band"), "members")
    # A class that meets many others is likely to be what they are copies of, so it comes first in its buckets.
    degrees = shared.groupBy("cls").agg(F.struct((-F.sum("n")).alias("less"), F.col("cls").alias("cls")).alias("rank"))
    ranked = shared.join(degrees, "cls")
    pivots = ranked.groupBy("band").agg(F.min("rank").alias("top"))
    members = store(ranked.join(pivots, "band").withColumn("pivot", F.col("top.cls")), "members")
    involved = members.select("row_key", "cls").distinct()
    texts = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text")).join(involved, "row_key").select("cls", "text")
    texts = store(texts.dropDuplicates(["cls"]), "texts")
    compared = store(members.where("cls <> pivot").select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct(), "pairs")
    linked = store(verify(compared, texts, k, percent), "linked")
    roots = components(linked)
    # A pivot may itself stand in the bucket of one that meets more: what lies around it is compared with that one too, so that
    # a family of copies gathers around one text before pairs are sought.
    nearest = store(members.groupBy("cls").agg(F.min("top")["cls"].alias("pivot")), "nearest")
    for _ in range(HOPS):
        over = nearest.select(F.col("cls").alias("pivot"), F.col("pivot").alias("over"))
        nearest = store(nearest.join(over, "pivot").select("cls", F.col("over").alias("pivot")), "nearest")
    around = nearest.where("cls <> pivot").select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b"))
    around = store(around.join(compared, ["a", "b"], "left_anti"), "pairs")
    found = store(verify(around, texts, k, percent), "linked")
    if not found.isEmpty():
        linked, compared = linked.union(found), compared.union(around)
        roots = components(linked)
    # Buckets that hold more than one component still; all members of the others are connected.
    named = members.select("band", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    split = named.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band")
    open_ = named.join(split, "band").select("cls", "root").distinct().join(nearest, "cls").join(texts, "cls")
    open_ = store(open_.join(texts.select(F.col("cls").alias("pivot"), F.col("text").alias("pivot_text")), "pivot"), "open")
    fresh = store(prefix_pairs(open_, k, percent).join(compared, ["a", "b"], "left_anti"), "pairs")
    found = store(verify(fresh, texts, k, percent), "linked")
    if not found.isEmpty():
        linked = linked.union(found)
        roots = components(linked)
    return roots, linked


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``row_key``, ``n_shingles``, ``component_id`` and ``kept`` of every row, ``n_links`` of its class, and ``stands`` for one row of each component."""
    per_doc = store(signed(docs, k, slots, bands), "signed")
    roots, linked = links(docs, per_doc, k, percent)
    ends = linked.select(F.col("a").alias("cls")).union(linked.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    rows = per_doc.drop("bands").join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(ends, "cls", "left")
    rows = rows.withColumn("root", F.coalesce("root", "cls"))
    named = per_doc.where("cls IS NOT NULL").select("cls", "doc_id", "row_key").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    least = named.groupBy(F.coalesce("root", "cls").alias("root")).agg(first.alias("least"))
    rows = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.select("doc_id", "row_key", "n_shingles", "component_id", stays, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("cls").isNull() | (F.col("least.row_key") == F.col("row_key"))).alias("stands"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with the columns of ``docs``; of repeated rows one stays."""
    key = free_name(docs, "row_key")
    stand = near_duplicates(docs, k, percent).where("stands").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text")).join(stand, key).dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
