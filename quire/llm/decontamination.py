"""Benchmark passages in documents, by greedy string tiling.

Tokens are runs of ASCII letters (in lower case), digits and non-ASCII bytes. Shared runs of ``least`` tokens are the seeds:
documents and benchmark items meet on them. An item counts where tiles inside a stretch of the document of at most ``spread``
times its length cover ``percent`` of it, so chance matches far apart do not add up, or where one run of ``long`` tokens is
shared, so a long item that leaks in part is found. What the seeds of a stretch cover bounds what any tiling of it can cover, so
a stretch goes on with an item only where that reaches the threshold. Then tiles are marked, longest first: windows of a length are
compared by running Karp-Rabin hashes, matches are extended over tokens not yet marked, marked in order of length, and the
length is halved until it is ``least``. Since tiles may lie in any order, passages that were cut up and reordered are caught.

The benchmark is a stated query set: its items go to the tasks in blocks of at most ``block_bytes`` of text, and each block is
held against all documents. Documents are judged where they are read; nothing is shuffled.

Null and empty texts match nothing. Items with fewer than ``least`` tokens are too short to be told and match nothing. Repeated
rows of either table are judged one by one; a null item_id is kept. Further columns of either table pass or do not matter. An
empty benchmark leaves all documents clean; an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import free_name, gram_hashes, lower, pass_through, text_buffer, word_hashes, words

LEAST, PERCENT, LONG, SPREAD = 4, 50, 13, 3
BLOCK_BYTES = 16 << 20
LEAK = "struct<item_id: bigint, item_tokens: bigint, covered: bigint, n_tiles: bigint, longest: bigint>"
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_FILTER_BITS = 22


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(data, off, _GAP)
    return word_hashes(lower(data), start, end), first


def _windows(token: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Running hash of each window of ``size`` tokens without a marked one, and where it begins."""
    if len(token) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, _ = _rolling(token, size)
    taken = np.concatenate([[0], np.cumsum(marked)])
    free = np.flatnonzero(taken[size:] == taken[:-size])
    return grams[free], free


_KR = 0x9E3779B97F4A7C15


def _rolling(token: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Karp-Rabin: window hash = sum of token * base**(size - 1 - place), from one prefix to the next."""
    inverse = pow(_KR, -1, 1 << 64)
    powers = np.full(len(token) + 1, np.uint64(inverse))
    powers[0] = 1
    powers = np.cumprod(powers)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token * powers[:-1])])
    ups = np.full(len(token) + 1, np.uint64(_KR))
    ups[0] = 1
    ups = np.cumprod(ups)
    at = np.arange(len(token) - size + 1)
    return (prefix[at + size] - prefix[at]) * ups[at], size


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (place in item, place in text, length), longest first among those left at each step."""
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while True:
        hashes, places = _windows(item, in_item, size)
        own: dict[int, list[int]] = {}
        for h, p in zip(hashes.tolist(), places.tolist()):
            own.setdefault(h, []).append(p)
        hashes, places = _windows(text, in_text, size)
        hit = np.isin(hashes, np.fromiter(own, np.uint64, len(own)))
        queue: dict[int, list[tuple[int, int]]] = {}
        for h, q in zip(hashes[hit].tolist(), places[hit].tolist()):
            for p in own[h]:
                if p and q and item[p - 1] == text[q - 1] and not in_item[p - 1] and not in_text[q - 1]:
                    continue  # the match begins further left
                n = 0
                while p + n < len(item) and q + n < len(text) and item[p + n] == text[q + n] and not in_item[p + n] and not in_text[q + n]:
                    n += 1
                if n >= size:
                    queue.setdefault(n, []).append((p, q))
        while queue:
            n = max(queue)
            for p, q in queue.pop(n):
                # A run that was marked meanwhile splits the match; what is left waits for its own length.
                free = ~(in_item[p : p + n] | in_text[q : q + n])
                if free.all():
                    in_item[p : p + n] = in_text[q : q + n] = True
                    tiles.append((p, q, n))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if b - a >= size:
                        queue.setdefault(b - a, []).append((p + a, q + a))
        if size == least:
            return tiles
        size = max(least, size // 2)


def stretches(place: np.ndarray, at: np.ndarray, size: int, least: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins of stretches of ``wide`` tokens, one at each seed of an item, and how many of its tokens their seeds cover; most first.

    ``place`` and ``at`` are the seeds' places in the item and in the text, in the order of the text.
    """
    times, last = [0] * size, 0
    covered, bounds = 0, []
    places, ats = place.tolist(), at.tolist()
    for first in range(len(ats)):
        while last < len(ats) and ats[last] + least <= ats[first] + wide:
            for i in range(places[last], places[last] + least):
                covered += not times[i]
                times[i] += 1
            last += 1
        bounds.append(covered)
        for i in range(places[first], places[first] + least):
            times[i] -= 1
            covered -= not times[i]
    order = np.argsort(-np.array(bounds), kind="stable")
    return at[order], np.array(bounds)[order]


class Block:
    """Items of the benchmark with their seeds, sorted by hash."""

    def __init__(self, ids: list, texts: list, least: int) -> None:
        data, off = text_buffer(pa.array([x or "" for x in texts], pa.string()))
        self.ids, self.least = ids, least
        self.token, self.first = tokens(data, off)
        self.size = np.diff(self.first)
        grams, begin = gram_hashes(self.token, self.first, least)
        item = np.repeat(np.arange(len(ids)), np.diff(begin))
        place = np.arange(len(grams)) - begin[:-1][item]
        fit = self.size[item] >= least
        order = np.argsort(grams[fit], kind="stable")
        self.seed, self.item, self.place = grams[fit][order], item[fit][order], place[fit][order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seed >> np.uint64(64 - _FILTER_BITS)] = True

    def leaks(self, data: np.ndarray, off: np.ndarray, percent: int, long: int = LONG, spread: int = SPREAD) -> list[list[dict]]:
        """For each row the items that it covers to the threshold in one stretch, or with which it shares a long run."""
        out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
        token, first = tokens(data, off)
        grams, begin = gram_hashes(token, first, self.least)
        at = np.flatnonzero(self.filter[grams >> np.uint64(64 - _FILTER_BITS)])
        low, high = np.searchsorted(self.seed, grams[at]), np.searchsorted(self.seed, grams[at], side="right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        if not len(at):
            return out
        n = high - low
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which = np.repeat(at, n)
        row = np.searchsorted(begin, which, side="right") - 1
        item, place, where = self.item[hit], self.place[hit], which - begin[row]
        # Seeds that follow one another on one diagonal are one run.
        order = np.lexsort((where, where - place, item, row))
        line = np.stack([row, item, where - place, where - np.arange(len(where))[np.argsort(order)]], 1)[order]
        head = np.flatnonzero(np.append(True, (line[1:] != line[:-1]).any(1)))
        size = np.diff(np.append(head, len(line))) + self.least - 1
        begins = order[head[size >= long]]
        runs: dict[tuple[int, int], int] = {}
        for i in begins[np.argsort(size[size >= long], kind="stable")].tolist():
            runs[int(row[i]), int(item[i])] = int(where[i])  # the longest comes last
        order = np.lexsort((where, item, row))
        row, item, place, where = row[order], item[order], place[order], where[order]
        cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(row)).tolist()):
            r, i = int(row[a]), int(item[a])
            size = int(self.size[i])
            step = np.minimum(np.diff(np.append(np.unique(place[a:b]), size)), self.least)
            if 100 * int(step.sum()) < percent * size and (r, i) not in runs:
                continue
            text, own = token[first[r] : first[r + 1]], self.token[self.first[i] : self.first[i + 1]]
            best, most = [], 0
            for begin_at, bound in zip(*stretches(place[a:b], where[a:b], size, self.least, spread * size)):
                if bound <= most or 100 * bound < percent * size:
                    break
                tiles = tile(own, text[begin_at : begin_at + spread * size], self.least)
                covered = sum(t[2] for t in tiles)
                if covered > most:
                    best, most = tiles, covered
            if 100 * most < percent * size:
                if (r, i) not in runs:
                    continue
                best = tile(own, text[runs[r, i] : runs[r, i] + spread * size], self.least)
                most = sum(t[2] for t in best)
            out[r].append({"item_id": self.ids[i], "item_tokens": size, "covered": most, "n_tiles": len(best), "longest": max(t[2] for t in best)})
        return out


def blocks(benchmark: DataFrame, least: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if ids and held + len(r[1] or "") > block_bytes // 4:
            yield Block(ids, texts, least)
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        held += len(r[1] or "")
    if ids:
        yield Block(ids, texts, least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, column: str = "leaks", long: int = LONG, spread: int = SPREAD) -> DataFrame:
    """``docs`` with one more column, ``leaks``: the items of which a stretch covers ``percent`` or more, or shares ``long`` tokens in a row."""
    spark, names = docs.sparkSession, docs.columns
    kind = pa.list_(pa.struct([(x.split(": ")[0], pa.int64()) for x in LEAK[7:-1].split(", ")]))
    out, parts = docs, []
    for block in blocks(benchmark, least, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def make(data: np.ndarray, off: np.ndarray, shared=shared) -> pa.Array:
            return pa.array(shared.value.leaks(data, off, percent, long, spread), kind)

        parts.append(free_name(out, f"leaks_{len(parts)}"))
        out = pass_through(out, parts[-1], f"array<{LEAK}>", make)
    found = F.concat(*parts) if parts else F.array().cast(f"array<{LEAK}>")
    return out.select(*[F.col(f"`{c}`") for c in names], found.alias(column))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, tokens, coverage and tiles."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").cast("long"), F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.*", (F.col("leak.covered") / F.col("leak.item_tokens")).alias("coverage"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that leak no item, with the columns of ``docs``."""
    column = free_name(docs, "leaks")
    return find_leaks(docs, benchmark, column=column, **options).where(F.size(column) == 0).drop(column)
