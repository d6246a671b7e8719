"""Quality rules from each document's own repetitions, found with a suffix array over its words.

The suffix array is built by prefix doubling for many documents at once: ranks start as those of (document, word), and only
suffixes that still share a rank are sorted on. Neighbouring suffixes get the length of their common prefix by comparing
hashes of doubling length. A maximal repeated substring is an interval of suffixes whose common prefixes have at least its
length; the longest one that begins at a word is the larger of its two neighbours' prefixes, so the union of all intervals'
spans is the union of those. A document is rejected where such repeats of at least ``min_words`` words cover more than
``max_covered`` of its words, where one of them is longer than ``max_share`` of its words and than ``short`` words, or than
``max_longest`` words, or where the base counts fail. Every word of a long repeat is also one of a repeat of five words, so
a limit on the former decides something only where it is below the base rule's limit on the latter.

Null and empty texts have no words and fail the base rule. Rows are judged alone: repeated rows, other columns and their
names do not matter. Ties do not arise. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import free_name, mix, pass_through, prefix_hash, range_hash, word_hashes, words

MIN_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.1, 100
MAX_SHARE, SHORT = 0.04, 25  # below half of MAX_COVERED: two copies side by side cover twice their length
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_array(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word positions of all rows, row by row, each row's in the order of its suffixes."""
    n = len(word)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][row]
    order = np.lexsort((word, row))
    fresh = np.ones(n, bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while True:
        tied = ~(fresh & np.append(fresh[1:], True))
        active = order[tied]
        if not len(active):
            return order
        ahead = active + step
        second = np.where(ahead < stop[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        old = rank[active]
        by = np.lexsort((second, old))
        active, old, second = active[by], old[by], second[by]
        place = np.arange(len(active))
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        rank[active] = old + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        # Tied groups keep their places in the order; only the order within them changes.
        order[tied] = active
        fresh[tied] = part
        step *= 2


def common_prefixes(order: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Common prefix, in words, of each suffix with the one before it in the order (0 for a row's first)."""
    n = len(order)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][row]
    prefix = prefix_hash(word)
    out = np.zeros(n, np.int64)
    pair = np.arange(1, n)
    a, b = order[:-1], order[1:]
    limit = np.where(row[a] == row[b], np.minimum(stop[a] - a, stop[b] - b), 0)
    same = lambda i, size: range_hash(prefix, a[i], a[i] + size) == range_hash(prefix, b[i], b[i] + size)
    live = pair - 1
    size = 1
    while len(live):  # grow: out is a length that is known to agree
        live = live[limit[live] >= size]
        live = live[same(live, size)]
        out[live + 1] = size
        size *= 2
    rest = np.flatnonzero(out[1:] > 0)
    step = size // 2
    while step:  # refine by halves
        wide = out[rest + 1] + step
        can = wide <= limit[rest]
        pick, wide = rest[can], wide[can]
        good = same(pick, wide)
        out[pick[good] + 1] = wide[good]
        step //= 2
    return out


def longest_at(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest repeat that begins there."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Positions below n that lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


def _longest(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, np.int64)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, first[:-1][some])
    return out


def line_repeats(data: np.ndarray, off: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    n = len(off) - 1
    ends = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([off[:-1], ends + 1]))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(n, np.int64)
    # A line runs to the next line end or to the next row; the line end itself is not part of it.
    stop = np.append(start[1:], len(data))
    stop = np.where(data[stop - 1] == 10, stop - 1, stop)
    row = np.searchsorted(off, start, side="right") - 1
    has_word = np.searchsorted(word_start, stop) > np.searchsorted(word_start, start)
    key = mix(range_hash(prefix_hash(data), start, stop) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[has_word]
    row = row[has_word]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    return np.bincount(row[order][again], minlength=n)


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, n_spans long"


def count_slice(data: np.ndarray, off: np.ndarray, min_words: int) -> list[np.ndarray]:
    """The columns of COUNTS for the rows of a text buffer."""
    start, end, first = words(data, off)
    n = len(start)
    per_byte = lambda flags: _per_row(flags, off)
    ink = np.zeros(len(data) + 1, np.int8)
    np.add.at(ink, start, 1)
    np.add.at(ink, end, -1)
    in_word = np.cumsum(ink[:-1], dtype=np.int8) > 0
    chars = per_byte(in_word & ((data & 0xC0) != 0x80))
    n_words = np.diff(first)
    if n:
        word = word_hashes(data, start, end)
        order = suffix_array(word, first)
        longest = longest_at(order, common_prefixes(order, word, first))
        fives = np.flatnonzero(longest >= 5)
        repeat_words = _per_row(covered(fives, np.full(len(fives), 5), n), first)
        long = np.flatnonzero(longest >= min_words)
        cover = covered(long, longest[long], n)
        head = cover.copy()
        head[1:] &= ~cover[:-1]
        head[first[:-1][n_words > 0]] = cover[first[:-1][n_words > 0]]
        cover_words, spans = _per_row(cover, first), _per_row(head, first)
        best = _longest(longest, first)
    else:
        repeat_words = cover_words = spans = best = np.zeros(len(off) - 1, np.int64)
    return [n_words, chars, per_byte(_SYMBOL[data]), line_repeats(data, off, start), repeat_words, cover_words, best, spans]


def measure(docs: DataFrame, min_words: int = MIN_WORDS, column: str = "quality_counts") -> DataFrame:
    """All columns of ``docs`` and one struct of counts; rows pass one by one and nothing is shuffled."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def make(data: np.ndarray, off: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(np.asarray(c, np.int64)) for c in count_slice(data, off, min_words)], names)

    return pass_through(docs, column, "struct<" + ", ".join(f"{n}: bigint" for n in names) + ">", make)


def base_failed(counts: str = "quality_counts"):
    return (F.col(f"{counts}.n_words") < 10) | (100 * F.col(f"{counts}.n_repeat_words") > 20 * F.col(f"{counts}.n_words"))


def passes(counts: str = "quality_counts", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, max_share: float = MAX_SHARE, short: int = SHORT):
    """The verdict: the base rules hold and the repeats are few and short."""
    n_words, longest = F.col(f"{counts}.n_words"), F.col(f"{counts}.longest_repeat")
    few = F.col(f"{counts}.covered_words") <= max_covered * n_words
    return ~base_failed(counts) & few & (longest <= F.least(F.lit(max_longest), F.greatest(F.lit(short), max_share * n_words)))


def quality(docs: DataFrame, min_words: int = MIN_WORDS, **limits) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row."""
    measured = measure(docs.select("doc_id", "text"), min_words)
    return measured.select(F.col("doc_id").cast("long"), "quality_counts.*", base_failed().alias("base_failed"), passes("quality_counts", **limits).alias("kept"))


def keep_good(docs: DataFrame, min_words: int = MIN_WORDS, **limits) -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    column = free_name(docs, "quality_counts")
    return measure(docs, min_words, column).where(passes(column, **limits)).drop(column)
