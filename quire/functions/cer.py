"""Character error rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import is_blank, strip_ws

PREVIEW_CHARS = 16000
# Rough costs of the two ways to compare, in nanoseconds: a step by diagonals and each diagonal in it; a column of bit vectors
# and each of its characters. They decide how far the diagonals are followed, never what comes out.
DIAGONAL_STEP, DIAGONAL_EACH, COLUMN_STEP, COLUMN_EACH = 100_000, 60, 3_000, 0.6
# The same for one place of a narrow band, and the widths of the bands that are tried: edits beyond the difference in length.
BAND_EACH, BANDS = 1_000, (0, 4, 16, 64)
_TOGETHER = 6


def _shared_start(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _without_shared_ends(a: str, b: str) -> tuple[str, str]:
    """Both texts without their common start and end, which no edit touches; the shorter first."""
    start = _shared_start(a, b)
    a, b = a[start:], b[start:]
    end = _shared_start(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    return (a, b) if len(a) <= len(b) else (b, a)


def _bit_parallel_distance(a: str, b: str) -> int:
    """Edit distance by bit vectors (Myers 1999, in Hyyrö's form for whole strings).

    One column of the matrix is a few operations on integers of ``len(a)`` bits, so a
    pair costs about a hundredth of filling the matrix cell by cell. Best with the longer text first.
    """
    if not a or not b:
        return len(a) + len(b)
    codes = _codes(a)
    match = {ch: int.from_bytes(np.packbits(codes == ord(ch), bitorder="little").tobytes(), "little") for ch in set(b)}
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for ch in b:
        same = match.get(ch, 0)
        vertical = same | minus
        horizontal = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1) | 1, down << 1
        plus = full & (down | ~(vertical | up))
        minus = full & up & vertical
    return distance


def _run(a: str, b: str, i: int, j: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on are equal, in chunks that double."""
    begin, size = i, 32
    while (part := a[i : i + size]) == (other := b[j : j + size]):
        if len(part) < size:
            return i - begin + len(part)
        i, j, size = i + size, j + size, size * 2
    return i - begin + _shared_start(part, other)


def _distance_in_band(a: str, b: str, slack: int) -> int | None:
    """Edit distance where it is at most the difference in length and ``slack`` more, else None. ``a`` is the shorter one.

    A way of at most ``most`` edits that has used ``e`` of them must be near enough to the last diagonal for the rest: so at
    most ``slack + 1`` diagonals are open at a time, however many edits there are.
    """
    n, m = len(a), len(b)
    goal = m - n
    most = goal + slack
    # The furthest place on each open diagonal, none before it: -2 stands for that.
    low, reach = 0, [_run(a, b, 0, 0)]
    for e in range(most + 1):
        if e:
            first, last = max(-e, e - slack, -n), min(e, goal + most - e, m)
            fresh = []
            for d in range(first, last + 1):
                k = d - low
                i = max(
                    reach[k] + 1 if 0 <= k < len(reach) else -2,
                    reach[k + 1] + 1 if -1 <= k < len(reach) - 1 else -2,
                    reach[k - 1] if 0 < k <= len(reach) else -2,
                )
                i = min(i, n, m - d)
                if i >= 0 and i + d >= 0 and i < n and i + d < m and a[i] == b[i + d]:
                    i += _run(a, b, i, i + d)
                fresh.append(i if i >= 0 and i + d >= 0 else -2)
            low, reach = first, fresh
        if 0 <= goal - low < len(reach) and reach[goal - low] >= n:
            return e
    return None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _equal_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on are equal, in chunks that double."""
    begin, size = i, 64
    while True:
        n = min(size, len(a) - i, len(b) - j)
        if n <= 0:
            return i - begin
        differ = a[i : i + n] != b[j : j + n]
        at = int(differ.argmax())
        if differ[at]:
            return i - begin + at
        i, j, size = i + n, j + n, size * 2


def _distance_by_diagonals(a: str, b: str, most: float) -> int | None:
    """Edit distance by the furthest place that each number of edits reaches on each diagonal (Ukkonen 1985).

    After ``e`` edits only ``2 * e + 1`` diagonals are open, and each keeps one number: so the cost follows the edits, not the
    product of the lengths. All diagonals step together; the few on which many characters are equal run on in chunks.
    ``a`` is the shorter one. None when the work would pass ``most`` nanoseconds.
    """
    x, y = _codes(a), _codes(b)
    n, m = len(x), len(y)
    # A sign past either end that equals nothing stops every run there.
    ends_x, ends_y = np.append(x, np.uint32(0xFFFFFFFF)), np.append(y, np.uint32(0xFFFFFFFE))

    def extend(reach: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        open_ = np.arange(len(reach))
        for _ in range(_TOGETHER):
            i = reach[open_]
            open_ = open_[ends_x[i] == ends_y[i + diagonal[open_]]]
            if not len(open_):
                return reach
            reach[open_] += 1
        for k in open_.tolist():
            i = int(reach[k])
            reach[k] += _equal_run(x, y, i, i + int(diagonal[k]))
        return reach

    low = high = 0
    reach = extend(np.zeros(1, np.int64), np.zeros(1, np.int64))
    edits, spent, goal = 0, 0.0, m - n
    while not (low <= goal <= high and reach[goal - low] >= n):
        edits += 1
        spent += DIAGONAL_STEP + DIAGONAL_EACH * len(reach)
        if spent > most:
            return None
        wide = np.full(len(reach) + 4, -2, np.int64)
        wide[2:-2] = reach
        # On a diagonal one edit takes from itself (both go on), from the next (a character of a is left out), or from the one before.
        fresh = np.maximum(np.maximum(wide[1:-1] + 1, wide[2:] + 1), wide[:-2])
        diagonal = np.arange(low - 1, high + 2)
        keep = (diagonal >= -n) & (diagonal <= m) & (fresh >= 0)
        fresh, diagonal = fresh[keep], diagonal[keep]
        low, high = int(diagonal[0]), int(diagonal[-1])
        reach = extend(np.minimum(fresh, np.minimum(n, m - diagonal)), diagonal)
    return edits


def distance(a: str, b: str) -> int:
    """Exact edit distance of two texts of any length.

    Shared ends go first. Then narrow bands of diagonals are tried, each a few times wider than the last, and then all diagonals,
    both as long as they cost less than bit vectors would in all; texts that turn out to have little in common are compared by
    those, so a pair costs at most three times the best of the ways.
    """
    a, b = _without_shared_ends(a, b)
    if not a:
        return len(b)
    columns = len(a) * (COLUMN_STEP + COLUMN_EACH * len(b))
    spent = 0.0
    for slack in BANDS:
        spent += (len(b) - len(a) + slack + 1) * (slack + 1) * BAND_EACH
        if spent > columns:
            break
        found = _distance_in_band(a, b, slack)
        if found is not None:
            return found
    found = _distance_by_diagonals(a, b, columns)
    return _bit_parallel_distance(b, a) if found is None else found


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def edit_distance(a: Column, b: Column) -> Column:
    """Exact edit distance, whole texts.

    Equal texts cost nothing; all other pairs go through one Arrow function, and equal ones send nulls there. Batches are
    bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    differ = a != b
    compare = F.pandas_udf(_distances, T.IntegerType())
    return F.when(differ, compare(F.when(differ, a), F.when(differ, b))).when(a == b, F.lit(0))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Edits over reference length; may exceed 1. Two empties are 0, an empty reference is 1,
    a blank-only reference is 0."""
    ref = F.coalesce(reference, F.lit(""))
    hyp = F.coalesce(hypothesis, F.lit(""))
    counted = ~is_blank(ref) & (ref != hyp)
    r, h = F.when(counted, strip_ws(ref)), F.when(counted, strip_ws(hyp))
    return (
        F.when((ref == "") & (hyp == ""), F.lit(0.0))
        .when(ref == "", F.lit(1.0))
        .when(~counted, F.lit(0.0))
        .otherwise(edit_distance(r, h) / F.length(r))
        .cast("double")
    )


def cer_percent(reference: Column, hypothesis: Column) -> Column:
    return F.round(cer(reference, hypothesis) * 100, 2)


def cer_preview(reference: Column, hypothesis: Column, limit: int = PREVIEW_CHARS) -> Column:
    """The quick percentage shown beside an editor: both texts cut at ``limit``, not trimmed."""
    ref = F.coalesce(reference, F.lit(""))
    hyp = F.coalesce(hypothesis, F.lit(""))
    a, b = (F.when(ref != "", F.left(t, F.lit(limit))) for t in (ref, hyp))
    return (
        F.when((ref == "") & (hyp == ""), F.lit(0.0))
        .when(ref == "", F.lit(100.0))
        .otherwise(F.round(edit_distance(a, b) / F.length(a) * 100, 2))
        .cast("double")
    )
