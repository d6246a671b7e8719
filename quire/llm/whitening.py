"""Whitening of embeddings by singular values: blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations.

Vectors are read as integers ``floor(256 * c)``. The fit list holds each distinct vector once; its centred rows are reduced block
by block: a task keeps one triangular factor and takes the next batch of rows into it by a QR step, and the tasks' factors are
combined in the same way, a bounded number at a time. So the covariance is never formed, and what reaches the driver is a
triangle of as many rows as there are dimensions, whatever the number of vectors.

The triangle is made upper bidiagonal by Householder reflections from both sides. The differential quotient-difference algorithm
with shifts finds the squares of its singular values to high relative accuracy. For each leading value the twisted factorisation
of the shifted tridiagonal matrix gives the singular vector, which the reflections take back to the vectors' space; vectors of
values that lie very close are made orthogonal to each other by inverse iteration.

Rows whose vector is null or holds null or non-finite entries, and rows with an entry whose integer is 2**30 or more, take no
part. Vectors that are shorter than the longest end in zeros. Repeated rows are fitted once and all returned; null ids are
returned like others. Directions without variance (below 1e-24 of the trace) have no whitened values and are left out, so one
distinct vector, or none, gives no rows. Where eigenvalues are equal any orthonormal choice of their directions is valid.
``deviation`` is null where it does not fit a long; ``deviation_exact`` holds it up to 38 digits. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import store
from quire.llm.vectors import finite, fold, integers, matrix, per_task

COMPONENTS = 4
LARGEST = 1 << 30
_EPS = np.finfo(float).eps
_TINY = 1e-290


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of a block of rows, as many rows as columns."""
    dims = rows.shape[1]
    if len(rows) < dims:
        rows = np.concatenate([rows, np.zeros((dims - len(rows), dims))])
    return np.linalg.qr(rows, mode="r")


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of U' R V, and V, by Householder reflections from the left and the right in turn."""
    a, n = r.astype(float).copy(), r.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size <= _TINY:
            return None
        u = x / size
        u[0] += np.copysign(1.0, u[0])
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            u = reflector(a[k, k + 1 :])
            if u is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """One differential step: new quotients and differences, the least remainder and its place; stops early where one is negative."""
    n = len(q)
    fresh_q, fresh_e = np.empty(n), np.empty(max(n - 1, 0))
    d = q[0] - shift
    least, where = d, 0
    for k in range(n - 1):
        if d < 0:
            return fresh_q, fresh_e, d, k
        fresh_q[k] = d + e[k]
        ratio = q[k + 1] / fresh_q[k] if fresh_q[k] > 0 else 0.0
        fresh_e[k] = e[k] * ratio
        d = d * ratio - shift if fresh_q[k] > 0 else q[k + 1] - shift
        if d < least:
            least, where = d, k + 1
    fresh_q[n - 1] = d
    return fresh_q, fresh_e, least, where


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal matrix's singular values, falling, by dqds.

    Shifts are bounds from below: the least remainder of the step before is tried, and if only the last remainder becomes
    negative it corrects the shift, else the shift is made smaller; without a shift a step always succeeds. The array is turned
    round where its large end is at the bottom, and cut where a difference is negligible.
    """
    top = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not top:
        return np.zeros(len(diagonal))
    # Scaled so that squares neither overflow nor vanish.
    open_ = [((diagonal / top) ** 2, (upper / top) ** 2, 0.0)]
    found: list[float] = []
    while open_:
        q, e, moved = open_.pop()
        guess, slack = 0.0, 1.0
        while len(q):
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            small = e <= slack * _EPS * _EPS * (moved + np.minimum(q[:-1], q[1:]))
            if small[-1]:
                found.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            if small.any():
                cut = int(np.flatnonzero(small)[-1])
                open_.append((q[: cut + 1], e[:cut], moved))
                q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            shift, wanted = guess, guess
            while True:
                fresh_q, fresh_e, least, where = _qd_step(q, e, shift)
                if least >= 0:
                    break
                bound = shift + least if where == len(q) - 1 else shift / 4
                shift = bound * (1 - 4 * _EPS) if bound > 1e-12 * shift else 0.0
            q, e, moved, guess = fresh_q, fresh_e, moved + shift, max(least, 0.0)
            # Between equal values no shift succeeds and a step without one changes nothing: differences of rounding are dropped.
            slack = 1e4 if wanted and not shift else 1.0
    return np.sort(np.array(found))[::-1] * top * top


def _stationary(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L+ D+ L+' = L D L' - value, from the top: D+, L+ and the remainders before each pivot."""
    n = len(d)
    s, plus, below = np.empty(n), np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        plus[i] = s[i] + d[i]
        if abs(plus[i]) < _TINY:
            plus[i] = -_TINY
        below[i] = d[i] * l[i] / plus[i]
        s[i + 1] = below[i] * l[i] * s[i] - value
    plus[n - 1] = s[n - 1] + d[n - 1]
    return plus, below, s


def _progressive(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U- D- U-' = L D L' - value, from the bottom: D-, U- and the remainders after each pivot."""
    n = len(d)
    p, minus, above = np.empty(n), np.empty(n), np.empty(max(n - 1, 0))
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        minus[i + 1] = d[i] * l[i] * l[i] + p[i + 1]
        if abs(minus[i + 1]) < _TINY:
            minus[i + 1] = -_TINY
        ratio = d[i] / minus[i + 1]
        above[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
    minus[0] = p[0]
    return minus, above, p


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """The right singular vector of a bidiagonal matrix for the square ``value``, by the twist with the least remainder."""
    n = len(diagonal)
    safe = np.where(np.abs(diagonal) < 1e-140, 1e-140, diagonal)
    d, l = safe * safe, upper / safe[:-1]
    _, below, s = _stationary(d, l, value)
    _, above, p = _progressive(d, l, value)
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -below[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -above[i] * z[i]
    return z / np.linalg.norm(z)


def _solve(diagonal: np.ndarray, upper: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """A vector near a solution of (B'B - value) x = b: pivots that vanish are lifted, which is all that inverse iteration needs."""
    n, floor = len(b), max(_EPS * abs(value), _TINY)
    middle, beside = diagonal * diagonal - value, diagonal[:-1] * upper
    middle[1:] += upper * upper
    pivot, x, below = np.empty(n), b.copy(), np.empty(max(n - 1, 0))
    for i in range(n):
        pivot[i] = middle[i] - (below[i - 1] * beside[i - 1] if i else 0.0)
        if abs(pivot[i]) < floor:
            pivot[i] = floor
        if i < n - 1:
            below[i] = beside[i] / pivot[i]
            x[i + 1] -= below[i] * x[i]
    x /= pivot
    for i in range(n - 2, -1, -1):
        x[i] -= below[i] * x[i + 1]
    return x


def directions(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Orthonormal right singular vectors of the first ``count`` squares, as columns."""
    last = count
    while last < len(values) and values[last - 1] - values[last] < 1e-4 * values[last - 1]:
        last += 1
    out: list[np.ndarray] = []
    group = 0
    for k in range(last):
        if k and values[k - 1] - values[k] >= 1e-4 * values[k - 1]:
            group = k
        z = twisted_vector(diagonal, upper, values[k])
        near = out[group:k]
        if near:
            base = np.stack(near, 1)
            for trial in range(8):
                rest = z - base @ (base.T @ z)
                size = np.linalg.norm(rest)
                if size > 0.7:
                    break
                # It repeats a neighbour's direction: step towards what the neighbours leave.
                start = rest / size if size > 1e-3 else np.random.default_rng(k + 31 * trial).standard_normal(len(z))
                start -= base @ (base.T @ start)
                z = _solve(diagonal, upper, values[k], start / np.linalg.norm(start))
                z /= np.linalg.norm(z)
            z = rest - base @ (base.T @ rest)
            z /= np.linalg.norm(z)
        out.append(z)
    return np.stack(out[:count], 1)


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first squared singular values of a triangle, their right singular vectors as columns, and the sum of all the squares."""
    diagonal, upper, v = bidiagonal(r)
    values = squared_singular_values(diagonal, upper)
    total = float(values.sum())
    count = min(count, int((values > 1e-24 * total).sum()))
    if not count:
        return np.zeros(0), np.zeros((r.shape[1], 0)), total
    return values[:count], v @ directions(diagonal, upper, values, count), total


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """(n * x - total) / n, the difference exact before it is divided."""
    if n * LARGEST < 1 << 62 or n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0) < 1 << 62:
        return (n * x - np.array(total, np.int64)) / n
    whole = x.astype(object) * n - np.array(total, object)
    return whole.astype(float) / n


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> dict | None:
    """Count, sums, directions, eigenvalues, trace and identity error of a table of distinct integer vectors ``x``; None without any."""

    def sums(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        n, total = 0, [0] * dims
        for batch in batches:
            n += batch.num_rows
            total = [a + b for a, b in zip(total, matrix(batch.column(0), dims).sum(0).tolist())]
        return " ".join(map(str, [n, *total])).encode() if n else None

    def add(parts: list[bytes]) -> bytes:
        return " ".join(map(str, map(sum, zip(*[map(int, p.split()) for p in parts])))).encode()

    counted = fold(per_task(vectors, sums), add)
    if counted is None:
        return None
    n, *total = map(int, counted.split())

    def reduce(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = _centred(matrix(batch.column(0), dims), n, total)
                r = triangle(rows if r is None else np.concatenate([r, rows]))
        return None if r is None else r.tobytes()

    def stack(parts: list[bytes]) -> bytes:
        return triangle(np.concatenate([np.frombuffer(p).reshape(dims, dims) for p in parts])).tobytes()

    r = np.frombuffer(fold(per_task(vectors, reduce), stack)).reshape(dims, dims)
    values, basis, trace = principal(r, components)
    scale = basis / np.sqrt(values / n)
    k = len(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        state = None
        for batch in batches:
            if batch.num_rows:
                w = _centred(matrix(batch.column(0), dims), n, total) @ scale
                mean = w.mean(0)
                own = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                state = own if state is None else join([state.tobytes(), own.tobytes()], k)
        return None if state is None else state.tobytes()

    spread = np.frombuffer(fold(per_task(vectors, moments), lambda parts: join(parts, k).tobytes()))
    error = float(np.abs(spread[1 + k :].reshape(k, k) / n - np.eye(k)).max(initial=0.0))
    return {"n": n, "total": total, "scale": scale, "basis": basis, "values": values / n, "trace": trace / n, "error": error}


def join(parts: list[bytes], k: int) -> np.ndarray:
    """Counts, means and centred products of several parts as those of the whole."""
    out = None
    for part in parts:
        p = np.frombuffer(part)
        if out is None:
            out = p.copy()
            continue
        apart, n = p[1 : k + 1] - out[1 : k + 1], out[0] + p[0]
        out[k + 1 :] += p[k + 1 :] + np.outer(apart, apart).ravel() * (out[0] * p[0] / n)
        out[1 : k + 1] += apart * (p[0] / n)
        out[0] = n
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` and ``deviation_exact`` of each row and component."""
    spark = embeddings.sparkSession
    small = F.forall("x", lambda v: F.abs(v) < F.lit(LARGEST))
    rows = embeddings.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), integers().alias("x")).where(small)
    rows = store(rows, "integers")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    even = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    model = fit(store(rows.select(even.alias("x")).distinct(), "distinct"), dims, components) if dims else None
    if model is None or not len(model["values"]):
        return spark.createDataFrame([], shape)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, total, k = m["n"], m["total"], len(m["values"])
        most = max(map(abs, total))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dims)
            if dims * (n * int(np.abs(x).max(initial=0)) + most) ** 2 < 1 << 63:
                apart = n * x - np.array(total, np.int64)
                deviation = [int(v) for v in (apart * apart).sum(1)]
            else:
                apart = x.astype(object) * n - np.array(total, object)
                deviation = [int(v) for v in (apart * apart).sum(1)]
            w = _centred(x, n, total) @ m["scale"]
            size = len(x)
            each = np.repeat(np.arange(size), k)
            whole = pa.array([v if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)).take(pa.array(each))
            plain = pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()).take(pa.array(each))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)), plain, pa.array(w.ravel()),
                 pa.array(np.tile(m["values"] / m["trace"], size)), pa.array(np.full(size * k, m["error"])), whole],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return rows.mapInArrow(run, shape)
