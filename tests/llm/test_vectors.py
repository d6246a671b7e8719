"""Hard negatives and whitening against brute force, on tables with nulls, ties, repeats, ragged and empty vectors and clashing columns."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x int, rank int, window string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "r", 1, 2, "w", 3) for i, v, y in rows], SCHEMA).repartition(3)


def some(seed: int, n: int, dims: int, coarse: float):
    """Random rows; a coarse grid makes many ties."""
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(round(x / coarse) * coarse)) for x in rng.standard_normal(dims)], int(rng.integers(0, 4))) for i in range(n)]


ODD = [
    (None, [0.5, 0.5, 0.5], 1), (1000, None, 1), (1001, [], 2), (1002, [0.5, None, 0.1], 1), (1003, [float("nan"), 0.1, 0.1], 1), (1004, [float("inf"), 0.1, 0.1], 1),
    (1005, [0.25, 0.5, 0.75], None), (1006, [1.0], 0), (1100, [1.0, 1.0, 1.0], 1), (1100, [1.0, 1.0, 1.0], 1), (1200, [0.0, 0.0, 0.0], 2), (1300, [-1.0, -1.0, -1.0], 3),
]


def clean(rows):
    return [(i, [math.floor(256 * float(c)) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute_negatives(rows):
    use = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y, k) for k, (i, v, y) in enumerate(clean(rows)) if y is not None]
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    for i, v, y, k in use:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, z) for j, w, z, m in use]
        positive = sorted((s for s in scored if s[3] == y and s[2] != k), key=order)[:5]
        for p in positive:
            fit = sorted((s for s in scored if s[3] != y and 30 * p[0] <= 100 * s[0] <= 90 * p[0]), key=order)[:10]
            out += [(i, p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("dims", "coarse", "block"), [(3, 0.25, 16), (3, 0.5, 4096), (8, 0.01, 32)])
def test_hard_negatives(spark, monkeypatch, dims, coarse, block):
    from quire.llm import hard_negatives

    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", 2)
    rows = some(dims, 420, dims, coarse) + (ODD if dims == 3 else [])
    got = sorted((tuple(r) for r in hard_negatives.mine(table(spark, rows)).collect()), key=repr)
    want = brute_negatives(rows)
    assert len(want) > 30 and got == want


def test_hard_negatives_of_nothing(spark):
    from quire.llm.hard_negatives import mine

    assert mine(table(spark, [(5, [1.0], 1)]).where("vec_id > 5")).count() == 0
    assert mine(table(spark, [(100, [1.0], 1)])).count() == 0
    assert mine(table(spark, [(100, [], 1), (101, [], 1), (102, [], 2)])).count() == 1


def test_the_walk_stops_before_it_has_seen_all_rows():
    from quire.llm.hard_negatives import Block, Windowed, walk

    rng = np.random.default_rng(3)
    x = (rng.standard_normal((4000, 2)) * 256).astype(np.int64)
    block = Block(x, np.zeros(4000, np.int64), np.arange(4000), np.arange(4000))
    window = Windowed(-(1 << 62), 1 << 62, 5)
    scored = walk(block, np.array([40, -30]), np.ones(4000, bool), [window])
    every = x @ np.array([40, -30])
    assert scored < 1500 and window.row.tolist() == np.lexsort((np.arange(4000), -every))[:5].tolist()


def test_long_scores_are_exact():
    from quire.llm.hard_negatives import Block

    x = np.array([[1 << 30, 3], [(1 << 30) + 1, -1]], np.int64)
    scores = Block(x, np.zeros(2, np.int64), np.arange(2), np.arange(2)).scores(np.arange(2), np.array([(1 << 30) - 1, 1]))
    assert scores.tolist() == [(1 << 30) * ((1 << 30) - 1) + 3, ((1 << 30) + 1) * ((1 << 30) - 1) - 1]


def brute_whitening(rows):
    use = clean(rows)
    dims = max(len(v) for _, v, _ in use)
    x = np.array([v + [0] * (dims - len(v)) for _, v, _ in use], np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = (n * fit - total) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _, _ in use], n, ((n * x - total) ** 2).sum(1), (n * x - total) / n, e[::-1], u[:, ::-1]


def test_whitening(spark, monkeypatch):
    from quire.llm import vectors
    from quire.llm.whitening import whiten

    monkeypatch.setattr(vectors, "FAN", 2)
    rows = some(9, 300, 3, 0.01) + some(9, 40, 3, 0.01) + ODD
    got = [r.asDict() for r in whiten(table(spark, rows)).collect()]
    ids, n, deviation, centred, e, u = brute_whitening(rows)
    assert len(got) == 3 * len(ids) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["component"], r["deviation"]), []).append(r)
    for k in range(3):
        own = centred @ u[:, k] / np.sqrt(e[k])
        mine = sorted((r["deviation"], r["vec_id"] or -1, r["whitened"]) for r in got if r["component"] == k + 1)
        for sign in (1, -1):
            want = sorted((int(d), i or -1, sign * w) for d, i, w in zip(deviation, ids, own))
            if [m[:2] for m in mine] == [w[:2] for w in want] and np.allclose([m[2] for m in mine], [w[2] for w in want], rtol=0, atol=1e-9):
                break
        else:
            raise AssertionError(k)
    for r in got:
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12 and r["identity_error"] < 1e-10 and int(r["deviation_exact"]) == r["deviation"]


def test_whitening_without_variance(spark):
    from quire.llm.whitening import whiten

    assert whiten(table(spark, [(1, [1.0], 1)]).where("vec_id > 1")).count() == 0
    assert whiten(table(spark, [(1, [0.5, 0.5], 1)] * 4)).count() == 0
    assert whiten(table(spark, [(1, [], 1), (2, None, 1)])).count() == 0
    line = [(i, [i / 256, 2 * i / 256, 0.0], 0) for i in range(5)]
    got = whiten(table(spark, line)).orderBy("vec_id").collect()
    assert [r["component"] for r in got] == [1] * 5 and np.allclose(np.abs([r["whitened"] for r in got]), np.abs(np.arange(5) - 2) / np.sqrt(2))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 24), st.sampled_from(["plain", "graded", "equal", "low rank", "zero"]))
def test_singular_values_and_vectors(seed, n, kind):
    from quire.llm.whitening import bidiagonal, principal, squared_singular_values, triangle

    rng = np.random.default_rng(seed)
    a = rng.standard_normal((2 * n, n))
    if kind == "graded":
        a = a * 10.0 ** rng.integers(-6, 3, n)
    elif kind == "equal":
        a = np.linalg.qr(a)[0] * 3
    elif kind == "low rank":
        a[:, n // 2 :] = a[:, : n - n // 2] * 2
    elif kind == "zero":
        a[:] = 0
    r = triangle(a)
    d, u, v = bidiagonal(r)
    true = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-13)
    assert np.allclose(squared_singular_values(d, u), true, rtol=1e-7, atol=1e-12 * max(true[0], 1e-300))
    values, vectors, total = principal(r, 4)
    assert np.isclose(total, true.sum()) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.allclose(a.T @ (a @ vectors), vectors * values, atol=1e-12 * max(true[0], 1e-300))


def test_equal_singular_values_end():
    from quire.llm.whitening import squared_singular_values

    diagonal, upper = np.array([-3.0, 3.0, -3.0]), np.array([7.02166694e-16, 2.22044605e-15])
    assert np.allclose(squared_singular_values(diagonal, upper), 9, rtol=1e-14)


def test_dqds_keeps_small_values_accurate():
    from quire.llm.whitening import squared_singular_values

    # A bidiagonal matrix whose entries span many orders; its values are known to full precision from rational arithmetic.
    from fractions import Fraction

    diagonal, upper = np.array([1.0, 1e-4, 1e-8]), np.array([1.0, 1e-4])
    got = squared_singular_values(diagonal, upper)
    a = [[Fraction(float(diagonal[i])) if i == j else Fraction(float(upper[i])) if j == i + 1 else Fraction(0) for j in range(3)] for i in range(3)]
    t = [[sum(a[k][i] * a[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    trace = float(t[0][0] + t[1][1] + t[2][2])
    product = float(Fraction(float(diagonal.prod())) ** 2)
    assert abs(got.sum() / trace - 1) < 1e-14 and abs(got.prod() / product - 1) < 1e-11
