"""Rasters measured in strips equal whole-page values, whatever the size of page and strip."""

import numpy as np
import pytest

from quire.operators import quality as Q

IMAGE = "image struct<origin string, height int, width int, nChannels int, mode int, data binary>"
SIZES = [(1, 1), (1, 7), (7, 1), (2, 2), (3, 5), (5, 3), (64, 64), (31, 33), (97, 12), (200, 1)]


def gray(pixels):
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(int)
    b, g, r = (pixels[:, :, i].astype(int) for i in range(3))
    return (b * 3735 + g * 19235 + r * 9798 + (1 << 14)) >> 15


def mirrored(plane, by):
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (by, by)
        plane = np.pad(plane, width, mode="reflect" if plane.shape[axis] > 1 else "edge")
    return plane


def whole_page(pixels):
    g = gray(pixels)
    p, q = mirrored(g, 1), mirrored(g, 2)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    weights = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
    blur = sum(weights[i, j] * q[i : i + g.shape[0], j : j + g.shape[1]] for i in range(5) for j in range(5))
    rest = g - ((blur + 128) >> 8)
    return [g.mean(), g.std(), lap.var(), rest.std(), (g > 230).mean(), (g < 100).mean()]


def row(pixels):
    h, w, c = pixels.shape
    return ("", h, w, c, 0, pixels.tobytes())


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(11)
    return [rng.integers(0, 256, (h, w, c)).astype(np.uint8) for h, w in SIZES for c in (1, 3, 4)]


@pytest.mark.parametrize("strip, spread", [(1, False), (50, True), (64 * 7, False), (1 << 20, True)])
def test_strips_equal_whole_pages(spark, monkeypatch, pages, strip, spread):
    monkeypatch.setattr(Q, "STRIP_PIXELS", strip)
    df = spark.createDataFrame([(i, row(p)) for i, p in enumerate(pages)], f"k int, {IMAGE}")
    got = {r.k: r for r in Q.raster_stats(df, ["k"], spread=spread).collect()}
    assert len(got) == len(pages)
    for i, p in enumerate(pages):
        r = got[i]
        have = [r.mean_gray, r.std_gray, r.laplacian_variance, r.noise_std, r.paper_share, r.ink_share]
        assert np.allclose(have, whole_page(p), rtol=1e-10, atol=1e-9), p.shape
        assert (r.height_px, r.width_px) == p.shape[:2]
        assert np.allclose(r.histogram, np.bincount(gray(p).ravel() >> 4, minlength=16) / gray(p).size, atol=1e-6)


def test_a_large_page_is_many_rows(spark, monkeypatch):
    """Its strips lie in several tasks, and none holds more than a strip and its border."""
    monkeypatch.setattr(Q, "STRIP_PIXELS", 1000)
    page = np.random.default_rng(3).integers(0, 256, (900, 100, 1)).astype(np.uint8)
    df = spark.createDataFrame([(1, row(page))], f"k int, {IMAGE}")
    strips = Q._strips(df, ["k"], "image", border=2).collect()
    assert len(strips) == 90 and max(len(s["__data"]) for s in strips) == 1400
    plan = Q.raster_stats(df, ["k"], spread=True)._jdf.queryExecution().toString()
    assert "__strip" in plan and "REPARTITION_BY_COL" in plan
    assert "REPARTITION_BY_COL" not in Q.raster_stats(df, ["k"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("strip", [7, 1 << 20])
def test_report_of_pages_in_strips(spark, monkeypatch, pages, strip):
    monkeypatch.setattr(Q, "STRIP_PIXELS", strip)
    rng = np.random.default_rng(12)
    other = [np.where(rng.random(p.shape) < 0.3, 255 - p, p).astype(np.uint8) for p in pages]
    unread = ("", -1, -1, -1, -1, b"")
    extra = [(100, row(pages[0]), row(pages[9])), (101, unread, row(pages[9])), (102, unread, unread), (103, None, row(pages[9])),
             (104, row(pages[-1]), row(pages[-1][:100]))]
    rows = [(i, row(a), row(b)) for i, (a, b) in enumerate(zip(pages, other))] + extra
    before, after = (spark.createDataFrame([(r[0], r[i]) for r in rows], f"k int, {IMAGE}") for i in (1, 2))
    got = {r.k: r for r in Q.enhancement_report(before, after, ["k"]).collect()}
    assert len(got) == len(rows)
    for i, (a, b) in enumerate(zip(pages, other)):
        x, y, r = gray(a), gray(b), got[i]
        d = y - x
        want = [(d != 0).mean(), d[x >= 230].mean() if (x >= 230).any() else 0, d[x < 100].mean() if (x < 100).any() else 0, d.mean()]
        assert np.allclose([r.pct_pixels_changed, r.paper_lift, r.ink_deepen, r.mean_shift], want, atol=0.00501)
        assert np.allclose(r.hist_after, np.bincount(y.ravel() >> 4, minlength=16) / y.size, atol=1e-6)
    for k in range(100, 105):
        assert set(got[k].asDict().values()) == {k, None}


def test_sums_stay_exact(spark):
    """Half black, half white: the largest squares; the variance is exact."""
    page = np.zeros((3000, 2000, 1), np.uint8)
    page[::2] = 255
    df = spark.createDataFrame([(1, row(page))], f"k int, {IMAGE}")
    r = Q.raster_stats(df, ["k"]).first()
    assert r.mean_gray == 127.5 and r.std_gray == 127.5 and r.paper_share == r.ink_share == 0.5
    assert r.laplacian_variance == 510.0**2
