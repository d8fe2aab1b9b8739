"""Hulls, peaks, grid fills, polynomials by key and containment against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrion.operators import containment, grids, polynomials, shapes, stats


def brute_hull(x, y):
    """Highest line under all points at each x, over every two points."""
    out = np.array(y, float)
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            line = y[i] + (y[j] - y[i]) * (x - x[i]) / (x[j] - x[i])
            if (line <= y + 1e-9).all():
                inside = (x >= x[i]) & (x <= x[j])
                out[inside] = np.minimum(out[inside], np.maximum(line[inside], -np.inf))
    return out


def test_hull(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 25, 40):
        x = np.sort(rng.choice(200, n, replace=False)).astype(float)
        y = rng.integers(0, 9, n).astype(float)
        at = shapes.lower_hull(x, y)
        assert np.allclose(np.interp(x, x[at], y[at]), brute_hull(x, y))
    rows = [("a", float(i), float(abs(i - 5)) + 2) for i in range(11)] + [("b", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 4.0, 5.0), ("c", 1.0, 7.0), ("a", None, 1.0)]
    got = shapes.hull_baseline(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()
    assert len(got) == 15 and all(abs(r.y - r.baseline) < 1e-9 for r in got if r.k == "a")
    assert sorted((r.x, r.y, r.baseline) for r in got if r.k == "b") == [(1, 2, 2), (1, 3, 2), (4, 5, 5)]
    began = time.time()
    shapes.lower_hull(np.arange(1e6), np.sin(np.arange(1e6) / 1e5) * 1e6)
    assert time.time() - began < 10


def brute_peaks(y, prominence, share=0.5):
    out = []
    i = 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
            p = (i + j) // 2
            ends = []
            for step in (-1, 1):
                low, k, base = y[p], p, p
                while 0 <= k < len(y) and y[k] <= y[p]:
                    if y[k] < low:
                        low, base = y[k], k
                    k += step
                ends.append((low, base))
            stands = y[p] - max(ends[0][0], ends[1][0])
            if stands >= prominence:
                height, cross = y[p] - share * stands, []
                for step, (_, base) in zip((-1, 1), ends):
                    k = p
                    while k != base and height < y[k]:
                        k += step
                    cross.append(k - step * (height - y[k]) / (y[k - step] - y[k]) if y[k] < height else k)
                out.append((p, stands, ends[0][0], ends[1][0], cross[1] - cross[0]))
        i = j + 1
    return out


def test_peaks_by_brute_force():
    rng = np.random.default_rng(7)
    for n in [0, 1, 2, 3, *rng.integers(4, 60, 300)]:
        y = rng.integers(0, 6, n).astype(float) if n % 2 else np.round(rng.normal(size=n), 1)
        for least in (0.0, 1.0, 2.5):
            p = shapes.peaks(y, least)
            got = list(zip(p.at.tolist(), p.prominence, y[p.left_base] if n else [], y[p.right_base] if n else [], p.width))
            assert np.allclose(np.array(got, float).reshape(-1, 5), np.array(brute_peaks(y, least), float).reshape(-1, 5)), (y, least)


def test_a_million_points_take_seconds():
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=1_000_000))
    began = time.time()
    found = shapes.peaks(y, 5.0, distance=20)
    assert len(found.at) > 100 and time.time() - began < 30
    began = time.time()
    shapes.peaks(np.concatenate([np.arange(500_000.0), np.arange(500_000.0)[::-1]]) + np.tile([0, 0.5], 500_000))
    assert time.time() - began < 30


def test_peak_tables(spark):
    x = np.linspace(0, 30, 3001)
    y = 50 + sum(h * np.exp(-0.5 * ((x - c) / w) ** 2) for h, c, w in ((30, 8, 0.05), (12, 20, 0.08)))
    rng = np.random.default_rng(5)
    noisy = y + rng.normal(size=len(x)) * 0.05
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, noisy)] + [("few", 1.0, 2.0)], "k string, t double, i double")
    got = sorted(((r.retention, r.area, r.height) for r in shapes.tic_peaks(df, ["k"], "t", "i", sigmas=8).collect()), key=lambda r: -r[2])[:2]
    for (t, area, height), (h, c, w) in zip(got, ((30, 8, 0.05), (12, 20, 0.08))):
        assert t == pytest.approx(c, abs=0.03) and height == pytest.approx(h, rel=0.03) and area == pytest.approx(h * w * np.sqrt(2 * np.pi), rel=0.05)
    table = shapes.peak_table(df, ["k"], "t", "i", 5.0).orderBy("t").collect()
    assert [round(r.t) for r in table] == [8, 20] and table[0].left_base < 8 < table[0].right_base and table[0].width == pytest.approx(0.05 * 2.355 / 0.01, rel=0.1)
    close = shapes.peaks(np.array([0, 5, 0, 6, 0, 4, 0, 0, 6, 0.0]), distance=3)
    assert close.at.tolist() == [3, 8]


def test_triangles_hold_no_corner():
    rng = np.random.default_rng(2)
    for points in (rng.random((60, 2)) * 100, np.array([(i, j) for i in range(7) for j in range(6)], float), np.array([(240 + 10 * i, 280 + 5 * j) for i in range(9) for j in range(12) if abs(i - j) > 1], float)):
        tri = grids.triangles(points)
        a, b, c = (points[tri[:, k]] for k in range(3))
        area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])).sum() / 2
        centre, square = grids._circles(points, tri)
        for m, s in zip(centre, square):
            assert (((points - m) ** 2).sum(axis=1) > s * (1 - 1e-6)).all()
        hull = points[np.lexsort((points[:, 1], points[:, 0]))]
        lower, upper = shapes.lower_hull(*_by_x(hull, 1)), shapes.lower_hull(*_by_x(hull, -1))
        ux, lo = _by_x(hull, 1)
        _, hi = _by_x(hull, -1)
        span = np.trapezoid(-hi[upper], ux[upper]) - np.trapezoid(lo[lower], ux[lower])
        assert area == pytest.approx(span, rel=1e-6)
    assert len(grids.triangles(np.array([(0, 0), (1, 1), (2, 2), (3, 3)], float))) == 0


def _by_x(points, sign):
    xs = np.unique(points[:, 0])
    return xs, np.array([(sign * points[points[:, 0] == x, 1]).min() for x in xs])


def test_gaps_take_planes(spark):
    em, ex = np.arange(300.0, 500, 10), np.arange(240.0, 400, 15)
    plane = lambda e, x: 5 + 0.3 * e - 0.2 * x
    rows = []
    for k, shift in (("a", 0.0), ("b", 40.0)):
        rows += [(k, float(e), float(x), float(plane(e, x) + shift), bool(abs(e - x - 60) < 25 or abs(e - 1.2 * x) < 9)) for e in em for x in ex]
    rows = [r if i % 37 else (*r[:3], None, r[4]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, em double, ex double, v double, gap boolean")
    got = grids.fill_gaps(df, ["k"], "em", "ex", "v", "gap").collect()
    corners = {(e, x) for e in (em[0], em[-1]) for x in (ex[0], ex[-1])}
    assert len(got) == len(rows) and sum(r.gap for r in got) > 60
    for r in got:
        if not r.gap or r.v and (r.em, r.ex) not in corners:
            assert r.v == pytest.approx(plane(r.em, r.ex) + (40 if r.k == "b" else 0)), r
    lone = spark.createDataFrame([("a", 1.0, 1.0, 3.0, False), ("a", 2.0, 2.0, 4.0, True)], df.schema)
    assert sorted((r.em, r.ex, r.v, r.gap) for r in grids.fill_gaps(lone, ["k"], "em", "ex", "v", "gap").collect()) == [(1, 1, 3, False), (1, 2, 0, True), (2, 1, 0, True), (2, 2, 0, True)]


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_polynomials_by_key(spark, degree):
    rng = np.random.default_rng(degree)
    data, rows = {}, []
    for k in "abc":
        x = rng.uniform(5, 11, 30) + (5000 if k == "c" else 0)
        y = 12.8 - 2.5 * (x % 4000) + 0.28 * (x % 100) ** 2 + rng.normal(size=30) * 0.1
        data[k] = x, y
        rows += [(k, float(p), float(q)) for p, q in zip(x, y)]
    df = spark.createDataFrame([*rows, ("few", 1.0, 2.0), ("none", None, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in polynomials.fitted(df, ["k"], "x", "y", degree).withColumns({**polynomials.plain_coefficients(degree), "at": polynomials.value_at((F.col("low") + F.col("high")) / 2, degree)}).collect()}
    for k, (x, y) in data.items():
        mid = (x.min() + x.max()) / 2
        u = x - x.mean()
        c = np.polyfit(u, y, degree)
        assert got[k]["at"] == pytest.approx(np.polyval(c, mid - x.mean()), rel=1e-7)
        assert got[k].r2 == pytest.approx(1 - ((y - np.polyval(c, u)) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-6)
        if k != "c":
            assert np.allclose([got[k][f"a{i}"] for i in range(degree + 1)], np.polyfit(x, y, degree)[::-1], rtol=1e-5)
    assert got["few"].c0 is None and "none" not in got


def test_calibration_holds_within_its_range(spark):
    standards = spark.createDataFrame([("a", 100.0 + 10 * i + 1e-3 * (i - 4) ** 2, 100.0 + 10 * i) for i in range(9)], "k string, found double, known double")
    points = spark.createDataFrame([("a", 130.001), ("a", 99.0), ("b", 130.0)], "k string, x double")
    got = {(r.k, r.x): r.calibrated for r in polynomials.calibrated(points, standards, ["k"], "x", "known", "found", 2).collect()}
    assert got["a", 130.001] == pytest.approx(130.0, abs=1e-4) and got["a", 99.0] is None and got["b", 130.0] is None
    sec = spark.createDataFrame([("s", float(v), float(12.849 - 2.5447 * v + 0.27938 * v**2 - 0.0121366 * v**3)) for v in np.arange(5.85, 10.3, 0.4)] + [("w", float(v), float((v - 5) ** 2)) for v in range(11)], "k string, v double, m double")
    fall = lambda d: {r.k: r.f for r in polynomials.fitted(sec, ["k"], "v", "m", d).select("k", polynomials.falling(d).alias("f")).collect()}
    assert fall(3) == {"s": True, "w": False} and fall(2) == {"s": True, "w": False}


def test_containment_equals_a_cross_join(spark):
    pick = random.Random(3)
    made = lambda n: ["".join(pick.choice("abAB-é ") for _ in range(pick.randrange(0, 9))) for _ in range(n)] + [None, "", "x", "Straße"]
    left, right = made(700), made(700) + ["die straße 5"]
    a, b = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    got = {(x.l, x.r) for x in containment.containing(a, b, "l", "r").collect()}
    form = lambda s: (s or "").strip(" ").lower()
    expected = {(x, y) for x in left for y in right if form(x) and form(y) and (form(x) in form(y) or form(y) in form(x))}
    assert got == expected and len(got) > 500


# Quantiles of F at 0.95 with three degrees of freedom above, from published tables
F3 = {2: 19.164, 5: 5.4095, 10: 3.7083, 27: 2.9604, 60: 2.7581, 120: 2.6802}


def test_ellipsoid_radii(spark):
    rng = np.random.default_rng(1)
    data = {n + 3: rng.normal(size=(n + 3, 3)) * [1, 2, 3] for n in F3}
    rows = [(n, *map(float, r)) for n, m in data.items() for r in m] + [(4, 1.0, 2.0, 3.0)] * 4 + [(5, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    got = {r.k: r for r in stats.hotelling_ellipsoid(df, ["k"], ["a", "b", "c"]).collect()}
    for n, m in data.items():
        if n - 3 in F3 and n != 5:
            scale = np.sqrt(3 * (n - 1) / (n - 3) * F3[n - 3])
            assert [got[n][f"radius_{x}"] for x in "abc"] == pytest.approx(m.std(axis=0, ddof=1) * scale, rel=1e-4)
            assert [got[n][f"centre_{x}"] for x in "abc"] == pytest.approx(m.mean(axis=0))
    assert got[4].radius_a is None and got[4].n == 4


def test_false_discovery_in_pieces(spark):
    rng = np.random.default_rng(2)
    rows = [(f, i, float(p)) for f, n in ((0, 700), (1, 3), (2, 90)) for i, p in enumerate(np.where(rng.random(n) < 0.3, rng.random(n) ** 6, np.round(rng.random(n), 2)))] + [(1, 99, None)]
    df = spark.createDataFrame(rows, "f int, i int, p double")
    got = {(r.f, r.i): r.q for r in stats.benjamini_hochberg(df, ["f"], "p", "i", pieces=7).collect()}
    for f in range(3):
        mine = sorted((p, i) for g, i, p in rows if g == f and p is not None)
        q = 1.0
        for k in range(len(mine), 0, -1):
            q = min(q, mine[k - 1][0] * len(mine) / k)
            assert got[f, mine[k - 1][1]] == pytest.approx(q)
    assert got[1, 99] is None and len(got) == len(rows)


def test_correlations_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7)) @ rng.normal(size=(7, 7))
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(7)))
    whole = {(r.f1, r.f2): (r.n, r.r) for r in stats.correlations(df, df.columns).collect()}
    cut = {(r.f1, r.f2): (r.n, r.r) for r in stats.correlations(df, df.columns, side=3).collect()}
    assert whole.keys() == cut.keys() and len(cut) == 21
    for k, (n, r) in cut.items():
        assert whole[k][0] == n and whole[k][1] == pytest.approx(r)
        i, j = int(k[0][1]), int(k[1][1])
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])
