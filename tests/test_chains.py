"""Alignment by runs and whole chains of an instrument's signals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrion.operators import chains, kernels, ordered, spectra


def greedy(ma, mb, ppm):
    used, out = set(), []
    for m in sorted(ma):
        free = [j for j, v in enumerate(sorted(mb)) if j not in used and m - m * ppm * 1e-6 <= v <= m + m * ppm * 1e-6]
        if free:
            j = min(free, key=lambda i: (abs(sorted(mb)[i] - m), i))
            used.add(j)
            out.append((m, sorted(mb)[j]))
    return out


def test_alignment_by_runs(spark, monkeypatch):
    monkeypatch.setattr(kernels, "CELLS", 8)
    pick = random.Random(2)
    rows = {k: [[round(100 * (1 + 2e-4 * pick.randrange(n)) + pick.random() * 0.004, 5) for _ in range(60)] for _ in (0, 1)] for k, n in (("dense", 12), ("thin", 4000), ("mid", 90))}
    frame = lambda i: spark.createDataFrame([(k, m) for k, v in rows.items() for m in v[i]] + [("dense", None), ("thin", -1.0)], "k string, m double")
    for ppm in (30.0, 200.0):
        got = sorted(map(tuple, kernels.aligned(frame(0), frame(1), ["k"], "m", ppm).collect()))
        assert got == sorted((k, *p) for k, (a, b) in rows.items() for p in greedy(a, b, ppm)) + ([] if ppm else [])
    numbered = kernels.runs(frame(0).unionByName(frame(1)).where("m > 0"), ["k"], "m", 30.0).collect()
    for k in rows:
        mine = sorted((r.m, r._run) for r in numbered if r.k == k)
        for (m, a), (n, b) in zip(mine, mine[1:]):
            assert a == b or (n - m) / n > 30e-6
            assert a <= b


def spectrum(spark, keys=("a", "b")):
    x = np.linspace(400, 4000, 721)
    rows = []
    for i, k in enumerate(keys):
        y = 0.5 + i * 0.2 + 1e-4 * x + sum(h * np.exp(-0.5 * ((x - c) / 12) ** 2) for c, h in ((1605, 0.8), (2920, 0.4 + 0.2 * i), (1510, 0.5)))
        rows += [(k, float(p), float(q)) for p, q in zip(x, y)]
    return spark.createDataFrame(rows, "k string, x double, y double")


@pytest.mark.parametrize("method", ["als", "hull", "rubberband", "linear", "none"])
def test_infrared_chain(spark, method):
    points = spectrum(spark)
    got = {r.k: r for r in chains.infrared(points, ["k"], "x", "y", method).collect()}
    assert got.keys() == {"a", "b"}
    for i, k in enumerate("ab"):
        if method == "none":
            assert got[k].i1600 == pytest.approx(0.5 + i * 0.2 + 0.1605 + 0.8, abs=0.02)
        else:
            assert got[k].i1600 == pytest.approx(0.8, abs=0.05) and got[k].i2920 == pytest.approx(0.4 + 0.2 * i, abs=0.05)
    with pytest.raises(ValueError, match="no baseline"):
        chains.corrected(points, ["k"], "x", "y", "other")


def test_resonance_chain_and_drawn_spectra(spark):
    x = np.linspace(-10, 220, 1151)
    peak = lambda c, h: h * np.exp(-0.5 * ((x - c) / 1.2) ** 2)
    y = 1 + peak(40.1, 30) + peak(130, 10) + peak(75, 20)
    points = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "k string, x double, y double")
    plain = chains.carbon_resonance(points, ["k"], "x", "y", "hull").first()
    direct = spectra.nmr_descriptors(points.withColumn("y", F.col("y") - 1.0), ["k"], "x", "y").first()
    assert plain.aromatic == pytest.approx(direct.aromatic, rel=1e-3) and plain.o_alkyl == pytest.approx(direct.o_alkyl, rel=1e-3)
    moved = chains.carbon_resonance(points, ["k"], "x", "y", "hull", "dmso").first()
    assert moved.alkyl == pytest.approx(plain.alkyl, rel=1e-2)
    drawn = chains.shown(points, ["k"], "x", "y", "hull").orderBy("x").toPandas()
    scaled = (y - 1 - (y - 1).mean()) / (y - 1).std()
    assert len(drawn) == len(x) and np.abs(drawn.y.to_numpy() - scaled).max() < 0.5
    assert chains.wavelengths(points, "x", 0, 100).agg(F.min("x"), F.max("x")).first() == (pytest.approx(0, abs=0.2), pytest.approx(100, abs=0.2))
    assert ordered.savgol_weights(2)
