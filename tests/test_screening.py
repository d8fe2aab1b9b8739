"""Names, headers, tables of instruments and steps of spectra against known answers and plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrion.functions import text
from spectrion.operators import kernels, ordered, spectra, stats
from spectrion.sources import tables


def one(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_names(spark):
    names = {
        "2,6-Dimethoxyphenol": "syringyl", "Syringic acid": "syringyl", "Vanillin": "guaiacyl", "2-methoxyphenol": "guaiacyl", "Phenol, 4-methyl-": "hydroxyphenyl", "Сахар": "carbohydrate",
        "Hexadecanamide": "nitrogen", "Octadecanoic": "lipid", "Toluene": "other", "": "other", None: "other",
    }
    assert one(spark, names, text.pyrolysis_class) == list(names.values())
    carbonyls = {"Vanillic acid": "guaiacyl_acid", "Acetosyringone": "syringyl_ketone", "vanillin": "guaiacyl_aldehyde", "Homovanillin": None, "isovanillin": None, "Phenol": None, None: None}
    assert one(spark, carbonyls, text.lignin_carbonyl) == list(carbonyls.values())
    headers = {
        "wavelength,absorbance": "UV-Vis", "Temp (°C);Mass %": "TGA", "Wavenumber cm-1\tAbs": "FTIR", "mz,abundance": "FT-ICR MS", "Elution volume,RI": "SEC/GPC", "RT,Area": "Py-GC-MS", "Em/Ex,240,250": "EEM",
        "280,290,300,310,320": "EEM", "Sample,C%,H%,N": "Elemental", "smart,area": "generic", "": "generic", None: "generic",
    }
    assert one(spark, headers, text.header_modality) == list(headers.values())
    files = {"x/Baikal_01_fticr.csv": "FT-ICR MS", "a.JDX": "NMR", "b-uv.txt": "UV-Vis", "massive.csv": None, None: None}
    assert one(spark, files, text.file_modality) == list(files.values())
    assert one(spark, ["CHO C9H10O4", " Na Cl ", None], text.clean_formula) == ["C9H10O4", "NaCl", None]


def test_smoothing_to_the_ends(spark):
    r = np.random.default_rng(1)
    y = r.normal(size=12)
    rows = [("a", i, float(v)) for i, v in enumerate(y)] + [("short", i, 1.0) for i in range(4)]
    points = spark.createDataFrame(rows, "k string, x int, y double")
    for degree, derivative in ((2, 0), (3, 1), (3, 2)):
        got = {(p["k"], p["x"]): p["smooth"] for p in ordered.savgol(points, ["k"], ["x"], "y", 2, derivative, degree, ends=True).collect()}
        for i in range(12):
            centre = min(max(i, 2), 9)
            fit = np.polynomial.Polynomial.fit(np.arange(-2, 3), y[centre - 2 : centre + 3], degree, domain=[-1, 1])
            assert got["a", i] == pytest.approx((fit.deriv(derivative) if derivative else fit)(i - centre), abs=1e-9)
        assert all(got["short", i] is None for i in range(4))


def test_polynomial_baseline(spark):
    x = np.linspace(1000, 1800, 200)
    true = 1e-5 * (x - 1300) ** 2 + 3
    y = true + 20 * np.exp(-(((x - 1350) / 20) ** 2))
    lower = y.copy()
    for _ in range(100):
        base = np.polyval(np.polyfit((x - x.mean()) / 800, lower, 3), (x - x.mean()) / 800)
        lower = np.minimum(lower, base)
    assert np.allclose(kernels.polynomial_baseline(x, y), base, atol=1e-5)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("b", 1.0, 5.0), ("b", 2.0, None)]
    got = kernels.fitted_baseline(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").orderBy("k", "x").collect()
    assert np.allclose([r["baseline"] for r in got[:200]], base, atol=1e-5)
    assert [tuple(r) for r in got[200:]] == [("b", 1.0, 5.0, 5.0)]


def test_shift_references(spark):
    def spectrum(key, peak, height=100.0):
        return [(key, 30 + i * 0.1, 1.0 + (height if abs(30 + i * 0.1 - peak) < 0.01 else 0.0)) for i in range(200)]

    rows = spectrum("moved", 39.0) + spectrum("edge", 38.0) + spectrum("far", 35.0) + spectrum("weak", 39.0, 0.01) + [("weak", 10.0, 500.0), ("one", 39.0, 1.0)]
    got = {r["k"]: r["m"] for r in spectra.recalibrated_shifts(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", "dmso").groupBy("k").agg(F.max("shift_by").alias("m")).collect()}
    assert got["moved"] == pytest.approx(0.5)
    assert {k: v for k, v in got.items() if k != "moved"} == {"edge": 0.0, "far": 0.0, "weak": 0.0, "one": 0.0}


def test_correlations_of_joint_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5)) + 1e6
    x[:, 1] += x[:, 0] * 2
    x[:, 4] = 7.3
    rows = [[None if r.random() < 0.2 else float(v) for v in row] for row in x]
    rows[3][0] = math.nan
    names = ["a", "b.c", "d", "e", "flat"]
    got = {(p["f1"], p["f2"]): (p["n"], p["r"]) for p in stats.correlations(spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(3), names).collect()}
    assert len(got) == 10
    for i in range(5):
        for j in range(i + 1, 5):
            both = [(a[i], a[j]) for a in rows if all(v is not None and v == v for v in (a[i], a[j]))]
            n, value = got[names[i], names[j]]
            assert n == len(both)
            assert value is None if j == 4 else value == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)
    assert stats.correlations(spark.createDataFrame([], "a double, b double"), ["a", "b"]).where("r IS NOT NULL").count() == 0


def test_exact_p(spark):
    p = one(spark, [0.5, -0.5, 1.0, None], lambda v: kernels.correlation_p(v, F.lit(6)), "double")
    t = 0.5 * math.sqrt(4 / 0.75)  # four degrees of freedom have a closed form
    tail = 1 - (t / math.sqrt(4 + t * t)) * (1 + 0.5 * 4 / (4 + t * t))
    assert p[0] == p[1] == pytest.approx(tail) and p[2] == 0 and p[3] is None


def test_tables_of_instruments(spark):
    sec = spark.createDataFrame([("s", "1", "9", "2.5"), ("s", "2", "9", "x"), (None, "3", "9", None)], ["Sample", "Volume mL", "UV corrected", "UV raw"])
    assert [tuple(r) for r in tables.chromatogram(sec, ["Sample"]).collect()] == [("s", 1.0, 2.5)]
    timed = spark.createDataFrame([("4", "1")], ["Time", "RI"])
    assert [tuple(r) for r in tables.chromatogram(timed, [], 0.5).collect()] == [(2.0, 1.0)]
    tga = spark.createDataFrame([("a", "30", "20"), ("a", "100", "10"), ("b", "30", "99"), ("b", "90", "80"), ("c", "60", "8"), ("c", "70", "4"), ("d", "30", "0"), ("d", "40", "n")], ["id", "Temperature", "Weight (mg)"])
    got = {(r["id"], r["temperature"]): r["mass"] for r in tables.thermogram(tga, ["id"]).collect()}
    assert got == {("a", 30.0): 100.0, ("a", 100.0): 50.0, ("b", 30.0): 99.0, ("b", 90.0): 80.0, ("c", 60.0): 100.0, ("c", 70.0): 50.0, ("d", 30.0): 0.0}
    py = spark.createDataFrame([("1.5", "-3", "Vanillin"), ("2", "4", " "), ("x", "1", "Phenol")], ["RT", "Peak area", "Name"])
    assert sorted(tuple(r) for r in tables.pyrogram(py, []).collect()) == [(1.5, 0.0, "Vanillin", "guaiacyl"), (2.0, 4.0, None, None)]
