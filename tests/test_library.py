"""Operators on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrion.functions import chem, text
from spectrion.operators import assign, fusion, kernels, models, ordered, ranges, relational, stats
from spectrion.streaming import windows


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("x")).first()["x"]


def test_formula_assignment(spark):
    masses = [(1, 168.0422587 - 1.00727646), (2, 180.0422587 - 1.00727646), (3, 300.12345)]
    peaks = spark.createDataFrame(masses, "id long, mass double")
    bounds = {"C": (4, 15), "H": (4, 25), "O": (1, 10), "N": (0, 0), "S": (0, 0)}
    got = {r["id"]: r for r in assign.assigned(peaks, "id", "mass", bounds).collect()}
    assert got[1]["formula"] == "C8H8O4" and got[2]["formula"] == "C9H8O4" and all(abs(r["error_ppm"]) <= 2 for r in got.values())


def test_candidates_obey_rules(spark):
    rows = assign.candidates(spark, {"C": (4, 8), "H": (1, 20), "O": (1, 6), "N": (0, 2), "S": (0, 1)}).collect()
    expected = {
        (c, h, o, n, s)
        for c in range(4, 9) for h in range(1, 21) for o in range(1, 7) for n in range(3) for s in range(2)
        if 0.2 * c <= h <= 2.5 * c and o <= 1.2 * c and (h + n) % 2 == 0 and (d := 1 + c - h / 2 + n / 2) >= 0 and -10 <= d - o <= 10
    }
    assert {(r["c"], r["h"], r["o"], r["n"], r["s"]) for r in rows} == expected and len(rows) == len(expected)


def test_carbon13(spark):
    found = spark.createDataFrame([(1, 10, 1, 200.0, 100.0), (2, 10, 1, 300.0, 100.0)], "id long, c int, z int, mass double, i double")
    peaks = spark.createDataFrame([(201.003355, 10.8), (201.0034, 99.0), (301.003355, 90.0)], "mass double, i double")
    got = {r["id"]: r["confirmed"] for r in assign.confirmed_by_carbon13(found, peaks, "id", "mass", "i").collect()}
    assert got == {1: True, 2: False}


def test_descriptors(spark):
    df = spark.createDataFrame([(10.0, 10.0, 4.0, 1.0, 0.0), (20.0, 30.0, 6.0, 0.0, 1.0)], "c double, h double, o double, n double, s double")
    c, h, o, n, s = (F.col(x) for x in "chons")
    got = df.select(chem.ratio(h, c), chem.ratio(o, c), chem.dbe(c, h, n), chem.hetero_class(n, s), chem.aromaticity(c, h, o, n, s)).collect()
    assert tuple(got[0])[:4] == (1.0, 0.4, 6.5, "CHON") and got[1][3] == "CHOS"
    assert got[0][4] == pytest.approx((1 + 10 - 4 - 5.5) / (10 - 4 - 1))


def test_kendrick_and_formulas(spark):
    kmd = [r[0] for r in spark.createDataFrame([(200.05,), (214.06565,), (228.0813,)], "m double").select(chem.kendrick(F.col("m"))[2]).collect()]
    assert max(kmd) - min(kmd) < 0.005
    assert col(spark, "C2H5OC", chem.formula_counts(F.col("v"))) == {"C": 3, "H": 5, "O": 1}
    assert col(spark, "XeF2", chem.formula_mass(F.col("v"))) is None


def test_grid(spark):
    df = spark.createDataFrame([(0.1, 0.4, 100.0), (0.4, 0.8, 200.0), (0.6, 1.2, 300.0), (0.9, 1.6, 400.0)], "oc double, hc double, i double")
    rows = relational.grid20(df, F.col("oc"), F.col("hc"), F.col("i")).collect()
    assert len(rows) == 20 and sum(r["n_percent"] for r in rows) == pytest.approx(100) and sum(r["weight_percent"] for r in rows) == pytest.approx(100)


def test_set_algebra(spark):
    a, b = (spark.createDataFrame([(m, 1.0) for m in x], "mass double, i double") for x in ([100.0, 200.0, 300.0], [200.0005, 300.0, 400.0]))
    masses = lambda df: sorted(r["mass"] for r in df.collect())
    assert masses(ranges.spectral_difference(a, b, "mass", 5)) == [100]
    assert masses(ranges.spectral_intersection(a, b, "mass", 5)) == [200, 300]
    assert masses(ranges.spectral_union(a, b, "mass", 5)) == [100, 200, 300, 400]
    assert masses(ranges.spectral_symmetric(a, b, "mass", 5)) == [100, 400]


@pytest.mark.parametrize("ppm", [1.0, 50.0, 5000.0])
def test_ppm_join_equals_brute_force(spark, ppm):
    r = np.random.default_rng(1)
    a, b = r.uniform(100, 400, 300), r.uniform(100, 400, 300)
    x, y = spark.createDataFrame([(float(v),) for v in a], "m double"), spark.createDataFrame([(float(v),) for v in b], "t double")
    got = {tuple(p) for p in ranges.ppm_join(x, y, "m", "t", ppm).collect()}
    assert got == {(m, t) for m in a.tolist() for t in b.tolist() if m - m * (ppm * 1e-6) <= t <= m + m * (ppm * 1e-6)}


def test_mass_differences(spark):
    df = spark.createDataFrame([(1, 200.0), (2, 214.01565), (3, 250.0)], "id long, m double")
    assert [tuple(r)[:3] for r in ranges.mass_differences(df, "id", "m", chem.TRANSFORMATIONS, 0.002).collect()] == [(1, 2, "CH2")]


def test_interpolation_and_nearest(spark):
    curve = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 5.0)], "k string, cx double, cy double")
    asked = spark.createDataFrame([("a", 4.0), ("a", 10.0), ("a", 11.0), ("b", 1.0)], "k string, x double")
    assert {(r["k"], r["x"]): r["y"] for r in ranges.interpolated(asked, curve, ["k"], "x", "cx", "cy").collect()} == {("a", 4.0): 2.0, ("a", 10.0): 5.0, ("a", 11.0): None, ("b", 1.0): None}


def test_simpson(spark):
    x = np.array([0.0, 1.0, 2.5, 3.0, 4.0, 6.0])
    for n in (2, 3, 4, 5, 6):
        df = spark.createDataFrame([("k", float(v), float(v * v)) for v in x[:n]], "k string, x double, y double")
        got = ordered.simpson(df, ["k"], "x", "y").first()["area"]
        exact = x[n - 1] ** 3 / 3 if n > 2 else 0.5
        assert got == pytest.approx(exact)


def test_savgol_weights():
    assert np.allclose(np.array(ordered.savgol_weights(2)) * 35, [-3, 12, 17, 12, -3])
    assert np.allclose(np.array(ordered.savgol_weights(2, 1)) * 10, [-2, -1, 0, 1, 2])


def test_crossing_and_gradient(spark):
    df = spark.createDataFrame([("k", 0.0, 100.0), ("k", 10.0, 90.0), ("k", 20.0, 70.0), ("z", 0.0, 100.0)], "k string, x double, y double")
    got = {r["k"]: r["crossing"] for r in ordered.crossing(df, ["k"], "x", "y", F.lit(80.0)).collect()}
    assert got == {"k": 15.0, "z": None}
    g = [r["gradient"] for r in ordered.gradient(df.where("k = 'k'"), ["k"], "x", "y").orderBy("x").collect()]
    assert np.allclose(g, np.gradient([100.0, 90.0, 70.0], [0.0, 10.0, 20.0], edge_order=1))


def test_bh(spark):
    p = np.random.default_rng(3).uniform(0, 1, 40)
    p[5] = p[7]
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * 40 / np.arange(1, 41))[::-1])[::-1]
    expected = dict(zip(order.tolist(), np.minimum(q, 1)))
    df = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(p)] + [(99, "f", None)], "id long, fam string, p double")
    for r in stats.benjamini_hochberg(df, ["fam"], "p", "id").collect():
        assert r["q"] is None if r["id"] == 99 else r["q"] == pytest.approx(expected[r["id"]], abs=1e-12)


def test_correlations_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    got = {(r["f1"], r["f2"]): r["r"] for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): None, ("a", "c"): None, ("b", "c"): None}


def test_student_p():
    for r in (0.01, 0.3, 0.9, 0.999):
        assert kernels.student_p(r, 4) == pytest.approx(1 - r, abs=1e-12)  # two degrees of freedom
        assert kernels.student_p(r, 3) == pytest.approx(1 - 2 / np.pi * np.arctan(r / np.sqrt(1 - r * r)), abs=1e-10)


def test_asls_equals_dense_solve():
    y = np.sin(np.linspace(0, 6, 60)) + np.linspace(0, 2, 60)
    d = np.diff(np.eye(60), 2, axis=0)
    w = np.ones(60)
    for _ in range(10):
        z = np.linalg.solve(np.diag(w) + 100 * d.T @ d, w * y)
        w = np.where(y > z, 0.01, 0.99)
    assert np.allclose(kernels.asls(y, 100.0), z)


def test_prominent():
    y = np.array([0, 3, 1, 5, 5, 5, 2, 4, 0.0])
    assert kernels.prominent(y, 1.5).tolist() == [1, 4, 7]
    assert kernels.prominent(y, 2.5).tolist() == [4]
    assert kernels.prominent(y, 0, 4).tolist() == [4]


def test_pls_separates(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(40, 4))
    y = (x[:, 0] + 0.1 * r.normal(size=40) > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(40)], "id long, a double, b double, c double, d double, y double")
    runs = models.cross_validated(df, "id", list("abcd"), "y", 5)
    q2 = runs.agg(stats.q_squared(runs, "truth", "predicted").alias("q")).first()["q"]
    assert runs.count() == 40 and q2 > 0.4
    top = models.variable_importance(df, "id", list("abcd"), "y").orderBy(F.desc("vip")).first()
    assert top["descriptor"] == "a" and top["vip"] > 1
    axes = kernels.principal_axes(df, "id", list("abcd"), 4).collect()
    assert sum({x["component"]: x["explained"] for x in axes}.values()) == pytest.approx(100)


def test_fusion(spark):
    a = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "id string, v double")
    b = spark.createDataFrame([("s2", 3.0), ("s3", None)], "id string, v double")
    assert [tuple(r) for r in fusion.fuse_blocks({"A": a, "B": b}, "id").collect()] == [("s2", 2.0, 3.0)]
    wide = fusion.fuse_blocks({"A": a, "B": b}, "id", "outer")
    assert {tuple(r) for r in wide.collect()} == {("s1", 1.0, None), ("s2", 2.0, 3.0), ("s3", None, None)}
    long = fusion.unpivot(wide, ["id"])
    assert long.count() == 3 and {tuple(r) for r in fusion.pivot(long, ["id"], ["A_v", "B_v"]).collect()} == {("s1", 1.0, None), ("s2", 2.0, 3.0)}


def test_names(spark):
    assert col(spark, "data/Lake_Control_01_fticr.csv", text.sample_id(F.col("v"))) == "Lake_Control_01"
    for name, block in {"VK_1": "FT-ICR MS", "h/c": "FT-ICR MS", "FTIR_Lignin_Idx": "FTIR", "so4_cl": "IC", "shape": "Other", "doc": "UV-Vis", "sec": "Other", "": "Other"}.items():
        assert col(spark, name, text.feature_block(F.col("v"))) == block
    assert col(spark, "=HYPERLINK(1)", text.guarded_cell(F.col("v"))) == "'=HYPERLINK(1)"
    assert col(spark, "-1.5", text.guarded_cell(F.col("v"))) == "-1.5"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.tumbling(stream, "ts", "1 hour", ["event_type"], "value", late="3650 days")
    run = out.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r["event_type"], r["start"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("counts")) == key(windows.tumbling(events, "ts", "1 hour", ["event_type"], "value"))


def test_models(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(30, 4)), r.normal(size=30)
    y = x[:, 0] * 2 + 0.01 * y
    assert (np.count_nonzero(kernels.sparse_weights(np.array([3.0, -2, 1, 0.5]), 2)), kernels.sparse_weights(np.array([3.0, -2, 1]), 2)[1] < 0) == (2, True)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(30)], "id long, a double, b double, c double, d double, y double")
    got = {z["block"]: z for z in models.block_models(df, "id", {"one": ["a", "b"], "two": ["c", "d"]}, "y").collect()}
    assert got["one"]["multiblock_share"] > 0.8 and got["one"]["sequential_share"] > 0.9 > got["two"]["sequential_share"]
    assert [z["descriptor"] for z in kernels.sparse_selection(df, "id", list("abcd"), "y", 1).collect()] == ["a"]


def test_parafac(spark):
    r = np.random.default_rng(2)
    a, b, c = r.uniform(0.5, 2, (6, 2)), np.array([[1, 0], [0.8, 0.1], [0.1, 0.9], [0, 1.0]]), np.array([[1, 0.1], [0.5, 0.5], [0, 1.0]])
    cube = np.einsum("ir,jr,kr->ijk", a, b, c)
    rows = [(i, float(j), float(k), float(cube[i, j, k])) for i in range(6) for j in range(4) for k in range(3)]
    scores, loadings, explained = kernels.parafac(spark.createDataFrame(rows, "s long, em double, ex double, v double"), "s", "em", "ex", "v", 2, rounds=12)
    assert explained > 0.98 and scores.count() == 12 and len(loadings) == 14


def test_band_fits(spark):
    x = np.linspace(0, 40, 81)
    y = 3 * np.exp(-0.5 * ((x - 11) / 3) ** 2) + 2 * np.exp(-0.5 * ((x - 27) / 4) ** 2)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)] + [("few", 1.0, 1.0)], "k string, x double, y double")
    all_ = kernels.fit_bands(df, ["k"], "x", "y", [10.0, 30.0], 5.0, 5.0).orderBy("band").collect()
    assert [(r["band"], r["height"], r["r2"], r["state"]) for r in all_ if r["k"] == "few"] == [(1, None, None, "too few points"), (2, None, None, "too few points")]
    got = [r for r in all_ if r["k"] == "k"]
    assert [(round(r["height"], 3), round(r["centre"], 3), round(r["width"], 3)) for r in got] == [(3.0, 11.0, 3.0), (2.0, 27.0, 4.0)]
    assert got[0]["r2"] > 0.9999 and got[0]["area_percent"] == pytest.approx(100 * 9 / 17, abs=0.01)


def test_greedy_alignment(spark):
    a = spark.createDataFrame([("k", 100.0), ("k", 100.001), ("k", 200.0), ("only_a", 1.0)], "k string, m double")
    b = spark.createDataFrame([("k", 100.0009), ("k", 100.002), ("only_b", 1.0)], "k string, m double")
    got = sorted(tuple(r) for r in kernels.aligned(a, b, ["k"], "m", 20.0).collect())
    assert got == [("k", 100.0, 100.0009), ("k", 100.001, 100.002)]


# Models against plain numpy over the samples themselves


def nipals(x, y, components):
    e, f, w, t, p, q = x.copy(), y.copy(), [], [], [], []
    for _ in range(components):
        w.append(e.T @ f / np.linalg.norm(e.T @ f))
        t.append(e @ w[-1])
        p.append(e.T @ t[-1] / (t[-1] @ t[-1]))
        q.append(f @ t[-1] / (t[-1] @ t[-1]))
        e, f = e - np.outer(t[-1], p[-1]), f - q[-1] * t[-1]
    w, t, p, q = (np.array(v).T for v in (w, t, p, q))
    return w, t, p, q, w @ np.linalg.inv(p.T @ w) @ q


def centred(x):
    return (x - x.mean(0)) / x.std(0)


@pytest.fixture(scope="module")
def cohort(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(60, 5)) @ r.normal(size=(5, 5)) + 1000
    y = x[:, 0] - 0.5 * x[:, 3] + 0.3 * r.normal(size=60)
    label = (y > np.median(y)).astype(float)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), float(label[i])) for i in range(60)], "id long, a double, b double, c double, d double, e double, y double, label double")
    return df, x, y, label


def test_importance_and_quality_by_sums(cohort):
    df, x, y, _ = cohort
    w, t, p, q, b = nipals(centred(x), y - y.mean(), 3)
    ssy = (t * t).sum(0) * q * q
    got = {z["descriptor"]: z for z in models.variable_importance(df, "id", list("abcde"), "y", 3).collect()}
    assert np.allclose([got[f]["vip"] for f in "abcde"], np.sqrt(5 * (w * w @ ssy) / ssy.sum()), rtol=1e-6)
    assert np.allclose([got[f]["coefficient"] for f in "abcde"], b, rtol=1e-6)
    rows = models.quality(df, "id", list("abcde"), "y", 5, 3).collect()
    assert np.allclose([z["r2y"] for z in rows], np.cumsum(ssy) / ((y - y.mean()) ** 2).sum(), rtol=1e-6)
    assert np.allclose([z["r2x"] for z in rows], np.cumsum((t * t).sum(0) * (p * p).sum(0)) / (centred(x) ** 2).sum(), rtol=1e-6)


def test_cross_validation_by_sums(cohort):
    df, x, y, label = cohort
    expected = np.zeros(60)
    for f in range(4):
        out = np.arange(60) % 4 == f
        mean, scale = x[~out].mean(0), x[~out].std(0)
        b = nipals((x[~out] - mean) / scale, y[~out] - y[~out].mean(), 2)[4]
        expected[out] = (x[out] - mean) / scale @ b + y[~out].mean()
    fold = F.col("id") % 4
    rows = models.cross_validated(df, "id", list("abcde"), "y", 4, 2, fold).orderBy("id").collect()
    assert np.allclose([z["predicted"] for z in rows], expected, rtol=1e-6)
    scores = {z["permutation"]: z["q2"] for z in models.permutation_test(df, "id", list("abcde"), "label", 4, 20, fold=fold).collect()}
    runs = models.cross_validated(df, "id", list("abcde"), "label", 4, 2, fold)
    assert scores[0] == pytest.approx(runs.agg(stats.q_squared(runs, "truth", "predicted").alias("q")).first()["q"], rel=1e-6)
    assert len(scores) == 21 and sum(v >= scores[0] for k, v in scores.items() if k) <= 1
    with pytest.raises(ValueError):
        models.permutation_test(df, "id", list("abcde"), "y", 4, 2)


def test_orthogonal_scores_by_sums(cohort):
    df, x, y, _ = cohort
    e, f = centred(x), y - y.mean()
    w = e.T @ f / np.linalg.norm(e.T @ f)
    t = e @ w
    p = e.T @ t / (t @ t)
    wo = p - (w @ p) * w
    to = e @ (wo / np.linalg.norm(wo))
    e = e - np.outer(to, e.T @ to / (to @ to))
    sign = 1 if w[np.argmax(np.abs(w))] >= 0 else -1
    rows = models.orthogonal_scores(df, "id", list("abcde"), "y").orderBy("id").collect()
    assert np.allclose([z["predictive"] for z in rows], sign * (e @ w), atol=1e-6)
    assert np.allclose([z["orthogonal"] for z in rows], to, atol=1e-6)


def test_block_models_by_sums(cohort):
    df, x, y, _ = cohort
    e, f = centred(x), y - y.mean()
    w, t, _, q, _ = nipals(np.hstack([e[:, :2] / np.sqrt(2), e[:, 2:] / np.sqrt(3)]), f, 2)
    ssy = (t * t).sum(0) * q * q
    share = np.array([(w[a:b] ** 2 @ ssy).sum() for a, b in ((0, 2), (2, 5))])
    first = nipals(e[:, :2], f, 1)[1]
    left = f - first @ np.linalg.lstsq(first, f, rcond=None)[0]
    second = e[:, 2:] - first @ np.linalg.lstsq(first, e[:, 2:], rcond=None)[0]
    second = nipals(second, left, 1)[1]
    added = [((f - left) ** 2).sum(), ((second @ np.linalg.lstsq(second, left, rcond=None)[0]) ** 2).sum()] / (f @ f)
    rows = models.block_models(df, "id", {"one": ["a", "b"], "two": ["c", "d", "e"]}, "y").collect()
    assert np.allclose([z["multiblock_share"] for z in rows], share / share.sum(), rtol=1e-6)
    assert np.allclose([z["sequential_share"] for z in rows], added, rtol=1e-6)


def test_models_leave_out_incomplete_rows(cohort, spark):
    df, *_ = cohort
    odd = df.unionByName(spark.createDataFrame([(90, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (91, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], df.schema))
    got, whole = ({z["descriptor"]: z["vip"] for z in models.variable_importance(x, "id", list("abcde"), "y").collect()} for x in (odd, df))
    assert got == pytest.approx(whole)
    assert models.variable_importance(df.limit(0), "id", list("abcde"), "y").count() == 5


def test_samples_never_meet(spark):
    rows = [("s1", 1, 100.0, 9.0), ("s2", 2, 101.003355, 1.0), ("s1", 3, 300.0, 5.0), ("s2", 4, 300.0, 2.0), ("s1", 5, 114.01565, 1.0)]
    p = spark.createDataFrame(rows, "sample string, id long, m double, i double")
    assert ranges.isotope_companions(p, "id", "m", "i", chem.CARBON13, 0.01).count() == 1
    assert ranges.isotope_companions(p, "id", "m", "i", chem.CARBON13, 0.01, ["sample"]).count() == 0
    assert [tuple(r)[:4] for r in ranges.mass_differences(p, "id", "m", {"CH2": 14.01565}, 0.001, ["sample"]).collect()] == [("s1", 1, 5, "CH2")]
    a, b = p.where("id < 4"), spark.createDataFrame([("s2", 7, 100.0, 1.0), ("s1", 8, 300.0, 4.0)], p.schema)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(ranges.spectral_intersection(a, b, "m", 1.0, ["sample"])) == [3]
    assert ids(ranges.spectral_union(a, b, "m", 1.0, ["sample"])) == [1, 2, 3, 7]
    assert {r["id"]: r["i"] for r in ranges.blank_subtracted(a, b, "m", "i", 1.0, keys=["sample"]).collect()} == {1: 9.0, 2: 1.0, 3: 1.0}


def test_ions_by_ph(spark):
    charge = lambda ph: col(spark, ph, chem.phosphate_charge(F.col("v").cast("double"))[0])
    assert charge(2.15) == pytest.approx(0.5, abs=1e-4) and charge(7.2) == pytest.approx(1.5, abs=1e-4) and charge(12.35) == pytest.approx(2.5, abs=1e-4)
    bicarbonate, carbonate = (col(spark, 10.33, x) for x in chem.alkalinity_split(F.lit(3.0), F.col("v").cast("double")))
    assert bicarbonate == pytest.approx(carbonate) and bicarbonate * 3 == pytest.approx(3.0 - 1000 * 10 ** (10.33 - 14), abs=1e-6)
    assert col(spark, 13.0, chem.alkalinity_split(F.lit(1.0), F.col("v").cast("double"))[0]) == 0
