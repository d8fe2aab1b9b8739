"""Laboratory tables, Raman bands, trilinear checks, ranks and cohort operators on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrion.functions import chem, sql
from spectrion.operators import kernels, ordered, ranges, spectra, stats
from spectrion.sources import formats, tables


@pytest.mark.parametrize(
    "header, name, unit",
    [
        ("SO4²⁻ (mg/L)", "so42", "mg/l"), ("sulfate_mg_l", "sulfate", "mg/l"), ("Сульфат, мг/л", "сульфат", "mg/l"), ("so4_mg_l", "so4", "mg/l"), ("Mg", "mg", None),
        ("NO3-N, mg/L", "no3n", "mg/l"), ("Alkalinity (mg/L as CaCO3)", "alkalinity", "mg/l caco3"), ("Alkalinity_meq_L", "alkalinity", "meq/l"), ("K, ug_L", "k", "ug/l"), ("Na mmol/L", "na", "mmol/l"), ("pH", "ph", None),
    ],
)
def test_headers(header, name, unit):
    assert (tables.plain_name(header), tables.unit_of(header)) == (name, unit)


def test_elemental_table(spark):
    df = spark.createDataFrame([("a", "50", "5", "x", "38", "2"), ("b", "nan", None, "1", "", "4")], "Name string, Carbon string, `H%` string, N string, O string, `Ash, wt` string")
    got = [r.asDict() for r in tables.elemental(df, "dry").orderBy("sample_id").collect()]
    assert got[0] | {"c": 50, "h": 5, "n": 0, "s": 0, "o": 38, "ash": 2, "moisture": 0, "basis": "dry", "sample_type": "Unknown"} == got[0]
    assert got[1] | {"c": 0, "h": 0, "n": 1, "o": 95, "ash": 4} == got[1]
    assert tables.elemental(df.limit(0)).count() == 0


def test_ion_table(spark):
    df = spark.createDataFrame([("w", "96.06", "2", "7", "9")], "`Проба` string, `Sulphate meq/L` string, `NO2-N` string, NO2 string, Alk string")
    r = tables.ions(df).first()
    assert (r["sample_id"], r["nitrite"], r["alkalinity"], r["ph"]) == ("w", 7, None, None) and r["sulfate"] == pytest.approx(96.06 * 48.03)
    assert "sulfate" not in r["missing"] and len(r["missing"]) == 19
    assert tables.ions(df, "ueq/l").first()["alkalinity"] == pytest.approx(0.009)


def test_isotope_table(spark):
    df = spark.createDataFrame([("a", "-27.5", "River_water", None), ("b", "inf", None, "да")], "id string, `delta13C_permil corr` string, origin string, `is water` string")
    got = {r["sample_id"]: (r["d13c"], r["is_water"], r["d34s"]) for r in tables.isotopes(df).collect()}
    assert got == {"a": (-27.5, True, None), "b": (None, True, None)}
    assert chem.isotope_standard(" d ") == chem.isotope_standard("2h") == 155.76e-6


def test_matrix_of_numbers(spark, tmp_path):
    (tmp_path / "S_eem.csv").write_text("em,240,250 nm\n300,1,2\n310,3,4\n")
    got = {(r["ex"], r["em"], r["value"]) for r in tables.excitation_emission(formats.read_points(spark, str(tmp_path))).collect()}
    assert got == {(240, 300, 1), (250, 300, 2), (240, 310, 3), (250, 310, 4)}


def test_raman_carbon(spark):
    x = np.arange(1000, 1801, 2.0)
    lorentz = lambda h, c, w: h / (1 + 4 * ((x - c) / w) ** 2)
    y = lorentz(80, 1350, 100) + lorentz(100, 1585, 60)
    p, _, r2, cov = kernels.carbon_fit(x, y)
    assert r2 > 0.9999 and p[1] == pytest.approx([80, 1350, 100], rel=0.02) and p[3] == pytest.approx([100, 1585, 60], rel=0.02) and np.isfinite(cov).all()
    rows = [("s", float(a), float(b) + 0.01 * float(a)) for a, b in zip(x, y)] + [("few", 1200.0, 1.0)] + [("flat", float(a), 0.0) for a in x]
    got = {r["k"]: r for r in kernels.raman_carbon(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["few"]["state"] == "too few points" and got["flat"]["state"] == "flat" and got["flat"]["r2"] is None
    s = got["s"]
    assert s["state"] in ("good", "poor") and s["r2"] > 0.95 and abs(s["d_centre"] - 1350) < 15 and abs(s["g_centre"] - 1585) < 10 and 0.6 < s["height_ratio"] < 1.0


def test_crystallite_size(spark):
    got = chem.crystallite_size(F.lit(1.0), F.lit(1.0), F.lit(514.5))
    r = spark.range(1).select(*[c.alias(n) for n, c in got.items()]).first()
    assert r["size"] == pytest.approx(2.4e-10 * 514.5**4) and r["size_heights"] == pytest.approx((1 / 0.0055) ** 0.5 / 10) and r["regime"] == "ordered"


def test_trilinear_checks(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.uniform(0.2, 1, (40, 2)), np.array([[1, 0.1], [0.6, 0.4], [0.2, 1], [0.0, 0.5]]), np.array([[1, 0.0], [0.5, 0.6], [0.1, 1.0]])
    t = np.einsum("ir,jr,kr->ijk", a, b, c)
    cells = spark.createDataFrame([(i, float(j), float(k), float(t[i, j, k])) for i, j, k in np.ndindex(t.shape)], "s long, em double, ex double, v double")
    scores, loadings, explained = kernels.parafac(cells, "s", "em", "ex", "v", 2, rounds=60)
    assert explained > 0.999 and kernels.core_consistency(cells, "s", "em", "ex", "v", scores, loadings) > 95
    assert min(kernels.split_half(cells, "s", "em", "ex", "v", 2, rounds=60)) > 0.95


def test_ranks_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("d", i, float(v)) for i, v in enumerate(np.floor(rng.exponential(30, 2000)))] + [("e", i, 1.0) for i in range(5)] + [("f", 0, None)]
    for pieces in (3, 200):
        got = stats.ranked_columns(spark.createDataFrame(rows, "descriptor string, id long, value double"), pieces=pieces).collect()
        values = np.array([v for d, _, v in rows if d == "d"])
        expected = {i: float((values < v).sum() + ((values == v).sum() + 1) / 2) for i, v in enumerate(values)}
        assert {r["id"]: r["rank"] for r in got if r["descriptor"] == "d"} == expected
        assert {r["rank"] for r in got if r["descriptor"] == "e"} == {3.0} and [r["rank"] for r in got if r["descriptor"] == "f"] == [None]


def test_ellipse_and_markers(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 4.0, 3.0), ("a", 5.0, 6.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: r for r in stats.hotelling_ellipse(df, ["k"], "x", "y").collect()}
    assert got["b"]["radius_x"] is None and got["a"]["radius_x"] == pytest.approx(np.std([1, 2, 4, 5], ddof=1) * (3 * 19.0) ** 0.5)  # F(0.95; 2, 2) = 19
    m = spark.createDataFrame([("d", "p", 1.0), ("d", "p", 3.0), ("d", "q", 2.0), ("d", "r", 0.5), ("d", None, 9.0)], "d string, c string, v double")
    r = stats.marker_directions(m, "d", "c", "v").first()
    assert (r["highest_class"], r["highest_mean"], r["lowest_class"], r["lowest_mean"]) == ("p", 2.0, "r", 0.5)
    one = spark.createDataFrame([([0.5],), ([0.4],), ([0.1, 0.7],), (None,)], "s array<double>")
    assert [r[0] for r in one.select(stats.predicted_class(F.col("s"), ["n", "y"])).collect()] == ["y", "n", "y", None]


def test_membership_and_crop(spark):
    a = spark.createDataFrame([("s", 1.00004), ("s", 2.0), ("t", 2.0)], "k string, m double")
    b = spark.createDataFrame([("s", 1.00001), ("s", 3.0), ("s", None)], "k string, m double")
    got = {(r["k"], r["m"], r["side"]) for r in ranges.membership(a, b, "m", 4, ["k"]).collect()}
    assert got == {("s", 1.0, "common"), ("s", 2.0, "first_only"), ("t", 2.0, "first_only"), ("s", 3.0, "second_only")}
    assert {(r["k"], r["m"]) for r in ordered.cropped(a, ["k"], "m", 0.5, 1.5).collect()} == {("s", 1.00004), ("t", 2.0)}


def test_compounds(spark):
    library = spark.createDataFrame([("Guaiacol (2-Methoxyphenol)", 1), ("Phenol", 2)], "entry string, place int")
    peaks = spark.createDataFrame([(1, "GUAIACOL"), (2, "2-methoxyphenol"), (3, "cresol"), (4, None), (5, "guaiacol (2-methoxyphenol)")], "id int, name string")
    assert {r["id"]: r["place"] for r in spectra.identified(peaks, library, "id", "name", "entry").collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: 1}
    found = spark.createDataFrame([(1, "p", 0.2, 5.0), (2, "p", 0.1, 1.0), (3, "p", 0.1, 2.0), (4, None, 0.0, 9.0)], "id int, c string, d double, a double").withColumn("s", F.lit(1))
    assert {r["id"]: r["matched"] for r in spectra.unique_matches(found, ["s"], "c", "d", "a", "id").collect()} == {1: None, 2: None, 3: "p", 4: None}


def test_raman_units_without_blank(spark):
    g = spark.createDataFrame([("a", 350.0, 381.0 + i, 2.0) for i in range(5)] + [("b", 360.0, 381.0, 2.0)], "k string, ex double, em double, v double")
    got = {(r["k"], r["v"], r["raman_area"]) for r in spectra.raman_units(g, g, ["k"], "ex", "em", "v").collect()}
    assert got == {("a", 0.25, 8.0), ("b", 2.0, None)}


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    r = spark.sql("SELECT chem_dbe(6, 6, 0) AS d, chem_absorbance(10) AS a, chem_delta(1.1, 1.0) AS t, chem_source_share(1, 2, 2) AS n").first()
    assert (r["d"], r["a"], r["n"]) == (4.0, 1.0, None) and r["t"] == pytest.approx(100)
