"""Queries of laboratory tables, optical scaling, Raman sizes and cohorts; inputs are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrion.functions import chem, sql, text
from spectrion.operators import kernels, ordered, ranges, spectra, stats
from spectrion.sources import tables

from .base import query, r, table
from .instruments import _BINS, _simpson_sql, _spectrum, _spectrum_sql

_ELEMENTS = """SELECT p_partkey, 'P' || p_partkey AS id, 40.0::DOUBLE + p_partkey % 20 AS c, 3.0::DOUBLE + p_partkey % 5 AS h, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 3) * 1.0::DOUBLE END AS n, p_partkey % 2 * 0.5::DOUBLE AS s,
    CASE WHEN p_partkey % 3 > 0 THEN 20.0::DOUBLE + p_size % 20 END AS o, (p_partkey % 11) * 1.0::DOUBLE AS ash, (p_partkey % 4) * 1.0::DOUBLE AS w, CASE p_partkey % 4 WHEN 0 THEN 'dry' WHEN 1 THEN 'daf' WHEN 2 THEN 'as_received' END AS basis FROM part"""


@query(f"""SELECT id AS sample_id, c, h, coalesce(n, 0) AS n, s, coalesce(o, greatest(0.0, 100 - (c + h + coalesce(n, 0) + s) - CASE coalesce(basis, 'as_received') WHEN 'daf' THEN 0 WHEN 'dry' THEN ash ELSE ash + w END)) AS o,
    ash, w AS moisture, coalesce(basis, 'as_received') AS basis FROM ({_ELEMENTS})""")
def elemental_table(spark, d):
    k = F.col("p_partkey")
    cells = [
        F.concat(F.lit("P"), k), 40.0 + k % 20, 3.0 + k % 5, F.when(k % 4 > 0, k % 3 * 1.0), k % 2 * 0.5, F.when(k % 3 > 0, 20.0 + F.col("p_size") % 20), k % 11, k % 4,
        F.when(k % 4 == 0, "Dry").when(k % 4 == 1, "daf").when(k % 4 == 2, " as_received"),
    ]
    lines = table(spark, d, "part").select(F.concat_ws(";", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("line"))
    out = tables.elemental(tables.from_lines(lines, "line", "Sample;C%;Hydrogen;N;S;O_pct;Ash, %;Moisture;Basis"))
    return out.select("sample_id", *"chnso", "ash", "moisture", "basis")


@query("""WITH x AS (SELECT c_custkey AS k, abs(c_acctbal) AS v FROM customer)
SELECT 'C' || k AS sample_id, round(v, 6) AS sulfate, round(CASE WHEN k % 3 > 0 THEN v / 1000 END, 6) AS chloride, round(v * 62.004::DOUBLE / 14.007::DOUBLE, 4) AS nitrate, round(v * 40.078::DOUBLE, 4) AS calcium, round((k % 7) / 50.04::DOUBLE, 8) AS alkalinity,
    (k % 9) * 1.0::DOUBLE AS ph, CASE WHEN k % 3 > 0 THEN 17 ELSE 18 END AS n_missing FROM x""")
def ion_table(spark, d):
    k, v = F.col("c_custkey"), F.abs("c_acctbal")
    cells = [F.concat(F.lit("C"), k), v, F.when(k % 3 > 0, v), v, v, k % 7, k % 9]
    lines = table(spark, d, "customer").select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("n.d.")) for c in cells]).alias("line"))
    out = tables.ions(tables.from_lines(lines, "line", "Sample ID\tSO4²⁻ (mg/L)\tCl- ug/l\tNO3-N, mg/L\tCa (mmol/L)\tAlkalinity (mg/L as CaCO3)\tpH"))
    rounded = [r("sulfate").alias("sulfate"), r("chloride").alias("chloride"), r("nitrate", 4).alias("nitrate"), r("calcium", 4).alias("calcium"), r("alkalinity", 8).alias("alkalinity")]
    return out.select("sample_id", *rounded, "ph", F.size("missing").alias("n_missing"))


@query("""SELECT 'C' || c_custkey AS sample_id, CASE WHEN c_custkey % 4 > 0 THEN -32.0::DOUBLE + c_custkey % 9 END AS d13c, c_acctbal / 100 AS d34s, CAST(NULL AS DOUBLE) AS d2h, c_mktsegment = 'BUILDING' OR c_custkey % 2 = 0 AS is_water, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS label FROM customer""")
def isotope_table(spark, d):
    k = F.col("c_custkey")
    kind = F.when((F.col("c_mktsegment") == "BUILDING") | (k % 2 == 0), "Lake-Water 2").otherwise("soil")
    site = F.when(F.col("c_mktsegment") == "MACHINERY", "x_Lignin").otherwise("x")
    cells = [F.concat(F.lit("C"), k), F.when(k % 4 > 0, -32.0 + k % 9), F.col("c_acctbal") / 100, kind, site]
    lines = table(spark, d, "customer").select(F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("line"))
    raw = tables.from_lines(lines, "line", "Sample,δ¹³C (‰ VPDB),d34S_mean,Type,site")
    out = tables.isotopes(raw)
    return out.join(raw.select(F.col("Sample").alias("sample_id"), text.default_class(F.col("site")).alias("label")), "sample_id").select("sample_id", "d13c", "d34s", "d2h", "is_water", "label")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 20 AS hc, l_discount * 12 AS oc FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN oc BETWEEN 0 AND 0.5 AND hc >= 0.2 AND hc < 1 THEN 'condensed_tannins' WHEN oc BETWEEN 0 AND 0.5 AND hc >= 1 AND hc < 1.4 THEN 'lignins' WHEN oc BETWEEN 0 AND 0.5 AND hc >= 1.4 AND hc < 1.8 THEN 'terpenoids'
    WHEN oc BETWEEN 0 AND 0.25 AND hc BETWEEN 1.8 AND 2.2 THEN 'lipids' WHEN oc BETWEEN 0 AND 0.5 AND hc BETWEEN 1.8 AND 2.2 THEN 'peptides' WHEN oc > 0.5 AND oc <= 1 AND hc >= 0.2 AND hc < 1.4 THEN 'hydrolysable_tannins'
    WHEN oc > 0.5 AND oc <= 1 AND hc BETWEEN 1.4 AND 2.2 THEN 'carbohydrates' ELSE 'other' END AS class FROM v""")
def classical_classes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", chem.class_classical(F.col("l_quantity") / 20, F.col("l_discount") * 12).alias("class"))


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'C' || p_size || 'H' || (p_partkey % 30) || 'Xx' WHEN 1 THEN ' C' || p_size WHEN 2 THEN 'C' || p_size || 'NaCl' ELSE 'C' || p_size || 'H' || (p_partkey % 30) || 'O' END AS formula FROM part)
SELECT p_partkey, formula, regexp_matches(formula, '^[A-Z]') AND NOT contains(formula, 'Xx') AS valid FROM f""")
def valid_formulas(spark, d):
    k, c = F.col("p_partkey"), F.concat(F.lit("C"), F.col("p_size"))
    h = F.concat(c, F.lit("H"), k % 30)
    formula = F.when(k % 5 == 0, F.concat(h, F.lit("Xx"))).when(k % 5 == 1, F.concat(F.lit(" "), c)).when(k % 5 == 2, F.concat(c, F.lit("NaCl"))).otherwise(F.concat(h, F.lit("O")))
    return table(spark, d, "part").select("p_partkey", formula.alias("formula")).withColumn("valid", chem.valid_formula(F.col("formula")))


_CELLS = "SELECT l_suppkey, 350.0::DOUBLE + l_orderkey % 3 * 10 AS ex, 371.0::DOUBLE + l_partkey % 13 * 5 AS em, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"


@query(f"""WITH g AS ({_CELLS}), b AS (SELECT l_suppkey, em AS x, v AS y FROM g WHERE ex = 350 AND em BETWEEN 381 AND 426), n AS (SELECT l_suppkey, count(*) AS n FROM b GROUP BY 1), a AS ({_simpson_sql("SELECT * FROM b", "l_suppkey")})
SELECT g.l_suppkey, ex, em, round(CASE WHEN area > 0 AND n >= 3 THEN v / area ELSE v END, 6) AS v, round(CASE WHEN area > 0 AND n >= 3 THEN area END, 4) AS raman_area FROM g LEFT JOIN a USING (l_suppkey) LEFT JOIN n USING (l_suppkey)""")
def raman_unit_scaling(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", (350.0 + F.col("l_orderkey") % 3 * 10).alias("ex"), (371.0 + F.col("l_partkey") % 13 * 5).alias("em")).agg(F.avg("l_quantity").alias("v"))
    return spectra.raman_units(g, g, ["l_suppkey"], "ex", "em", "v").select("l_suppkey", "ex", "em", r("v").alias("v"), r("raman_area", 4).alias("raman_area"))


@query("""WITH x AS (SELECT p_partkey, p_size / 25.0::DOUBLE AS h, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice / 400 END AS a, CASE p_partkey % 3 WHEN 0 THEN 514.5::DOUBLE WHEN 1 THEN 532.0 ELSE 785.0 END AS l FROM part),
y AS (SELECT *, 2.4e-10::DOUBLE * pow(l, 4) / a AS tk, sqrt(h / (0.0055::DOUBLE * pow(l, 4) / pow(514.5::DOUBLE, 4))) / 10 AS fr FROM x)
SELECT p_partkey, round(CASE WHEN tk >= 2 THEN tk ELSE fr END, 6) AS size, CASE WHEN tk >= 2 THEN 'ordered' ELSE 'amorphous' END AS regime FROM y""")
def crystallite_sizes(spark, d):
    k = F.col("p_partkey")
    laser = F.when(k % 3 == 0, 514.5).when(k % 3 == 1, 532.0).otherwise(785.0)
    got = chem.crystallite_size(F.col("p_size") / 25.0, F.when(k % 7 > 0, F.col("p_retailprice") / 400), laser)
    return table(spark, d, "part").select("p_partkey", r(got["size"]).alias("size"), got["regime"].alias("regime"))


@query()
def raman_carbon_bands(spark, d):
    points = table(spark, d, "lineitem").select("l_suppkey", (1000.0 + F.col("l_orderkey") % 401 * 2).alias("x"), F.col("l_quantity").alias("noise"))
    x = F.col("x")
    shape = chem.lorentzian(x, 80.0 + F.col("l_suppkey") % 5 * 8, F.lit(1350.0), F.lit(110.0)) + chem.lorentzian(x, F.lit(100.0), F.lit(1588.0), F.lit(65.0))
    spectrum = points.groupBy("l_suppkey", "x").agg(F.avg("noise").alias("noise")).select("l_suppkey", "x", (shape + F.col("noise") / 50 + (x - 1000) / 40).alias("y"))
    return kernels.raman_carbon(spectrum, ["l_suppkey"], "x", "y")


@query(f"""WITH s AS ({_spectrum_sql(0, 220)}), c AS (SELECT user_id, bin, x, y FROM s JOIN (VALUES {_BINS}) t(bin, lo, hi) ON x BETWEEN lo AND hi), a AS ({_simpson_sql('SELECT * FROM c', 'user_id, bin')}), t AS (SELECT user_id, bin, greatest(area, 0) AS area, sum(greatest(area, 0)) OVER (PARTITION BY user_id) AS total FROM a)
SELECT user_id, {", ".join(f"round(coalesce(sum(area) FILTER (WHERE bin IN ({', '.join(repr(b) for b in bins)})), 0) * 100 / nullif(max(total), 0), 6) AS zone_{n}" for n, bins in spectra.NMR_ZONES.items())} FROM t GROUP BY 1""")
def nmr_zone_shares(spark, d):
    zones = spectra.nmr_zones(spectra.nmr_descriptors(_spectrum(spark, d, 0.0, 220.0), ["user_id"], "x", "y"))
    return zones.select("user_id", *[r(f"zone_{n}").alias(f"zone_{n}") for n in spectra.NMR_ZONES])


@query("""WITH a AS (SELECT DISTINCT l_suppkey, round(l_extendedprice / 100, 1) AS mass FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey, round(l_extendedprice / 100, 1) AS mass FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.mass, b.mass) AS mass, CASE WHEN a.mass IS NULL THEN 'second_only' WHEN b.mass IS NULL THEN 'first_only' ELSE 'common' END AS side FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.mass = b.mass""")
def spectral_membership(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_extendedprice") / 100).alias("mass"))
    return ranges.membership(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "mass", 1, ["l_suppkey"])


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 100 / max(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS l_quantity FROM lineitem""")
def spectra_renormalized(spark, d):
    out = ranges.renormalized(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", r("l_quantity").alias("l_quantity"))


@query("""WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS v, CASE WHEN c_nationkey = 3 THEN 1.0::DOUBLE ELSE 8.0::DOUBLE END AS a FROM customer), s AS (SELECT *, CASE WHEN a <> 1 THEN least(1.0, greatest(0.0, (v - 1) / (a - 1))) END AS f FROM x)
SELECT c_custkey, round(100 * f, 6) AS source_percent, round(100 * (1 - f), 6) AS background_percent, CASE WHEN a <> 1 THEN v < 1 OR v > 8 END AS outside, CASE WHEN f > 0.5 THEN 'source' WHEN f > 0.15 THEN 'mixed' WHEN f IS NOT NULL THEN 'background' END AS label FROM s""")
def cohort_mixing(spark, d):
    source = F.when(F.col("c_nationkey") == 3, 1.0).otherwise(8.0)
    got = chem.mixing_table(F.col("c_acctbal") / 1000, source, F.lit(1.0))
    return table(spark, d, "customer").select("c_custkey", r(got["source_percent"]).alias("source_percent"), r(got["background_percent"]).alias("background_percent"), got["outside"].alias("outside"), got["label"].alias("label"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS x, avg(l_discount) AS y, stddev_samp(l_quantity) AS sx, stddev_samp(l_discount) AS sy FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, round(x, 6) AS centre_x, round(y, 6) AS centre_y, round(CASE WHEN n >= 4 THEN sx * k END, 5) AS radius_x, round(CASE WHEN n >= 4 THEN sy * k END, 6) AS radius_y
FROM (SELECT *, CASE WHEN n >= 4 THEN sqrt(2.0::DOUBLE * (n - 1) / (n - 2) * ((n - 2) / 2.0::DOUBLE * (pow(0.05::DOUBLE, -2.0::DOUBLE / (n - 2)) - 1))) END AS k FROM a)""")
def hotelling_ellipses(spark, d):
    e = stats.hotelling_ellipse(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount")
    return e.select("l_suppkey", "n", r("centre_x").alias("centre_x"), r("centre_y").alias("centre_y"), r("radius_x", 5).alias("radius_x"), r("radius_y").alias("radius_y"))


@query("""WITH m AS (SELECT o_clerk, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2)
SELECT o_clerk, min_by(o_orderpriority, {'m': -m, 'c': o_orderpriority}) AS highest_class, round(max(m), 4) AS highest_mean, min_by(o_orderpriority, {'m': m, 'c': o_orderpriority}) AS lowest_class, round(min(m), 4) AS lowest_mean FROM m GROUP BY 1""".replace("o_clerk", "o_custkey"))
def marker_classes(spark, d):
    out = stats.marker_directions(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice")
    return out.select("o_custkey", "highest_class", r("highest_mean", 4).alias("highest_mean"), "lowest_class", r("lowest_mean", 4).alias("lowest_mean"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, [l_discount, l_tax, l_quantity / 500] AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN s[1] >= s[2] AND s[1] >= s[3] THEN 'first' WHEN s[2] >= s[3] THEN 'second' ELSE 'third' END AS class FROM v""")
def predicted_classes(spark, d):
    scores = F.array("l_discount", "l_tax", F.col("l_quantity") / 500)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stats.predicted_class(scores, ["first", "second", "third"]).alias("class"))


@query("""SELECT p_partkey, 1 + c - 0.5::DOUBLE * h + 0.5::DOUBLE * n AS dbe, round(4 - (4 * c + h - 3 * n - 2 * o) / c, 6) AS nosc, round(CASE WHEN 1 + c - o - 0.5::DOUBLE * (h + n) > 0 AND c - o - n > 0 THEN (1 + c - o - 0.5::DOUBLE * (h + n)) / (c - o - n) ELSE 0 END, 6) AS ai, round(greatest(0.0, least(1.0, (o - 8) / (h - 8))), 6) AS share
FROM (SELECT p_partkey, (p_size + 5) * 1.0::DOUBLE AS c, (p_partkey % 30 + 9) * 1.0::DOUBLE AS h, (p_partkey % 9) * 1.0::DOUBLE AS o, (p_partkey % 2) * 1.0::DOUBLE AS n FROM part)""")
def session_functions(spark, d):
    sql.register(spark)
    k = F.col("p_partkey")
    atoms = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 5.0).alias("c"), (k % 30 + 9.0).alias("h"), (k % 9 * 1.0).alias("o"), (k % 2 * 1.0).alias("n"))
    return spark.sql("SELECT p_partkey, chem_dbe(c, h, n) AS dbe, round(chem_nosc(c, h, o, n, 0D), 6) AS nosc, round(chem_aromaticity(c, h, o, n, 0D), 6) AS ai, round(chem_source_share(o, h, 8D), 6) AS share FROM {atoms}", atoms=atoms)


@query("""WITH l AS (SELECT n_nationkey, lower(n_name) AS a, lower(substr(n_name, 1, 4)) AS b FROM nation), k AS (SELECT n_nationkey, a AS name FROM l UNION SELECT n_nationkey, b FROM l), u AS (SELECT name, min(n_nationkey) AS n_nationkey FROM k GROUP BY 1),
p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, 4) ELSE 'none' END AS name FROM customer JOIN nation ON c_nationkey = nation.n_nationkey)
SELECT c_custkey, u.n_nationkey AS entry_key FROM p LEFT JOIN u ON lower(p.name) = u.name""")
def compound_lookup(spark, d):
    n = table(spark, d, "nation")
    short = F.substring("n_name", 1, 4)
    library = n.select(F.concat("n_name", F.lit(" ("), short, F.lit(")")).alias("entry"), F.col("n_nationkey").alias("entry_key"))
    k = F.col("c_custkey")
    peaks = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, short).otherwise("none").alias("name"))
    return spectra.identified(peaks, library, "c_custkey", "name", "entry").select("c_custkey", "entry_key")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 > 0 AND row_number() OVER (PARTITION BY l_suppkey, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 5 END ORDER BY l_discount, l_quantity DESC, l_orderkey * 10 + l_linenumber) = 1 THEN l_partkey % 5 END AS matched FROM lineitem""")
def unique_retention_matches(spark, d):
    k = F.col("l_partkey") % 5
    peaks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_quantity", F.when(k > 0, k).alias("compound"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ident"))
    return spectra.unique_matches(peaks, ["l_suppkey"], "compound", "l_discount", "l_quantity", "ident").select("l_orderkey", "l_linenumber", "matched")


@query(f"""WITH s AS ({_spectrum_sql(500, 1500)}), c AS (SELECT *, bool_or(x BETWEEN 650 AND 700) OVER (PARTITION BY user_id) AS inside FROM s)
SELECT user_id, round(x, 4) AS x, round(max(y) OVER (PARTITION BY user_id ORDER BY x), 6) AS highest FROM c WHERE NOT inside OR x BETWEEN 650 AND 700""")
def cropped_running_maximum(spark, d):
    s = ordered.cropped(_spectrum(spark, d, 500.0, 1500.0), ["user_id"], "x", 650.0, 700.0)
    return ordered.running_maximum(s, ["user_id"], ["x"], "y").select("user_id", r("x", 4).alias("x"), r("highest").alias("highest"))
