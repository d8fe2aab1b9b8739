"""Queries over peak lists: windows, histograms, moments, classes, range joins, set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrion.functions import chem
from spectrion.operators import assign, ranges, relational

from .base import query, r, table


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """Line items as peaks: mass from price, intensity from quantity, sample from the order."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_id"), (F.col("l_orderkey") % 16).alias("sample"), "l_returnflag",
        (F.col("l_extendedprice") / 100).alias("mass"), F.col("l_quantity").alias("intensity"), "l_discount", "l_tax", "l_suppkey",
    )


_PEAKS = "SELECT l_orderkey * 10 + l_linenumber AS peak_id, l_orderkey % 16 AS sample, l_returnflag, l_extendedprice / 100 AS mass, l_quantity AS intensity, l_discount, l_tax, l_suppkey FROM lineitem"


def formulas(spark: SparkSession, d: str) -> DataFrame:
    """Parts as assigned formulas; element counts are derived from size and key."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", (size % 36 + 5).cast("int").alias("c"), (key % 45 + 4).cast("int").alias("h"), (key % 17).cast("int").alias("o"), (key % 3).cast("int").alias("n"), (size % 2).cast("int").alias("s"),
        F.col("p_retailprice").alias("intensity"), F.col("p_retailprice").alias("mass"),
    )


_FORMULAS = "SELECT p_partkey, p_size % 36 + 5 AS c, p_partkey % 45 + 4 AS h, p_partkey % 17 AS o, p_partkey % 3 AS n, p_size % 2 AS s, p_retailprice AS intensity, p_retailprice AS mass FROM part"


@query(f"""SELECT peak_id, l_returnflag, round(100.0 * intensity / max(intensity) OVER (PARTITION BY l_returnflag), 6) AS base_peak,
    round(100.0 * intensity / sum(intensity) OVER (PARTITION BY l_returnflag), 9) AS tic FROM ({_PEAKS}) WHERE mass BETWEEN 150 AND 800 AND intensity >= 5""")
def peak_filter_normalize(spark, d):
    kept = relational.peak_window(peaks(spark, d), "mass", "intensity", 150, 800, 5)
    both = relational.scaled(relational.scaled(kept, ["l_returnflag"], "intensity", "base_peak", "base_peak"), ["l_returnflag"], "intensity", "tic", "tic")
    return both.select("peak_id", "l_returnflag", r("base_peak"), r("tic", 9)).toDF("peak_id", "l_returnflag", "base_peak", "tic")


@query("""WITH b AS (SELECT floor(p_retailprice) AS b, count(*) AS n FROM part GROUP BY 1)
SELECT CAST(i AS DOUBLE) AS mass_from, round(coalesce(100.0 * n / (SELECT count(*) FROM part), 0), 6) AS percent FROM range(900, 1101) x(i) LEFT JOIN b ON b.b = i""")
def nominal_mass_bins(spark, d):
    out = relational.mass_bins(table(spark, d, "part"), "p_retailprice", 900, 1100)
    return out.select("mass_from", r("percent").alias("percent"))


@query(f"""WITH b AS (SELECT floor(mass / 25) * 25 AS mass_from, count(*) AS n, sum(intensity) AS i FROM ({_PEAKS}) WHERE mass BETWEEN 150 AND 1000 GROUP BY 1)
SELECT CAST(mass_from AS DOUBLE) AS mass_from, n, round(100.0 * n / sum(n) OVER (), 6) AS n_percent, round(i, 4) AS intensity, round(100.0 * i / sum(i) OVER (), 6) AS intensity_percent FROM b""")
def mass_intervals(spark, d):
    out = relational.mass_intervals(peaks(spark, d), "mass", "intensity", 150, 1000, 25.0)
    return out.select("mass_from", "n", r("n_percent").alias("n_percent"), r("intensity", 4).alias("intensity"), r("intensity_percent").alias("intensity_percent"))


_CELL = """CASE WHEN hc >= 0.2 AND hc < 0.6 THEN 0 WHEN hc >= 0.6 AND hc < 1.0 THEN 1 WHEN hc >= 1.0 AND hc < 1.4 THEN 2 WHEN hc >= 1.4 AND hc < 1.8 THEN 3 WHEN hc >= 1.8 AND hc < 2.200001 THEN 4 END * 4 + 1
 + CASE WHEN oc >= 0 AND oc < 0.25 THEN 0 WHEN oc >= 0.25 AND oc < 0.5 THEN 1 WHEN oc >= 0.5 AND oc < 0.75 THEN 2 WHEN oc >= 0.75 AND oc < 1.000001 THEN 3 END"""


@query(f"""WITH p AS (SELECT CAST(l_discount AS DOUBLE) * 10 AS oc, CAST(l_tax AS DOUBLE) * 25 AS hc, l_quantity AS w FROM lineitem), c AS (SELECT {_CELL} AS cell, w FROM p),
g AS (SELECT cell, count(*) AS n, sum(w) AS w FROM c WHERE cell IS NOT NULL GROUP BY cell)
SELECT CAST(i AS INTEGER) AS cell, coalesce(n, 0) AS n, round(coalesce(100.0 * n / sum(n) OVER (), 0), 6) AS n_percent, round(coalesce(100.0 * w / sum(w) OVER (), 0), 6) AS weight_percent FROM range(1, 21) x(i) LEFT JOIN g ON g.cell = i""")
def vk20_grid(spark, d):
    out = relational.grid20(table(spark, d, "lineitem"), F.col("l_discount") * 10, F.col("l_tax") * 25, F.col("l_quantity"))
    return out.select("cell", "n", r("n_percent").alias("n_percent"), r("weight_percent").alias("weight_percent"))


@query("""SELECT l_suppkey, round(sum(l_quantity) / sum(l_quantity / l_extendedprice), 6) AS mn, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS mw,
    round(sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity * l_extendedprice), 6) AS mz, (max({'s': l_quantity, 'm': l_extendedprice})).m AS mp,
    round((sum(l_quantity * l_extendedprice) / sum(l_quantity)) / (sum(l_quantity) / sum(l_quantity / l_extendedprice)), 6) AS pdi
FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY l_suppkey""")
def molar_mass_moments(spark, d):
    out = relational.molar_mass_moments(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", *[r(c).alias(c) for c in ("mn", "mw", "mz")], "mp", r("pdi").alias("pdi"))


@query("""SELECT o_orderpriority, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted_price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def weighted_mean_ratio(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = relational.weighted_mean(joined, ["o_orderpriority"], F.col("l_extendedprice"), F.col("l_quantity"), "weighted_price")
    return out.select("o_orderpriority", r("weighted_price").alias("weighted_price"))


@query("""SELECT l_suppkey, round(sum(l_quantity), 4) AS total, round(100.0 * sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share_A,
    round(100.0 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share_N, round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share_R
FROM lineitem GROUP BY l_suppkey""")
def class_area_shares(spark, d):
    out = relational.class_shares(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity", ["A", "N", "R"])
    return out.select("l_suppkey", r("total", 4).alias("total"), *[r(f"share_{c}").alias(f"share_{c}") for c in "ANR"])


_DESCRIBED = f"""SELECT *, h * 1.0 / c AS hc, o * 1.0 / c AS oc, 1.0 + c - 0.5 * h + 0.5 * n AS dbe,
    CASE WHEN c - o - s - n > 0 AND 1.0 + c - o - s - 0.5 * (h + n) > 0 THEN CAST(1.0 + c - o - s - 0.5 * (h + n) AS DOUBLE) / (c - o - s - n) ELSE 0 END AS ai,
    CASE WHEN c - 0.5 * o - s - n > 0 AND 1.0 + c - 0.5 * o - s - 0.5 * (h + n) > 0 THEN CAST(1.0 + c - 0.5 * o - s - 0.5 * (h + n) AS DOUBLE) / (c - 0.5 * o - s - n) ELSE 0 END AS ai_mod,
    4.0 - CAST(4.0 * c + h - 3.0 * n - 2.0 * o - 2.0 * s AS DOUBLE) / c AS nosc FROM (SELECT p_partkey, CAST(c AS DOUBLE) AS c, CAST(h AS DOUBLE) AS h, CAST(o AS DOUBLE) AS o, CAST(n AS DOUBLE) AS n, CAST(s AS DOUBLE) AS s, intensity, mass FROM ({_FORMULAS}))"""
_CRAM = "c > 0 AND h > 0 AND o > 0 AND dbe / c BETWEEN 0.30 AND 0.68 AND dbe / h BETWEEN 0.20 AND 0.95 AND dbe / o BETWEEN 0.77 AND 1.75 AND h / c BETWEEN 0.70 AND 1.60 AND o / c BETWEEN 0.20 AND 0.70 AND ai < 0.50"


def described(spark: SparkSession, d: str) -> DataFrame:
    f = formulas(spark, d).select("p_partkey", *[F.col(x).cast("double").alias(x) for x in "chons"], "intensity", "mass")
    c, h, o, n, s = (F.col(x) for x in "chons")
    f = f.withColumns({"hc": chem.ratio(h, c), "oc": chem.ratio(o, c), "dbe": chem.dbe(c, h, n), "ai": chem.aromaticity(c, h, o, n, s), "ai_mod": chem.aromaticity(c, h, o, n, s, 0.5), "nosc": chem.nosc(c, h, o, n, s)})
    return f.withColumn("cram", chem.is_cram(c, h, o, F.col("dbe"), F.col("ai")))


@query(f"""SELECT p_partkey, round(hc, 6) AS hc, round(oc, 6) AS oc, dbe, round(ai, 6) AS ai, round(ai_mod, 6) AS ai_mod, round(nosc, 6) AS nosc, {_CRAM} AS cram,
    CASE WHEN n > 0 AND s > 0 THEN 'CHONS' WHEN n > 0 THEN 'CHON' WHEN s > 0 THEN 'CHOS' ELSE 'CHO' END AS hetero FROM ({_DESCRIBED})""")
def formula_descriptors(spark, d):
    f = described(spark, d)
    return f.select("p_partkey", r("hc").alias("hc"), r("oc").alias("oc"), "dbe", r("ai").alias("ai"), r("ai_mod").alias("ai_mod"), r("nosc").alias("nosc"), "cram", chem.hetero_class(F.col("n"), F.col("s")).alias("hetero"))


@query(f"""WITH f AS (SELECT *, {_CRAM} AS cram FROM ({_DESCRIBED}))
SELECT p_partkey,
CASE WHEN cram THEN 'cram' WHEN ai >= 0.67 OR (hc < 0.7 AND oc <= 0.67) THEN 'condensed_aromatics' WHEN hc BETWEEN 0.5 AND 1.5 AND oc > 0.67 AND oc <= 1.0 AND ai >= 0.5 THEN 'condensed_tannins'
 WHEN hc BETWEEN 0.5 AND 1.5 AND oc > 0.67 AND oc <= 1.2 THEN 'hydrolysable_tannins' WHEN hc BETWEEN 1.5 AND 2.4 AND oc > 0.67 AND oc <= 1.2 THEN 'carbohydrates'
 WHEN hc BETWEEN 1.5 AND 2.2 AND oc BETWEEN 0.3 AND 0.67 THEN 'proteins' WHEN hc BETWEEN 1.5 AND 2.2 AND oc >= 0 AND oc < 0.3 THEN 'lipids'
 WHEN hc >= 0.7 AND hc < 1.5 AND oc BETWEEN 0.1 AND 0.67 THEN 'phenylpropanoids' WHEN hc >= 0.7 AND hc < 1.5 AND oc >= 0 AND oc < 0.1 THEN 'terpenoids' ELSE 'other' END AS perminova,
CASE WHEN ai > 0.66 OR (hc < 0.7 AND oc <= 0.67) THEN 'polycyclic_aromatics' WHEN ai BETWEEN 0.5 AND 0.66 THEN 'polyphenols' WHEN ai < 0.5 AND hc < 1.5 AND oc < 0.5 THEN 'unsaturated_low_oxygen'
 WHEN ai < 0.5 AND hc < 1.5 THEN 'unsaturated_high_oxygen' WHEN hc BETWEEN 1.5 AND 2.0 AND oc < 0.9 AND n >= 1 THEN 'peptide_like' WHEN hc BETWEEN 1.5 AND 2.0 AND oc < 0.9 THEN 'aliphatics'
 WHEN hc >= 1.5 AND oc >= 0.9 THEN 'carbohydrate_like' ELSE 'other' END AS kellerman,
CASE WHEN ai >= 0.67 OR (hc < 0.7 AND oc <= 0.67) THEN 'condensed_aromatics' WHEN hc BETWEEN 1.5 AND 2.0 AND oc BETWEEN 0 AND 0.3 THEN 'lipids' WHEN hc BETWEEN 1.5 AND 2.2 AND oc > 0.3 AND oc <= 0.67 AND n >= 1 THEN 'peptides'
 WHEN hc BETWEEN 1.5 AND 2.2 AND oc > 0.67 AND oc <= 1.2 AND n >= 1 THEN 'aminosugars' WHEN hc BETWEEN 1.5 AND 2.4 AND oc > 0.67 AND oc <= 1.2 AND n = 0 THEN 'carbohydrates'
 WHEN hc >= 0.7 AND hc < 1.5 AND oc BETWEEN 0.1 AND 0.67 THEN 'lignin' WHEN hc >= 0.5 AND hc < 1.5 AND oc > 0.67 AND oc <= 1.2 THEN 'tannins' WHEN hc BETWEEN 1.5 AND 2.2 AND oc > 0.3 AND oc <= 0.67 THEN 'unsaturated_aliphatics' ELSE 'other' END AS laszakovits
FROM f""")
def class_ladders(spark, d):
    f = described(spark, d)
    hc, oc, ai, n = (F.col(x) for x in ("hc", "oc", "ai", "n"))
    return f.select("p_partkey", chem.class_perminova(hc, oc, ai, F.col("cram")).alias("perminova"), chem.class_kellerman(hc, oc, ai, n).alias("kellerman"), chem.class_laszakovits(hc, oc, ai, n).alias("laszakovits"))


@query(f"""WITH f AS (SELECT CASE WHEN ai > 0.66 OR (hc < 0.7 AND oc <= 0.67) THEN 'polycyclic_aromatics' WHEN ai BETWEEN 0.5 AND 0.66 THEN 'polyphenols' WHEN ai < 0.5 AND hc < 1.5 AND oc < 0.5 THEN 'unsaturated_low_oxygen'
 WHEN ai < 0.5 AND hc < 1.5 THEN 'unsaturated_high_oxygen' WHEN hc BETWEEN 1.5 AND 2.0 AND oc < 0.9 AND n >= 1 THEN 'peptide_like' WHEN hc BETWEEN 1.5 AND 2.0 AND oc < 0.9 THEN 'aliphatics'
 WHEN hc >= 1.5 AND oc >= 0.9 THEN 'carbohydrate_like' ELSE 'other' END AS class FROM ({_DESCRIBED}))
SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM f GROUP BY class""")
def class_distribution(spark, d):
    f = described(spark, d).select(chem.class_kellerman(F.col("hc"), F.col("oc"), F.col("ai"), F.col("n")).alias("class"))
    return relational.distribution(f, "class").select("class", "n", r("percent").alias("percent"))


@query(f"""SELECT CAST(p_partkey % 7 AS BIGINT) AS sample, round(avg(mass), 6) AS mn, round(sum(mass * intensity) / sum(intensity), 6) AS mw, round(avg(hc), 6) AS hc, round(avg(dbe), 6) AS dbe,
    round(100.0 * sum(CASE WHEN {_CELL} = 5 THEN 1 ELSE 0 END) / count(*), 6) AS vk_5, round(100.0 * sum(CASE WHEN {_CELL} = 10 THEN 1 ELSE 0 END) / count(*), 6) AS vk_10,
    round(100.0 * sum(CASE WHEN {_CRAM} THEN 1 ELSE 0 END) / count(*), 6) AS cram FROM ({_DESCRIBED}) GROUP BY 1""")
def sample_descriptor_vector(spark, d):
    f = described(spark, d).withColumn("sample", F.col("p_partkey") % 7)
    out = relational.sample_descriptors(f, ["sample"], relational.grid_cell(F.col("oc"), F.col("hc")), F.col("mass"), F.col("intensity"), {"hc": F.col("hc"), "dbe": F.col("dbe"), "cram": F.col("cram").cast("double") * 100})
    return out.select("sample", *[r(c).alias(c) for c in ("mn", "mw", "hc", "dbe", "vk_5", "vk_10", "cram")])


@query("""SELECT p_partkey, round(p_retailprice * (14 / 14.015650::DOUBLE), 6) AS km, round_even(p_retailprice * (14 / 14.015650::DOUBLE), 0) AS nominal, round(round_even(p_retailprice * (14 / 14.015650::DOUBLE), 0) - p_retailprice * (14 / 14.015650::DOUBLE), 6) AS kmd FROM part""")
def kendrick_defect(spark, d):
    km, nominal, kmd = chem.kendrick(F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", r(km).alias("km"), nominal.alias("nominal"), r(kmd).alias("kmd"))


@query(f"""WITH f AS (SELECT p_partkey, 'C' || c || 'H' || h || 'O' || o || 'N' || n || 'S' || s AS formula, c, h, o, n, s FROM ({_FORMULAS}))
SELECT p_partkey, formula, CAST(c AS INTEGER) AS n_c, CAST(o AS INTEGER) AS n_o, round(c * 12.0::DOUBLE + h * 1.007825::DOUBLE + o * 15.994915::DOUBLE + n * 14.003074::DOUBLE + s * 31.972071::DOUBLE, 6) AS mass FROM f""")
def formula_parse(spark, d):
    f = formulas(spark, d).select("p_partkey", F.concat(*[x for e in "CHONS" for x in (F.lit(e), F.col(e.lower()).cast("string"))]).alias("formula"))
    counts = chem.formula_counts(F.col("formula"))
    return f.select("p_partkey", "formula", counts["C"].alias("n_c"), counts["O"].alias("n_o"), r(chem.formula_mass(F.col("formula"))).alias("mass"))


# Range joins

_CANDIDATES = "SELECT l_orderkey * 10 + l_linenumber AS cand, l_extendedprice / 100 * 1.0000005 AS theor FROM lineitem WHERE l_returnflag = 'R'"
_MEASURED = "SELECT l_orderkey * 10 + l_linenumber AS peak_id, l_extendedprice / 100 AS mass FROM lineitem WHERE l_returnflag = 'A'"


def _measured(spark, d):
    p = peaks(spark, d)
    return p.where("l_returnflag = 'A'").select("peak_id", "mass"), p.where("l_returnflag = 'R'").select(F.col("peak_id").alias("cand"), (F.col("mass") * 1.0000005).alias("theor"))


@query(f"SELECT peak_id, cand, round((mass - theor) / mass * 1e6, 4) AS error_ppm FROM ({_MEASURED}) JOIN ({_CANDIDATES}) ON theor BETWEEN mass - mass * 2e-6 AND mass + mass * 2e-6")
def ppm_range_join(spark, d):
    a, b = _measured(spark, d)
    return ranges.ppm_join(a, b, "mass", "theor", 2.0).select("peak_id", "cand", r(chem.ppm_error(F.col("mass"), F.col("theor")), 4).alias("error_ppm"))


@query(f"""SELECT peak_id, round(theor, 9) AS theor, round(e, 4) AS error_ppm FROM (SELECT peak_id, theor, (mass - theor) / mass * 1e6 AS e, row_number() OVER (PARTITION BY peak_id ORDER BY abs((mass - theor) / mass * 1e6), theor) AS k
    FROM ({_MEASURED}) JOIN ({_CANDIDATES}) ON theor BETWEEN mass - mass * 2e-6 AND mass + mass * 2e-6) WHERE k = 1""")
def ppm_best_match(spark, d):
    a, b = _measured(spark, d)
    return ranges.ppm_best(a, b, "peak_id", "mass", "theor", 2.0).select("peak_id", r("theor", 9).alias("theor"), r("error_ppm", 4).alias("error_ppm"))


_FORMULA_SQL = """WITH e AS (SELECT c, o, n, s, h, c * 12.0::DOUBLE + h * 1.007825::DOUBLE + o * 15.994915::DOUBLE + n * 14.003074::DOUBLE + s * 31.972071::DOUBLE - 1.007276::DOUBLE AS theor
    FROM range(8, 31) a(c), range(1, 13) b(o), range(0, 3) d(n), range(0, 2) f(s), range(4, 67) g(h)
    WHERE h >= 0.2 * c AND h <= 2.5 * c AND o <= 1.2 * c AND (h + n) % 2 = 0 AND 1 + c - h / 2.0 + n / 2.0 >= 0 AND 1 + c - h / 2.0 + n / 2.0 - o BETWEEN -10 AND 10),
p AS (SELECT l_orderkey * 10 + l_linenumber AS peak_id, l_extendedprice / 100 AS mass FROM lineitem WHERE l_returnflag = 'A'),
k AS (SELECT peak_id, c, h, o, n, s, (mass - theor) / mass * 1e6 AS error, row_number() OVER (PARTITION BY peak_id ORDER BY abs((mass - theor) / mass * 1e6), theor) AS k FROM p JOIN e ON theor BETWEEN mass - mass * 2e-6 AND mass + mass * 2e-6)
SELECT peak_id, 'C' || c || 'H' || h || 'O' || o || CASE WHEN n > 0 THEN 'N' || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END ELSE '' END || CASE WHEN s > 0 THEN 'S' ELSE '' END AS formula, round(error, 4) AS error_ppm FROM k WHERE k = 1"""


@query(_FORMULA_SQL)
def formula_assignment(spark, d):
    found = assign.assigned(_measured(spark, d)[0], "peak_id", "mass", {"C": (8, 30), "H": (4, 66), "O": (1, 12), "N": (0, 2), "S": (0, 1)}, ppm=2.0)
    return found.select("peak_id", "formula", r("error_ppm", 4).alias("error_ppm"))


_LIBRARY = "SELECT n_nationkey AS place, n_name AS compound, 2.0::DOUBLE + n_nationkey * 7.9::DOUBLE AS rt FROM nation"


@query(f"""WITH x AS (SELECT event_id, value, place, compound, abs(value - rt) AS dist FROM events LEFT JOIN ({_LIBRARY}) ON abs(value - rt) <= 0.6),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, place) AS k FROM x) SELECT event_id, compound FROM k WHERE k = 1""")
def nearest_rt(spark, d):
    lib = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("compound"), (2.0 + F.col("n_nationkey") * 7.9).alias("rt"))
    return ranges.nearest_within(table(spark, d, "events").select("event_id", "value"), lib, "event_id", "value", "rt", 0.6, "place").select("event_id", "compound")


@query("""WITH b AS (SELECT r_regionkey AS place, r_name AS band, -1000.0 + r_regionkey * 2100 AS lo, 1500.0 + r_regionkey * 2100 AS hi FROM region),
k AS (SELECT c_custkey, band, row_number() OVER (PARTITION BY c_custkey ORDER BY place) AS k FROM customer LEFT JOIN b ON c_acctbal BETWEEN lo AND hi) SELECT c_custkey, band FROM k WHERE k = 1""")
def interval_band_lookup(spark, d):
    key = F.col("r_regionkey")
    bands = table(spark, d, "region").select(key.alias("place"), F.col("r_name").alias("band"), (-1000.0 + key * 2100).alias("lo"), (1500.0 + key * 2100).alias("hi"))
    return ranges.first_interval(table(spark, d, "customer").select("c_custkey", "c_acctbal"), bands, "c_custkey", "c_acctbal", "lo", "hi", "place", 1000.0).select("c_custkey", "band")


_DELTAS = ", ".join(f"('{n}', {v!r}::DOUBLE)" for n, v in chem.TRANSFORMATIONS.items())
_PAIRS = f"SELECT a.p_partkey AS source, b.p_partkey AS target, code FROM part a JOIN part b ON a.p_size % 5 = b.p_size % 5 AND b.p_retailprice > a.p_retailprice JOIN (VALUES {_DELTAS}) t(code, delta) ON abs(b.p_retailprice - a.p_retailprice - delta) <= 0.02"


@query(f"SELECT code, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM ({_PAIRS}) GROUP BY code")
def mass_difference_network(spark, d):
    edges = ranges.mass_differences(table(spark, d, "part").withColumn("sample", F.col("p_size") % 5), "p_partkey", "p_retailprice", chem.TRANSFORMATIONS, 0.02, ["sample"])
    return relational.distribution(edges, "code").select("code", "n", r("percent").alias("percent"))


@query(f"SELECT node, count(*) AS degree FROM (SELECT source AS node FROM ({_PAIRS}) UNION ALL SELECT target FROM ({_PAIRS})) GROUP BY node")
def degree_hubs(spark, d):
    return ranges.degrees(ranges.mass_differences(table(spark, d, "part").withColumn("sample", F.col("p_size") % 5), "p_partkey", "p_retailprice", chem.TRANSFORMATIONS, 0.02, ["sample"]))


@query("""WITH x AS (SELECT a.p_partkey, b.p_partkey AS companion, CAST(b.p_size AS DOUBLE) / a.p_size AS ratio, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(b.p_retailprice - (a.p_retailprice + 1.003355)), b.p_retailprice, b.p_partkey) AS k
    FROM part a JOIN part b ON a.p_size % 5 = b.p_size % 5 AND abs(a.p_retailprice + 1.003355::DOUBLE - b.p_retailprice) <= 0.005) SELECT p_partkey, companion, round(ratio, 6) AS ratio FROM x WHERE k = 1""")
def isotope_companion(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"), (F.col("p_size") % 5).alias("sample"))
    return ranges.isotope_companions(p, "p_partkey", "p_retailprice", "p_size", chem.CARBON13, 0.005, ["sample"]).select("p_partkey", "companion", r("ratio").alias("ratio"))


_A = "SELECT l_linenumber AS sample, l_extendedprice / 100 AS mass, l_quantity AS intensity FROM lineitem WHERE l_returnflag = 'A'"
_B = "SELECT l_linenumber AS sample, l_extendedprice / 100 AS mass, l_quantity AS intensity FROM lineitem WHERE l_returnflag = 'R'"
_NEAR = "o.sample = x.sample AND o.mass BETWEEN x.mass - x.mass * 1.5e-6 AND x.mass + x.mass * 1.5e-6"
_FAR = "o.sample = x.sample AND x.mass BETWEEN o.mass - o.mass * 1.5e-6 AND o.mass + o.mass * 1.5e-6"


def _halves(spark, d):
    """Spectra of samples by line number, in two states."""
    p = peaks(spark, d).withColumn("sample", F.col("peak_id") % 10)
    return p.where("l_returnflag = 'A'").select("sample", "mass", "intensity"), p.where("l_returnflag = 'R'").select("sample", "mass", "intensity")


def _summed(df):
    """Rows by mass, so that the result's size follows the spectrum's."""
    return df.groupBy(r("mass", 4).alias("mass")).agg(F.count("*").alias("n"), r(F.sum("intensity"), 4).alias("intensity"))


def _summed_sql(q: str) -> str:
    return f"SELECT round(mass, 4) AS mass, count(*) AS n, round(sum(intensity), 4) AS intensity FROM ({q}) GROUP BY 1"


@query(_summed_sql(f"SELECT * FROM ({_A}) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT sample, mass FROM ({_B})) o WHERE {_NEAR})"))
def spectral_difference(spark, d):
    return _summed(ranges.spectral_difference(*_halves(spark, d), "mass", 1.5, ["sample"]))


@query(_summed_sql(f"SELECT * FROM ({_A}) x WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT sample, mass FROM ({_B})) o WHERE {_NEAR})"))
def spectral_intersection(spark, d):
    return _summed(ranges.spectral_intersection(*_halves(spark, d), "mass", 1.5, ["sample"]))


@query(_summed_sql(f"{_A} UNION ALL SELECT * FROM ({_B}) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT sample, mass FROM ({_A})) o WHERE {_FAR})"))
def spectral_union(spark, d):
    return _summed(ranges.spectral_union(*_halves(spark, d), "mass", 1.5, ["sample"]))


@query(_summed_sql(f"SELECT * FROM ({_A}) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT sample, mass FROM ({_B})) o WHERE {_NEAR}) UNION ALL SELECT * FROM ({_B}) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT sample, mass FROM ({_A})) o WHERE {_FAR})"))
def spectral_symmetric(spark, d):
    return _summed(ranges.spectral_symmetric(*_halves(spark, d), "mass", 1.5, ["sample"]))


@query(_summed_sql(f"SELECT sample, mass, i AS intensity FROM (SELECT x.sample, x.mass, greatest(x.intensity - 0.5 * coalesce((SELECT max(o.intensity) FROM ({_B}) o WHERE {_NEAR}), 0), 0) AS i FROM ({_A}) x) WHERE i > 0"))
def blank_subtraction(spark, d):
    return _summed(ranges.blank_subtracted(*_halves(spark, d), "mass", "intensity", 1.5, 0.5, ["sample"]))


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS s, s_nationkey AS t FROM customer JOIN supplier ON c_nationkey + 3 = s_nationkey OR c_nationkey = s_nationkey + 2),
w AS (SELECT [n_nationkey] AS path, 0 AS depth FROM nation WHERE n_regionkey = 0)
SELECT array_to_string(path, '>') AS path, depth FROM (
  SELECT [a.n_nationkey, e.t] AS path, 1 AS depth FROM nation a JOIN e ON e.s = a.n_nationkey AND e.t <> a.n_nationkey WHERE n_regionkey = 0
  UNION ALL SELECT [a.n_nationkey, e.t, f.t], 2 FROM nation a JOIN e ON e.s = a.n_nationkey AND e.t <> a.n_nationkey JOIN e f ON f.s = e.t AND f.t NOT IN (a.n_nationkey, e.t) WHERE n_regionkey = 0
  UNION ALL SELECT [a.n_nationkey, e.t, f.t, g.t], 3 FROM nation a JOIN e ON e.s = a.n_nationkey AND e.t <> a.n_nationkey JOIN e f ON f.s = e.t AND f.t NOT IN (a.n_nationkey, e.t) JOIN e g ON g.s = f.t AND g.t NOT IN (a.n_nationkey, e.t, f.t) WHERE n_regionkey = 0)""")
def recursive_pathways(spark, d):
    c, s = table(spark, d, "customer").select("c_nationkey").distinct(), table(spark, d, "supplier").select("s_nationkey").distinct()
    up = c.join(s, F.col("c_nationkey") + 3 == F.col("s_nationkey"))
    down = c.join(s, F.col("c_nationkey") == F.col("s_nationkey") + 2)
    edges = up.unionByName(down).distinct()
    starts = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return ranges.paths(edges, starts, "c_nationkey", "s_nationkey", 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


@query(f"""SELECT sample, CAST(rank AS INTEGER) AS rank, peak_id, intensity FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY intensity DESC, peak_id) AS rank FROM ({_PEAKS})) WHERE rank <= 5""")
def top_peaks(spark, d):
    """A top-k report: the strongest peaks of each sample."""
    return relational.top_per_key(peaks(spark, d), ["sample"], [F.desc("intensity"), F.asc("peak_id")], 5).select("sample", "rank", "peak_id", "intensity")


@query(f"""SELECT p_partkey, round((mass / 1000 / 0.0112372 - 1.0) * 1000.0, 4) AS delta, round(CASE WHEN intensity <> 900 THEN -29.0 + (mass - 900) * (-12.0 + 29.0) / (1100 - 900) END, 6) AS normalised,
    round(least(1.0, greatest(0.0, (mass - 1000) / (920.0 - 1000.0))), 6) AS share FROM ({_FORMULAS})""")
def isotope_scale(spark, d):
    m = F.col("mass")
    lit = F.lit
    norm = F.when(F.col("intensity") != 900, chem.two_point(m, lit(900.0), lit(1100.0), lit(-29.0), lit(-12.0)))
    return formulas(spark, d).select("p_partkey", r(chem.delta_from_ratio(m / 1000, lit(0.0112372)), 4).alias("delta"), r(norm).alias("normalised"), r(chem.two_source_share(m, lit(920.0), lit(1000.0))).alias("share"))


_IONS = ", ".join(f"({i}, {mw!r}::DOUBLE, {z}, {sign})" for i, (mw, z, sign) in enumerate(list(chem.IONS.values())[14:], 1))


@query(f"""WITH i(k, mw, z, sign) AS (VALUES {_IONS}), m AS (SELECT l_orderkey, l_quantity / mw AS mmol, z, sign FROM lineitem JOIN i ON k = l_linenumber),
s AS (SELECT l_orderkey, sum(CASE WHEN sign > 0 THEN mmol * z ELSE 0 END) AS cat, sum(CASE WHEN sign < 0 THEN mmol * z ELSE 0 END) AS an, 0.5 * sum(mmol * z * z) AS ionic FROM m GROUP BY 1)
SELECT l_orderkey, round(cat, 6) AS cations, round(an, 6) AS anions, round((cat - an) / (cat + an) * 100, 4) AS balance_percent, round(ionic, 6) AS ionic_strength FROM s""")
def ion_balance(spark, d):
    """Charge balance of long (sample, ion, concentration) rows."""
    ions = list(chem.IONS.values())[14:]
    pick = lambda i: F.element_at(F.array(*[F.lit(float(v[i])) for v in ions]), F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").where(F.col("l_linenumber").between(1, len(ions))).select("l_orderkey", (F.col("l_quantity") / pick(0)).alias("mmol"), pick(1).alias("z"), pick(2).alias("sign"))
    part = lambda s: F.sum(F.when(F.col("sign") == s, F.col("mmol") * F.col("z")).otherwise(0.0))
    out = rows.groupBy("l_orderkey").agg(part(1.0).alias("cat"), part(-1.0).alias("an"), (0.5 * F.sum(F.col("mmol") * F.col("z") * F.col("z"))).alias("ionic"))
    return out.select("l_orderkey", r("cat").alias("cations"), r("an").alias("anions"), r((F.col("cat") - F.col("an")) / (F.col("cat") + F.col("an")) * 100, 4).alias("balance_percent"), r("ionic").alias("ionic_strength"))
