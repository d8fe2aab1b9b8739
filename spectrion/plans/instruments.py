"""Queries of the instruments' descriptors; signals and samples are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrion.operators import chains, ordered, spectra

from .base import query, r, table


def _spectrum(spark, d, low: float, high: float):
    """Users' events as spectra: x spread over the range by event number, equal x averaged."""
    e = table(spark, d, "events").select("user_id", (F.lit(low) + F.col("event_id") * 37 % 997 * ((high - low) / 997.0)).alias("x"), F.col("value").alias("y"))
    return ordered.averaged_duplicates(e, ["user_id"], "x", "y", 6)


def _spectrum_sql(low: float, high: float) -> str:
    return f"SELECT user_id, round({low}::DOUBLE + event_id * 37 % 997 * {(high - low) / 997.0!r}::DOUBLE, 6) AS x, avg(value) AS y FROM events GROUP BY 1, 2"


def _simpson_sql(source: str, keys: str) -> str:
    """Simpson areas of (keys, x, y)."""
    return f"""SELECT {keys}, coalesce(sum(CASE WHEN n >= 3 AND n % 2 = 1 THEN (a + b) / 6 * ((2 - b / a) * y0 + (a + b) * (a + b) / (a * b) * y1 + (2 - a / b) * y)
    WHEN m % 2 = 0 AND n = m AND n >= 3 THEN y * (2 * b * b + 3 * a * b) / (6 * (a + b)) + y1 * (b * b + 3 * b * a) / (6 * a) - y0 * b * b * b / (6 * a * (a + b))
    WHEN m = 2 AND n = 2 THEN (y1 + y) / 2 * b END), 0) AS area FROM (SELECT *, x1 - x0 AS a, x - x1 AS b FROM (SELECT *, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x0, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y0,
    row_number() OVER w AS n, count(*) OVER (PARTITION BY {keys}) AS m FROM ({source}) WINDOW w AS (PARTITION BY {keys} ORDER BY x))) GROUP BY {keys}"""


_BINS = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in spectra.NMR_BINS.items())


@query(f"""WITH s AS ({_spectrum_sql(0, 220)}), c AS (SELECT user_id, bin, x, y FROM s JOIN (VALUES {_BINS}) t(bin, lo, hi) ON x BETWEEN lo AND hi), a AS ({_simpson_sql('SELECT * FROM c', 'user_id, bin')}),
p AS (SELECT user_id, {", ".join(f"coalesce(sum(greatest(area, 0)) FILTER (WHERE bin = '{n}'), 0) * 100 / nullif(sum(greatest(area, 0)), 0) AS {n}" for n in spectra.NMR_BINS)} FROM a GROUP BY 1)
SELECT user_id, {", ".join(f"round({n}, 6) AS {n}" for n in spectra.NMR_BINS)}, round(aromatic + phenolic, 6) AS fa,
    round(CASE WHEN methoxy + o_alkyl + acetal + carboxyl + carbonyl >= 1e-4 THEN (alkyl + aromatic + phenolic) / (methoxy + o_alkyl + acetal + carboxyl + carbonyl) END, 6) AS hb_hi,
    round(CASE WHEN aromatic + phenolic >= 1e-4 THEN carboxyl / (aromatic + phenolic) END, 6) AS coo_ar FROM p""")
def nmr_descriptors(spark, d):
    out = spectra.nmr_descriptors(_spectrum(spark, d, 0.0, 220.0), ["user_id"], "x", "y")
    return out.select("user_id", *[r(c).alias(c) for c in [*spectra.NMR_BINS, "fa", "hb_hi", "coo_ar"]])


_NEAR = "min_by(y, {{'d': abs(x - {w}), 'x': x}}) FILTER (WHERE abs(x - {w}) <= 5)"
_SLOPE = "-regr_slope(ln(y), x) FILTER (WHERE x BETWEEN {a} AND {b} AND y > 0)"


@query(f"""WITH s AS ({_spectrum_sql(200, 700)}), a AS (SELECT user_id, {", ".join(f"{_NEAR.format(w=w)} AS a{w}" for w in (250, 254, 365, 465, 665))}, {_SLOPE.format(a=275, b=295)} AS s275, {_SLOPE.format(a=350, b=400)} AS s350 FROM s GROUP BY 1)
SELECT user_id, round(a254, 6) AS a254, round(CASE WHEN a365 > 0 THEN a250 / a365 END, 6) AS e2_e3, round(CASE WHEN a665 > 0 THEN a465 / a665 END, 6) AS e4_e6, round(s275, 7) AS s275, round(s350, 7) AS s350,
    round(CASE WHEN a365 > 0 AND a250 / a365 > 0 AND a250 / a365 <= 7.82 THEN 3450 - 390 * (a250 / a365) END, 4) AS mass_estimate, round(CASE WHEN user_id % 9 > 0 THEN a254 / (user_id % 9) * 100 END, 6) AS suva254 FROM a""")
def uv_descriptors(spark, d):
    out = spectra.uv_descriptors(_spectrum(spark, d, 200.0, 700.0), ["user_id"], "x", "y", (F.col("user_id") % 9).cast("double"))
    return out.select("user_id", *[r(c).alias(c) for c in ("a254", "e2_e3", "e4_e6")], r("s275", 7).alias("s275"), r("s350", 7).alias("s350"), r("mass_estimate", 4).alias("mass_estimate"), r("suva254").alias("suva254"))


_GRID = """SELECT l_suppkey, 240.0::DOUBLE + l_orderkey * 7 % 22 * 10 AS ex, 280.0::DOUBLE + l_partkey * 3 % 65 * 5 AS em, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3"""
_SPOT = "min_by(value, {{'a': abs(ex - {x}), 'b': abs(em - {m}), 'c': ex, 'd': em}}) FILTER (WHERE abs(ex - {x}) <= 5 AND abs(em - {m}) <= 5)"


@query(f"""WITH g AS ({_GRID}), s AS (SELECT l_suppkey, {_SPOT.format(x=370, m=470)} AS a, {_SPOT.format(x=370, m=520)} AS b, {_SPOT.format(x=310, m=380)} AS c, {_SPOT.format(x=310, m=430)} AS e FROM g GROUP BY 1),
f AS (SELECT l_suppkey, min_by(ex, {{'d': abs(ex - 254), 'x': ex}}) AS ex FROM g WHERE abs(ex - 254) <= 5 GROUP BY 1), l AS (SELECT g.l_suppkey, em AS x, value AS y FROM g JOIN f ON g.l_suppkey = f.l_suppkey AND g.ex = f.ex),
h AS ({_simpson_sql('SELECT * FROM l WHERE x BETWEEN 435 AND 480', 'l_suppkey')}), w AS ({_simpson_sql('SELECT * FROM l WHERE x BETWEEN 300 AND 345', 'l_suppkey')})
SELECT s.l_suppkey, round(CASE WHEN b > 0 THEN a / b END, 6) AS fi, round(CASE WHEN e > 0 THEN c / e END, 6) AS bix, round(CASE WHEN w.area > 0 THEN h.area / w.area END, 6) AS hix FROM s LEFT JOIN h USING (l_suppkey) LEFT JOIN w USING (l_suppkey)""")
def eem_descriptors(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", (F.lit(240.0) + F.col("l_orderkey") * 7 % 22 * 10).alias("ex"), (F.lit(280.0) + F.col("l_partkey") * 3 % 65 * 5).alias("em")).agg(F.avg("l_quantity").alias("value"))
    out = spectra.eem_descriptors(g, ["l_suppkey"], "ex", "em", "value")
    return out.select("l_suppkey", *[r(c).alias(c) for c in ("fi", "bix", "hix")])


_BANDS = ", ".join(f"max(y) FILTER (WHERE x BETWEEN {c} - {h} AND {c} + {h}) AS {n}" for n, (c, h) in spectra.FTIR_BANDS.items())


@query(f"""WITH s AS ({_spectrum_sql(650, 4000)}), b AS (SELECT user_id, {_BANDS}, max(abs(y)) AS top FROM s GROUP BY 1), q AS (SELECT user_id, y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY x)),
m AS (SELECT user_id, median(d) AS m FROM q WHERE d IS NOT NULL GROUP BY 1), n AS (SELECT user_id, 1.4826::DOUBLE * median(abs(d - m)) / sqrt(6) AS sigma FROM q JOIN m USING (user_id) WHERE d IS NOT NULL GROUP BY 1)
SELECT user_id, {", ".join(f"round(CASE WHEN {e} > greatest(3 * coalesce(sigma, 0), 0.01 * top) THEN {a} / {e} END, 6) AS {k}" for k, (a, e) in spectra.FTIR_RATIOS.items())} FROM b LEFT JOIN n USING (user_id)""")
def ftir_descriptors(spark, d):
    out = spectra.ftir_descriptors(_spectrum(spark, d, 650.0, 4000.0), ["user_id"], "x", "y")
    return out.select("user_id", *[r(c).alias(c) for c in spectra.FTIR_RATIOS])


_SLICES = "SELECT l_suppkey, l_quantity AS s, pow(10.0, least(7.0, greatest(1.0, 6.2::DOUBLE - 0.06::DOUBLE * (l_extendedprice / 1000)))) AS m FROM lineitem"


@query(f"""SELECT l_suppkey, round(CASE WHEN max(m) > 20000 THEN 100.0 * sum(CASE WHEN m >= 20000 THEN s ELSE 0 END) / sum(s) END, 6) AS fraction_1,
    round(CASE WHEN max(m) > 5000 AND min(m) < 20000 THEN 100.0 * sum(CASE WHEN m >= 5000 AND m < 20000 THEN s ELSE 0 END) / sum(s) END, 6) AS fraction_2,
    round(CASE WHEN max(m) > 1000 AND min(m) < 5000 THEN 100.0 * sum(CASE WHEN m >= 1000 AND m < 5000 THEN s ELSE 0 END) / sum(s) END, 6) AS fraction_3,
    round(CASE WHEN max(m) > 0 AND min(m) < 1000 THEN 100.0 * sum(CASE WHEN m >= 0 AND m < 1000 THEN s ELSE 0 END) / sum(s) END, 6) AS fraction_4 FROM ({_SLICES}) GROUP BY 1""")
def sec_fractions(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("s"), (F.col("l_extendedprice") / 1000).alias("v"))
    out = spectra.sec_fractions(li.withColumn("m", spectra.sec_masses(li, "v", [6.2, -0.06])), ["l_suppkey"], "s", "m")
    return out.select("l_suppkey", *[r(f"fraction_{i}").alias(f"fraction_{i}") for i in range(1, 5)])


_TGA = "SELECT l_suppkey, 20.0::DOUBLE + l_orderkey % 90 * 10 AS t, avg(100 - (l_orderkey % 90) * (l_suppkey % 7 + 3) / 10.0::DOUBLE) AS m FROM lineitem GROUP BY 1, 2"
_AT = "coalesce(max(m) FILTER (WHERE t = {b}), max(m + ({b} - t) * (m1 - m) / (t1 - t)) FILTER (WHERE t < {b} AND t1 > {b}))"
_CROSS = "min_by(CASE WHEN t0 IS NULL OR m0 = m THEN t ELSE t0 + ({s} * dry - m0) * (t - t0) / (m - m0) END, t) FILTER (WHERE m <= {s} * dry)"


@query(f"""WITH p AS ({_TGA}), n AS (SELECT *, lead(t) OVER w AS t1, lead(m) OVER w AS m1 FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY t)),
b AS (SELECT l_suppkey, {", ".join(f"{_AT.format(b=b)} AS m{b}" for b in (25, 150, 350, 550))} FROM n GROUP BY 1),
c AS (SELECT p.l_suppkey, t, m, m150 AS dry, lag(t) OVER w AS t0, lag(m) OVER w AS m0 FROM p JOIN b USING (l_suppkey) WHERE t >= 150 AND m150 IS NOT NULL WINDOW w AS (PARTITION BY p.l_suppkey ORDER BY t)),
x AS (SELECT l_suppkey, {_CROSS.format(s='0.95::DOUBLE')} AS t5, {_CROSS.format(s='0.5::DOUBLE')} AS t50 FROM c GROUP BY 1)
SELECT b.l_suppkey, round(m25 - m150, 6) AS loss_moisture, round(m150 - m350, 6) AS loss_aliphatic, round(m350 - m550, 6) AS loss_aromatic, round(CASE WHEN m150 - m350 >= 1e-4 THEN (m350 - m550) / (m150 - m350) END, 6) AS thermostability,
    round(t5, 4) AS t5, round(t50, 4) AS t50 FROM b LEFT JOIN x USING (l_suppkey)""")
def tga_descriptors(spark, d):
    k = F.col("l_orderkey") % 90
    p = table(spark, d, "lineitem").groupBy("l_suppkey", (F.lit(20.0) + k * 10).alias("t")).agg(F.avg(100 - k * (F.col("l_suppkey") % 7 + 3) / 10.0).alias("m"))
    out = spectra.tga_descriptors(p, ["l_suppkey"], "t", "m")
    return out.select("l_suppkey", *[r(c).alias(c) for c in ("loss_moisture", "loss_aliphatic", "loss_aromatic", "thermostability")], r("t5", 4).alias("t5"), r("t50", 4).alias("t50"))


_EL = """SELECT p_partkey, 40.0::DOUBLE + p_partkey % 20 AS c, 3.0::DOUBLE + p_partkey % 5 AS h, p_partkey % 3 * 1.0::DOUBLE AS n, p_partkey % 2 * 0.5::DOUBLE AS s, 20.0::DOUBLE + p_size % 20 AS o, p_partkey % 11 * 1.0::DOUBLE AS ash, p_partkey % 4 * 1.0::DOUBLE AS moisture,
    CASE p_partkey % 3 WHEN 0 THEN 'as_received' WHEN 1 THEN 'dry' ELSE 'daf' END AS basis FROM part"""


@query(f"""WITH k AS (SELECT *, 100.0 / CASE basis WHEN 'as_received' THEN 100 - ash - moisture WHEN 'dry' THEN 100 - ash ELSE 100 END AS k FROM ({_EL})), d AS (SELECT p_partkey, c * k AS c, h * k AS h, n * k AS n, s * k AS s, o * k AS o FROM k),
q AS (SELECT *, h / 1.008::DOUBLE / (c / 12.011::DOUBLE) AS hc, o / 15.999::DOUBLE / (c / 12.011::DOUBLE) AS oc, n / 14.007::DOUBLE / (c / 12.011::DOUBLE) AS nc, s / 32.065::DOUBLE / (c / 12.011::DOUBLE) AS sc FROM d)
SELECT p_partkey, round(hc, 6) AS h_c, round(oc, 6) AS o_c, round(-(hc - 3 * nc - 2 * oc - 2 * sc), 6) AS nosc, round(CASE WHEN 1 - oc - sc - 0.5 * (hc + nc) > 0 AND 1 - oc - sc - nc > 0 THEN (1 - oc - sc - 0.5 * (hc + nc)) / (1 - oc - sc - nc) ELSE 0 END, 6) AS ai,
    round((0.3383::DOUBLE * c + 1.443::DOUBLE * (h - o / 8.0::DOUBLE) + 0.0942::DOUBLE * s) / (0.339::DOUBLE * c + 1.256::DOUBLE * h - 0.1088::DOUBLE * (o - s)), 6) AS hhv_ratio FROM q""")
def elemental_descriptors(spark, d):
    k = F.col("p_partkey")
    one = lambda x: x * 1.0
    samples = table(spark, d, "part").select(
        "p_partkey", (40.0 + k % 20).alias("c"), (3.0 + k % 5).alias("h"), one(k % 3).alias("n"), (k % 2 * 0.5).alias("s"), (20.0 + F.col("p_size") % 20).alias("o"), one(k % 11).alias("ash"), one(k % 4).alias("moisture"),
        F.when(k % 3 == 0, "as_received").when(k % 3 == 1, "dry").otherwise("daf").alias("basis"),
    )
    out = spectra.elemental_descriptors(samples)
    return out.select("p_partkey", *[r(c).alias(c) for c in ("h_c", "o_c", "nosc", "ai")], r(F.col("hhv_dulong") / F.col("hhv_mendeleev")).alias("hhv_ratio"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN -32.0::DOUBLE + c_custkey % 9 END AS c, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 7) * 1.0::DOUBLE END AS n, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 10) * 1.0::DOUBLE END AS s, c_acctbal / 100 AS h, c_acctbal / 1000 AS o, c_custkey % 2 = 0 AS w FROM customer),
k AS (SELECT *, CASE WHEN s IS NULL THEN 0 WHEN s >= 4 THEN 0.5::DOUBLE * least(1, (s - 3.5::DOUBLE) / 4) ELSE 0 END + CASE WHEN c IS NULL THEN 0 WHEN c > -28.5 THEN 0.3::DOUBLE * least(1, (c + 29) / 2) ELSE 0 END + CASE WHEN n BETWEEN 0.5 AND 4.5 THEN 0.2::DOUBLE ELSE 0 END AS sc,
    CASE WHEN s IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN n IS NULL THEN 0 ELSE 0.2::DOUBLE END AS w2 FROM s)
SELECT c_custkey, round(CASE WHEN w THEN h - 8.0 * o END, 6) AS d_excess, round(CASE WHEN w2 > 0 THEN least(1.0, greatest(0.0, sc / w2)) END, 6) AS kraft_score FROM k""")
def isotope_descriptors(spark, d):
    k = F.col("c_custkey")
    samples = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 4 > 0, -32.0 + k % 9).alias("d13c"), F.when(k % 5 > 0, k % 7 * 1.0).alias("d15n"), F.when(k % 3 > 0, k % 10 * 1.0).alias("d34s"),
        (F.col("c_acctbal") / 100).alias("d2h"), (F.col("c_acctbal") / 1000).alias("d18o"), (k % 2 == 0).alias("is_water"),
    )
    return spectra.isotope_descriptors(samples).select("c_custkey", r("d_excess").alias("d_excess"), r("kraft_score").alias("kraft_score"))


@query("""WITH x AS (SELECT l_orderkey, sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS so4, sum(l_quantity) FILTER (WHERE l_linenumber = 2) / 10 AS cl, sum(l_quantity) FILTER (WHERE l_linenumber = 3) / 5 AS ac, sum(l_quantity) FILTER (WHERE l_linenumber = 4) AS na FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(least(1.0, greatest(0.0, CASE WHEN so4 > 20 THEN 0.4::DOUBLE * least(1.0, (so4 - 20) / 80) ELSE 0 END + CASE WHEN cl > 0 AND so4 / cl > 13 THEN 0.3::DOUBLE * least(1.0, (so4 / cl - 13) / 13) ELSE 0 END
    + CASE WHEN ac > 1.5 THEN 0.2::DOUBLE * least(1.0, (ac - 1.5::DOUBLE) / 15) ELSE 0 END + CASE WHEN na > 15 THEN 0.1::DOUBLE * least(1.0, (na - 15) / 50) ELSE 0 END)), 6) AS score FROM x""")
def kraft_water_score(spark, d):
    pick = lambda n: F.sum(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(pick(1).alias("so4"), (pick(2) / 10).alias("cl"), (pick(3) / 5).alias("ac"), pick(4).alias("na"))
    return x.select("l_orderkey", r(spectra.kraft_water_score(F.col("so4"), F.col("cl"), F.col("ac"), F.col("na"))).alias("score"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 9 - 4) * 0.5::DOUBLE END AS ppm, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 101 * 1.0::DOUBLE END AS f, CASE WHEN p_partkey % 4 > 0 THEN p_size * 2.0::DOUBLE END AS n FROM part),
m AS (SELECT *, CASE WHEN ppm IS NOT NULL THEN greatest(0.0, 100.0 - 25.0 * abs(ppm) / 2.0) END AS ms FROM x)
SELECT p_partkey, round((coalesce(ms * 0.2::DOUBLE, 0) + coalesce(f * 0.35::DOUBLE, 0) + coalesce(n * 0.3::DOUBLE, 0)) / nullif(CASE WHEN ms IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN f IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN n IS NULL THEN 0 ELSE 0.3::DOUBLE END, 0), 6) AS score FROM m""")
def structure_concordance(spark, d):
    k = F.col("p_partkey")
    ppm, ftir, nmr = F.when(k % 5 > 0, (k % 9 - 4) * 0.5), F.when(k % 3 > 0, k % 101 * 1.0), F.when(k % 4 > 0, F.col("p_size") * 2.0)
    return table(spark, d, "part").select("p_partkey", r(spectra.concordance(ppm, 2.0, ftir, nmr, F.lit(None).cast("double"))).alias("score"))


_BAND = "max(c) FILTER (WHERE x BETWEEN {m} - {h} AND {m} + {h})"


@query(f"""WITH s AS (SELECT * FROM ({_spectrum_sql(400, 4000)})), e AS (SELECT user_id, arg_min(y, x) AS a, arg_max(y, x) AS b, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT user_id, x, greatest(y - (a + (b - a) * coalesce((row_number() OVER (PARTITION BY user_id ORDER BY x) - 1) / nullif(n - 1, 0)::DOUBLE, 0)), 0) AS c FROM s JOIN e USING (user_id))
SELECT user_id, {", ".join(f"round({_BAND.format(m=spectra.FTIR_BANDS[n][0], h=spectra.FTIR_BANDS[n][1])}, 6) AS {n}" for n in ("i3400", "i1650", "i1600", "i1030"))} FROM c GROUP BY 1""")
def infrared_chain(spark, d):
    e = table(spark, d, "events").select("user_id", (F.lit(400.0) + F.col("event_id") * 37 % 997 * (3600.0 / 997.0)).alias("x"), F.col("value").alias("y"))
    out = chains.infrared(e, ["user_id"], "x", "y", "linear")
    return out.select("user_id", *[r(n).alias(n) for n in ("i3400", "i1650", "i1600", "i1030")])
