"""Queries of hulls, peaks, filled matrices, polynomials by key and names that contain each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrion.operators import containment, grids, polynomials, shapes, stats

from .base import query, r, table

#: A supplier's prices by month of shipment, summed in cents and so exactly, as a signal.
_SIGNAL = "SELECT l_suppkey AS k, (year(l_shipdate) * 12 + month(l_shipdate) - 23900)::DOUBLE AS x, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100 AS y FROM lineitem GROUP BY 1, 2"


def _signals(spark, d):
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 23900
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), month.cast("double").alias("x")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100).alias("y"))


@query(f"""WITH s AS (SELECT k, x, ln(y) AS y FROM ({_SIGNAL})), c AS (SELECT p.k, p.x, p.y, min(CASE WHEN a.x = b.x THEN a.y ELSE a.y + (b.y - a.y) * (p.x - a.x) / (b.x - a.x) END) AS base
    FROM s p JOIN s a ON a.k = p.k AND a.x <= p.x JOIN s b ON b.k = p.k AND b.x >= p.x WHERE (a.x < p.x AND b.x > p.x) OR (a.x = p.x AND b.x = p.x) GROUP BY ALL)
SELECT k, x, round(base, 6) AS baseline, round(greatest(y - base, 0), 6) AS corrected FROM c""")
def hull_baselines(spark, d):
    return shapes.hull_baseline(_signals(spark, d).withColumn("y", F.log("y")), ["k"], "x", "y").select("k", "x", r("baseline").alias("baseline"), r("corrected").alias("corrected"))


@query(f"""WITH s AS ({_SIGNAL}), n AS (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after FROM s WINDOW w AS (PARTITION BY k ORDER BY x)), p AS (SELECT k, x, y FROM n WHERE y > before AND y > after),
h AS (SELECT p.k, p.x, p.y, max(q.x) FILTER (WHERE q.x < p.x AND q.y > p.y) AS l, min(q.x) FILTER (WHERE q.x > p.x AND q.y > p.y) AS r FROM p JOIN s q USING (k) GROUP BY ALL),
b AS (SELECT h.k, h.x, h.y, min(q.y) FILTER (WHERE q.x <= h.x AND (l IS NULL OR q.x > l)) AS a, min(q.y) FILTER (WHERE q.x >= h.x AND (r IS NULL OR q.x < r)) AS b FROM h JOIN s q USING (k) GROUP BY ALL)
SELECT k, x, y, round(y - greatest(a, b), 4) AS prominence FROM b WHERE y - greatest(a, b) >= 2000""")
def peak_prominences(spark, d):
    return shapes.peak_table(_signals(spark, d), ["k"], "x", "y", 2000.0).select("k", "x", "y", r("prominence", 4).alias("prominence"))


@query()
def chromatogram_peaks(spark, d):
    """Peaks of users' events as total ion chromatograms."""
    e = table(spark, d, "events").groupBy("user_id", (F.col("event_id") * 37 % 997 * 0.05).alias("t")).agg(F.avg("value").alias("value"))
    return shapes.tic_peaks(e, ["user_id"], "t", "value")


_MATRIX = "SELECT l_suppkey AS k, avg(l_quantity) AS level FROM lineitem GROUP BY 1"


@query(f"""WITH m AS ({_MATRIX}), g AS (SELECT k, level, 300.0::DOUBLE + 10 * i AS em, 240.0::DOUBLE + 15 * j AS ex FROM m, range(20) a(i), range(11) b(j)),
v AS (SELECT *, abs(em - ex - 60) < 25 AND em BETWEEN 320 AND 470 OR CAST(k + em + ex AS BIGINT) % 11 = 3 AND em BETWEEN 330 AND 460 AND ex BETWEEN 270 AND 370 AS missing FROM g)
SELECT k, em, ex, round(level + 0.3::DOUBLE * em - 0.2::DOUBLE * ex, 4) AS value, missing FROM v""")
def filled_matrices(spark, d):
    """Matrices whose scatter bands and single cells are taken out and filled again; their values lie on planes, which a fill must give back."""
    level = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("level"))
    axes = level.select("k", "level", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("k", "level", (300.0 + 10 * F.col("i")).alias("em"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("j"))
    cells = axes.select("k", "em", (240.0 + 15 * F.col("j")).alias("ex"), "level").withColumn("value", F.col("level") + 0.3 * F.col("em") - 0.2 * F.col("ex"))
    band = (F.abs(F.col("em") - F.col("ex") - 60) < 25) & F.col("em").between(320, 470)
    single = ((F.col("k") + F.col("em") + F.col("ex")).cast("long") % 11 == 3) & F.col("em").between(330, 460) & F.col("ex").between(270, 370)
    out = grids.fill_gaps(cells.withColumn("missing", band | single), ["k"], "em", "ex", "value", "missing")
    return out.select("k", "em", "ex", r("value", 4).alias("value"), "missing")


def _moments_sql(degree: int) -> str:
    """Closed solution of the normal equations of standardised x (mean 0, mean square 1) and centred y."""
    sums = ", ".join(f"avg(u ** {k}) AS s{k}" for k in range(3, 7)) + ", " + ", ".join(f"avg(v * u ** {k}) AS t{k}" for k in range(1, 4))
    base = f"""WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice / 1000 + l_quantity * l_quantity / 50 AS y FROM lineitem),
    m AS (SELECT k, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM p GROUP BY 1), u AS (SELECT k, mx, sx, my, n, (x - mx) / sx AS u, y - my AS v FROM p JOIN m USING (k)),
    q AS (SELECT k, mx, sx, my, n, {sums} FROM u GROUP BY ALL), z AS (SELECT *, s4 - 1 - s3 * s3 AS a, s5 - s3 - s3 * s4 AS b, s6 - s3 * s3 - s4 * s4 AS c, t2 - s3 * t1 AS f, t3 - s4 * t1 AS g FROM q),"""
    if degree == 2:
        solved = "w AS (SELECT *, 0 AS c3, f / a AS c2 FROM z),"
    else:
        solved = "w AS (SELECT *, (a * g - b * f) / (a * c - b * b) AS c3, (c * f - b * g) / (a * c - b * b) AS c2 FROM z),"
    return f"""{base} {solved} x AS (SELECT *, t1 - s3 * c2 - s4 * c3 AS c1, -c2 - s3 * c3 AS c0, (25 - mx) / sx AS h FROM w)
    SELECT k, n, round(c1, 6) AS c1, round(c2, 6) AS c2{", round(c3, 6) AS c3" if degree == 3 else ""}, round(my + c0 + c1 * h + c2 * h * h + c3 * h * h * h, 6) AS at_25 FROM x"""


def _curve(spark, d, degree: int):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity", (F.col("l_extendedprice") / 1000 + F.col("l_quantity") * F.col("l_quantity") / 50).alias("y"))
    fit = polynomials.fitted(p, ["k"], "l_quantity", "y", degree)
    return fit.select("k", "n", *[r(f"c{i}").alias(f"c{i}") for i in range(1, degree + 1)], r(polynomials.value_at(F.lit(25.0), degree)).alias("at_25"))


@query(_moments_sql(2))
def quadratic_calibration(spark, d):
    return _curve(spark, d, 2)


@query(_moments_sql(3))
def cubic_calibration(spark, d):
    return _curve(spark, d, 3)


@query("""SELECT a.name, b.file FROM (SELECT 'Nr' || s_suppkey AS name FROM supplier) a JOIN (SELECT 'in-NR' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN ' uv' ELSE '' END AS file FROM part) b ON contains(lower(b.file), lower(a.name)) OR contains(lower(a.name), lower(b.file))""")
def contained_names(spark, d):
    names = table(spark, d, "supplier").select(F.concat(F.lit("Nr"), F.col("s_suppkey").cast("string")).alias("name"))
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(F.concat(F.lit("in-NR"), k.cast("string"), F.when(k % 2 == 0, " uv").otherwise("")).alias("file"))
    return containment.containing(names, files, "name", "file")


@query("""WITH p AS (SELECT l_suppkey, l_extendedprice / 100 AS mass FROM lineitem), c AS (SELECT DISTINCT l_extendedprice / 100 * 1.000002::DOUBLE AS t FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.06),
k AS (SELECT l_suppkey, t, mass, row_number() OVER (PARTITION BY l_suppkey, t ORDER BY abs(mass - t), mass) AS k FROM c JOIN (SELECT DISTINCT l_suppkey, mass FROM p) p ON mass BETWEEN t - t * 5e-6 AND t + t * 5e-6),
e AS (SELECT l_suppkey, mass, mass - t AS y FROM k WHERE k = 1), m AS (SELECT l_suppkey, avg(mass) AS mx, stddev_pop(mass) AS sx, avg(y) AS my, count(*) AS n, max(mass) - min(mass) AS span FROM e GROUP BY 1),
q AS (SELECT l_suppkey, mx, sx, my, n, span, avg(u ** 3) AS s3, avg(u ** 4) AS s4, avg(v * u) AS t1, avg(v * u * u) AS t2 FROM (SELECT m.*, (mass - mx) / nullif(sx, 0) AS u, y - my AS v FROM e JOIN m USING (l_suppkey)) GROUP BY ALL),
w AS (SELECT l_suppkey, max(mass) - min(mass) AS width FROM p GROUP BY 1),
z AS (SELECT *, CASE WHEN n < 3 OR sx = 0 THEN 0 WHEN span / greatest(1, width) >= 0.6 AND abs(s4 - 1 - s3 * s3) > 1e-12 THEN 2 ELSE 1 END AS degree, (t2 - s3 * t1) / nullif(s4 - 1 - s3 * s3, 0) AS c2 FROM q JOIN w USING (l_suppkey)),
r AS (SELECT p.l_suppkey, coalesce(n, 0) AS n_calibrants, coalesce(degree, 0)::INT AS degree, mass - CASE degree WHEN 2 THEN my - c2 + (t1 - s3 * c2) * ((mass - mx) / sx) + c2 * ((mass - mx) / sx) ** 2 WHEN 1 THEN my + t1 * ((mass - mx) / sx) ELSE 0 END AS corrected FROM p LEFT JOIN z USING (l_suppkey))
SELECT l_suppkey, n_calibrants, degree, count(*) AS n_peaks, round(sum(corrected), 4) AS total FROM r GROUP BY 1, 2, 3""")
def curved_recalibration(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select("l_suppkey", (F.col("l_extendedprice") / 100).alias("mass"))
    c = li.where("l_returnflag = 'N' AND l_discount > 0.06").select((F.col("l_extendedprice") / 100 * 1.000002).alias("t"))
    out = polynomials.recalibrated(p, c, ["l_suppkey"], "mass", "t", 5.0)
    return out.groupBy("l_suppkey", "n_calibrants", "degree").agg(F.count("*").alias("n_peaks"), r(F.sum("corrected"), 4).alias("total"))


@query()
def score_ellipsoids(spark, d):
    """T-squared ellipsoids of suppliers' three mean values by nation."""
    means = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return stats.hotelling_ellipsoid(means.withColumn("nation", F.col("l_suppkey") % 7), ["nation"], ["l_quantity", "l_discount", "l_tax"])
