"""Queries over ordered signals: areas, smoothing, noise, crossings, spectral indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrion.operators import kernels, ordered, ranges

from .base import query, r, table


def curves(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as signals: x in days, y the price; equal days are averaged."""
    o = table(spark, d, "orders").select("o_custkey", (F.unix_timestamp("o_orderdate") / 86400.0).alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return ordered.averaged_duplicates(o, ["o_custkey"], "x", "y", 0)


_CURVES = "SELECT o_custkey, round(epoch(o_orderdate) / 86400.0, 0) AS x, avg(o_totalprice / 1000) AS y FROM orders GROUP BY 1, 2"


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as evenly spaced signals: place and value, by time."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


_TRACES = "SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"


@query(f"SELECT o_custkey, x, round(y, 6) AS y FROM ({_CURVES})")
def duplicate_x_average(spark, d):
    return curves(spark, d).select("o_custkey", "x", r("y").alias("y"))


@query(f"SELECT o_custkey, round(coalesce(sum(p), 0), 7) AS area FROM (SELECT o_custkey, (y + lag(y) OVER w) / 2 * (x - lag(x) OVER w) AS p FROM ({_CURVES}) WINDOW w AS (PARTITION BY o_custkey ORDER BY x)) GROUP BY 1")
def trapezoid_area(spark, d):
    return ordered.trapezoid(curves(spark, d), ["o_custkey"], "x", "y").select("o_custkey", r("area", 7).alias("area"))


@query(f"""WITH p AS (SELECT o_custkey, x, y, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x0, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y0, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM ({_CURVES}) WINDOW w AS (PARTITION BY o_custkey ORDER BY x)),
h AS (SELECT *, x1 - x0 AS a, x - x1 AS b FROM p)
SELECT o_custkey, round(coalesce(sum(CASE WHEN n >= 3 AND n % 2 = 1 THEN (a + b) / 6 * ((2 - b / a) * y0 + (a + b) * (a + b) / (a * b) * y1 + (2 - a / b) * y)
    WHEN m % 2 = 0 AND n = m AND n >= 3 THEN y * (2 * b * b + 3 * a * b) / (6 * (a + b)) + y1 * (b * b + 3 * b * a) / (6 * a) - y0 * b * b * b / (6 * a * (a + b))
    WHEN m = 2 AND n = 2 THEN (y1 + y) / 2 * b END), 0), 3) AS area FROM h GROUP BY 1""")
def simpson_area(spark, d):
    return ordered.simpson(curves(spark, d), ["o_custkey"], "x", "y").select("o_custkey", r("area", 3).alias("area"))


@query("SELECT o_custkey, o_orderkey, round(100.0 * sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS cumulative FROM orders")
def cumulative_mwd(spark, d):
    out = ordered.cumulative(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_custkey", "o_orderkey", r("cumulative").alias("cumulative"))


@query(f"""WITH g AS (SELECT o_custkey, x, y, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b, lag(y) OVER w AS y0, lead(y) OVER w AS y2 FROM ({_CURVES}) WINDOW w AS (PARTITION BY o_custkey ORDER BY x))
SELECT o_custkey, x, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN (y2 - y) / b WHEN b IS NULL THEN (y - y0) / a ELSE (a * a * y2 + (b * b - a * a) * y - b * b * y0) / (a * b * (a + b)) END, 6) AS gradient FROM g""")
def gradient(spark, d):
    return ordered.gradient(curves(spark, d), ["o_custkey"], "x", "y").select("o_custkey", "x", r("gradient").alias("gradient"))


@query(f"SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS baseline FROM ({_TRACES})")
def rolling_median(spark, d):
    return ordered.rolling_median(traces(spark, d), ["user_id"], ["i"], "value", 2).select("event_id", r("baseline").alias("baseline"))


@query(f"SELECT event_id, round((-3 * lag(value, 2) OVER w + 12 * lag(value) OVER w + 17 * value + 12 * lead(value) OVER w - 3 * lead(value, 2) OVER w) / 35.0::DOUBLE, 6) AS smooth FROM ({_TRACES}) WINDOW w AS (PARTITION BY user_id ORDER BY i)")
def savgol_interior(spark, d):
    return ordered.savgol(traces(spark, d), ["user_id"], ["i"], "value", 2).select("event_id", r("smooth").alias("smooth"))


@query(f"SELECT event_id, round((2 * lag(value, 2) OVER w - lag(value) OVER w - 2 * value - lead(value) OVER w + 2 * lead(value, 2) OVER w) / 7.0::DOUBLE, 6) AS curvature FROM ({_TRACES}) WINDOW w AS (PARTITION BY user_id ORDER BY i)")
def savgol_curvature(spark, d):
    return ordered.savgol(traces(spark, d), ["user_id"], ["i"], "value", 2, derivative=2, out="curvature").select("event_id", r("curvature").alias("curvature"))


@query(f"""WITH s AS (SELECT user_id, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS d FROM ({_TRACES}) WINDOW w AS (PARTITION BY user_id ORDER BY i)), k AS (SELECT * FROM s WHERE d IS NOT NULL),
m AS (SELECT user_id, median(d) AS m FROM k GROUP BY 1) SELECT user_id, round(1.4826::DOUBLE * median(abs(d - m)) / sqrt(6), 6) AS sigma FROM k JOIN m USING (user_id) GROUP BY 1""")
def mad_noise(spark, d):
    return ordered.noise_sigma(traces(spark, d), ["user_id"], ["i"], "value").select("user_id", r("sigma").alias("sigma"))


@query(f"""WITH c AS (SELECT o_custkey, x, 100.0 - y / 5 AS y FROM ({_CURVES})), s AS (SELECT o_custkey, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY x)),
h AS (SELECT o_custkey, x, CASE WHEN x0 IS NULL OR y0 = y THEN x ELSE x0 + (60.0::DOUBLE - y0) * (x - x0) / (y - y0) END AS t, y <= 60 AS hit FROM s)
SELECT o_custkey, round(min_by(t, x) FILTER (WHERE hit), 6) AS crossing FROM h GROUP BY 1""")
def crossing_point(spark, d):
    c = curves(spark, d).withColumn("y", 100.0 - F.col("y") / 5)
    return ordered.crossing(c, ["o_custkey"], "x", "y", F.lit(60.0)).select("o_custkey", r("crossing").alias("crossing"))


@query(f"""WITH s AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS b FROM ({_TRACES})), t AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY i) AS a FROM s WHERE b IS NULL OR b <> value)
SELECT event_id, value FROM t WHERE value > b AND value > a AND value >= 100""")
def local_maxima(spark, d):
    return ordered.local_maxima(traces(spark, d), ["user_id"], ["i"], "value", 100.0).select("event_id", "value")


@query(f"SELECT user_id, segment, min_by(i, {{'v': value, 'i': i}}) AS knot, min(value) AS low FROM (SELECT *, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY i) AS INTEGER) AS segment FROM ({_TRACES})) GROUP BY 1, 2")
def rubberband_knots(spark, d):
    out = ordered.segment_minima(traces(spark, d).withColumn("i", F.col("i").cast("long")), ["user_id"], ["i"], "i", "value", 4)
    return out.select("user_id", "segment", F.col("knot_x").alias("knot"), F.col("knot_y").alias("low"))


@query(f"""SELECT o_custkey, max(y) FILTER (WHERE x BETWEEN 9000 - 200 AND 9000 + 200) AS band_a, max(y) FILTER (WHERE x BETWEEN 9500 - 300 AND 9500 + 300) AS band_b FROM (SELECT o_custkey, x, round(y, 6) AS y FROM ({_CURVES})) GROUP BY 1""")
def band_maxima(spark, d):
    c = curves(spark, d).withColumn("y", r("y"))
    return ordered.band_maximum(c, ["o_custkey"], "x", "y", {"band_a": (9000, 200), "band_b": (9500, 300)})


@query(f"""WITH c AS (SELECT o_custkey, x, round(y, 6) AS y FROM ({_CURVES})), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(x - 9000), x) AS k FROM c WHERE abs(x - 9000) <= 250),
s AS (SELECT o_custkey, -regr_slope(ln(y), x) AS slope FROM c WHERE x BETWEEN 8700 AND 9700 AND y > 0 GROUP BY 1)
SELECT o_custkey, n.y AS nearest, round(slope, 9) AS slope FROM (SELECT DISTINCT o_custkey FROM c) LEFT JOIN (SELECT * FROM n WHERE k = 1) n USING (o_custkey) LEFT JOIN s USING (o_custkey)""")
def spectral_indices(spark, d):
    c = curves(spark, d).withColumn("y", r("y"))
    x, y = F.col("x"), F.col("y")
    out = c.groupBy("o_custkey").agg(ordered.nearest_value(x, y, 9000, 250).alias("nearest"), ordered.log_slope(x, y, 8700, 9700).alias("slope"))
    return out.select("o_custkey", "nearest", r("slope", 9).alias("slope"))


@query(f"""WITH c AS (SELECT o_custkey, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ({_CURVES}) WINDOW w AS (PARTITION BY o_custkey ORDER BY x)),
a AS (SELECT o_custkey, CAST(u AS DOUBLE) AS x FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES (8800), (9200), (9600)) t(u))
SELECT a.o_custkey, a.x, round(coalesce(max(e.y), max(c.y + (a.x - c.x) * (c.y1 - c.y) / (c.x1 - c.x))), 4) AS y FROM a LEFT JOIN c ON c.o_custkey = a.o_custkey AND c.x < a.x AND c.x1 > a.x
    LEFT JOIN ({_CURVES}) e ON e.o_custkey = a.o_custkey AND e.x = a.x GROUP BY 1, 2""")
def interp_lookup(spark, d):
    asked = table(spark, d, "orders").select("o_custkey").distinct().select("o_custkey", F.explode(F.array(F.lit(8800.0), F.lit(9200.0), F.lit(9600.0))).alias("x"))
    return ranges.interpolated(asked, curves(spark, d), ["o_custkey"], "x", "x", "y").select("o_custkey", "x", r("y", 4).alias("y"))


@query()
def baseline_asls(spark, d):
    """Baseline of each user's trace; tests hold the kernel against a dense solve."""
    return kernels.baseline(traces(spark, d).withColumn("x", F.col("i").cast("double")), ["user_id"], "x", "value", 100.0)


@query()
def prominent_peaks(spark, d):
    return kernels.find_peaks(traces(spark, d).withColumn("x", F.col("i").cast("double")), ["user_id"], "x", "value", 50.0, 2)


@query()
def greedy_alignment(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 100).alias("mass"), "o_orderstatus")
    return kernels.aligned(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_orderpriority"], "mass", 50.0)
