"""Analytics over ordered signals. A signal is the set of rows of a key; windows never run over more than one signal."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], x: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*x)


def averaged_duplicates(points: DataFrame, keys: list[str], x: str, y: str, digits: int) -> DataFrame:
    """Points with equal rounded x become one with the mean y."""
    return points.groupBy(*keys, F.round(x, digits).alias(x)).agg(F.avg(y).alias(y))


def trapezoid(points: DataFrame, keys: list[str], x: str, y: str, order: list[str] | None = None) -> DataFrame:
    """Area under each signal."""
    w = _order(keys, order or [x])
    part = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return points.withColumn("_part", part).groupBy(*keys).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("area"))


def simpson(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Composite Simpson area of each signal with uneven steps.

    Pairs of intervals are fitted by parabolas; with an odd number of intervals
    the last one gets the parabola through the last three points.
    """
    w = _order(keys, [x])
    h0, h1 = F.col("x1") - F.col("x0"), F.col("x2") - F.col("x1")
    rows = points.select(
        *keys, F.lag(x, 2).over(w).alias("x0"), F.lag(x, 1).over(w).alias("x1"), F.col(x).alias("x2"),
        F.lag(y, 2).over(w).alias("y0"), F.lag(y, 1).over(w).alias("y1"), F.col(y).alias("y2"),
        F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy(*keys)).alias("total"),
    )
    pair = (h0 + h1) / 6 * ((2 - h1 / h0) * F.col("y0") + (h0 + h1) * (h0 + h1) / (h0 * h1) * F.col("y1") + (2 - h0 / h1) * F.col("y2"))
    last = F.col("y2") * (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) + F.col("y1") * (h1 * h1 + 3 * h1 * h0) / (6 * h0) - F.col("y0") * h1 * h1 * h1 / (6 * h0 * (h0 + h1))
    even = F.col("total") % 2 == 0
    part = F.when((F.col("n") >= 3) & (F.col("n") % 2 == 1), pair).when(even & (F.col("n") == F.col("total")) & (F.col("n") >= 3), last)
    two = F.when((F.col("total") == 2) & (F.col("n") == 2), (F.col("y1") + F.col("y2")) / 2 * h1)
    return rows.withColumn("_part", F.coalesce(part, two)).groupBy(*keys).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("area"))


def cumulative(points: DataFrame, keys: list[str], order: list[str], y: str, out: str = "cumulative") -> DataFrame:
    """Running sum as percentage of the signal's sum."""
    run = F.sum(y).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn(out, 100.0 * F.try_divide(run, F.sum(y).over(Window.partitionBy(*keys))))


def running_maximum(points: DataFrame, keys: list[str], order: list[str], y: str, out: str = "highest") -> DataFrame:
    """Highest value of a signal up to each point."""
    return points.withColumn(out, F.max(y).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def cropped(points: DataFrame, keys: list[str], x: str, low: float, high: float) -> DataFrame:
    """Points of each signal with x in [low, high]; a signal without any there stays whole."""
    inside = F.col(x).between(low, high)
    some = points.groupBy(*keys).agg(F.bool_or(inside).alias("_some"))
    return points.join(some, keys).where(inside | ~F.coalesce("_some", F.lit(False))).drop("_some")


def gradient(points: DataFrame, keys: list[str], x: str, y: str, out: str = "gradient") -> DataFrame:
    """Second-order derivative estimate for uneven steps, one-sided at the ends; null for a single point."""
    w = _order(keys, [x])
    hd, hs = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    middle = (hd * hd * after + (hs * hs - hd * hd) * F.col(y) - hs * hs * before) / (hs * hd * (hd + hs))
    return points.withColumn(out, F.when(hd.isNull() & hs.isNull(), None).when(hd.isNull(), (after - F.col(y)) / hs).when(hs.isNull(), (F.col(y) - before) / hd).otherwise(middle))


def rolling_median(points: DataFrame, keys: list[str], order: list[str], y: str, half: int, out: str = "baseline") -> DataFrame:
    """Exact median of up to 2 half + 1 neighbours; the frame is cut at the ends."""
    frame = _order(keys, order).rowsBetween(-half, half)
    return points.withColumn(out, F.percentile(y, 0.5).over(frame))


def savgol_weights(half: int, derivative: int = 0, degree: int = 2, at: int = 0) -> list[float]:
    """Weights of the neighbours -half..half for a polynomial fit's value or derivative at the neighbour ``at``."""
    import math

    import numpy as np

    x = np.arange(-half, half + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    power = [math.perm(k, derivative) * float(at) ** (k - derivative) if k >= derivative else 0.0 for k in range(degree + 1)]
    return [float(v) for v in np.array(power) @ fit]


def savgol(points: DataFrame, keys: list[str], order: list[str], y: str, half: int, derivative: int = 0, degree: int = 2, out: str = "smooth", ends: bool = False) -> DataFrame:
    """Savitzky-Golay smoothing (or derivative per step) of evenly spaced points.

    Within ``half`` of an end the result is null or, with ``ends``, the value
    of the polynomial through the window at that end; signals shorter than a
    window have none.
    """
    w = _order(keys, order)

    def fit(at: int) -> Column:
        weights = zip(range(-half - at, half - at + 1), savgol_weights(half, derivative, degree, at))
        return reduce(add, [(F.lag(y, -k).over(w) if k < 0 else F.lead(y, k).over(w) if k else F.col(y)) * c for k, c in weights])

    total = fit(0)
    if ends:
        place, size = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
        for at in range(1, half + 1):
            total = F.when(place == half + 1 - at, fit(-at)).when(place == size - half + at, fit(at)).otherwise(total)
        total = F.when(size > 2 * half, total)
    return points.withColumn(out, total)


def noise_sigma(points: DataFrame, keys: list[str], order: list[str], y: str) -> DataFrame:
    """Noise from the median absolute deviation of second differences."""
    w = _order(keys, order)
    second = points.select(*keys, (F.col(y) - 2 * F.lag(y, 1).over(w) + F.lag(y, 2).over(w)).alias("_d")).where("_d IS NOT NULL")
    centre = second.groupBy(*keys).agg(F.median("_d").alias("_m"))
    return second.join(centre, keys).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col("_d") - F.col("_m"))) / (6**0.5)).alias("sigma"))


def crossings(points: DataFrame, keys: list[str], x: str, y: str, targets: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """For each target the first x at which y is at or below it, interpolated from the point before; null if none."""
    w = _order(keys, order or [x])
    named = [t.alias(f"_t{i}") for i, t in enumerate(targets.values())]
    rows = points.select(*keys, *(order or []), F.col(x).alias("_x1"), F.col(y).alias("_y1"), F.lag(x).over(w).alias("_x0"), F.lag(y).over(w).alias("_y0"), *named)
    found = []
    for i, name in enumerate(targets):
        t, hit = F.col(f"_t{i}"), F.col("_y1") <= F.col(f"_t{i}")
        at = F.when(F.col("_x0").isNull() | (F.col("_y0") == F.col("_y1")), F.col("_x1")).otherwise(F.col("_x0") + (t - F.col("_y0")) * (F.col("_x1") - F.col("_x0")) / (F.col("_y1") - F.col("_y0")))
        found.append(F.min_by(F.when(hit, at), F.when(hit, F.struct(*(order or ["_x1"])))).alias(name))
    return rows.groupBy(*keys).agg(*found)


def crossing(points: DataFrame, keys: list[str], x: str, y: str, target: Column, order: list[str] | None = None) -> DataFrame:
    """``crossings`` for one target, in column ``crossing``."""
    return crossings(points, keys, x, y, {"crossing": target}, order)


def local_maxima(points: DataFrame, keys: list[str], order: list[str], y: str, least: float = 0.0) -> DataFrame:
    """Points higher than both neighbours and at least ``least``; of a flat top its first point."""
    w = _order(keys, order)
    # compare with the next different value: steps of equal values are left out
    steps = points.withColumn("_before", F.lag(y).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(y))).withColumn("_after", F.lead(y).over(w))
    return steps.where((F.col(y) > F.col("_before")) & (F.col(y) > F.col("_after")) & (F.col(y) >= least)).drop("_before", "_after")


def segment_minima(points: DataFrame, keys: list[str], order: list[str], x: str, y: str, segments: int) -> DataFrame:
    """Lowest point of each of ``segments`` equal stretches of a signal: knots of a baseline."""
    part = points.withColumn("segment", F.ntile(segments).over(_order(keys, order)))
    return part.groupBy(*keys, "segment").agg(F.min_by(x, F.struct(y, x)).alias("knot_x"), F.min(y).alias("knot_y"))


def band_maximum(points: DataFrame, keys: list[str], x: str, y: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Highest y in each named band (centre, half width) of a signal; null where the band has no point."""
    return points.groupBy(*keys).agg(*[F.max(F.when(F.col(x).between(c - h, c + h), F.col(y))).alias(n) for n, (c, h) in bands.items()])


def nearest_value(x: Column, y: Column, target: float, tolerance: float) -> Column:
    """Aggregate: y at the x nearest to the target, null beyond the tolerance; of equals the lower x."""
    near = F.abs(x - target)
    return F.min_by(F.when(near <= tolerance, y), F.when(near <= tolerance, F.struct(near, x)))


def log_slope(x: Column, y: Column, low: float, high: float) -> Column:
    """Aggregate: negative slope of ln y over x in [low, high]."""
    inside = x.between(low, high) & (y > 0)
    return -F.regr_slope(F.when(inside, F.log(y)), F.when(inside, x))
