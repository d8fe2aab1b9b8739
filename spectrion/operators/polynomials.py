"""Polynomials fitted by key from sums of powers: one pass for middle and spread, one for the sums, the rest is expressions."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _solved(normal: list[list[Column]], right: list[Column]) -> list[Column]:
    """Coefficients of symmetric normal equations by elimination, written out as expressions; null where they have no one solution."""
    n = len(right)
    a = [[*row, right[i]] for i, row in enumerate(normal)]
    for k in range(n):
        pivot = F.when(F.abs(a[k][k]) > 1e-12, a[k][k])
        for i in range(k + 1, n):
            share = a[i][k] / pivot
            a[i] = [None] * (k + 1) + [a[i][j] - share * a[k][j] for j in range(k + 1, n + 1)]
    out: list[Column] = [None] * n
    for i in reversed(range(n)):
        left = a[i][n]
        for j in range(i + 1, n):
            left = left - a[i][j] * out[j]
        out[i] = left / F.when(F.abs(a[i][i]) > 1e-12, a[i][i])
    return out


def _sums(points: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """(keys, n, low, high, middle, spread, _level, means of powers and products): what fits up to a degree are solved from."""
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    size = known.groupBy(*keys).agg(F.avg("_x").alias("middle"), F.stddev_pop("_x").alias("spread"), F.avg("_y").alias("_level"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    u = F.col("_x") - F.col("middle")
    u = F.when(F.col("spread") > 0, u / F.col("spread")).otherwise(0.0)
    v = F.col("_y") - F.col("_level")
    power = lambda k: F.lit(1.0) if not k else u if k == 1 else F.pow(u, F.lit(float(k)))
    return known.join(size, keys).groupBy(*keys, "middle", "spread", "_level", "low", "high").agg(
        F.count("*").alias("n"), *[F.avg(power(k)).alias(f"_s{k}") for k in range(2 * degree + 1)], *[F.avg(v * power(k)).alias(f"_t{k}") for k in range(degree + 1)], F.avg(v * v).alias("_vv"),
    )


def _coefficients(degree: int) -> list[Column]:
    """Coefficients of y less its level, over a row of ``_sums`` of this degree or a higher one."""
    return _solved([[F.col(f"_s{i + j}") for j in range(degree + 1)] for i in range(degree + 1)], [F.col(f"_t{i}") for i in range(degree + 1)])


def fitted(points: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """(keys, n, low, high, middle, spread, c0.., r2): y by powers of (x - middle) / spread, with the range of x in which it holds.

    Null coefficients mean fewer different x than coefficients.
    """
    if not 1 <= degree <= 3:
        raise ValueError("degrees 1 to 3")
    made = _sums(points, keys, x, y, degree).withColumns({f"_c{i}": e for i, e in enumerate(_coefficients(degree))})
    explained = sum((F.col(f"_c{i}") * F.col(f"_t{i}") for i in range(1, degree + 1)), F.col("_c0") * F.col("_t0"))
    r2 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(explained, F.col("_vv"))))
    return made.select(*keys, "n", "low", "high", "middle", "spread", *[(F.col(f"_c{i}") + (F.col("_level") if not i else 0.0)).alias(f"c{i}") for i in range(degree + 1)], r2.alias("r2"))


def value_at(x: Column, degree: int) -> Column:
    """The fitted value at x, over a row of ``fitted``."""
    u = F.try_divide(x - F.col("middle"), F.col("spread"))
    out = F.col(f"c{degree}")
    for i in reversed(range(degree)):
        out = out * u + F.col(f"c{i}")
    return out


def plain_coefficients(degree: int) -> dict[str, Column]:
    """Coefficients by powers of x itself, as ``a0`` and so on, over a row of ``fitted``."""
    m, s = F.col("middle"), F.col("spread")
    out = {}
    for k in range(degree + 1):
        out[f"a{k}"] = sum((F.try_divide(F.col(f"c{i}"), F.pow(s, F.lit(float(i)))) * (comb(i, k) * F.pow(-m, F.lit(float(i - k)))) for i in range(k, degree + 1)), F.lit(0.0))
    return out


def calibrated(points: DataFrame, standards: DataFrame, keys: list[str], x: str, known: str, found: str, degree: int = 2, out: str = "calibrated") -> DataFrame:
    """Points with ``out``: x corrected by the polynomial of its key's standards (``found`` against ``known``); outside the standards' range, or without a fit, it is null."""
    fit = fitted(standards, keys, found, known, degree)
    joined = points.join(fit, keys, "left")
    inside = F.col(x).between(F.col("low"), F.col("high"))
    return joined.withColumn(out, F.when(inside, value_at(F.col(x), degree))).select(*points.columns, out)


def falling(degree: int) -> Column:
    """Whether the fitted curve falls all over its range: the slope at both ends and, for a cubic, at its turning point."""
    c = [F.col(f"c{i}") for i in range(degree + 1)]
    slope = lambda u: sum((i * c[i] * (F.pow(u, F.lit(float(i - 1))) if i > 1 else F.lit(1.0)) for i in range(1, degree + 1)), F.lit(0.0))
    ends = [F.try_divide(F.col(e) - F.col("middle"), F.col("spread")) for e in ("low", "high")]
    good = (slope(ends[0]) < 0) & (slope(ends[1]) < 0)
    if degree == 3:
        turn = F.try_divide(-c[2], 3 * c[3])
        good = good & (~F.coalesce(turn.between(*ends), F.lit(False)) | (slope(turn) < 0))
    return good


def recalibrated(peaks: DataFrame, calibrants: DataFrame, keys: list[str], mass: str, theoretical: str, ppm: float, degree: int = 2, least: int = 3, span: float = 0.6) -> DataFrame:
    """Masses less the error that calibrants show, a polynomial of the mass: columns ``corrected``, ``n_calibrants`` and ``degree``.

    Per calibrant and key the peak nearest to the theoretical mass within
    ``ppm`` counts. Calibrants that span less than ``span`` of the spectrum
    give a straight line; with fewer than ``least`` of them, or without a
    solution, masses stay as they are and the degree is zero.
    """
    from .ranges import calibrant_peaks

    if not 1 <= degree <= 3:
        raise ValueError("degrees 1 to 3")
    near = calibrant_peaks(peaks, calibrants, keys, mass, theoretical, ppm).withColumn("_error", F.col(mass) - F.col("_t"))
    whole = peaks.groupBy(*keys).agg((F.max(mass) - F.min(mass)).alias("_width"))
    sums = _sums(near, keys, mass, "_error", degree)
    solved = []
    for d in sorted({1, degree}):
        c = [F.col(f"_c{d}{i}") for i in range(d + 1)]
        sums = sums.withColumns({f"_c{d}{i}": e for i, e in enumerate(_coefficients(d))})
        row = F.struct("middle", "spread", *[(c[i] + (F.col("_level") if not i else 0.0)).alias(f"c{i}") for i in range(d + 1)])
        solved.append(F.when(c[d].isNotNull(), row).alias(f"_f{d}"))
    fits = whole.join(sums.select(*keys, F.col("n").alias("_n"), (F.col("high") - F.col("low")).alias("_span"), *solved), keys, "left")
    joined = peaks.join(fits, keys, "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    wide = F.col("_span") / F.greatest(F.lit(1.0), F.col("_width")) >= span

    def error(d: int) -> Column:
        f = F.col(f"_f{d}")
        u = F.try_divide(F.col(mass) - f["middle"], f["spread"])
        out = f[f"c{d}"]
        for i in reversed(range(d)):
            out = out * u + f[f"c{i}"]
        return out

    chosen = F.when(n < least, 0).when(F.lit(degree > 1) & wide & F.col(f"_f{degree}").isNotNull(), degree).when(F.col("_f1").isNotNull(), 1).otherwise(0)
    out = joined.withColumn("n_calibrants", n).withColumn("degree", chosen)
    moved = F.when(F.col("degree") == degree, error(degree)).when(F.col("degree") == 1, error(1)).otherwise(0.0)
    return out.withColumn("corrected", F.col(mass) - moved).select(*peaks.columns, "corrected", "n_calibrants", "degree")
