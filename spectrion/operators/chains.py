"""Whole ways of an instrument's signals: from raw points to descriptors, a sample a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, ordered, ranges, shapes, spectra, stats


def corrected(points: DataFrame, keys: list[str], x: str, y: str, method: str = "als") -> DataFrame:
    """(keys, x, y) less a baseline, never below zero: ``als``, ``hull``, ``rubberband`` (lowest points of twenty stretches), ``linear`` (first to last point by number) or ``none``."""
    if method == "none":
        return points.select(*keys, x, F.greatest(F.col(y), F.lit(0.0)).alias(y))
    if method == "als":
        made = kernels.baseline(points, keys, x, y)
    elif method == "hull":
        made = shapes.hull_baseline(points, keys, x, y)
    elif method == "linear":
        order = Window.partitionBy(*keys).orderBy(x)
        ends = points.groupBy(*keys).agg(F.min_by(y, x).alias("_a"), F.max_by(y, x).alias("_b"), F.count("*").alias("_n"))
        share = F.coalesce(F.try_divide(F.row_number().over(order) - 1, F.col("_n") - 1), F.lit(0.0))
        made = points.join(ends, keys).withColumn("baseline", F.col("_a") + (F.col("_b") - F.col("_a")) * share).withColumn("corrected", F.greatest(F.col(y) - F.col("baseline"), F.lit(0.0)))
    elif method == "rubberband":
        ends = points.groupBy(*keys).agg(F.array(F.struct(F.min(x).alias("knot_x"), F.min_by(y, x).alias("knot_y")), F.struct(F.max(x).alias("knot_x"), F.max_by(y, x).alias("knot_y"))).alias("_e"))
        knots = ordered.segment_minima(points, keys, [x], x, y, 20).select(*keys, "knot_x", "knot_y").unionByName(ends.select(*keys, F.inline("_e")))
        made = ranges.interpolated(points, knots, keys, x, "knot_x", "knot_y", "baseline").withColumn("corrected", F.greatest(F.col(y) - F.col("baseline"), F.lit(0.0)))
    else:
        raise ValueError(f"no baseline {method}")
    return made.select(*keys, x, F.col("corrected").alias(y))


def infrared(points: DataFrame, keys: list[str], x: str, y: str, baseline: str = "als") -> DataFrame:
    """Descriptors of infrared spectra: points of one wavenumber averaged, baseline taken off, bands of the absorbance as it is, not normalised."""
    return spectra.ftir_descriptors(corrected(ordered.averaged_duplicates(points, keys, x, y, 6), keys, x, y, baseline), keys, x, y)


def carbon_resonance(points: DataFrame, keys: list[str], x: str, y: str, baseline: str = "als", reference: str | None = None) -> DataFrame:
    """Descriptors of carbon spectra: points of one shift averaged, moved to the reference signal if one is named, baseline taken off."""
    one = ordered.averaged_duplicates(points, keys, x, y, 6)
    placed = spectra.recalibrated_shifts(one, keys, x, y, reference).drop("shift_by") if reference else one
    return spectra.nmr_descriptors(corrected(placed, keys, x, y, baseline), keys, x, y)


def shown(points: DataFrame, keys: list[str], x: str, y: str, baseline: str = "als", scale: str = "snv", half: int = 7, degree: int = 2, derivative: int = 0) -> DataFrame:
    """(keys, x, y) as spectra are drawn: baseline taken off, scaled, smoothed or derived."""
    scaled = stats.standardized(corrected(points, keys, x, y, baseline), keys, y, scale, "_scaled")
    return ordered.savgol(scaled, keys, [x], "_scaled", half, derivative, degree, "_smooth", ends=True).select(*keys, x, F.col("_smooth").alias(y))


def wavelengths(points: DataFrame, x: str, low: float = 180.0, high: float = 1200.0) -> DataFrame:
    """Points at wavelengths that a spectrometer of this kind has."""
    return points.where(F.col(x).between(low, high))
