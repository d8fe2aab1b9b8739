"""The chemistry functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and type of each function, and its body in Spark SQL, which Catalyst inlines into the plan that calls it.
FUNCTIONS = {
    "chem_dbe": ("c DOUBLE, h DOUBLE, n DOUBLE", "DOUBLE", "1 + c - 0.5D * h + 0.5D * n"),
    "chem_nosc": ("c DOUBLE, h DOUBLE, o DOUBLE, n DOUBLE, s DOUBLE", "DOUBLE", "CASE WHEN c > 0 THEN 4 - (4 * c + h - 3 * n - 2 * o - 2 * s) / c END"),
    "chem_aromaticity": ("c DOUBLE, h DOUBLE, o DOUBLE, n DOUBLE, s DOUBLE", "DOUBLE", "CASE WHEN 1 + c - o - s - 0.5D * (h + n) > 0 AND c - o - s - n > 0 THEN (1 + c - o - s - 0.5D * (h + n)) / (c - o - s - n) ELSE 0D END"),
    "chem_ppm_error": ("measured DOUBLE, theoretical DOUBLE", "DOUBLE", "(measured - theoretical) / measured * 1e6D"),
    "chem_kendrick_defect": ("mass DOUBLE", "DOUBLE", "rint(mass * 14 / 14.015650D) - mass * 14 / 14.015650D"),
    "chem_delta": ("ratio DOUBLE, standard DOUBLE", "DOUBLE", "(ratio / standard - 1) * 1000"),
    "chem_absorbance": ("transmittance_percent DOUBLE", "DOUBLE", "2 - log10(greatest(transmittance_percent, 1e-4D))"),
    "chem_source_share": ("sample DOUBLE, a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a <> b THEN least(1D, greatest(0D, (sample - b) / (a - b))) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL as temporary functions; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
