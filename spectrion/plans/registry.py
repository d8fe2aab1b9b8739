"""All queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import files, instruments, laboratory, models, peaks, screening, shapes, signals, tables  # noqa: F401 (they register their queries)
from .base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor vectors of all samples from their formulas."""
    return peaks.sample_descriptor_vector(spark, sf_dir)
