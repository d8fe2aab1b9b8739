"""Descriptor tables: long and wide forms, fusion of blocks, upserts and key lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrion.functions.text import normalized_id, sample_id


def clean_number(x: Column) -> Column:
    """Null for what isn't a finite number."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def unpivot(wide: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(keys, descriptor, value) for every finite value of the numeric columns."""
    numeric = columns or [c for c, t in wide.dtypes if c not in keys and t.split("(")[0] in ("double", "float", "int", "bigint", "decimal", "smallint")]
    cast = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric])
    return cast.unpivot(keys, numeric, "descriptor", "value").where(clean_number(F.col("value")).isNotNull())


def pivot(long: DataFrame, keys: list[str], descriptors: list[str]) -> DataFrame:
    """One wide row per key; a descriptor that wasn't measured is null. The columns are stated, so no pass over the data finds them."""
    return long.groupBy(*keys).pivot("descriptor", descriptors).agg(F.first("value"))


def upsert(long: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last value of each (keys, descriptor) by ``order``: later files overwrite earlier ones."""
    return long.groupBy(*keys, "descriptor").agg(F.max_by("value", order).alias("value"))


def fuse_blocks(blocks: dict[str, DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Join of descriptor blocks on the sample; columns are prefixed by their block, so equal names don't clash."""
    named = [df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]) for name, df in blocks.items()]
    return reduce(lambda a, b: a.join(b, key, how), named)


def key_ladder(left: DataFrame, right: DataFrame, name: str, other: str) -> DataFrame:
    """Left rows with the right key that matches best: exactly, else by stem, else normalised; null if none does.

    Each step is an equi-join, so no pair is compared that can't match.
    """
    forms = lambda c: F.array(F.struct(F.lit(0).alias("step"), F.col(c).alias("form")), F.struct(F.lit(1).alias("step"), sample_id(F.col(c)).alias("form")), F.struct(F.lit(2).alias("step"), normalized_id(F.col(c)).alias("form")))
    asked = left.select(name).distinct().select(name, F.explode(forms(name)).alias("f")).select(name, "f.step", "f.form")
    known = right.select(other).distinct().select(other, F.explode(forms(other)).alias("f")).select(other, "f.step", "f.form")
    best = asked.join(known, ["step", "form"]).groupBy(name).agg(F.min(F.struct("step", other)).alias("_b")).select(name, F.col("_b.step").alias("step"), F.col(f"_b.{other}").alias(other))
    return left.join(best, name, "left")


def present_columns(long: DataFrame, least: int = 1, spread: float | None = None) -> DataFrame:
    """Descriptors with ``least`` values and, if asked, a sample variance above ``spread``."""
    agg = long.groupBy("descriptor").agg(F.count("value").alias("n"), F.var_samp("value").alias("variance")).where(F.col("n") >= least)
    return agg if spread is None else agg.where(F.col("variance") > spread)


def missing_counts(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(descriptor, missing) for the columns of a wide table, in one pass."""
    counts = wide.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return counts.unpivot([], columns, "descriptor", "missing")
