"""Filters, scaling, histograms and weighted aggregates over peak lists and descriptor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def peak_window(peaks: DataFrame, mass: str, intensity: str, low: float, high: float, least: float = 0.0) -> DataFrame:
    """Peaks with mass in [low, high] and enough intensity; a pushed-down filter."""
    return peaks.where(F.col(mass).between(low, high) & (F.col(intensity) >= least))


def scaled(peaks: DataFrame, keys: list[str], intensity: str, mode: str = "base_peak", out: str = "norm_intensity") -> DataFrame:
    """Intensity as percentage of the key's base peak or of its sum, or as it is (mode "raw").

    The scale is a partial aggregate joined back, so a key with most of the rows is no single task.
    """
    if mode == "raw":
        return peaks.withColumn(out, F.col(intensity))
    if mode not in ("base_peak", "tic"):
        raise ValueError(mode)
    scale = peaks.groupBy(*keys).agg((F.max if mode == "base_peak" else F.sum)(intensity).alias("_scale"))
    joined = peaks.join(scale, keys)
    return joined.withColumn(out, F.when(F.col("_scale") > 0, 100.0 * F.col(intensity) / F.col("_scale")).otherwise(F.col(intensity))).drop("_scale")


def mass_bins(peaks: DataFrame, mass: str, low: int, high: int, weight: Column | None = None, width: float = 1.0) -> DataFrame:
    """Dense histogram: each bin of [low, high] with its share of all rows' weight in percent, bins without rows included."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    binned = peaks.select(F.floor(F.col(mass) / width).alias("bin"), w.alias("w")).groupBy("bin").agg(F.sum("w").alias("w"))
    total = binned.agg(F.sum("w").alias("total"))
    every = peaks.sparkSession.range(int(low / width), int(high / width) + 1).select(F.col("id").alias("bin"))
    return every.join(binned, "bin", "left").crossJoin(F.broadcast(total)).select((F.col("bin") * width).alias("mass_from"), F.coalesce(100.0 * F.col("w") / F.nullif("total", F.lit(0.0)), F.lit(0.0)).alias("percent"))


def mass_intervals(peaks: DataFrame, mass: str, intensity: str, low: float, high: float, width: float = 1.0) -> DataFrame:
    """Sparse histogram over [low, high]: count, intensity and their percentages of the filtered rows."""
    binned = peaks.where(F.col(mass).between(low, high)).groupBy((F.floor(F.col(mass) / width) * width).alias("mass_from")).agg(F.count("*").alias("n"), F.sum(intensity).alias("intensity"))
    total = binned.agg(F.sum("n").alias("_n"), F.sum("intensity").alias("_i"))
    return binned.crossJoin(F.broadcast(total)).select("mass_from", "n", (100.0 * F.col("n") / F.col("_n")).alias("n_percent"), "intensity", (100.0 * F.col("intensity") / F.nullif("_i", F.lit(0.0))).alias("intensity_percent"))


#: Edges of the 5 x 4 grid; the last ones let the border in.
OC_EDGES = (0.0, 0.25, 0.5, 0.75, 1.000001)
HC_EDGES = (0.2, 0.6, 1.0, 1.4, 1.8, 2.200001)


def _bin(x: Column, edges: tuple[float, ...]) -> Column:
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (x >= a) & (x < b)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def grid_cell(oc: Column, hc: Column) -> Column:
    """Cell 1 to 20, row by row from low H/C; null outside the grid."""
    return 1 + _bin(hc, HC_EDGES) * 4 + _bin(oc, OC_EDGES)


def grid20(formulas: DataFrame, oc: Column, hc: Column, weight: Column) -> DataFrame:
    """All 20 cells with counts, weights and their percentages of the grid."""
    cells = formulas.select(grid_cell(oc, hc).alias("cell"), weight.alias("w")).where("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    total = cells.agg(F.sum("n").alias("_n"), F.sum("w").alias("_w"))
    every = formulas.sparkSession.range(1, 21).select(F.col("id").cast("int").alias("cell"))
    share = lambda x, t: F.coalesce(100.0 * F.col(x) / F.nullif(F.col(t).cast("double"), F.lit(0.0)), F.lit(0.0))
    return every.join(cells, "cell", "left").crossJoin(F.broadcast(total)).select("cell", F.coalesce("n", F.lit(0)).alias("n"), share("n", "_n").alias("n_percent"), share("w", "_w").alias("weight_percent"))


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Share of each label in percent; null labels don't count."""
    counted = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("_n")))).select(label, "n", (100.0 * F.col("n") / F.col("_n")).alias("percent"))


def molar_mass_moments(slices: DataFrame, keys: list[str], signal: str, mass: str) -> DataFrame:
    """Mn, Mw, Mz, peak mass and polydispersity of each key."""
    s, m = F.col(signal), F.col(mass)
    out = slices.where((s > 0) & (m > 0)).groupBy(*keys).agg(
        F.sum(s).alias("_s"), F.sum(s / m).alias("_n"), F.sum(s * m).alias("_w"), F.sum(s * m * m).alias("_z"), F.max_by(m, F.struct(s, m)).alias("mp"),
    )
    mn, mw = F.try_divide("_s", "_n"), F.try_divide("_w", "_s")
    return out.select(*keys, mn.alias("mn"), mw.alias("mw"), F.try_divide("_z", "_w").alias("mz"), "mp", (mw / mn).alias("pdi"))


def class_shares(df: DataFrame, keys: list[str], label: str, value: str, classes: list[str]) -> DataFrame:
    """Per key the share of each class's value in percent, null where the total is zero."""
    sums = [F.sum(F.when(F.col(label) == c, F.col(value)).otherwise(0.0)).alias(f"_{i}") for i, c in enumerate(classes)]
    out = df.groupBy(*keys).agg(F.sum(value).alias("total"), *sums)
    return out.select(*keys, "total", *[(100.0 * F.try_divide(F.col(f"_{i}"), F.col("total"))).alias(f"share_{c}") for i, c in enumerate(classes)])


def weighted_mean(df: DataFrame, keys: list[str], value: Column, weight: Column, out: str = "weighted_mean") -> DataFrame:
    agg = df.groupBy(*keys).agg(F.sum(value * weight).alias("_vw"), F.sum(weight).alias("_w"))
    return agg.select(*keys, F.try_divide("_vw", "_w").alias(out))


def sample_descriptors(formulas: DataFrame, keys: list[str], cell: Column, mass: Column, intensity: Column, means: dict[str, Column]) -> DataFrame:
    """One wide row per sample: share of each of the 20 cells by count, mean mass, intensity-weighted mass and means."""
    cells = [(100.0 * F.sum(F.when(cell == k, 1.0).otherwise(0.0)) / F.count("*")).alias(f"vk_{k}") for k in range(1, 21)]
    return formulas.groupBy(*keys).agg(F.avg(mass).alias("mn"), F.try_divide(F.sum(mass * intensity), F.sum(intensity)).alias("mw"), *[F.avg(c).alias(n) for n, c in means.items()], *cells)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each key. A per-task top n comes first, so that a key's rows don't all meet."""
    from pyspark.sql import Window

    near = df.withColumn("_part", F.spark_partition_id())
    few = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_rank") <= n).drop("_part", "_rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
