"""Assignment of elemental formulas to measured masses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrion.functions.chem import CARBON13, EXACT_MASS, PROTON

from .ranges import absolute_join, best_match, ppm_join

# Default bounds of the element counts.
BOUNDS = {"C": (4, 120), "H": (4, 200), "O": (1, 60), "N": (0, 2), "S": (0, 1)}


def candidates(spark: SparkSession, bounds: dict[str, tuple[int, int]] = BOUNDS, polarity: int = -1, charges: int = 1, max_hc: float = 2.5, max_oc: float = 1.2, low: float = 0.0, high: float = 1e9) -> DataFrame:
    """Every plausible formula within the bounds as rows (c, h, o, n, s, z, theor, formula), generated by Spark.

    The carbon counts are dealt over tasks and the rest is exploded there; rules on hydrogen bound its range before it is exploded.
    """
    c0, c1 = bounds["C"]
    step = lambda e: F.explode(F.sequence(F.lit(bounds[e][0]), F.lit(bounds[e][1])))
    base = spark.range(c0, c1 + 1, numPartitions=min(c1 - c0 + 1, 32)).select(F.col("id").cast("int").alias("c"))
    base = base.withColumn("o", step("O")).where(F.col("o") <= max_oc * F.col("c")).withColumn("n", step("N")).withColumn("s", step("S"))
    # DBE >= 0 and -10 <= DBE - O <= 10 in terms of hydrogen
    c, o, n = F.col("c"), F.col("o"), F.col("n")
    least = F.greatest(F.lit(bounds["H"][0]), F.ceil(0.2 * c), 2 * (c - o - 9) + n)
    most = F.least(F.lit(bounds["H"][1]), F.floor(max_hc * c), 2 * c + n + 2, 2 * (11 + c - o) + n)
    made = base.withColumn("lo", least.cast("int")).withColumn("hi", most.cast("int")).where("lo <= hi").withColumn("h", F.explode(F.sequence("lo", "hi"))).where((F.col("h") + n) % 2 == 0)
    mass = sum((F.col(e.lower()) * m for e, m in EXACT_MASS.items()), F.lit(0.0))
    ion = made.withColumn("z", F.explode(F.sequence(F.lit(1), F.lit(charges)))).withColumn("theor", (mass + polarity * F.col("z") * PROTON) / F.col("z"))
    part = lambda e: F.when(F.col(e.lower()) > 1, F.concat(F.lit(e), F.col(e.lower()).cast("string"))).when(F.col(e.lower()) == 1, F.lit(e)).otherwise("")
    always = lambda e: F.concat(F.lit(e), F.col(e.lower()).cast("string"))
    name = F.concat(*[always(e) if bounds[e][0] > 0 else part(e) for e in "CHONS"])
    return ion.where(F.col("theor").between(low, high)).select("c", "h", "o", "n", "s", "z", "theor", name.alias("formula"))


def assigned(peaks: DataFrame, key: str, mass: str, bounds: dict[str, tuple[int, int]] = BOUNDS, ppm: float = 2.0, polarity: int = -1, charges: int = 1) -> DataFrame:
    """Each peak's formula with the least error: of equals the smaller charge, then the lighter one. Peaks without one are left out."""
    pairs = ppm_join(peaks, candidates(peaks.sparkSession, bounds, polarity, charges), mass, "theor", ppm)
    pairs = pairs.withColumn("error_ppm", (F.col(mass) - F.col("theor")) / F.col(mass) * 1e6)
    return best_match(pairs, [key], [F.abs("error_ppm"), F.col("z"), F.col("theor")])


def confirmed_by_carbon13(found: DataFrame, peaks: DataFrame, key: str, mass: str, intensity: str, ppm: float = 2.0, low: float = 0.4, high: float = 2.2, keys: list[str] | None = None) -> DataFrame:
    """Column ``confirmed``: whether the nearest peak one 13C above, of the same ``keys`` (the sample), has an intensity that the number of carbons explains."""
    keys = keys or []
    tolerance = 1000.0 * ppm * 1e-6
    aim = found.select(*keys, F.col(key).alias("_k"), "c", (F.col(mass) + CARBON13 / F.col("z")).alias("_aim"), F.col(intensity).alias("_i"))
    other = peaks.select(*keys, F.col(mass).alias("_m"), F.col(intensity).alias("_ci"))
    near = absolute_join(aim, other, "_aim", "_m", tolerance, keys).where(F.abs(F.col("_m") - F.col("_aim")) <= F.col("_aim") * ppm * 1e-6)
    best = best_match(near, [*keys, "_k"], [F.abs(F.col("_m") - F.col("_aim")), F.col("_m")])
    share = F.try_divide("_ci", "_i") / (0.0108 * F.col("c"))
    flagged = best.select(*keys, F.col("_k").alias(key), share.between(low, high).alias("confirmed"))
    return found.join(flagged, [*keys, key], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
