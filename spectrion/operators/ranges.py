"""Range, band and nearest joins without nested loops, and what is built on them.

A tolerance join becomes an equi-join on bins: one side has its own bin, the
other is repeated into the neighbouring ones, and the exact predicate follows.
Spark can then hash, sort and split skewed bins as in any equi-join. No side
is broadcast unless its size is bounded by construction.

``keys`` name columns that both sides must agree in, such as the sample; they
join together with the bin, so peaks of different samples never meet and the
work grows with the samples and not with their square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ppm_join(peaks: DataFrame, candidates: DataFrame, mass: str, theoretical: str, ppm: float, keys: list[str] | None = None) -> DataFrame:
    """All pairs with the theoretical mass within ``ppm`` of the measured one, borders included. Bins are logarithmic, as the tolerance grows with mass."""
    tol = ppm * 1e-6
    width = math.log1p(tol)
    m, t = F.col(mass), F.col(theoretical)
    left = peaks.where(m > 0).withColumn("_bin", F.floor(F.log(m) / width))
    right = candidates.where(t > 0).withColumn("_own", F.floor(F.log(t) / width)).withColumn("_bin", F.explode(F.sequence(F.col("_own") - 2, F.col("_own") + 2))).drop("_own")
    return left.join(right, ["_bin", *(keys or [])]).where(t.between(m - m * tol, m + m * tol)).drop("_bin")


def absolute_join(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """All pairs with |a - b| <= tolerance."""
    x = left.withColumn("_bin", F.floor(F.col(a) / tolerance))
    y = right.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(b) / tolerance) + d)))
    return x.join(y, ["_bin", *(keys or [])]).where(F.abs(F.col(a) - F.col(b)) <= tolerance).drop("_bin")


def best_match(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order given; a partial aggregate and no window."""
    rest = [c for c in pairs.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))
    return pairs.groupBy(*keys).agg(F.min(ranked)["_row"].alias("_row")).select(*keys, "_row.*")


def ppm_best(peaks: DataFrame, candidates: DataFrame, key: str, mass: str, theoretical: str, ppm: float) -> DataFrame:
    """Each peak's candidate with the least error; of equals the lighter one."""
    pairs = ppm_join(peaks, candidates, mass, theoretical, ppm).withColumn("error_ppm", (F.col(mass) - F.col(theoretical)) / F.col(mass) * 1e6)
    return best_match(pairs, [key], [F.abs("error_ppm"), F.col(theoretical)])


def nearest_within(left: DataFrame, library: DataFrame, key: str, a: str, b: str, tolerance: float, place: str) -> DataFrame:
    """Each row's nearest library entry within the tolerance, the first in the library's order among equals; rows without one keep nulls."""
    names = [c for c in library.columns]
    hits = best_match(absolute_join(left.select(key, a), library, a, b, tolerance), [key], [F.abs(F.col(a) - F.col(b)), F.col(place)])
    return left.join(hits.select(key, *names), key, "left")


def first_interval(rows: DataFrame, bands: DataFrame, key: str, x: str, low: str, high: str, place: str, width: float) -> DataFrame:
    """Each row's first band [low, high] that holds x; rows outside all keep nulls. Bands are repeated into bins of ``width``."""
    mine = rows.select(key, x).withColumn("_bin", F.floor(F.col(x) / width))
    cut = bands.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    hits = best_match(mine.join(cut, "_bin").where(F.col(x).between(F.col(low), F.col(high))).drop("_bin", x), [key], [F.col(place)])
    return rows.join(hits, key, "left")


def interpolated(rows: DataFrame, curve: DataFrame, keys: list[str], x: str, cx: str, cy: str, out: str = "y") -> DataFrame:
    """Linear interpolation of a curve at each row's x within a key; null outside the curve.

    Both are laid on one axis per key; the neighbours come from windows over the key.
    """
    points = curve.groupBy(*keys, F.col(cx).alias("_x")).agg(F.avg(cy).alias("_y")).withColumn("_asked", F.lit(False))
    asked = rows.select(*keys, F.col(x).alias("_x")).distinct().withColumn("_y", F.lit(None).cast("double")).withColumn("_asked", F.lit(True))
    axis = points.unionByName(asked)
    order = Window.partitionBy(*keys).orderBy("_x", "_asked")
    back = Window.partitionBy(*keys).orderBy(F.desc("_x"), "_asked")
    p = F.when(~F.col("_asked"), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    both = axis.withColumn("_lo", F.last(p, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.last(p, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    y = F.when(F.col("_lo.x") == F.col("_hi.x"), F.col("_lo.y")).otherwise(F.col("_lo.y") + (F.col("_x") - F.col("_lo.x")) * (F.col("_hi.y") - F.col("_lo.y")) / (F.col("_hi.x") - F.col("_lo.x")))
    found = both.where("_asked").select(*keys, F.col("_x").alias(x), y.alias(out))
    return rows.join(found, [*keys, x], "left")


def mass_differences(peaks: DataFrame, key: str, mass: str, deltas: dict[str, float], tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of peaks (a below b) whose difference is one of ``deltas`` within the tolerance: (keys, source, target, code, difference).

    Each peak is repeated once for each delta, not paired with every other.
    """
    keys = keys or []
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("code"), F.lit(d).alias("delta")) for n, d in deltas.items()]))
    low = peaks.select(*keys, F.col(key).alias("source"), F.col(mass).alias("m1"), steps.alias("s")).select(*keys, "source", "m1", "s.code", "s.delta", (F.col("m1") + F.col("s.delta")).alias("aim"))
    high = peaks.select(*keys, F.col(key).alias("target"), F.col(mass).alias("m2"))
    # a looser join on the sum, then the predicate on the difference
    pairs = absolute_join(low, high, "aim", "m2", tolerance * 1.000001, keys)
    return pairs.where(F.abs(F.col("m2") - F.col("m1") - F.col("delta")) <= tolerance).select(*keys, "source", "target", "code", (F.col("m2") - F.col("m1")).alias("difference"))


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Number of edges at each node."""
    ends = edges.select(F.col(source).alias("node")).unionByName(edges.select(F.col(target).alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def paths(edges: DataFrame, starts: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """All simple paths of up to ``depth`` edges from the start nodes: (path array, depth); one self-join for each step."""
    step = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
    now = starts.select(F.array("node").alias("path"))
    found = None
    for d in range(1, depth + 1):
        now = now.join(step, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_t"))).select(F.concat("path", F.array("_t")).alias("path"))
        one = now.withColumn("depth", F.lit(d))
        found = one if found is None else found.unionByName(one)
    return found


# Set algebra over masses that agree within a tolerance


def _matched(a: DataFrame, b: DataFrame, mass: str, ppm: float, keys: list[str]) -> DataFrame:
    other = b.select(*keys, F.col(mass).alias("_other")).distinct()
    return ppm_join(a.select(*keys, mass).distinct(), other, mass, "_other", ppm, keys).select(*keys, mass).distinct()


def spectral_difference(a: DataFrame, b: DataFrame, mass: str, ppm: float, keys: list[str] | None = None) -> DataFrame:
    """Rows of a without a partner in b."""
    keys = keys or []
    return a.join(_matched(a, b, mass, ppm, keys), [*keys, mass], "left_anti")


def spectral_intersection(a: DataFrame, b: DataFrame, mass: str, ppm: float, keys: list[str] | None = None) -> DataFrame:
    """Rows of a with a partner in b."""
    keys = keys or []
    return a.join(_matched(a, b, mass, ppm, keys), [*keys, mass], "left_semi")


def _unmatched_right(a: DataFrame, b: DataFrame, mass: str, ppm: float, keys: list[str]) -> DataFrame:
    mine = b.select(*keys, mass).distinct()
    hit = ppm_join(a.select(*keys, F.col(mass).alias("_a")).distinct(), mine, "_a", mass, ppm, keys).select(*keys, mass).distinct()
    return b.join(hit, [*keys, mass], "left_anti")


def spectral_union(a: DataFrame, b: DataFrame, mass: str, ppm: float, keys: list[str] | None = None) -> DataFrame:
    """All of a and the rows of b without a partner in a."""
    return a.unionByName(_unmatched_right(a, b, mass, ppm, keys or []), allowMissingColumns=True)


def spectral_symmetric(a: DataFrame, b: DataFrame, mass: str, ppm: float, keys: list[str] | None = None) -> DataFrame:
    """Rows of either side without a partner on the other."""
    return spectral_difference(a, b, mass, ppm, keys).unionByName(_unmatched_right(a, b, mass, ppm, keys or []), allowMissingColumns=True)


def membership(a: DataFrame, b: DataFrame, mass: str, digits: int = 4, keys: list[str] | None = None) -> DataFrame:
    """(keys, mass, side) of all masses rounded to ``digits``: in both tables or in one only. One shuffle of rounded masses."""
    keys = keys or []
    part = lambda df, first: df.where(F.col(mass).isNotNull()).select(*keys, F.round(mass, digits).alias(mass), F.lit(first).alias("_a"))
    seen = part(a, True).unionByName(part(b, False)).groupBy(*keys, mass).agg(F.bool_or("_a").alias("_in_a"), F.bool_or(~F.col("_a")).alias("_in_b"))
    return seen.select(*keys, mass, F.when(F.col("_in_a") & F.col("_in_b"), "common").when(F.col("_in_a"), "first_only").otherwise("second_only").alias("side"))


def renormalized(peaks: DataFrame, keys: list[str], intensity: str, top: float = 100.0) -> DataFrame:
    """Intensities over each sample's highest one, times ``top``, as after any algebra of spectra."""
    highest = peaks.groupBy(*keys).agg(F.max(intensity).alias("_top"))
    return peaks.join(highest, keys).withColumn(intensity, F.when(F.col("_top") > 0, F.col(intensity) * top / F.col("_top"))).drop("_top")


def blank_subtracted(sample: DataFrame, blank: DataFrame, mass: str, intensity: str, ppm: float, factor: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Sample peaks less ``factor`` times the strongest matching blank peak; what is left stays if positive."""
    keys = keys or []
    other = blank.groupBy(*keys, F.col(mass).alias("_other")).agg(F.max(intensity).alias("_blank"))
    hit = ppm_join(sample.select(*keys, mass).distinct(), other, mass, "_other", ppm, keys).groupBy(*keys, mass).agg(F.max("_blank").alias("_blank"))
    left = F.col(intensity) - factor * F.coalesce("_blank", F.lit(0.0))
    return sample.join(hit, [*keys, mass], "left").withColumn(intensity, F.greatest(left, F.lit(0.0))).where(F.col(intensity) > 0).drop("_blank")


def isotope_companions(peaks: DataFrame, key: str, mass: str, intensity: str, shift: float, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """For each peak the nearest peak one isotope step above, of equals the lighter one, then the first by key: (keys, key, companion, ratio of intensities).

    Peaks of one mass have one companion, so different masses are matched and
    peaks joined with what is found; peaks of equal masses never meet.
    """
    keys = keys or []
    m, aim, cm = F.col("_m"), F.col("_aim"), F.col("_cm")
    low = peaks.where(F.col(mass).isNotNull()).select(*keys, F.col(key), F.col(mass).alias("_m"), F.col(intensity).alias("_i"))
    high = low.groupBy(*keys, m.alias("_cm")).agg(F.min(F.struct(F.col(key).alias("companion"), F.col("_i").alias("_ci"))).alias("_c"))
    aims = low.select(*keys, "_m").distinct().withColumn("_aim", m + shift)
    found = best_match(absolute_join(aims, high, "_aim", "_cm", tolerance, keys), [*keys, "_m"], [F.abs(cm - aim), cm])
    rows = low.join(found.select(*keys, "_m", F.abs(cm - aim).alias("_o"), "_cm", "_c.*"), [*keys, "_m"])
    best = rows.groupBy(*keys, key).agg(F.min(F.struct("_o", "_cm", "companion", "_m", "_i", "_ci")).alias("_b"))  # of peaks with one key
    return best.select(*keys, key, F.col("_b.companion").alias("companion"), F.try_divide("_b._ci", "_b._i").alias("ratio"))


#: Bits of the filter of bins: 131,072 numbers of 64 bits at most when broadcast.
FILTER_BITS = 1 << 23


def calibrant_peaks(peaks: DataFrame, calibrants: DataFrame, keys: list[str], mass: str, theoretical: str, ppm: float) -> DataFrame:
    """(keys, mass, _t): for each key and calibrant the peak nearest to the theoretical mass within ``ppm`` of it; of equals the lighter one.

    Calibrants, the fewer ones, are repeated into the bins that their windows
    touch. Peaks in no such bin are left out by a filter of bins that is
    broadcast, so only the others are shuffled, once each.
    """
    tol = ppm * 1e-6
    t, m = F.col("_t"), F.col(mass)
    place = lambda x: F.floor(F.log(x) / math.log1p(tol))
    slot = lambda b: F.pmod(b, F.lit(FILTER_BITS))
    word = lambda b: F.shiftright(slot(b), 6)
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (slot(b) % 64).cast("int"))
    known = calibrants.select(F.col(theoretical).cast("double").alias("_t")).where((t > 0) & (t < float("inf"))).distinct()
    binned = known.select("_t", F.explode(F.sequence(place(t - t * tol), place(t + t * tol))).alias("_bin"))
    b = F.col("_bin")
    bits = binned.groupBy(word(b).alias("_word")).agg(F.bit_or(bit(b)).alias("_bits"))
    mine = peaks.where(m > 0).select(*keys, mass, place(m).alias("_bin"))
    maybe = mine.withColumn("_word", word(b)).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit(b)) != 0)
    pairs = maybe.select(*keys, mass, "_bin").join(binned, "_bin").where(m.between(t - t * tol, t + t * tol))
    # numbers only, so that Spark adds up by hash and needn't sort
    best = pairs.groupBy(*keys, "_t").agg(F.max(F.when(m <= t, m)).alias("_below"), F.min(F.when(m > t, m)).alias("_above"))
    below, above = F.col("_below"), F.col("_above")
    return best.select(*keys, F.when(above.isNull() | (t - below <= above - t), below).otherwise(above).alias(mass), "_t")


def recalibrated(peaks: DataFrame, calibrants: DataFrame, keys: list[str], mass: str, theoretical: str, ppm: float, least: int = 3) -> DataFrame:
    """Masses less the linear error that calibrants show: per calibrant and key the nearest peak within ``ppm`` of the theoretical mass, then a regression of the error on the mass.

    Columns ``corrected`` and ``n_calibrants``; with fewer than ``least`` calibrants, masses stay as they are.
    """
    near = calibrant_peaks(peaks, calibrants, keys, mass, theoretical, ppm)
    error = F.col(mass) - F.col("_t")
    fit = near.groupBy(*keys).agg(F.regr_slope(error, F.col(mass)).alias("_b"), F.regr_intercept(error, F.col(mass)).alias("_a"), F.count("*").alias("n_calibrants"))
    out = peaks.join(fit, keys, "left").withColumn("n_calibrants", F.coalesce("n_calibrants", F.lit(0)))
    good = (F.col("n_calibrants") >= least) & F.col("_b").isNotNull()
    return out.withColumn("corrected", F.when(good, F.col(mass) - F.col("_a") - F.col("_b") * F.col(mass)).otherwise(F.col(mass))).drop("_a", "_b")
