"""Statistics over descriptor tables: scaling, correlation, discovery control, matching and validation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrion.session import let_workers_import, work_folder


def standardized(df: DataFrame, keys: list[str], value: str, mode: str = "snv", out: str = "scaled") -> DataFrame:
    """Per key: snv (population deviation), minmax, vector, area or max; null where the scale is zero."""
    return scalings(df, keys, value, {out: mode})


def scalings(df: DataFrame, keys: list[str], value: str, modes: dict[str, str]) -> DataFrame:
    """``standardized`` in several modes at once, a column for each, from one aggregation."""
    v = F.col(value)
    aggs = {
        "snv": (F.avg(v), F.stddev_pop(v)),
        "minmax": (F.min(v), F.max(v) - F.min(v)),
        "vector": (F.lit(0.0), F.sqrt(F.sum(v * v))),
        "area": (F.lit(0.0), F.sum(F.abs(v))),
        "max": (F.lit(0.0), F.max(v)),
        "pareto": (F.avg(v), F.sqrt(F.stddev_samp(v))),
        "auto": (F.avg(v), F.stddev_samp(v)),
    }
    unknown = set(modes.values()) - set(aggs)
    if unknown:
        raise ValueError(f"no such mode: {sorted(unknown)}")
    known = df.groupBy(*keys).agg(*[a.alias(f"_{part}{i}") for i, mode in enumerate(modes.values()) for part, a in zip(("shift", "scale"), aggs[mode])])
    scaled = {out: F.when(F.col(f"_scale{i}") != 0, (v - F.col(f"_shift{i}")) / F.col(f"_scale{i}")) for i, out in enumerate(modes)}
    return df.join(known, keys).withColumns(scaled).drop(*[f"_{part}{i}" for i in range(len(modes)) for part in ("shift", "scale")])


def block_scaled(long: DataFrame, block: str, value: str, out: str = "scaled") -> DataFrame:
    """Each value over its block's Frobenius norm, so that blocks weigh alike."""
    norm = long.groupBy(block).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    return long.join(norm, block).withColumn(out, F.try_divide(F.col(value), F.col("_norm"))).drop("_norm")


#: Columns of a side in one pass of correlations: six matrices of its square are held by a task.
SIDE = 1000


def correlations(wide: DataFrame, columns: list[str], least: int = 3, side: int = SIDE) -> DataFrame:
    """Pearson r of every pair of columns over their joint rows: (f1, f2, n, r); null if too few or a constant column.

    Tasks add up products of all pairs batch by batch, so the plan's size
    doesn't grow with the pairs and rows aren't shuffled. More than ``side``
    columns are cut into blocks, and every two blocks take a pass of their own
    that reads their columns only. Values are taken from their column's mean to
    keep digits, so a column counts as constant where its deviation is below a
    millionth of its joint rows' distance from it; NaN and infinity count as
    missing.
    """
    let_workers_import(wide.sparkSession)
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in cells]
    means = wide.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(finite)]).first()
    centred = [(c - float(means[i] or 0.0)).alias(f"c{i}") for i, c in enumerate(finite)]
    starts = range(0, len(columns), side)
    parts = reduce(DataFrame.unionByName, [_product_pairs(wide, centred, (a, min(a + side, len(columns))), (b, min(b + side, len(columns)))) for a in starts for b in starts if b >= a])
    pair = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    n = F.col("n")
    spread = lambda s, ss: F.when(n * F.col(ss) - F.col(s) * F.col(s) > 1e-12 * n * F.col(ss), n * F.col(ss) - F.col(s) * F.col(s))
    r = (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread("x", "xx")) / F.sqrt(spread("y", "yy"))
    names = F.array(*map(F.lit, columns))
    return pair.select(names[F.col("i")].alias("f1"), names[F.col("j")].alias("f2"), n.cast("long").alias("n"), F.when((n >= least) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


_SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def _product_pairs(wide: DataFrame, cells: list[Column], one: tuple[int, int], two: tuple[int, int]) -> DataFrame:
    """(i, j, sums) of each task for the pairs i < j of two ranges of columns."""
    same = one == two
    chosen = cells[slice(*one)] + ([] if same else cells[slice(*two)])
    p, q = one[1] - one[0], two[1] - two[0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, p, q))
        for batch in batches:
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(z)
            z, there = np.where(there, z, 0.0), there.astype(float)
            a, b, ta, tb = z[:, :p], z[:, -q:], there[:, :p], there[:, -q:]
            total += ta.T @ tb, a.T @ tb, ta.T @ b, (a * a).T @ tb, ta.T @ (b * b), a.T @ b
        for i in range(p):
            j = np.arange(i + 1 if same else 0, q)
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), one[0] + i, np.int32)), pa.array((two[0] + j).astype(np.int32)), *[pa.array(m[i, j]) for m in total]], ["i", "j", *_SUMS])

    return wide.select(*chosen).mapInArrow(add, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))


def ranked_columns(long: DataFrame, key: str = "descriptor", value: str = "value", out: str = "rank", pieces: int = 200) -> DataFrame:
    """Average rank of each value among its descriptor's, for Spearman correlation; a null value has none.

    Equal values are counted first. Each descriptor's values are then cut into
    ``pieces`` ranges, which are ranked apart and set off by the counts of the
    ranges below, so no task sorts a whole descriptor. The cuts (numbers of
    descriptors times pieces) pass through the driver and decide only how even
    the ranges are; ranks are exact for any cuts.
    """
    known = long.where(F.col(value).isNotNull())
    counts = known.groupBy(key, value).agg(F.count("*").alias("_n"))
    edges = counts.groupBy(key).agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("_cuts"))
    cuts = long.sparkSession.createDataFrame(edges.collect(), edges.schema)
    piece = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    cut = counts.join(F.broadcast(cuts), key).select(key, value, "_n", piece.alias("_piece"))
    below = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = cut.groupBy(key, "_piece").agg(F.sum("_n").alias("_m")).select(key, "_piece", F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_off"))
    before = Window.partitionBy(key, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = cut.join(offset, [key, "_piece"]).select(key, value, (F.col("_off") + F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(out))
    return long.join(ranks, [key, value], "left")


def normal_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation by Fisher's z (for the t distribution see ``kernels.student_p``)."""
    z = F.abs(F.atanh(r)) * F.sqrt(n - 3.0)
    t = 1.0 / (1.0 + 0.2316419 * z)
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2.0 * tail)


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: str, ident: str, out: str = "q", pieces: int = 200) -> DataFrame:
    """False-discovery q of each test of a family; a null p has none and doesn't count.

    A family's p-values are cut into ``pieces`` ranges that are ranked apart,
    set off by the counts below; the least value above a range comes from the
    ranges' own least values. So no task sorts a whole family, and q is exact
    for any cuts.

    The tests are written to the work folder first and stay there: they are
    read several times, and a p-value made from sums may differ in its last
    digit each time it is worked out, which would move it to another range.
    """
    path = work_folder(tests.sparkSession)
    tests.write.parquet(path)
    tests = tests.sparkSession.read.schema(tests.schema).parquet(path)
    known = tests.where(F.col(p).isNotNull())
    cuts = known.groupBy(*keys).agg(F.percentile_approx(p, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("_cuts"), F.count("*").alias("_m"))
    piece = F.size(F.filter("_cuts", lambda c: c < F.col(p)))
    cut = known.join(cuts, keys).withColumn("_piece", piece).drop("_cuts")
    ranges = Window.partitionBy(*keys).orderBy("_piece")
    counted = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    offset = counted.select(*keys, "_piece", F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_piece")
    rank = F.col("_off") + F.row_number().over(inside.orderBy(p, ident))
    ranked = cut.join(offset, [*keys, "_piece"]).withColumn("_v", F.col(p) * F.col("_m") / rank)
    least = ranked.groupBy(*keys, "_piece").agg(F.min("_v").alias("_least"))
    above = least.select(*keys, "_piece", F.min("_least").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    back = inside.orderBy(F.desc(p), F.desc(ident)).rowsBetween(Window.unboundedPreceding, 0)
    q = ranked.withColumn("_back", F.min("_v").over(back)).join(above, [*keys, "_piece"])
    made = q.withColumn(out, F.least(F.lit(1.0), F.col("_back"), F.col("_above"))).select(*tests.columns, out)
    return made.unionByName(tests.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def hotelling_ellipse(scores: DataFrame, keys: list[str], x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """Centre and half axes of the T-squared ellipse of two scores; null with fewer than four points.

    With two numerator degrees of freedom the quantile of F has a closed form.
    """
    known = scores.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*").cast("double")
    quantile = (n - 2.0) / 2.0 * (F.pow(F.lit(1.0 - confidence), -2.0 / (n - 2.0)) - 1.0)
    scale = F.when(n >= 4, F.sqrt(2.0 * (n - 1.0) / (n - 2.0) * quantile))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("centre_x"), F.avg(y).alias("centre_y"), (F.stddev_samp(x) * scale).alias("radius_x"), (F.stddev_samp(y) * scale).alias("radius_y"))


def hotelling_ellipsoid(scores: DataFrame, keys: list[str], axes: list[str], confidence: float = 0.95) -> DataFrame:
    """(keys, n, centre and radius of each axis) of the T-squared ellipsoid of any number of scores; radii are null with fewer than two points over the axes."""
    k = len(axes)
    known = scores.where(F.array_min(F.array(*[F.col(a).isNotNull() for a in axes])))
    found = known.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"centre_{a}") for a in axes], *[F.stddev_samp(a).alias(f"_s_{a}") for a in axes])
    n = F.col("n").cast("double")
    scale = F.when(n >= k + 2, F.sqrt(k * (n - 1.0) / (n - k) * f_quantile(confidence, k, n - k)))
    return found.withColumn("_scale", scale).select(*keys, "n", *[f"centre_{a}" for a in axes], *[(F.col(f"_s_{a}") * F.col("_scale")).alias(f"radius_{a}") for a in axes])


def beta_share(x: Column, a: Column, b: Column, rounds: int = 200) -> Column:
    """Regularised incomplete beta function by its continued fraction, for x up to (a + 1) / (a + b + 2)."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = F.struct(F.lit(1.0).alias("c"), (1.0 / safe(1.0 - (a + b) * x / (a + 1.0))).alias("d"), (1.0 / safe(1.0 - (a + b) * x / (a + 1.0))).alias("h"))

    def step(s: Column, num: Column) -> Column:
        d, c = 1.0 / safe(1.0 + num * s["d"]), safe(1.0 + num / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def both(s: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return F.transform(F.array(step(s, even)), lambda t: step(t, odd))[0]

    h = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, both)["h"]
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return F.when(x <= 0, 0.0).otherwise(front * h / a)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series from ten steps on."""
    up = x + 10.0
    lower = F.log(x)
    for k in range(1, 10):
        lower = lower + F.log(x + float(k))
    series = 1.0 / (12.0 * up) - 1.0 / (360.0 * F.pow(up, F.lit(3.0))) + 1.0 / (1260.0 * F.pow(up, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(up, F.lit(7.0)))
    return (up - 0.5) * F.log(up) - up + 0.9189385332046727 + series - lower


def f_quantile(share: float, top: int, bottom: Column, rounds: int = 60) -> Column:
    """Quantile of F with ``top`` and ``bottom`` degrees of freedom, by halving the interval of x = top f / (top f + bottom)."""
    a, b = F.lit(top / 2.0), bottom / 2.0

    def below(x: Column) -> Column:
        near = x <= (a + 1.0) / (a + b + 2.0)
        return F.when(near, beta_share(x, a, b, 60)).otherwise(1.0 - beta_share(1.0 - x, b, a, 60))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2.0
        low = below(mid) < share
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    x = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)["lo"]
    return bottom * x / (top * (1.0 - x))


def marker_directions(long: DataFrame, descriptor: str, label: str, value: str) -> DataFrame:
    """For each descriptor the classes with the highest and lowest mean, and these means; of equals the first class."""
    means = long.where(F.col(label).isNotNull()).groupBy(descriptor, label).agg(F.avg(value).alias("_m")).where("_m IS NOT NULL")
    low, high = F.min(F.struct(F.col("_m"), F.col(label))), F.min(F.struct((-F.col("_m")).alias("_m"), F.col(label)))
    return means.groupBy(descriptor).agg(high[label].alias("highest_class"), (-high["_m"]).alias("highest_mean"), low[label].alias("lowest_class"), low["_m"].alias("lowest_mean"))


def predicted_class(scores: Column, classes: list) -> Column:
    """Class of the highest of the scores, the first of equals; a single score tells the second of two classes from 0.5 on."""
    names = F.array(*map(F.lit, classes))
    many = F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    return F.when(F.size(scores) == 1, F.when(scores[0] >= 0.5, names[1]).when(scores[0].isNotNull(), names[0])).when(F.array_max(scores).isNotNull(), many)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count("*").alias("n"))


def binary_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, sensitivity, specificity and their mean of 0/1 labels."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    hit = lambda a, b: F.sum((a & b).cast("double"))
    m = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).agg(hit(t, g).alias("tp"), hit(~t, ~g).alias("tn"), hit(~t, g).alias("fp"), hit(t, ~g).alias("fn"))
    sens, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return m.select("tp", "tn", "fp", "fn", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays (Tucker congruence of two profiles); null if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label as ``reference``; vectors may be of any length, and each place is the mean of those that have it."""
    places = vectors.select(label, F.posexplode(vector).alias("_i", "_v")).groupBy(label, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    return places.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda p: p["_v"]).alias("reference"))


def congruences(profiles: DataFrame, name: str, profile: str, bound: int = 10_000) -> DataFrame:
    """(a, b, congruence) of every two profiles with a < b; more than ``bound`` are refused, since each is held against all."""
    if profiles.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} profiles")
    entries = profiles.agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(profile).alias("ref"))).alias("_all"))
    later = F.filter("_all", lambda e: e["name"] > F.col(name))
    pairs = profiles.crossJoin(F.broadcast(entries)).select(F.col(name).alias("a"), profile, F.explode(later).alias("e"))
    return pairs.select("a", F.col("e.name").alias("b"), cosine(F.col(profile), F.col("e.ref")).alias("congruence"))


def library_match(vectors: DataFrame, library: DataFrame, key: str, vector: str, name: str, reference: str, top: int, bound: int = 10_000) -> DataFrame:
    """The ``top`` references with the highest cosine for each vector.

    The library is scored as one array per row; a library of more than
    ``bound`` entries is refused, since every vector has to be held against
    every entry and this form keeps them in each task.
    """
    if library.limit(bound + 1).count() > bound:
        raise ValueError(f"the library has more than {bound} entries")
    entries = library.agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("name"), F.col(reference).alias("ref")))).alias("_library"))
    scored = F.transform("_library", lambda e: F.struct((-F.coalesce(cosine(F.col(vector), e["ref"]), F.lit(-2.0))).alias("order"), e["name"].alias("name")))
    best = F.slice(F.sort_array(scored), 1, top)
    rows = vectors.crossJoin(F.broadcast(entries)).select(key, F.posexplode(best).alias("place", "e"))
    return rows.select(key, (F.col("place") + 1).alias("rank"), F.col("e.name").alias(name), F.when(F.col("e.order") < 2, -F.col("e.order")).alias("cosine"))


def q_squared(df: DataFrame, truth: str, guess: str) -> Column:
    """Aggregate: 1 - PRESS / total sum of squares; may be negative, null without spread."""
    t, g = F.col(truth), F.col(guess)
    return 1 - F.try_divide(F.sum((t - g) * (t - g)), F.var_pop(t) * F.count(t))


def _dynamic(long: DataFrame, block: str, name: str, step: str, value: str) -> DataFrame:
    mean = long.groupBy(block, name).agg(F.avg(value).alias("_mean"))
    return long.join(mean, [block, name]).select(block, name, step, (F.col(value) - F.col("_mean")).alias("d"))


def synchronous(long: DataFrame, block: str, name: str, step: str, value: str, first: str, second: str) -> DataFrame:
    """Synchronous two-dimensional correlation of two blocks over a perturbation: covariance of every pair of their variables.

    An equi-join on the step, then a partial aggregate; the result has a row per pair of variables.
    """
    dyn = _dynamic(long, block, name, step, value)
    a = dyn.where(F.col(block) == first).select(F.col(name).alias("v1"), step, F.col("d").alias("d1"))
    b = dyn.where(F.col(block) == second).select(F.col(name).alias("v2"), step, F.col("d").alias("d2"))
    return a.join(b, step).groupBy("v1", "v2").agg(F.try_divide(F.sum(F.col("d1") * F.col("d2")), F.count("*") - 1).alias("synchronous"))


def asynchronous(long: DataFrame, block: str, name: str, step: str, value: str, first: str, second: str) -> DataFrame:
    """Asynchronous correlation: the second block goes through the Hilbert-Noda transform over numbered steps first.

    The transform joins a variable's own steps, so its rows grow with the square of the number of steps, not of samples.
    """
    dyn = _dynamic(long, block, name, step, value)
    two = dyn.where(F.col(block) == second)
    other = two.select(F.col(name).alias("_n"), F.col(step).alias("_s"), F.col("d").alias("_d"))
    turned = two.join(other, (F.col(name) == F.col("_n")) & (F.col(step) != F.col("_s"))).groupBy(F.col(name).alias("v2"), step).agg(F.sum(F.col("_d") / (F.pi() * (F.col("_s") - F.col(step)))).alias("d2"))
    a = dyn.where(F.col(block) == first).select(F.col(name).alias("v1"), step, F.col("d").alias("d1"))
    return a.join(turned, step).groupBy("v1", "v2").agg(F.try_divide(F.sum(F.col("d1") * F.col("d2")), F.count("*") - 1).alias("asynchronous"))


def permutation_p(scores: DataFrame, observed: str, permuted: str) -> Column:
    """Aggregate: share of permuted scores at or above the observed one, the observed one included."""
    return (F.sum((F.col(permuted) >= F.col(observed)).cast("double")) + 1) / (F.count("*") + 1)


def validation_status(q2_percent: Column, p: Column) -> Column:
    return (
        F.when(q2_percent.isNull(), "no_model").when(p.isNull(), "unverified").when((q2_percent <= 0) | (p >= 0.05), "not_validated").when(q2_percent <= 50, "weak").otherwise("validated")
    )


def spectrum_similarity(a: DataFrame, b: DataFrame, mass: str, intensity: str, ppm: float) -> DataFrame:
    """One row: peaks of each spectrum, those of a with a partner, Jaccard index and cosine.

    A peak's partner is the nearest in its window; the norms of the cosine are over all peaks, not the matched ones only.
    """
    from .ranges import best_match, ppm_join

    other = b.groupBy(F.col(mass).alias("_m")).agg(F.sum(intensity).alias("_i"))
    mine = a.groupBy(mass).agg(F.sum(intensity).alias(intensity))
    hit = best_match(ppm_join(mine, other, mass, "_m", ppm), [mass], [F.abs(F.col("_m") - F.col(mass)), F.col("_m")])
    norm = lambda df, c: df.agg(F.count("*").alias("n"), F.sum(F.col(c) * F.col(c)).alias("s"))
    parts = norm(mine, intensity).select(F.lit("a").alias("k"), "n", "s").unionByName(norm(other, "_i").select(F.lit("b").alias("k"), "n", "s"))
    parts = parts.unionByName(hit.agg(F.count("*").alias("n"), F.sum(F.col(intensity) * F.col("_i")).alias("s")).select(F.lit("c").alias("k"), "n", "s"))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    one = parts.agg(pick("a", "n").alias("n_a"), pick("b", "n").alias("n_b"), pick("c", "n").alias("common"), (pick("c", "s") / F.sqrt(pick("a", "s") * pick("b", "s"))).alias("cosine"))
    return one.select("n_a", "n_b", "common", F.try_divide("common", F.col("n_a") + F.col("n_b") - F.col("common")).alias("jaccard"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def descriptor_cards(long: DataFrame, block: str = "block", value: str = "value") -> DataFrame:
    """Mean and sample deviation of each descriptor of each block; the deviation needs two values."""
    return long.groupBy(block, "descriptor").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def cohort_profile(long: DataFrame, value: str = "value") -> DataFrame:
    """Each value and its descriptor's mean, both scaled to 0..1 by the descriptor's range; null for a constant descriptor."""
    spread = long.groupBy("descriptor").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_mean"))
    scale = lambda x: F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return long.join(spread, "descriptor").withColumn("scaled", scale(F.col(value))).withColumn("cohort", scale(F.col("_mean"))).drop("_lo", "_hi", "_mean")


def correlation_edges(pairs: DataFrame, block: dict[str, str], threshold: float = 0.7, cross_only: bool = True) -> DataFrame:
    """Edges (f1, f2, r, block1, block2) of pairs with |r| at the threshold or above, between blocks only if asked."""
    known = F.create_map(*[F.lit(x) for kv in block.items() for x in kv])
    out = pairs.where(F.abs("r") >= threshold).withColumn("block1", F.element_at(known, F.col("f1"))).withColumn("block2", F.element_at(known, F.col("f2")))
    return out.where("block1 <> block2") if cross_only else out


def fused_features(wide: DataFrame, key: str, blocks: dict[str, list[str]]) -> DataFrame:
    """Descriptors ready for a model: the median for what is missing, population z-scores, and each block weighed by the square root of its number of descriptors.

    Medians come from sketches and one exact pass over what they bracket; a constant descriptor becomes zero.
    """
    from .fitted import apply_preprocessing, preprocessing

    features = [f for fs in blocks.values() for f in fs]
    return apply_preprocessing(wide.select(key, *features), preprocessing(wide, blocks)).select(key, *features)


def sec_calibration(standards: DataFrame, keys: list[str], volume: str, mass: str) -> DataFrame:
    """Linear calibration of log10 mass by volume of each key: slope, intercept, r2 and whether mass falls with volume."""
    x, y = F.when(F.col(mass) > 0, F.col(volume)), F.log10(F.when(F.col(mass) > 0, F.col(mass)))
    return standards.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")).withColumn("falling", F.col("slope") < 0)
