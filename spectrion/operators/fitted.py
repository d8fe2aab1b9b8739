"""Preprocessing and models that are fitted on one table, kept as a table, and applied to others, streams too.

Every parameter comes from training rows alone. Training sets are all rows
(number -1) and, with folds, all rows but one fold's. Medians are exact: KLL
sketches of (descriptor, fold) are merged to those of training sets and
bracket each median, one more pass counts below the bracket and the values in
it. Missing values take the training set's median.

Models are made from sums of products of [1, descriptors, gaps, responses] by
fold, where a gap is 1 for a missing value. A training set's matrix after
imputation follows from the sums for any medians, so one pass over the samples
serves all folds without a look at the rows that a fold leaves out.

A model is a table (response, descriptor, median, slope, intercept). Applied
to a table it is one broadcast row, so the other side may be a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fusion import clean_number, unpivot
from .models import product_sums

#: Size of a sketch, and the share of rows on either side of the middle that brackets a median.
SKETCH, MARGIN = 4000, 0.004

ALL = -1


def _long(wide: DataFrame, features: list[str], fold: Column) -> DataFrame:
    """(fold, descriptor, value) of finite values."""
    return unpivot(wide.withColumn("_fold", fold.cast("int")), ["_fold"], features).withColumnRenamed("_fold", "fold")


def _training(folds: int) -> Column:
    """The training sets that hold a row: all rows, and those that leave out another fold."""
    sets = F.array(F.lit(ALL), *map(F.lit, range(folds))) if folds > 1 else F.array(F.lit(ALL))
    return F.explode(F.filter(sets, lambda t: t != F.col("fold")))


def medians(long: DataFrame, folds: int = 1, sketch: int = SKETCH, margin: float = MARGIN) -> DataFrame:
    """(train, descriptor, n, median) over (fold, descriptor, value): exact, whatever the sketches say.

    A bracket that misses its median by a sketch's error is opened and counted again.
    """
    by_fold = long.groupBy("fold", "descriptor").agg(F.kll_sketch_agg_double("value", F.lit(sketch)).alias("s"), F.count("*").alias("n"))
    merged = by_fold.withColumn("train", _training(folds)).groupBy("train", "descriptor").agg(F.kll_merge_agg_double("s").alias("s"), F.sum("n").alias("n"))
    place = lambda q: F.kll_sketch_get_quantile_double("s", F.lit(q))
    brackets = merged.select("train", "descriptor", "n", place(0.5 - margin).alias("lo"), place(0.5 + margin).alias("hi"))
    found = _held(_within(long, brackets, folds))
    missed = found.where("median IS NULL")
    if missed.isEmpty():
        return found
    whole = missed.select("train", "descriptor", "n", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    return found.where("median IS NOT NULL").unionByName(_held(_within(long, whole, folds)))


def _held(small: DataFrame) -> DataFrame:
    """A table of a few numbers for each descriptor and training set, brought to the driver so that what uses it doesn't work it out again."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def _within(long: DataFrame, brackets: DataFrame, folds: int) -> DataFrame:
    """Medians of (train, descriptor, n, lo, hi); null where the bracket doesn't hold it. Brackets are three numbers for each descriptor and training set."""
    rows = long.withColumn("train", _training(folds)).join(F.broadcast(brackets), ["train", "descriptor"]).where("value <= hi")
    counted = rows.groupBy("train", "descriptor", F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("value")).agg(F.count("*").alias("m"), F.first("n").alias("n"))
    order = Window.partitionBy("train", "descriptor").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("m").over(order))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    hit = lambda k: F.min(F.when(F.col("value").isNotNull() & (F.col("upto") > k), F.col("value")))
    below = F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("m"))), F.lit(0))
    found = ranked.groupBy("train", "descriptor", "n").agg(hit(first).alias("a"), hit(second).alias("b"), below.alias("below"))
    return found.select("train", "descriptor", "n", F.when(F.col("below") <= first, (F.col("a") + F.col("b")) / 2).alias("median"))


def preprocessing(wide: DataFrame, blocks: dict[str, list[str]], fold: Column | None = None, folds: int = 1, weigh: str = "size") -> DataFrame:
    """(train, descriptor, block, median, mean, scale, weight) of each training set.

    Scales are population deviations after imputation, one where they are
    under 1e-12; a descriptor without a value has the median zero. Blocks are
    weighed by the square root of their number of descriptors (``size``), by
    their norm (``norm``) or not (``none``).
    """
    block = {f: b for b, fs in blocks.items() for f in fs}
    own = F.lit(0) if fold is None else fold
    long = _long(wide, list(block), own)
    spark = wide.sparkSession
    sets = [ALL, *(range(folds) if folds > 1 else [])]
    sizes = wide.select(own.cast("int").alias("fold")).withColumn("train", _training(folds)).groupBy("train").agg(F.count("*").alias("rows"))
    every = spark.createDataFrame([(t, f, b, len(blocks[b])) for t in sets for f, b in block.items()], "train int, descriptor string, block string, size int")
    mid = medians(long, folds)
    known = long.withColumn("train", _training(folds)).join(F.broadcast(mid.select("train", "descriptor", "median")), ["train", "descriptor"])
    off = F.col("value") - F.col("median")
    sums = known.groupBy("train", "descriptor").agg(F.first("median").alias("median"), F.sum(off).alias("s"), F.sum(off * off).alias("q"))
    joined = every.join(sizes, "train").join(sums, ["train", "descriptor"], "left")
    shift = F.coalesce(F.col("s") / F.col("rows"), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.coalesce(F.col("q") / F.col("rows"), F.lit(0.0)) - shift * shift, F.lit(0.0)))
    made = joined.withColumn("median", F.coalesce("median", F.lit(0.0))).withColumn("mean", F.col("median") + shift).withColumn("scale", F.when(spread >= 1e-12, spread).otherwise(1.0))
    if weigh == "norm":
        varied = F.when(spread >= 1e-12, F.col("rows")).otherwise(0)
        norm = F.sqrt(F.sum(varied).over(Window.partitionBy("train", "block")))
        weight = F.when(norm > 1e-12, 1.0 / norm).otherwise(1.0)
    else:
        weight = F.pow(F.col("size").cast("double"), F.lit(-0.5)) if weigh == "size" else F.lit(1.0)
    return _held(made.withColumn("weight", weight).select("train", "descriptor", "block", "median", "mean", "scale", "weight"))


def _one_row(state: DataFrame, features: list[str], fields: list[str]) -> DataFrame:
    """The state as one row: an array of each field in the order of ``features``, which are 3,000 at most for a model."""
    held = F.map_from_entries(F.collect_list(F.struct("descriptor", F.struct(*fields))))
    ordered = state.agg(held.alias("_m")).select(F.transform(F.array(*map(F.lit, features)), lambda f: F.element_at("_m", f)).alias("_m"))
    return ordered.select(*[F.col(f"_m.{c}").alias(f"_{c}") for c in fields])


def _values(wide: DataFrame, features: list[str]) -> Column:
    """The row's descriptors as an array; what the table doesn't have is null."""
    return F.array(*[clean_number(F.col(f"`{f}`").cast("double")) if f in wide.columns else F.lit(None).cast("double") for f in features])


def apply_preprocessing(wide: DataFrame, state: DataFrame, train: int = ALL) -> DataFrame:
    """The descriptors of a table or stream, imputed, standardised and weighed by a training set's parameters; other columns stay."""
    own = state.where(F.col("train") == train)
    features = [r[0] for r in own.select("descriptor").orderBy("descriptor").collect()]  # descriptors of one model
    row = _one_row(own, features, ["median", "mean", "scale", "weight"])
    joined = wide.crossJoin(F.broadcast(row)).withColumn("_x", _values(wide, features))
    z = lambda i: (F.coalesce(F.col("_x")[i], F.col("_median")[i]) - F.col("_mean")[i]) / F.col("_scale")[i] * F.col("_weight")[i]
    return joined.select(*[c for c in wide.columns if c not in features], *[z(i).alias(f) for i, f in enumerate(features)])


# Models in the space of sums


@dataclass
class Fit:
    """Weights, rotations, loadings and response loadings of a model's components (columns), and their squared score lengths."""

    weights: np.ndarray
    rotations: np.ndarray
    loadings: np.ndarray
    response: np.ndarray
    lengths: np.ndarray

    @property
    def coefficients(self) -> np.ndarray:
        return self.rotations @ self.response.T


Weigher = Callable[[np.ndarray], np.ndarray]


def leading(cross: np.ndarray) -> np.ndarray:
    """Weights of the direction that shares most with the responses."""
    return np.linalg.svd(cross, full_matrices=False)[0][:, 0] if cross.shape[1] > 1 else cross[:, 0] / np.linalg.norm(cross)


def thresholded(keep: int, rounds: int = 500, tolerance: float = 1e-10) -> Weigher:
    """Weights of which all but ``keep`` are shrunk to zero, in turn with the responses' until they stay."""

    def soft(w: np.ndarray) -> np.ndarray:
        least = np.sort(np.abs(w))[::-1][keep] if keep < len(w) else 0.0
        out = np.sign(w) * np.maximum(np.abs(w) - least, 0.0)
        return out / (np.linalg.norm(out) or 1.0)

    def weigh(cross: np.ndarray) -> np.ndarray:
        side = np.linalg.svd(cross, full_matrices=False)[2][0] if cross.shape[1] > 1 else np.ones(1)
        w = soft(cross @ side)
        for _ in range(rounds if cross.shape[1] > 1 else 0):
            side = cross.T @ w
            side /= np.linalg.norm(side) or 1.0
            new = soft(cross @ side)
            if np.linalg.norm(new - w) < tolerance:
                return new
            w = new
        return w

    return weigh


def latent(gram: np.ndarray, cross: np.ndarray, components: int, weigh: Weigher = leading) -> Fit:
    """PLS of several responses from X'X and X'Y; the descriptors' part is never deflated, their rotations are."""
    left, size = cross.astype(float).copy(), max(np.linalg.norm(cross), 1e-300)
    w, r, p, q, tt = [], [], [], [], []
    for _ in range(components):
        if np.linalg.norm(left) < 1e-10 * size:
            break
        weight = weigh(left)
        turn = weight.copy()
        for pj, rj in zip(p, r):
            turn -= (pj @ weight) * rj
        length = turn @ gram @ turn
        if length <= 1e-12 * max(np.trace(gram), 1e-300):
            break
        load, share = gram @ turn / length, left.T @ turn / length
        left = left - np.outer(load, share) * length
        w.append(weight), r.append(turn), p.append(load), q.append(share), tt.append(length)
    side = lambda x, n: np.array(x).T if x else np.zeros((n, 0))
    return Fit(side(w, len(gram)), side(r, len(gram)), side(p, len(gram)), side(q, cross.shape[1]), np.array(tt))


def orthogonal(gram: np.ndarray, cross: np.ndarray, across: int) -> Fit:
    """One predictive component of one response after ``across`` orthogonal ones; with none it is PLS of one component."""
    from .models import orthogonal_rotations

    if cross.shape[1] != 1:
        raise ValueError("orthogonal models have two classes or one response")
    ahead, _ = orthogonal_rotations(gram, cross[:, 0], across)
    length = ahead @ gram @ ahead
    if length <= 1e-12 * max(np.trace(gram), 1e-300):
        return latent(gram, cross, 0)
    return Fit(leading(cross)[:, None], ahead[:, None], (gram @ ahead / length)[:, None], (cross.T @ ahead / length)[:, None], np.array([length]))


def sequential(gram: np.ndarray, cross: np.ndarray, blocks: list[np.ndarray], components: list[int]) -> tuple[Fit, list[np.ndarray]]:
    """Blocks in turn, each cleared of the scores before it; also the coefficients after each block."""
    p = len(gram)
    fits, turns, left, b, stages = [], np.zeros((p, 0)), cross.astype(float).copy(), np.zeros_like(cross, dtype=float), []
    for idx, k in zip(blocks, components):
        own = np.eye(p)[:, idx]
        if turns.shape[1]:
            own = own - turns @ np.linalg.solve(turns.T @ gram @ turns, turns.T @ gram @ own)
        fit = latent(own.T @ gram @ own, own.T @ left, k)
        ahead = own @ fit.rotations
        left = left - gram @ ahead @ fit.response.T
        b = b + ahead @ fit.response.T
        stages.append(b)
        fits.append(Fit(np.zeros((p, fit.weights.shape[1])), ahead, gram @ ahead / np.maximum(fit.lengths, 1e-300), fit.response, fit.lengths))
        fits[-1].weights[idx] = fit.weights
        turns = np.column_stack([turns, ahead])
    parts = zip(*[(f.weights, f.rotations, f.loadings, f.response, f.lengths) for f in fits])
    return Fit(*(np.concatenate(x, axis=-1) for x in parts)), stages


# From samples to models


@dataclass
class Sums:
    """Sums by fold of products of [1, descriptors less ``shift`` (zero for gaps), gaps, responses]."""

    features: list[str]
    gaps: list[int]
    responses: list[str]
    shift: np.ndarray
    folds: np.ndarray
    medians: dict[int, np.ndarray]

    def matrix(self, part: np.ndarray, train: int) -> np.ndarray:
        """Products of [1, imputed descriptors less shift, responses] over a part, with a training set's medians."""
        p, g, k = len(self.features), len(self.gaps), len(self.responses)
        put = np.zeros((1 + p + k, part.shape[0]))
        put[0, 0] = 1.0
        put[1 : p + 1, 1 : p + 1] = np.eye(p)
        for place, j in enumerate(self.gaps):
            put[1 + j, 1 + p + place] = self.medians[train][j] - self.shift[j]
        put[1 + p :, 1 + p + g :] = np.eye(k)
        return put @ part @ put.T


def model_sums(samples: DataFrame, features: list[str], responses: dict[str, Column], fold: Column | None = None, folds: int = 1) -> Sums:
    """One pass for medians' sketches, one for their brackets, one for the sums; rows with a null response are left out."""
    own = F.lit(0) if fold is None else fold
    names = list(responses)
    rows = samples.withColumns({f"_y{i}": c.cast("double") for i, c in enumerate(responses.values())}).withColumn("_f", own.cast("int"))
    rows = rows.where(F.array_min(F.array(*[clean_number(F.col(f"_y{i}")).isNotNull() for i in range(len(names))])))
    sets = [ALL, *(range(folds) if folds > 1 else [])]
    at = {f: j for j, f in enumerate(features)}
    mid = {t: np.zeros(len(features)) for t in sets}
    known = np.zeros(len(features))
    total = rows.count()
    for r in medians(_long(rows, features, F.col("_f")), folds).collect():  # descriptors times training sets
        mid[r["train"]][at[r["descriptor"]]] = r["median"]
        if r["train"] == ALL:
            known[at[r["descriptor"]]] = r["n"]
    gaps = [j for j in range(len(features)) if known[j] < total]
    shift = mid[ALL]
    cell = lambda f: clean_number(F.col(f).cast("double"))
    columns = {f"x{j}": F.coalesce(cell(f) - float(shift[j]), F.lit(0.0)) for f, j in at.items()}
    columns |= {f"g{j}": cell(features[j]).isNull().cast("double") for j in gaps}
    columns |= {f"y{i}": F.col(f"_y{i}") for i in range(len(names))}
    return Sums(features, gaps, names, shift, product_sums(rows, columns, F.col("_f"), max(folds, 1)), mid)


@dataclass
class Standard:
    """A training set's products of standardised and weighed descriptors and centred responses."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    y_mean: np.ndarray
    yy: np.ndarray


def standard(m: np.ndarray, p: int, blocks: list[np.ndarray], weigh: str = "size", autoscale: bool = True) -> Standard:
    n = max(m[0, 0], 1.0)
    mean, y_mean = m[0, 1 : p + 1] / n, m[0, p + 1 :] / n
    cov = m[1 : p + 1, 1 : p + 1] / n - np.outer(mean, mean)
    var = np.maximum(np.diag(cov), 0.0)
    flat = var <= 1e-12 * np.maximum(np.diag(m)[1 : p + 1] / n, 1e-300)
    deviation = np.where(flat, 1.0, np.sqrt(var))
    scale = deviation if autoscale else np.ones(p)
    weight = np.ones(p)
    for idx in blocks:
        if weigh == "size":
            weight[idx] = len(idx) ** -0.5
        elif weigh == "norm":
            norm = np.sqrt((n * np.where(flat, 0.0, var)[idx] / scale[idx] ** 2).sum())
            weight[idx] = 1.0 / norm if norm > 1e-12 else 1.0
    k = weight / scale
    cross = (m[1 : p + 1, p + 1 :] - n * np.outer(mean, y_mean)) * k[:, None]
    return Standard(n, mean, scale, weight, n * cov * np.outer(k, k), cross, y_mean, m[p + 1 :, p + 1 :] - n * np.outer(y_mean, y_mean))


@dataclass
class Method:
    """How a model is made: ``kind`` is pls, sparse, orthogonal, multiblock or sequential."""

    kind: str = "pls"
    components: int = 2
    keep: int = 15
    across: int = 1
    weigh: str = "size"
    autoscale: bool = True

    def fit(self, s: Standard, blocks: list[np.ndarray]) -> Fit:
        k = min(self.components, max(1, int(s.n) - 1))
        if self.kind == "sparse":
            return latent(s.gram, s.cross, k, thresholded(self.keep))
        if self.kind == "orthogonal":
            return orthogonal(s.gram, s.cross, self.across)
        if self.kind == "sequential":
            return sequential(s.gram, s.cross, blocks, [min(k, len(b)) for b in blocks])[0]
        if self.kind not in ("pls", "multiblock"):
            raise ValueError(f"no model {self.kind}")
        return latent(s.gram, s.cross, k)


def places(features: list[str], blocks: dict[str, list[str]] | None) -> list[np.ndarray]:
    at = {f: j for j, f in enumerate(features)}
    return [np.array([at[f] for f in fs]) for fs in (blocks or {"all": features}).values()]


def q2(sums: Sums, method: Method, blocks: dict[str, list[str]] | None = None) -> float:
    """1 - PRESS / total squares over all responses: each fold by a model, medians and scales of the other folds, from the sums alone."""
    p, where = len(sums.features), places(sums.features, blocks)
    press = 0.0
    for f, part in enumerate(sums.folds):
        s = standard(sums.matrix(sums.folds.sum(axis=0) - part, f), p, where, method.weigh, method.autoscale)
        slope = method.fit(s, where).coefficients * (s.weight / s.scale)[:, None]
        left = sums.matrix(part, f)
        for i in range(len(sums.responses)):
            mix = np.zeros(len(left))
            mix[0], mix[1 : p + 1], mix[1 + p + i] = s.mean @ slope[:, i] - s.y_mean[i], -slope[:, i], 1.0
            press += mix @ left @ mix
    whole = standard(sums.matrix(sums.folds.sum(axis=0), ALL), p, where)
    squares = float(np.trace(whole.yy))
    return float(1 - press / squares) if squares > 0 else float("nan")


def dummies(label: str, classes: list) -> dict[str, Column]:
    """One response of 0 and 1 for each class; for two classes one response, that of the second."""
    found = F.col(label)
    return {str(c): F.when(found.isNotNull(), (found == F.lit(c)).cast("double")) for c in (classes if len(classes) != 2 else classes[1:])}


def classes_of(samples: DataFrame, label: str, most: int = 1000) -> list:
    """The classes in order; more than ``most`` are an error."""
    found = [r[0] for r in samples.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(most + 1).collect()]
    if not 2 <= len(found) <= most:
        raise ValueError(f"two to {most} classes are needed")
    return found


MODEL = "response string, descriptor string, median double, slope double, weight double, importance double, intercept double"


def model_table(spark: SparkSession, sums: Sums, method: Method, blocks: dict[str, list[str]] | None = None) -> DataFrame:
    """MODEL of all rows: a response is its intercept plus the sum of slopes times imputed descriptors. ``weight`` is that of the first component, ``importance`` in the projection."""
    p, where = len(sums.features), places(sums.features, blocks)
    s = standard(sums.matrix(sums.folds.sum(axis=0), ALL), p, where, method.weigh, method.autoscale)
    fit = method.fit(s, where)
    slope = fit.coefficients * (s.weight / s.scale)[:, None]
    explained = fit.lengths * (fit.response**2).sum(axis=0)
    vip = np.sqrt(p * (fit.weights**2 @ explained) / explained.sum()) if explained.sum() > 0 else np.ones(p)
    first = fit.weights[:, 0] if fit.weights.shape[1] else np.zeros(p)
    start = s.y_mean - (s.mean + sums.shift) @ slope
    rows = [(y, f, float(sums.medians[ALL][j]), float(slope[j, i]), float(first[j]), float(vip[j]), float(start[i])) for i, y in enumerate(sums.responses) for j, f in enumerate(sums.features)]
    return spark.createDataFrame(rows, MODEL)


def predicted(wide: DataFrame, model: DataFrame, scores: str = "scores", guess: str | None = "predicted", second: str | None = None) -> DataFrame:
    """A table or stream with each response's value in map ``scores`` and the response of the largest in ``guess``.

    A model of one response tells it from ``second`` at a half. Values are not
    cut to 0 and 1, and a row's don't depend on other rows.
    """
    features = [r[0] for r in model.select("descriptor").distinct().orderBy("descriptor").collect()]  # 3,000 at most
    held = F.map_from_entries(F.collect_list(F.struct("descriptor", F.struct("median", "slope"))))
    each = model.groupBy("response").agg(held.alias("m"), F.first("intercept").alias("intercept"))
    in_order = F.transform(F.array(*map(F.lit, features)), lambda f: F.element_at("m", f))
    one = each.agg(F.sort_array(F.collect_list(F.struct("response", "intercept", in_order.alias("m")))).alias("_models"))
    joined = wide.crossJoin(F.broadcast(one)).withColumn("_x", _values(wide, features))
    value = lambda r: F.aggregate(F.zip_with("_x", r["m"], lambda x, c: F.coalesce(x, c["median"]) * c["slope"]), r["intercept"], lambda a, b: a + b)
    out = joined.withColumn("_y", F.transform("_models", lambda r: F.struct(value(r).alias("y"), r["response"].alias("response"))))
    by_name = F.map_from_entries(F.transform("_y", lambda v: F.struct(v["response"], v["y"])))
    best = F.array_max("_y")
    named = F.when(F.size("_y") > 1, best["response"]).when(best["y"] >= 0.5, best["response"]).otherwise(F.lit(second))
    return out.select(*[c for c in wide.columns if c not in (scores, guess)], by_name.alias(scores), *([named.alias(guess)] if guess else []))
