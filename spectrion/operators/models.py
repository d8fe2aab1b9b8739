"""Latent-variable models from sums over samples.

A model needs no more of its samples than the sums of products of their
descriptors and response. Each task adds them up batch by batch and Spark adds
the tasks' sums, so no sample meets another one and the number of samples is
unbounded; what reaches the driver is the square of the number of descriptors
for each fold. Every fold's training sums are all sums less its own, so the
scaling of a fold is that of its training rows. Scores and predictions are
projections, a column expression over the samples.

Rows with a null or NaN in a descriptor or the response are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrion.session import let_workers_import

#: Descriptors and responses of one model.
MOST = 3000

#: Bytes that the matrices of all folds may take, in the driver and in a task.
MOST_BYTES = 1 << 29


def usable(samples: DataFrame, names: list[str]) -> DataFrame:
    good = [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names]
    return samples.where(F.array_min(F.array(*good)))


def matrix_rows(samples: DataFrame, columns: dict[str, Column], fold: Column, folds: int = 1) -> DataFrame:
    """(fold, i, total array): rows of each fold's sums of products of every two of [1, columns].

    A task adds its batches up and sends each matrix row as one array; what
    tasks send is added array by array, apart for each row of a matrix.
    """
    m = len(columns) + 1
    if m > MOST or folds * m * m * 8 > MOST_BYTES:
        raise ValueError(f"{folds} folds of {m} columns are over {MOST} columns or {MOST_BYTES} bytes")
    let_workers_import(samples.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])])
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for f in np.unique(own):
                part = z[own == f]
                held[f] = held.get(f, 0.0) + part.T @ part
        for f, sums in held.items():
            yield packed([(f, i, row) for i, row in enumerate(sums)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held[f, i] = held.get((f, i), 0.0) + row.values.to_numpy()
        yield packed([(f, i, row) for (f, i), row in held.items()])

    def packed(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        f, i, row = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(i, pa.int32()), pa.array(row, pa.list_(pa.float64()))], ["fold", "i", "total"])

    rows = samples.select(fold.cast("int").alias("fold"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    parts = rows.mapInArrow(add, "fold int, i int, total array<double>")
    return parts.repartition("fold", "i").mapInArrow(join, "fold int, i int, total array<double>")


def sums_by_fold(samples: DataFrame, columns: dict[str, Column], fold: Column, folds: int = 1) -> DataFrame:
    """(fold, place, total): the sums of ``matrix_rows`` one by one, row by row of the matrix whose first row is that of ones."""
    rows = matrix_rows(samples, columns, fold, folds)
    return rows.select("fold", "i", F.posexplode("total").alias("j", "total")).select("fold", (F.col("i") * (len(columns) + 1) + F.col("j")).alias("place"), "total")


def product_sums(samples: DataFrame, columns: dict[str, Column], fold: Column, folds: int) -> np.ndarray:
    """The same as one array (folds, m, m) in the driver, brought there as Arrow buffers; ``MOST_BYTES`` bounds it."""
    m = len(columns) + 1
    out = np.zeros((folds, m, m))
    got = matrix_rows(samples, columns, fold, folds).toArrow()
    for f, i, row in zip(got.column("fold").to_pylist(), got.column("i").to_pylist(), got.column("total")):
        out[f, i] = row.values.to_numpy()
    return out


@dataclass
class Moments:
    """Sums of products of [1, descriptors, responses], by fold; descriptors are shifted by ``shift`` to keep digits."""

    features: list[str]
    shift: np.ndarray
    folds: np.ndarray

    @property
    def total(self) -> np.ndarray:
        return self.folds.sum(axis=0)


def moments(samples: DataFrame, features: list[str], responses: dict[str, Column], fold: Column, folds: int) -> Moments:
    row = samples.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    shift = np.array([row[f"m{i}"] or 0.0 for i in range(len(features))])
    columns = {f: F.col(f).cast("double") - float(shift[i]) for i, f in enumerate(features)} | responses
    return Moments(features, shift, product_sums(samples, columns, fold, folds))


@dataclass
class Scaled:
    """Products of standardised descriptors (population deviation) and a centred response, from sums."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    y_mean: float
    yy: float


def scaled(sums: np.ndarray, p: int, response: int = 0) -> Scaled:
    n, y = max(sums[0, 0], 1.0), 1 + p + response
    mean, y_mean = sums[0, 1 : p + 1] / n, sums[0, y] / n
    cov = sums[1 : p + 1, 1 : p + 1] / n - np.outer(mean, mean)
    var = np.diag(cov).copy()
    scale = np.sqrt(np.where(var > 1e-12 * np.maximum(np.diag(sums)[1 : p + 1] / n, 1e-300), var, 1.0))
    gram = n * cov / np.outer(scale, scale)
    cross = (sums[1 : p + 1, y] - n * mean * y_mean) / scale
    return Scaled(n, mean, scale, gram, cross, y_mean, sums[y, y] - n * y_mean * y_mean)


@dataclass
class Pls:
    """Weights, rotations (scores are X times these), loadings, response loadings and squared lengths of the scores."""

    weights: np.ndarray
    rotations: np.ndarray
    loadings: np.ndarray
    response: np.ndarray
    lengths: np.ndarray

    @property
    def coefficients(self) -> np.ndarray:
        return self.rotations @ self.response


def pls(gram: np.ndarray, cross: np.ndarray, components: int) -> Pls:
    """PLS of one response from X'X and X'y."""
    left = cross.astype(float).copy()
    w, r, p, q, tt = [], [], [], [], []
    for _ in range(components):
        norm = np.linalg.norm(left)
        if norm < 1e-10 * max(np.linalg.norm(cross), 1e-300):
            break
        weight = left / norm
        turn = weight.copy()
        for pj, rj in zip(p, r):
            turn -= (pj @ weight) * rj
        length = turn @ gram @ turn
        if length <= 1e-12 * max(np.trace(gram), 1e-300):
            break
        load, share = gram @ turn / length, turn @ left / length
        left = left - load * (share * length)
        w.append(weight), r.append(turn), p.append(load), q.append(share), tt.append(length)
    k = len(w)
    side = lambda x: np.array(x).T if k else np.zeros((len(cross), 0))
    return Pls(side(w), side(r), side(p), np.array(q), np.array(tt))


def importance(model: Pls) -> np.ndarray:
    """Importance of each descriptor in the projection."""
    explained = model.lengths * model.response**2
    return np.sqrt(len(model.weights) * (model.weights**2 @ explained) / explained.sum()) if explained.sum() > 0 else np.zeros(len(model.weights))


def projection(features: list[str], coefficients: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Column:
    """Sum of standardised descriptors times coefficients, as an expression over the row."""
    slope = coefficients / scale
    terms = F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), F.array(*map(F.lit, slope.tolist())), lambda x, b: x * b)
    return F.aggregate(terms, F.lit(float(-mean @ slope)), lambda a, b: a + b)


def by_hash(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int")


def _by_fold(m: Moments, response: int, components: int) -> Iterator[tuple[int, Scaled, np.ndarray]]:
    for f in range(len(m.folds)):
        train = scaled(m.total - m.folds[f], len(m.features), response)
        yield f, train, pls(train.gram, train.cross, min(components, max(1, int(train.n) - 1))).coefficients


def cross_validated(samples: DataFrame, key: str, features: list[str], response: str, folds: int, components: int = 2, fold: Column | None = None) -> DataFrame:
    """(key, fold, truth, predicted): each row by the model of the other folds, scaled by their rows; folds by a hash of the key unless given."""
    rows = usable(samples, [*features, response]).withColumn("_fold", by_hash(key, folds) if fold is None else fold.cast("int"))
    m = moments(rows, features, {response: F.col(response)}, F.col("_fold"), folds)
    guess = F.lit(None).cast("double")
    for f, train, b in _by_fold(m, 0, components):
        guess = F.when(F.col("_fold") == f, F.lit(train.y_mean) + projection(features, b, train.mean + m.shift, train.scale)).otherwise(guess)
    return rows.select(key, F.col("_fold").alias("fold"), F.col(response).cast("double").alias("truth"), guess.alias("predicted"))


def _q2(m: Moments, response: int, components: int) -> float:
    """1 - PRESS / total squares, from the folds' sums alone."""
    p, press = len(m.features), 0.0
    for f, train, b in _by_fold(m, response, components):
        # residual y - y_mean - (x - mean) b / scale as a combination of [1, x, y]
        slope = b / train.scale
        mix = np.zeros(m.total.shape[0])
        mix[0], mix[1 : p + 1], mix[1 + p + response] = train.mean @ slope - train.y_mean, -slope, 1.0
        press += mix @ m.folds[f] @ mix
    yy = scaled(m.total, p, response).yy
    return float(1 - press / yy) if yy > 0 else float("nan")


def permutation_test(samples: DataFrame, key: str, features: list[str], response: str, folds: int, permutations: int, components: int = 2, seed: int = 42, fold: Column | None = None) -> DataFrame:
    """(permutation, q2) of a discriminant model: 0 has the true 0/1 labels, the others labels drawn anew for each row with the same share of ones, by a hash of the key.

    All responses' sums come from one pass over the samples.
    """
    rows = usable(samples, [*features, response]).withColumn("_fold", by_hash(key, folds) if fold is None else fold.cast("int"))
    y = F.col(response).cast("double")
    share, odd = rows.agg(F.avg(y), F.coalesce(F.max(F.abs(y * (1 - y))), F.lit(0.0))).first()
    if odd:
        raise ValueError("labels other than 0 and 1")
    draw = lambda k: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(k)), F.lit(1 << 53)) < F.lit(int((share or 0.0) * (1 << 53)))).cast("double")
    m = moments(rows, features, {"0": y} | {str(k): draw(k) for k in range(1, permutations + 1)}, F.col("_fold"), folds)
    return samples.sparkSession.createDataFrame([(k, _q2(m, k, components)) for k in range(permutations + 1)], "permutation int, q2 double")


def _all(samples: DataFrame, features: list[str], response: str) -> tuple[Moments, Scaled]:
    m = moments(usable(samples, [*features, response]), features, {response: F.col(response)}, F.lit(0), 1)
    return m, scaled(m.total, len(features))


def quality(samples: DataFrame, key: str, features: list[str], response: str, folds: int, components: int = 2) -> DataFrame:
    """(component, r2x, r2y, q2) after so many components: shares of the descriptors' and the response's variation, and of the response's when predicted."""
    rows = usable(samples, [*features, response])
    m = moments(rows, features, {response: F.col(response)}, by_hash(key, folds), folds)
    s = scaled(m.total, len(features))
    model = pls(s.gram, s.cross, components)
    r2x = np.cumsum(model.lengths * (model.loadings**2).sum(axis=0)) / max(np.trace(s.gram), 1e-300)
    r2y = np.cumsum(model.lengths * model.response**2) / max(s.yy, 1e-300)
    out = [(k + 1, float(r2x[k]), float(r2y[k]), _q2(m, 0, k + 1)) for k in range(len(r2x))]
    return samples.sparkSession.createDataFrame(out, "component int, r2x double, r2y double, q2 double")


def variable_importance(samples: DataFrame, key: str, features: list[str], response: str, components: int = 2) -> DataFrame:
    """(descriptor, weight, vip, coefficient) of a PLS model on all samples; the weight is that of the first component."""
    _, s = _all(samples, features, response)
    model = pls(s.gram, s.cross, components)
    first = model.weights[:, 0] if model.weights.shape[1] else np.zeros(len(features))
    rows = [(f, float(a), float(b), float(c)) for f, a, b, c in zip(features, first, importance(model), model.coefficients)]
    return samples.sparkSession.createDataFrame(rows, "descriptor string, weight double, vip double, coefficient double")


def orthogonal_rotations(gram: np.ndarray, cross: np.ndarray, orthogonal: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of the predictive and the orthogonal scores of an orthogonal PLS model."""
    w = cross / (np.linalg.norm(cross) or 1.0)
    turn, outs = np.eye(len(w)), []  # what is left of X is X times turn
    for _ in range(orthogonal):
        left = turn.T @ gram @ turn
        load = left @ w / ((w @ left @ w) or 1.0)
        wo = load - (w @ load) * w
        norm = np.linalg.norm(wo)
        if norm < 1e-10:
            break
        wo /= norm
        out = turn @ wo
        outs.append(out)
        turn = turn - np.outer(out, wo @ left) / (wo @ left @ wo)
    return turn @ w, np.array(outs).T if outs else np.zeros((len(w), 0))


def orthogonal_scores(samples: DataFrame, key: str, features: list[str], response: str, orthogonal: int = 1) -> DataFrame:
    """(key, predictive, orthogonal) scores of each sample; the sign makes the largest weight positive."""
    m, s = _all(samples, features, response)
    ahead, across = orthogonal_rotations(s.gram, s.cross, orthogonal)
    sign = 1.0 if s.cross[np.argmax(np.abs(s.cross))] >= 0 else -1.0
    score = lambda r: projection(features, r, s.mean + m.shift, s.scale)
    side = score(across[:, 0]) if across.shape[1] else F.lit(0.0)
    return usable(samples, [*features, response]).select(key, score(sign * ahead).alias("predictive"), side.alias("orthogonal"))


def block_models(samples: DataFrame, key: str, blocks: dict[str, list[str]], response: str, components: int = 2) -> DataFrame:
    """(block, multiblock_share, sequential_share) of one response.

    The multiblock model weighs blocks by their number of descriptors; the
    sequential one adds to each block's descriptors only what is orthogonal to
    the scores before, one component a block.
    """
    features = [f for fs in blocks.values() for f in fs]
    _, s = _all(samples, features, response)
    weigh = np.concatenate([np.full(len(fs), 1 / np.sqrt(len(fs))) for fs in blocks.values()])
    joint = pls(s.gram * np.outer(weigh, weigh), s.cross * weigh, components)
    explained = joint.lengths * joint.response**2
    edges = np.cumsum([0, *map(len, blocks.values())])
    share = np.array([(joint.weights[a:b] ** 2 @ explained).sum() for a, b in zip(edges, edges[1:])])
    share = share / (share.sum() or 1.0)
    scores, left, added = np.zeros((len(features), 0)), s.cross.copy(), []
    for a, b in zip(edges, edges[1:]):
        turn = np.eye(len(features))[:, a:b]
        if scores.shape[1]:
            turn = turn - scores @ np.linalg.solve(scores.T @ s.gram @ scores, scores.T @ s.gram @ turn)
        w = turn.T @ left
        out = turn @ (w / (np.linalg.norm(w) or 1.0))
        length = out @ s.gram @ out
        if length <= 1e-12 * max(np.trace(s.gram), 1e-300):
            added.append(0.0)
            continue
        q = out @ left / length
        added.append(float(q * q * length / (s.yy or 1.0)))
        left, scores = left - q * (s.gram @ out), np.column_stack([scores, out])
    rows = [(name, float(x), y) for name, x, y in zip(blocks, share, added)]
    return samples.sparkSession.createDataFrame(rows, "block string, multiblock_share double, sequential_share double")
