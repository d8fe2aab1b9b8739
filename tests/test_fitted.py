"""Fitted preprocessing and models against plain numpy, with folds, gaps, three classes, saved tables and a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrion.operators import fitted
from spectrion.operators.fitted import ALL, Method


def make(n=40, p=6, gaps=0.15, classes=2, seed=3):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + y[:, None] * rng.normal(size=p) * 2 + 100 * np.arange(p)
    x[rng.random((n, p)) < gaps] = np.nan
    return x, y


def frame(spark, x, y, k=5):
    rows = [(i, i % k, "abc"[c], *[None if np.isnan(v) else float(v) for v in row]) for i, (row, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, fold int, label string, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))


def prepared(x, train, weigh="size", blocks=None, autoscale=True):
    """Training medians, means and deviations applied to all rows."""
    med = np.nan_to_num(np.nanmedian(x[train], axis=0))
    full = np.where(np.isnan(x), med, x)
    mean, sd = full[train].mean(axis=0), full[train].std(axis=0)
    z = (full - mean) / (np.where(sd < 1e-12, 1.0, sd) if autoscale else 1.0)
    for idx in blocks or [np.arange(x.shape[1])]:
        if weigh == "size":
            z[:, idx] /= np.sqrt(len(idx))
        elif weigh == "norm":
            z[:, idx] /= np.linalg.norm(z[np.ix_(train, idx)])
    return z, med, mean, sd


def nipals(x, y, k, weigh=None):
    """PLS by deflating X and Y themselves; the coefficients."""
    e, f, w, p, q = x.copy(), y.copy(), [], [], []
    for _ in range(k):
        u = np.linalg.svd(e.T @ f, full_matrices=False)[0][:, 0] if weigh is None else weigh(e.T @ f)
        t = e @ u
        pl, ql = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, pl), f - np.outer(t, ql)
        w.append(u), p.append(pl), q.append(ql)
    w, p, q = (np.array(v).T for v in (w, p, q))
    return w @ np.linalg.pinv(p.T @ w) @ q.T


def responses(y):
    k = len(set(y))
    return np.eye(k)[y] if k > 2 else y[:, None].astype(float)


def cross_q2(x, y, fold, fit, **how):
    yy = responses(y)
    guess = np.zeros_like(yy)
    for f in set(fold):
        train = np.nonzero(fold != f)[0]
        z = prepared(x, train, **how)[0]
        mean = yy[train].mean(axis=0)
        guess[fold == f] = (z[fold == f] - z[train].mean(axis=0)) @ fit(z[train] - z[train].mean(axis=0), yy[train] - mean) + mean
    return 1 - ((yy - guess) ** 2).sum() / ((yy - yy.mean(axis=0)) ** 2).sum()


def sums_of(df, p, y, folds=5):
    features = [f"x{j}" for j in range(p)]
    return fitted.model_sums(df, features, fitted.dummies("label", ["a", "b", "c"][: len(set(y))]), F.col("fold"), folds)


def test_preprocessing_of_each_training_set(spark):
    x, y = make(n=45, gaps=0.2)
    x[:, 5] = 7.0  # constant
    x[:, 4] = np.nan  # never measured
    df = frame(spark, x, y)
    blocks = {"one": ["x0", "x1", "x2"], "two": ["x3", "x4", "x5"]}
    state = fitted.preprocessing(df, blocks, F.col("fold"), 5).cache()
    fold = np.arange(45) % 5
    for t in (ALL, 0, 3):
        train = np.nonzero(fold != t)[0]
        _, med, mean, sd = prepared(x, train)
        got = {r.descriptor: r for r in state.where(F.col("train") == t).collect()}
        for j in range(6):
            r = got[f"x{j}"]
            assert (r.median, r.mean, r.weight) == pytest.approx((med[j], mean[j], 3**-0.5)) and r.scale == pytest.approx(sd[j] if sd[j] > 1e-9 else 1.0)
    z = prepared(x, np.nonzero(fold != 2)[0], blocks=[np.arange(3), np.arange(3, 6)])[0]
    applied = fitted.apply_preprocessing(df, state, 2).orderBy("id").toPandas()
    assert np.allclose(applied[[f"x{j}" for j in range(6)]].to_numpy(), z) and list(applied.columns[:3]) == ["id", "fold", "label"]
    norms = {r.block: r.weight for r in fitted.preprocessing(df, blocks, weigh="norm").collect()}
    zn = prepared(x, np.arange(45), weigh="none")[0]
    assert norms["one"] == pytest.approx(1 / np.linalg.norm(zn[:, :3])) and norms["two"] == pytest.approx(1 / np.linalg.norm(zn[:, 3:]))


def test_medians_with_small_sketches_and_ties(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.repeat(0.25, 500), rng.exponential(size=2501) * 50])
    fold = np.arange(len(values)) % 7
    long = spark.createDataFrame([(int(f), "a", float(v)) for f, v in zip(fold, values)], "fold int, descriptor string, value double")
    for sketch, margin in ((4000, 0.004), (8, 1e-4)):  # the second pair's brackets miss
        got = {r.train: r.median for r in fitted.medians(long, 7, sketch, margin).collect()}
        assert got == {t: pytest.approx(np.median(values[fold != t])) for t in range(-1, 7)}


@pytest.mark.parametrize("classes", [2, 3])
def test_pls_q2_without_leakage(spark, classes):
    x, y = make(classes=classes)
    got = fitted.q2(sums_of(frame(spark, x, y), 6, y), Method(components=2))
    assert got == pytest.approx(cross_q2(x, y, np.arange(len(y)) % 5, lambda a, b: nipals(a, b, 2)), abs=1e-9)


def test_leave_one_out(spark):
    x, y = make(n=16)
    df = frame(spark, x, y, k=16)
    assert fitted.q2(sums_of(df, 6, y, 16), Method(components=2)) == pytest.approx(cross_q2(x, y, np.arange(16), lambda a, b: nipals(a, b, 2)), abs=1e-9)


@pytest.mark.parametrize("classes", [2, 3])
def test_sparse_components(spark, classes):
    x, y = make(classes=classes, gaps=0.1)
    sums = sums_of(frame(spark, x, y), 6, y)
    weigh = fitted.thresholded(3)
    assert fitted.q2(sums, Method("sparse", 2, keep=3)) == pytest.approx(cross_q2(x, y, np.arange(len(y)) % 5, lambda a, b: nipals(a, b, 2, weigh)), abs=1e-9)
    table = fitted.model_table(spark, sums, Method("sparse", 1, keep=3)).toPandas()
    assert (table[table.response == table.response[0]].weight != 0).sum() == 3
    z = prepared(x, np.arange(len(y)), weigh="none")[0]
    if classes == 2:
        w = z.T @ (y - y.mean())
        ref = np.sign(w) * np.maximum(np.abs(w) - np.sort(np.abs(w))[::-1][3], 0)
        assert np.allclose(np.abs(table.weight), np.abs(ref / np.linalg.norm(ref)))


def orthogonal_fit(x, y, across):
    e, yc = x.copy(), y[:, 0]
    w = e.T @ yc
    w /= np.linalg.norm(w)
    b = np.eye(x.shape[1])
    for _ in range(across):
        t = e @ w
        load = e.T @ t / (t @ t)
        wo = load - (w @ load) * w
        wo /= np.linalg.norm(wo)
        to = e @ wo
        po = e.T @ to / (to @ to)
        e, b = e - np.outer(to, po), b @ (np.eye(len(w)) - np.outer(wo, po))
    t = e @ w
    return (b @ w * (t @ yc) / (t @ t))[:, None]


@pytest.mark.parametrize("across", [0, 1, 2])
def test_orthogonal_q2(spark, across):
    x, y = make(seed=11)
    sums = sums_of(frame(spark, x, y), 6, y)
    expected = cross_q2(x, y, np.arange(len(y)) % 5, lambda a, b: orthogonal_fit(a, b, across))
    assert fitted.q2(sums, Method("orthogonal", across=across)) == pytest.approx(expected, abs=1e-9)
    three = sums_of(frame(spark, *make(classes=3)), 6, [0, 1, 2])
    with pytest.raises(ValueError, match="two classes"):
        fitted.q2(three, Method("orthogonal"))


BLOCKS = {"one": ["x0", "x1", "x2", "x3"], "two": ["x4", "x5"]}
WHERE = [np.arange(4), np.arange(4, 6)]


def sequential_fit(x, y, ks):
    scores, left, fit = np.zeros((len(x), 0)), y.copy(), np.zeros_like(y)
    for idx, k in zip(WHERE, ks):
        own = x[:, idx] - scores @ np.linalg.pinv(scores) @ x[:, idx]
        b = nipals(own, left, k)
        fit, left = fit + own @ b, left - own @ b
        u, s, _ = np.linalg.svd(own @ b, full_matrices=False)
        e, f, ts = own.copy(), y - fit + own @ b, []
        for _ in range(k):
            w = np.linalg.svd(e.T @ f, full_matrices=False)[0][:, 0]
            t = e @ w
            ts.append(t)
            e, f = e - np.outer(t, e.T @ t / (t @ t)), f - np.outer(t, f.T @ t / (t @ t))
        scores = np.column_stack([scores, *ts])
    return np.linalg.pinv(x) @ fit


@pytest.mark.parametrize("classes", [2, 3])
def test_multiblock_and_sequential(spark, classes):
    x, y = make(n=60, classes=classes)
    sums = sums_of(frame(spark, x, y), 6, y)
    fold = np.arange(60) % 5
    joint = cross_q2(x, y, fold, lambda a, b: nipals(a, b, 2), weigh="norm", blocks=WHERE, autoscale=False)
    assert fitted.q2(sums, Method("multiblock", 2, weigh="norm", autoscale=False), BLOCKS) == pytest.approx(joint, abs=1e-9)
    chained = cross_q2(x, y, fold, lambda a, b: sequential_fit(a, b, (2, 2)), weigh="none")
    assert fitted.q2(sums, Method("sequential", 2, weigh="none"), BLOCKS) == pytest.approx(chained, abs=1e-7)


def test_saved_models_score_other_tables_and_streams(spark, tmp_path):
    x, y = make(n=48, classes=3)
    df = frame(spark, x, y)
    sums = sums_of(df, 6, y)
    fitted.model_table(spark, sums, Method(components=2)).write.parquet(f"{tmp_path}/model")
    model = spark.read.parquet(f"{tmp_path}/model")
    z = prepared(x, np.arange(48))[0]
    yy = responses(y)
    b = nipals(z - z.mean(axis=0), yy - yy.mean(axis=0), 2)
    other, _ = make(n=20, classes=3, seed=9)
    _, med, mean, sd = prepared(x, np.arange(48))
    expected = (np.where(np.isnan(other), med, other) - mean) / sd / np.sqrt(6) @ b + yy.mean(axis=0)
    new = frame(spark, other, np.zeros(20, int)).drop("label")
    rows = fitted.predicted(new, model).orderBy("id").collect()
    assert np.allclose([[r.scores[c] for c in "abc"] for r in rows], expected)
    assert [r.predicted for r in rows] == ["abc"[i] for i in expected.argmax(axis=1)] and (expected.max() > 1 or expected.min() < 0)
    one = fitted.predicted(new.where("id = 3").drop("x2"), model).first()
    row = np.where(np.isnan(other[3]), med, other[3])
    row[2] = med[2]
    assert np.allclose([one.scores[c] for c in "abc"], (row - mean) / sd / np.sqrt(6) @ b + yy.mean(axis=0))
    new.write.parquet(f"{tmp_path}/new")
    stream = fitted.predicted(spark.readStream.schema(new.schema).parquet(f"{tmp_path}/new"), model)
    stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start().awaitTermination()
    assert [r.scores for r in spark.table("scored").orderBy("id").collect()] == [r.scores for r in rows]
    two = fitted.predicted(df, fitted.model_table(spark, sums_of(frame(spark, *make()), 6, [0, 1]), Method()), second="a")
    assert {r.predicted for r in two.collect()} <= {"a", "b"}


def test_limits(spark):
    df = spark.range(3).withColumn("fold", F.lit(0)).withColumn("label", F.lit("a"))
    with pytest.raises(ValueError, match="classes"):
        fitted.classes_of(df, "label")
    wide = {f"c{i}": F.lit(0.0) for i in range(1500)}
    from spectrion.operators.models import product_sums

    with pytest.raises(ValueError, match="bytes"):
        product_sums(df, wide, F.lit(0), 40)
