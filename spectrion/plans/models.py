"""Queries of preprocessing and models that are fitted on some samples and applied to others."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrion.operators import fitted
from spectrion.operators.fitted import Method

from .base import query, r, table

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_BLOCKS = {"amount": _COLS[:2], "rates": _COLS[2:]}
_FOLDS = 3


def _samples(spark, d):
    """Mean values by supplier; some of them missing."""
    li = table(spark, d, "lineitem")
    share = F.avg((F.col("l_returnflag") == "R").cast("double"))
    means = li.groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in _COLS], share.alias("share"), F.avg("l_linenumber").alias("lines"))
    gaps = [F.when((F.col("l_suppkey") + i) % 5 != 1, F.col(c)).alias(c) for i, c in enumerate(_COLS)]
    kind = F.when(F.col("share") > 0.35, "c").when(F.col("lines") > 3, "b").otherwise("a")
    return means.select("l_suppkey", *gaps, "share", kind.alias("kind"))


_SAMPLES = f"""SELECT l_suppkey, {", ".join(f"CASE WHEN (l_suppkey + {i}) % 5 <> 1 THEN avg({c}) END AS {c}" for i, c in enumerate(_COLS))},
    avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS share FROM lineitem GROUP BY 1"""
_LONG = " UNION ALL ".join(f"SELECT l_suppkey, '{c}' AS descriptor, '{b}' AS block, {len(cs)} AS size, {c} AS v FROM s" for b, cs in _BLOCKS.items() for c in cs)


def _state_sql(rows: str) -> str:
    """State of the training sets of (train, l_suppkey, descriptor, block, size, v)."""
    return f"""m AS (SELECT train, descriptor, block, size, coalesce(median(v), 0) AS median FROM {rows} GROUP BY ALL),
    f AS (SELECT train, descriptor, block, size, median, avg(coalesce(v, median)) AS mean, stddev_pop(coalesce(v, median)) AS sd FROM {rows} JOIN m USING (train, descriptor, block, size) GROUP BY ALL)"""


@query(f"""WITH s AS ({_SAMPLES}), l AS ({_LONG}), t AS (SELECT train::INT AS train, l.* FROM l JOIN (SELECT unnest(range(-1, {_FOLDS})) AS train) ON train = -1 OR train <> l_suppkey % {_FOLDS}), {_state_sql('t')}
SELECT train, descriptor, block, round(median, 6) AS median, round(mean, 6) AS mean, round(CASE WHEN sd >= 1e-12 THEN sd ELSE 1 END, 6) AS scale, round(1 / sqrt(size), 6) AS weight FROM f""")
def fitted_preprocessing(spark, d):
    state = fitted.preprocessing(_samples(spark, d), _BLOCKS, F.col("l_suppkey") % _FOLDS, _FOLDS)
    return state.select("train", "descriptor", "block", *[r(c).alias(c) for c in ("median", "mean", "scale", "weight")])


_Z = "(coalesce(l.v, median) - mean) / CASE WHEN sd >= 1e-12 THEN sd ELSE 1 END / sqrt(size)"


@query(f"""WITH s AS ({_SAMPLES}), l AS ({_LONG}), t AS (SELECT -1 AS train, * FROM l WHERE l_suppkey % 2 = 0), {_state_sql('t')}
SELECT l_suppkey, {", ".join(f"round(sum({_Z}) FILTER (WHERE descriptor = '{c}'), 6) AS {c}" for c in _COLS)} FROM l JOIN f USING (descriptor, block, size) WHERE l_suppkey % 2 = 1 GROUP BY 1""")
def applied_preprocessing(spark, d):
    samples = _samples(spark, d)
    state = fitted.preprocessing(samples.where("l_suppkey % 2 = 0"), _BLOCKS)
    out = fitted.apply_preprocessing(samples.where("l_suppkey % 2 = 1").select("l_suppkey", *_COLS), state)
    return out.select("l_suppkey", *[r(c).alias(c) for c in _COLS])


@query(f"""WITH s AS ({_SAMPLES}), l AS ({_LONG}), t AS (SELECT -1 AS train, * FROM l WHERE l_suppkey % 2 = 0), {_state_sql('t')},
z AS (SELECT l_suppkey, descriptor, {_Z} AS z FROM l JOIN f USING (descriptor, block, size)), y AS (SELECT l_suppkey, share, l_suppkey % 2 = 0 AS known FROM s),
w AS (SELECT descriptor, sum(z * share) AS w FROM z JOIN y USING (l_suppkey) WHERE known GROUP BY 1),
sc AS (SELECT l_suppkey, share, known, sum(z * w) AS t FROM z JOIN w USING (descriptor) JOIN y USING (l_suppkey) GROUP BY ALL), b AS (SELECT sum(t * share) / sum(t * t) AS b, avg(share) AS m FROM sc WHERE known)
SELECT l_suppkey, round(m + b * t, 6) AS predicted_share FROM sc, b WHERE NOT known""")
def scored_half(spark, d):
    """A model of one component made of one half of the samples, applied to the other."""
    samples = _samples(spark, d)
    sums = fitted.model_sums(samples.where("l_suppkey % 2 = 0"), _COLS, {"share": F.col("share")})
    model = fitted.model_table(spark, sums, Method(components=1), _BLOCKS)
    out = fitted.predicted(samples.where("l_suppkey % 2 = 1"), model, guess=None)
    return out.select("l_suppkey", r(F.col("scores")["share"]).alias("predicted_share"))


@query()
def three_class_predictions(spark, d):
    samples = _samples(spark, d)
    sums = fitted.model_sums(samples.where("l_suppkey % 2 = 0"), _COLS, fitted.dummies("kind", ["a", "b", "c"]))
    out = fitted.predicted(samples.where("l_suppkey % 2 = 1"), fitted.model_table(spark, sums, Method(components=2), _BLOCKS))
    return out.select("l_suppkey", "kind", "predicted", *[F.col("scores")[c].alias(f"score_{c}") for c in "abc"])


@query()
def model_comparison(spark, d):
    """Q2 of each kind of model with three classes, from one pass over the samples' sums; the orthogonal one for one response."""
    samples = _samples(spark, d)
    fold = F.col("l_suppkey") % 5
    three = fitted.model_sums(samples, _COLS, fitted.dummies("kind", ["a", "b", "c"]), fold, 5)
    one = fitted.model_sums(samples, _COLS, {"share": F.col("share")}, fold, 5)
    made = {
        "pls": (three, Method()), "sparse": (three, Method("sparse", keep=2)), "multiblock": (three, Method("multiblock", weigh="norm")), "sequential": (three, Method("sequential", 1, weigh="none")), "orthogonal": (one, Method("orthogonal")),
    }
    return spark.createDataFrame([(k, fitted.q2(sums, method, _BLOCKS)) for k, (sums, method) in made.items()], "model string, q2 double")
