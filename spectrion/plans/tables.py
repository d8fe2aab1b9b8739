"""Queries over descriptor tables: fusion, statistics, labels, models and event windows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spectrion.functions import chem, text
from spectrion.operators import fusion, kernels, models, ordered, ranges, stats
from spectrion.streaming import windows

from .base import query, r, table


@query("""SELECT c.c_nationkey, round(a.bal, 4) AS cust_balance, a.n AS cust_n, round(b.bal, 4) AS supp_balance, n.n_regionkey AS geo_n_regionkey FROM (SELECT DISTINCT c_nationkey FROM customer) c
JOIN (SELECT c_nationkey, avg(c_acctbal) AS bal, count(*) AS n FROM customer GROUP BY 1) a USING (c_nationkey) JOIN (SELECT s_nationkey, avg(s_acctbal) AS bal FROM supplier GROUP BY 1) b ON b.s_nationkey = c.c_nationkey JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def fuse_blocks(spark, d):
    cust = table(spark, d, "customer").groupBy("c_nationkey").agg(r(F.avg("c_acctbal"), 4).alias("balance"), F.count("*").alias("n"))
    supp = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(r(F.avg("s_acctbal"), 4).alias("balance"))
    geo = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return fusion.fuse_blocks({"cust": cust, "supp": supp, "geo": geo}, "c_nationkey")


@query("SELECT o_custkey, o_orderpriority AS descriptor, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2")
def fuse_outer_upsert(spark, d):
    long = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("descriptor"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return fusion.upsert(long, ["o_custkey"], "o_orderkey")


@query("SELECT p_partkey, descriptor, CAST(value AS DOUBLE) AS value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR descriptor IN (p_size, p_retailprice))")
def unpivot_descriptors(spark, d):
    return fusion.unpivot(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"])


@query("""SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1""")
def pivot_descriptors(spark, d):
    long = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("descriptor")).agg(r(F.sum("o_totalprice"), 4).alias("value"))
    return fusion.pivot(long, ["o_custkey"], ["F", "O", "P"])


@query("""WITH l AS (SELECT c_name || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_nmr.csv' ELSE '-FTIR.txt' END AS name, c_custkey FROM customer)
SELECT c_custkey, name, c_name AS other, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS step FROM l JOIN customer USING (c_custkey)""")
def key_ladder_lookup(spark, d):
    c = table(spark, d, "customer")
    ending = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "_nmr.csv").otherwise("-FTIR.txt")
    left = c.select("c_custkey", F.concat("c_name", ending).alias("name"))
    return fusion.key_ladder(left, c.select(F.col("c_name").alias("other")), "name", "other").select("c_custkey", "name", "other", "step")


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, count(*) AS n, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :])
_T = "(1.0::DOUBLE / (1.0 + 0.2316419::DOUBLE * z))"
_P = f"SELECT *, least(1.0, 2.0 * exp(-z * z / 2) / 2.5066282746310002::DOUBLE * {_T} * (0.319381530::DOUBLE + {_T} * (-0.356563782::DOUBLE + {_T} * (1.781477937::DOUBLE + {_T} * (-1.821255978::DOUBLE + {_T} * 1.330274429::DOUBLE))))) AS p FROM (SELECT *, abs(atanh(r)) * sqrt(n - 3.0) AS z FROM ({_CORR}))"


@query(f"SELECT f1, f2, n, round(r, 8) AS r FROM ({_CORR})")
def pairwise_correlation(spark, d):
    return stats.correlations(table(spark, d, "lineitem"), list(_COLS)).select("f1", "f2", "n", r("r", 8).alias("r"))


@query(f"""WITH p AS ({_P}), k AS (SELECT *, row_number() OVER (ORDER BY p, f1 || f2) AS k, count(*) OVER () AS m FROM p)
SELECT f1, f2, round(p, 7) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 7) AS q FROM k""")
def bh_fdr(spark, d):
    c = stats.correlations(table(spark, d, "lineitem"), list(_COLS)).withColumn("p", stats.normal_p(F.col("r"), F.col("n"))).withColumn("family", F.lit(1)).withColumn("id", F.concat("f1", "f2"))
    return stats.benjamini_hochberg(c, ["family"], "p", "id").select("f1", "f2", r("p", 7).alias("p"), r("q", 7).alias("q"))


_ZS = {"snv": "(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)", "minmax": "(v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0)", "vector": "v / nullif(sqrt(sum(v * v) OVER w), 0)", "area": "v / nullif(sum(abs(v)) OVER w, 0)", "max": "v / nullif(max(v) OVER w, 0)"}


@query("SELECT o_orderkey, " + ", ".join(f"round({e}, 7) AS {n}" for n, e in _ZS.items()) + " FROM (SELECT o_orderkey, o_custkey, o_totalprice AS v FROM orders) WINDOW w AS (PARTITION BY o_custkey)")
def normalize_spectrum(spark, d):
    df = stats.scalings(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", {m: m for m in _ZS})
    return df.select("o_orderkey", *[r(m, 7).alias(m) for m in _ZS])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(sum(l_quantity * l_quantity) OVER (PARTITION BY l_returnflag)), 9) AS scaled FROM lineitem")
def block_frobenius_scale(spark, d):
    out = stats.block_scaled(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", r("scaled", 9).alias("scaled"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return stats.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH m AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS DOUBLE) AS fn FROM labels)
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 8) AS accuracy, round(tp / nullif(tp + fn, 0), 8) AS sensitivity, round(tn / nullif(tn + fp, 0), 8) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 8) AS balanced_accuracy FROM m""")
def confusion_metrics(spark, d):
    m = stats.binary_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select("tp", "tn", "fp", "fn", *[r(c, 8).alias(c) for c in ("accuracy", "sensitivity", "specificity", "balanced_accuracy")])


@query("""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY 1),
s AS (SELECT e.vec_id, c.label, sum(e.v * c.v) / (sqrt(sum(e.v * e.v)) * any_value(n.n)) AS cosine FROM e JOIN c USING (i) JOIN n ON n.label = c.label GROUP BY 1, 2)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rank FROM s) WHERE rank <= 3""")
def cosine_library_match(spark, d):
    e = table(spark, d, "embeddings")
    library = stats.centroids(e, "label", "embedding")
    out = stats.library_match(e.select("vec_id", "embedding"), library, "vec_id", "embedding", "label", "reference", 3)
    return out.select("vec_id", "rank", "label", r("cosine").alias("cosine"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS congruence FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def tucker_congruence(spark, d):
    c = stats.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return stats.congruences(c, "label", "reference").select("a", "b", r("congruence").alias("congruence"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def slope_regression(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r(F.regr_slope(y, x)).alias("slope"), r(F.regr_intercept(y, x), 4).alias("intercept"), r(F.regr_r2(y, x), 8).alias("r2"))


@query("""WITH u AS (SELECT descriptor, value FROM (SELECT l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR descriptor IN (l_quantity, l_discount, l_tax))) SELECT descriptor, count(*) AS n, round(var_samp(value), 6) AS variance FROM u GROUP BY 1 HAVING var_samp(value) > 0.0009""")
def variance_filter(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    out = fusion.present_columns(fusion.unpivot(df, ["l_orderkey"]), 1, 0.0009)
    return out.select("descriptor", "n", r("variance").alias("variance"))


@query("SELECT 'lang' AS descriptor, CAST(count(*) FILTER (WHERE lang IS NULL) AS BIGINT) AS missing FROM documents UNION ALL SELECT 'text', CAST(count(*) FILTER (WHERE text IS NULL) AS BIGINT) FROM documents")
def missing_values(spark, d):
    return fusion.missing_counts(table(spark, d, "documents"), ["lang", "text"])


@query("""WITH m AS (SELECT l_returnflag AS f, l_linenumber AS k, month(l_shipdate) AS s, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT f, k, s, v - avg(v) OVER (PARTITION BY f, k) AS d FROM m)
SELECT a.k AS v1, b.k AS v2, round(sum(a.d * b.d) / (count(*) - 1), 6) AS synchronous FROM c a JOIN c b ON a.s = b.s AND a.f = 'A' AND b.f = 'R' GROUP BY 1, 2""")
def synchronous_2dcos(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber", F.month("l_shipdate").alias("s")).agg(F.avg("l_quantity").alias("v"))
    return stats.synchronous(m, "l_returnflag", "l_linenumber", "s", "v", "A", "R").select("v1", "v2", r("synchronous").alias("synchronous"))


@query("SELECT l_returnflag, round(1 - sum((l_extendedprice - l_quantity * 1000) ** 2) / (var_pop(l_extendedprice) * count(*)), 8) AS q2 FROM lineitem GROUP BY 1")
def predictive_q2(spark, d):
    df = table(spark, d, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    return df.groupBy("l_returnflag").agg(r(stats.q_squared(df, "l_extendedprice", "guess"), 8).alias("q2"))


@query("""SELECT l_suppkey, CASE WHEN q IS NULL THEN 'no_model' WHEN q <= 0 OR p >= 0.05 THEN 'not_validated' WHEN q <= 50 THEN 'weak' ELSE 'validated' END AS status FROM (SELECT l_suppkey, avg(l_quantity) * 4 - 50 AS q, avg(l_tax) AS p FROM lineitem GROUP BY 1)""")
def validation_ladder(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") * 4 - 50).alias("q"), F.avg("l_tax").alias("p"))
    return m.select("l_suppkey", stats.validation_status(F.col("q"), F.col("p")).alias("status"))


@query("""SELECT c_custkey, c_name || '_' || c_custkey AS sample, lower(replace(c_name, '#', ' ')) || ' ' || c_custkey AS normal FROM customer""")
def sample_id_clean(spark, d):
    name = F.concat(F.lit("data/run/"), "c_name", F.lit("_"), F.col("c_custkey").cast("string"), F.lit("_FTICR.csv"))
    return table(spark, d, "customer").select("c_custkey", text.sample_id(name).alias("sample"), F.regexp_replace(text.normalized_id(name), "#", " ").alias("normal"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') AND NOT regexp_matches(v, '^[+-]?[0-9]+([.,][0-9]+)?([eE][+-]?[0-9]+)?$') THEN '''' || v ELSE v END AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '=' ELSE '-1' END || substr(lang, 1, CAST(doc_id % 3 AS INTEGER)) AS v FROM documents)""")
def excel_guard(spark, d):
    v = F.concat(F.when(F.col("doc_id") % 2 == 0, "=").otherwise("-1"), F.substring("lang", F.lit(1), (F.col("doc_id") % 3).cast("int")))
    return table(spark, d, "documents").select("doc_id", text.guarded_cell(v).alias("cell"))


# Event windows, the same functions that streams use


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value").select("event_type", "start", "n", r("total", 4).alias("total"))


@query("SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(k * 30) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) x(k) GROUP BY 1, 2")
def sliding_counts(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value", "30 minutes").select("event_type", "start", "n", r("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], "value").select("user_id", "start", "n", r("total", 4).alias("total"))


# Models: tests hold them against plain numpy; what SQL can say of them has its own query


def _samples(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in _COLS], F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"))
    return li.withColumn("label", (F.col("returned") > 1 / 3).cast("double"))


_SAMPLES = f"SELECT l_suppkey, {', '.join(f'avg({c}) AS {c}' for c in _COLS)}, CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) > 1 / 3.0::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS label FROM lineitem GROUP BY 1"
_PLACES = ["1", *_COLS, "label"]


@query(f"WITH s AS ({_SAMPLES}) " + " UNION ALL ".join(f"SELECT CAST(l_suppkey % 5 AS INTEGER) AS fold, {i * len(_PLACES) + j} AS place, round(sum({a} * 1.0::DOUBLE * {b}) / count(*), 4) AS mean_product FROM s GROUP BY 1" for i, a in enumerate(_PLACES) for j, b in enumerate(_PLACES)))
def fold_moments(spark, d):
    """Sums of products by fold, from which the latent-variable models are made, over the folds' rows."""
    fold = F.col("l_suppkey") % 5
    sums = models.sums_by_fold(_samples(spark, d), {c: F.col(c) for c in (*_COLS, "label")}, fold)
    rows = sums.where("place = 0").select("fold", F.col("total").alias("n"))
    return sums.join(rows, "fold").select("fold", "place", r(F.col("total") / F.col("n"), 4).alias("mean_product"))


_WEIGHTS = ", ".join(f"corr({c}, label) AS {c}" for c in _COLS)
_NORM = " + ".join(f"{c} * {c}" for c in _COLS)


@query(f"WITH s AS ({_SAMPLES}), c AS (SELECT {_WEIGHTS} FROM s) " + " UNION ALL ".join(f"SELECT '{c}' AS descriptor, round({c} / sqrt({_NORM}), 6) AS weight, round(abs({c}) * sqrt({len(_COLS)}) / sqrt({_NORM}), 6) AS vip FROM c" for c in _COLS))
def first_component_weights(spark, d):
    out = models.variable_importance(_samples(spark, d), "l_suppkey", list(_COLS), "label", 1)
    return out.select("descriptor", r("weight").alias("weight"), r("vip").alias("vip"))


@query()
def plsda_cross_validation(spark, d):
    return models.cross_validated(_samples(spark, d), "l_suppkey", list(_COLS), "label", 5)


@query()
def plsda_permutation(spark, d):
    scores = models.permutation_test(_samples(spark, d), "l_suppkey", list(_COLS), "label", 5, 50)
    observed = scores.where("permutation = 0").select(F.col("q2").alias("observed"))
    return scores.where("permutation > 0").crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("q2"), stats.permutation_p(scores, "observed", "q2").alias("p"))


@query()
def model_quality(spark, d):
    return models.quality(_samples(spark, d), "l_suppkey", list(_COLS), "label", 5, 3)


@query()
def variable_importance(spark, d):
    return models.variable_importance(_samples(spark, d), "l_suppkey", list(_COLS), "label")


@query()
def pca_block(spark, d):
    return kernels.principal_axes(_samples(spark, d), "l_suppkey", list(_COLS))


@query()
def opls_scores(spark, d):
    return models.orthogonal_scores(_samples(spark, d), "l_suppkey", list(_COLS), "label")


@query()
def spls_selection(spark, d):
    return kernels.sparse_selection(_samples(spark, d), "l_suppkey", list(_COLS), "label", 2)


@query()
def multiblock_shares(spark, d):
    return models.block_models(_samples(spark, d), "l_suppkey", {"amount": ["l_quantity", "l_extendedprice"], "rates": ["l_discount", "l_tax"]}, "label")


@query()
def parafac_scores(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (280.0 + F.col("l_partkey") % 12 * 5).alias("em"), (240.0 + F.col("l_orderkey") % 8 * 10).alias("ex"), "l_quantity")
    return kernels.parafac(li, "l_suppkey", "em", "ex", "l_quantity", 2)[0]


@query("""WITH v AS (SELECT l_suppkey, 240.0::DOUBLE + l_orderkey * 7 % 22 * 10 AS ex, 280.0::DOUBLE + l_partkey * 3 % 65 * 5 AS em, l_quantity AS f FROM lineitem),
m AS (SELECT *, abs(em - ex) <= 12 OR abs(em - 2 * ex) <= 15 OR em < ex - 5 OR coalesce(abs(em - CASE WHEN 1 / ex - 3.4e-4::DOUBLE > 0 THEN 1 / (1 / ex - 3.4e-4::DOUBLE) END) <= 10, false) AS masked FROM v)
SELECT l_suppkey, count(*) FILTER (WHERE masked) AS masked, count(*) AS n, round(sum(f) FILTER (WHERE NOT masked), 4) AS kept FROM m GROUP BY 1""")
def scatter_mask(spark, d):
    v = table(spark, d, "lineitem").select("l_suppkey", (F.lit(240.0) + F.col("l_orderkey") * 7 % 22 * 10).alias("ex"), (F.lit(280.0) + F.col("l_partkey") * 3 % 65 * 5).alias("em"), F.col("l_quantity").alias("f"))
    m = v.withColumn("masked", chem.scatter_masked(F.col("em"), F.col("ex")))
    return m.groupBy("l_suppkey").agg(F.count_if("masked").alias("masked"), F.count("*").alias("n"), r(F.sum(F.when(~F.col("masked"), F.col("f"))), 4).alias("kept"))


@query("""WITH a AS (SELECT s_suppkey, s_nationkey AS k, abs(s_acctbal) / 20000 AS a FROM supplier), n AS (SELECT k, avg(a) AS a FROM a GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_quantity * pow(10.0, 0.5::DOUBLE * (x.a + y.a)), 6) AS corrected FROM lineitem JOIN n x ON x.k = l_suppkey % 25 JOIN n y ON y.k = l_partkey % 25""")
def inner_filter_correction(spark, d):
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.avg(F.abs(F.col("s_acctbal")) / 20000).alias("a"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_suppkey") % 25).alias("kx"), (F.col("l_partkey") % 25).alias("km"))
    both = li.join(n.toDF("kx", "a_ex"), "kx").join(n.toDF("km", "a_em"), "km")
    return both.select("l_orderkey", "l_linenumber", r(chem.inner_filter(F.col("l_quantity"), F.col("a_ex"), F.col("a_em"))).alias("corrected"))


@query("""WITH u AS (SELECT p_partkey, 'size' AS descriptor, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part),
k AS (SELECT *, rank() OVER (PARTITION BY descriptor ORDER BY value) + (count(*) OVER (PARTITION BY descriptor, value) - 1) / 2.0::DOUBLE AS rank FROM u) SELECT p_partkey, descriptor, rank FROM k""")
def average_ranks(spark, d):
    long = fusion.unpivot(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"])
    return stats.ranked_columns(long).select("p_partkey", "descriptor", "rank")


@query("""WITH u AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b FROM part), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS b FROM u)
SELECT count(*) AS n, round(corr(a, b), 8) AS rho FROM k""")
def spearman_correlation(spark, d):
    long = fusion.unpivot(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"])
    wide = stats.ranked_columns(long).select("p_partkey", "descriptor", F.col("rank").alias("value"))
    return stats.correlations(fusion.pivot(wide, ["p_partkey"], ["size", "price"]), ["size", "price"]).select("n", r("r", 8).alias("rho"))


@query("""WITH m AS (SELECT l_returnflag AS f, l_linenumber AS k, month(l_shipdate) AS s, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT f, k, s, v - avg(v) OVER (PARTITION BY f, k) AS d FROM m),
h AS (SELECT x.k, x.s, sum(y.d / (pi() * (y.s - x.s))) AS d FROM c x JOIN c y ON x.f = 'R' AND y.f = 'R' AND x.k = y.k AND x.s <> y.s GROUP BY 1, 2)
SELECT a.k AS v1, b.k AS v2, round(sum(a.d * b.d) / (count(*) - 1), 6) AS asynchronous FROM c a JOIN h b ON a.s = b.s AND a.f = 'A' GROUP BY 1, 2""")
def asynchronous_2dcos(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber", F.month("l_shipdate").alias("s")).agg(F.avg("l_quantity").alias("v"))
    return stats.asynchronous(m, "l_returnflag", "l_linenumber", "s", "v", "A", "R").select("v1", "v2", r("asynchronous").alias("asynchronous"))


@query("""WITH a AS (SELECT l_extendedprice / 100 AS mass, sum(l_quantity) AS i FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_extendedprice / 100 AS mass, sum(l_quantity) AS i FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
h AS (SELECT a.mass, a.i, b.i AS j, row_number() OVER (PARTITION BY a.mass ORDER BY abs(b.mass - a.mass), b.mass) AS k FROM a JOIN b ON b.mass BETWEEN a.mass - a.mass * 1.5e-6 AND a.mass + a.mass * 1.5e-6),
s AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM h WHERE k = 1) AS common, (SELECT sum(i * j) FROM h WHERE k = 1) / sqrt((SELECT sum(i * i) FROM a) * (SELECT sum(i * i) FROM b)) AS cosine)
SELECT n_a, n_b, common, round(common / (n_a + n_b - common), 8) AS jaccard, round(coalesce(cosine, 0), 8) AS cosine FROM s""")
def spectrum_comparison(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 100).alias("mass"), F.col("l_quantity").alias("i"), "l_returnflag")
    out = stats.spectrum_similarity(p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"), "mass", "i", 1.5)
    return out.select("n_a", "n_b", "common", r("jaccard", 8).alias("jaccard"), r("cosine", 8).alias("cosine"))


_LONG = "SELECT p_brand AS block, 'size' AS descriptor, CAST(p_size AS DOUBLE) AS value, p_partkey FROM part UNION ALL SELECT p_brand, 'price', p_retailprice, p_partkey FROM part"


def _long(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("block"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return fusion.unpivot(p, ["p_partkey", "block"], ["size", "price"])


@query(f"SELECT block, descriptor, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM ({_LONG}) GROUP BY 1, 2")
def descriptor_cards(spark, d):
    return stats.descriptor_cards(_long(spark, d)).select("block", "descriptor", "n", r("mean").alias("mean"), r("deviation").alias("deviation"))


@query(f"SELECT p_partkey, descriptor, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 8) AS scaled, round((avg(value) OVER w - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 8) AS cohort FROM ({_LONG}) WINDOW w AS (PARTITION BY descriptor)")
def cohort_profile(spark, d):
    return stats.cohort_profile(_long(spark, d)).select("p_partkey", "descriptor", r("scaled", 8).alias("scaled"), r("cohort", 8).alias("cohort"))


@query(f"SELECT f1, f2, round(r, 8) AS r, CASE WHEN f1 IN ('l_quantity', 'l_extendedprice') THEN 'amount' ELSE 'rates' END AS block1, CASE WHEN f2 IN ('l_quantity', 'l_extendedprice') THEN 'amount' ELSE 'rates' END AS block2 FROM ({_CORR}) WHERE abs(r) >= 0.0001")
def correlation_network(spark, d):
    pairs = stats.correlations(table(spark, d, "lineitem"), list(_COLS))
    block = {"l_quantity": "amount", "l_extendedprice": "amount", "l_discount": "rates", "l_tax": "rates"}
    return stats.correlation_edges(pairs, block, 0.0001, False).select("f1", "f2", r("r", 8).alias("r"), "block1", "block2")


@query("""WITH m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS a, s_nationkey * 1.0::DOUBLE AS b FROM supplier), f AS (SELECT s_suppkey, coalesce(a, (SELECT median(a) FROM m)) AS a, b FROM m)
SELECT s_suppkey, round((a - avg(a) OVER ()) / stddev_pop(a) OVER () / sqrt(2), 7) AS a, round((b - avg(b) OVER ()) / stddev_pop(b) OVER () / sqrt(2), 7) AS b FROM f""")
def fused_features(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")).alias("a"), (F.col("s_nationkey") * 1.0).alias("b"))
    out = stats.fused_features(s, "s_suppkey", {"one": ["a", "b"]})
    return out.select("s_suppkey", r("a", 7).alias("a"), r("b", 7).alias("b"))


@query("SELECT l_suppkey, round(regr_slope(log10(l_extendedprice), l_quantity), 8) AS slope, round(regr_intercept(log10(l_extendedprice), l_quantity), 6) AS intercept, round(regr_r2(log10(l_extendedprice), l_quantity), 6) AS r2, regr_slope(log10(l_extendedprice), l_quantity) < 0 AS falling FROM lineitem GROUP BY 1")
def sec_calibration(spark, d):
    out = stats.sec_calibration(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", r("slope", 8).alias("slope"), r("intercept").alias("intercept"), r("r2").alias("r2"), "falling")


@query("""WITH p AS (SELECT l_suppkey, l_extendedprice / 100 AS mass FROM lineitem), c AS (SELECT DISTINCT l_extendedprice / 100 * 1.000002::DOUBLE AS t FROM lineitem WHERE l_returnflag = 'N' AND l_discount = 0.1),
k AS (SELECT l_suppkey, t, mass, row_number() OVER (PARTITION BY l_suppkey, t ORDER BY abs(mass - t), mass) AS k FROM c JOIN (SELECT DISTINCT l_suppkey, mass FROM p) p ON mass BETWEEN t - t * 5e-6 AND t + t * 5e-6),
f AS (SELECT l_suppkey, regr_slope(mass - t, mass) AS b, regr_intercept(mass - t, mass) AS a, count(*) AS n FROM k WHERE k = 1 GROUP BY 1)
SELECT p.l_suppkey, coalesce(n, 0) AS n_calibrants, count(*) AS n_peaks, round(sum(CASE WHEN n >= 3 AND b IS NOT NULL THEN mass - a - b * mass ELSE mass END), 4) AS total FROM p LEFT JOIN f USING (l_suppkey) GROUP BY 1, 2""")
def mass_recalibration(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select("l_suppkey", (F.col("l_extendedprice") / 100).alias("mass"))
    c = li.where("l_returnflag = 'N' AND l_discount = 0.1").select((F.col("l_extendedprice") / 100 * 1.000002).alias("t"))
    out = ranges.recalibrated(p, c, ["l_suppkey"], "mass", "t", 5.0)
    return out.groupBy("l_suppkey", "n_calibrants").agg(F.count("*").alias("n_peaks"), r(F.sum("corrected"), 4).alias("total"))


@query()
def band_fits(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") * 37 % 40 * 1.0).alias("x"), "value")
    return kernels.fit_bands(ordered.averaged_duplicates(e, ["user_id"], "x", "value", 3), ["user_id"], "x", "value", [10.0, 30.0], 5.0, 5.0)


_PH = "CASE WHEN c_mktsegment <> 'MACHINERY' THEN 2.0::DOUBLE + abs(c_acctbal) / 1000 END"


def _ph():
    return F.when(F.col("c_mktsegment") != "MACHINERY", 2.0 + F.abs("c_acctbal") / 1000)


@query(f"""WITH p AS (SELECT c_custkey, {_PH} AS ph FROM customer), h AS (SELECT c_custkey, pow(10.0::DOUBLE, -ph) AS h FROM p),
t AS (SELECT c_custkey, h * h * h AS a0, pow(10.0::DOUBLE, -2.15::DOUBLE) * h * h AS a1, pow(10.0::DOUBLE, -9.35::DOUBLE) * h AS a2, pow(10.0::DOUBLE, -21.7::DOUBLE) AS a3 FROM h)
SELECT c_custkey, round((a1 + 2 * a2 + 3 * a3) / (a0 + a1 + a2 + a3), 6) AS charge, round((a1 + 4 * a2 + 9 * a3) / (a0 + a1 + a2 + a3), 6) AS charge_squared FROM t""")
def phosphate_charge(spark, d):
    one, two = chem.phosphate_charge(_ph())
    return table(spark, d, "customer").select("c_custkey", r(one).alias("charge"), r(two).alias("charge_squared"))


@query(f"""WITH p AS (SELECT c_custkey, c_nationkey / 5.0::DOUBLE AS alk, {_PH} AS ph FROM customer), x AS (SELECT *, greatest(alk - 1000 * pow(10.0::DOUBLE, ph - 14) + 1000 * pow(10.0::DOUBLE, -ph), 0) AS carb, pow(10.0::DOUBLE, ph - 10.33::DOUBLE) AS r FROM p)
SELECT c_custkey, round(CASE WHEN ph IS NULL THEN alk ELSE carb / (1 + 2 * r) END, 6) AS bicarbonate, round(CASE WHEN ph IS NULL THEN 0 ELSE r * carb / (1 + 2 * r) END, 6) AS carbonate FROM x""")
def alkalinity_split(spark, d):
    one, two = chem.alkalinity_split(F.col("c_nationkey") / 5.0, _ph())
    return table(spark, d, "customer").select("c_custkey", r(one).alias("bicarbonate"), r(two).alias("carbonate"))


#: Parts as compounds: the class goes by the material.
_COMPOUNDS = {"hydroxyphenyl": "cresol", "guaiacyl": "vanillin", "syringyl": "syringol", "carbohydrate": "furfural", "other": "benzene"}
_NAMED = " ".join(f"WHEN p_size % 5 = {i} THEN '{n}'" for i, n in enumerate(_COMPOUNDS))
_AREAS = ", ".join(f"sum(CASE WHEN class = '{n}' THEN p_retailprice ELSE 0 END) AS {n}" for n in list(_COMPOUNDS)[:4])


@query(f"""WITH c AS (SELECT p_brand, p_retailprice, CASE {_NAMED} END AS class FROM part), s AS (SELECT p_brand, {_AREAS} FROM c GROUP BY 1), t AS (SELECT *, hydroxyphenyl + guaiacyl + syringyl AS lignin FROM s)
SELECT p_brand, round(100 * hydroxyphenyl / nullif(lignin, 0), 4) AS hydroxyphenyl_percent, round(100 * guaiacyl / nullif(lignin, 0), 4) AS guaiacyl_percent, round(100 * syringyl / nullif(lignin, 0), 4) AS syringyl_percent,
    round(syringyl / nullif(guaiacyl, 0), 6) AS s_g, round(hydroxyphenyl / nullif(guaiacyl, 0), 6) AS h_g, round(lignin / nullif(carbohydrate, 0), 6) AS lignin_carbohydrate FROM t""")
def pyrolysis_indices(spark, d):
    place = F.col("p_size") % len(_COMPOUNDS) + 1
    rows = table(spark, d, "part").select("p_brand", "p_retailprice", text.pyrolysis_class(F.element_at(F.array(*map(F.lit, _COMPOUNDS.values())), place.cast("int"))).alias("class"))
    areas = rows.groupBy("p_brand").agg(*[F.sum(F.when(F.col("class") == n, F.col("p_retailprice")).otherwise(0.0)).alias(n) for n in list(_COMPOUNDS)[:4]])
    found = chem.pyrolysis_ratios({n: F.col(n) for n in list(_COMPOUNDS)[:4]})
    return areas.select("p_brand", *[r(c, 4 if n.endswith("percent") else 6).alias(n) for n, c in found.items()])
