"""Rows that operators shuffle against the rows they are given, beside their results by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spectrion.operators import polynomials, ranges, stats
from spectrion.sources import detect, screening


def shuffled_rows(spark, make):
    """What ``make`` gives, and how many rows its stages wrote to shuffles."""
    sc = spark.sparkContext
    gateway = sc._gateway

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    made = make()
    return made, sum(n for k, n in written().items() if k not in before)


def joined_rows(spark, make):
    """What ``make`` gives, and the most rows that a join of the last plan gave."""
    made = make()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    joins = [n for n in (nodes.apply(i) for i in range(nodes.size())) if "Join" in n.name()]
    metrics = [m for n in joins for m in (n.metrics().apply(i) for i in range(n.metrics().size())) if m.name() == "number of output rows"]
    return made, max((int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if values.contains(m.accumulatorId())), default=0)


def calibration(spark):
    """Peaks by key, calibrants, and for each key and calibrant the nearest peak within 5 ppm by brute force."""
    rng = random.Random(4)
    peaks = [(k, round(rng.uniform(200, 900), 4)) for k in range(3) for _ in range(3000)]
    calibrants = sorted({round(rng.uniform(200, 900), 3) for _ in range(60)})
    for t in calibrants:  # a lighter and a heavier peak at one distance, one on the border and one beyond it
        peaks += [(0, t - 2**-11), (0, t + 2**-11), (1, t + t * 5e-6), (2, t - t * 5.1e-6)]
    nearest = set()
    for k in range(3):
        for t in calibrants:
            near = [m for i, m in peaks if i == k and t - t * 5e-6 <= m <= t + t * 5e-6]
            if near:
                nearest.add((k, t, min(near, key=lambda m: (abs(m - t), m))))
    return spark.createDataFrame(peaks, "k int, mass double").repartition(4), spark.createDataFrame([(t,) for t in calibrants], "t double"), nearest


def test_nearest_peaks_of_calibrants(spark):
    peaks, calibrants, nearest = calibration(spark)
    assert {(r["k"], r["_t"], r["mass"]) for r in ranges.calibrant_peaks(peaks, calibrants, ["k"], "mass", "t", 5.0).collect()} == nearest


@pytest.mark.parametrize("recalibrated", [ranges.recalibrated, polynomials.recalibrated])
def test_peaks_are_not_repeated_for_calibrants(spark, recalibrated):
    peaks, calibrants, nearest = calibration(spark)
    peaks = peaks.cache()
    n = peaks.count()
    rows, shuffled = shuffled_rows(spark, lambda: recalibrated(peaks, calibrants, ["k"], "mass", "t", 5.0).groupBy("k").agg(F.max("n_calibrants").alias("n"), F.count("*").alias("rows")).collect())
    peaks.unpersist()
    assert {r["k"]: r["n"] for r in rows} == {k: sum(e[0] == k for e in nearest) for k in range(3)}
    assert sum(r["rows"] for r in rows) == n
    assert shuffled < 1.5 * n


def test_calibrants_without_a_place_match_nothing(spark):
    p = spark.createDataFrame([(1, 100.0), (1, None), (1, float("inf")), (1, float("nan")), (1, -5.0), (1, 0.0)], "k int, mass double")
    c = spark.createDataFrame([(100.0,), (None,), (float("inf"),), (float("nan"),), (-5.0,), (0.0,)], "t double")
    assert [tuple(r) for r in ranges.calibrant_peaks(p, c, ["k"], "mass", "t", 5.0).collect()] == [(1, 100.0, 100.0)]


def test_false_discovery_of_values_that_differ_each_time(spark):
    """Sums over tasks differ in their last digits whenever they are worked out; no test may get lost by that."""
    last_digit = F.udf(lambda p: p * (1 + random.choice((-3, -2, -1, 0, 1, 2, 3)) * 2**-52), "double").asNondeterministic()
    tests = spark.createDataFrame([(1, i, (i + 1) / 100) for i in range(60)], "f int, i int, p double").repartition(3).withColumn("p", last_digit("p"))
    got = sorted((r.p, r.i, r.q) for r in stats.benjamini_hochberg(tests, ["f"], "p", "i").collect())
    assert [i for _, i, _ in got] == list(range(60))
    q = [min(p * 60 / (k + 1) for k, (p, _, _) in enumerate(got) if k >= at) for at in range(60)]
    assert [v for _, _, v in got] == q


def test_companions_of_equal_masses(spark):
    """The work grows with the peaks, also where many have one mass."""
    rng = random.Random(9)
    peaks = [(s, s * 10_000 + i, m, float(rng.randrange(5))) for s in range(2) for i, m in enumerate([100.0] * 400 + [101.0] * 400 + [102.0] * 400 + [round(rng.uniform(90, 110), 3) for _ in range(300)])]
    peaks += [(0, 5, 103.0, 1.0), (0, 5, 104.0, 2.0), (1, 99_999, None, 1.0), (1, 99_998, 100.5, None)]
    df = spark.createDataFrame(peaks, "sample int, id int, mass double, height double").repartition(4)
    got, joined = joined_rows(spark, lambda: ranges.isotope_companions(df, "id", "mass", "height", 1.0, 0.005, ["sample"]).collect())
    expected = {}
    for s, i, m, h in peaks:
        near = [(abs(cm - (m + 1.0)), cm, c, ch) for t, c, cm, ch in peaks if t == s and m is not None and cm is not None and abs(m + 1.0 - cm) <= 0.005]
        if near:
            o, cm, c, ch = min(near, key=lambda e: (*e[:3], e[3] is not None, e[3] or 0.0))
            one = (o, cm, c, m, (h is not None, h or 0.0), (ch is not None, ch or 0.0))
            expected[s, i] = min(expected.get((s, i), one), one)
    ratio = lambda h, ch: ch[1] / h[1] if h[0] and ch[0] and h[1] else None
    assert {(r["sample"], r["id"], r["companion"], r["ratio"]) for r in got} == {(*k, e[2], ratio(e[4], e[5])) for k, e in expected.items()}
    assert len(got) == len(expected)
    assert joined <= 2 * len(peaks)


def test_tables_in_files_are_not_shuffled(spark, tmp_path):
    """A table's lines are read where they stand; its header is told once for the file."""
    lines = [f"P{i},{40 + i % 9},{5 + i % 2},1,x{i}" for i in range(2000)]
    text = 'Sample, C% ,H%,N%,Name\r\n\r\n' + "\n \t \n".join(lines) + '\n"Q, 1","60,5",5,,\nshort,50\n,51,5,0\n'
    files = spark.createDataFrame([("in/a.csv", 0, len(text), bytearray(text.encode()))], "path string, t int, length bigint, content binary").select("path", F.col("t").cast("timestamp").alias("modificationTime"), "length", "content")
    found = []

    def described():
        found.append(screening.screened(files, str(tmp_path)))
        return found[0].descriptors.where("descriptor IN ('Elem_C_pct', 'Elem_O_pct')").collect()

    rows, shuffled = shuffled_rows(spark, described)
    got = {(r.sample_id, r.descriptor): round(r.value, 6) for r in rows}
    assert len(rows) == 2 * 2003
    assert got["x7", "Elem_C_pct"] == 47 and got["x7", "Elem_O_pct"] == 100 - 47 - 6 - 1  # of two columns of samples the last counts
    assert sorted(r.value for r in rows if r.sample_id == "a" and r.descriptor == "Elem_C_pct") == [50.0, 51.0, 60.5]  # lines without a name have the file's
    assert shuffled < 100  # kinds of files only
    assert found[0].summary.select("n_points", "n_samples", "status").collect()[0] == (2003, 2001, "success")


def test_lines_without_blanks_around_them(spark):
    texts = ["", " \t\r\n\x0b", "a", "  a  b \r\n\r\n\t\x0c c\rd \x0b\n", "x" + " " * 200_000 + "y\n z", "\n\n1\xa0\n\u2028\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.l for r in df.select("i", detect.lines_of(F.col("t")).alias("l")).collect()}
    blanks = " \t\n\x0b\x0c\r"
    assert got == {i: [p.strip(blanks) for p in re.split("\r\n|\r|\n", t) if p.strip(blanks)] for i, t in enumerate(texts)} | {len(texts): None}
