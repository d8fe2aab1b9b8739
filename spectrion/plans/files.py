"""Queries over files: their texts are made from the tables, then told apart and described as files of a folder are."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrion.session import work_folder
from spectrion.sources import detect, screening

from .base import query, r, table

# Numbers of a supplier's file by its kind; kinds 6 and 7 are tables with a header, 0 is one with a header of peaks.
_X = """CASE l_suppkey % 8 WHEN 1 THEN 400 + l_orderkey % 3000 WHEN 2 THEN 20 + l_orderkey % 1000 WHEN 3 THEN l_orderkey % 250 - 10
    WHEN 4 THEN 200 + 5 * (l_orderkey % 150) WHEN 5 THEN 60 + (l_orderkey % 50) * (l_orderkey % 50) ELSE l_orderkey % 900 END"""


@query(f"""WITH p AS (SELECT l_suppkey, l_suppkey % 8 AS kind, {_X} AS x, l_quantity AS y FROM lineitem),
s AS (SELECT l_suppkey, x - lag(x) OVER (PARTITION BY l_suppkey ORDER BY x) AS step FROM (SELECT DISTINCT l_suppkey, x FROM p)),
v AS (SELECT l_suppkey, CASE WHEN count(step) > 2 THEN stddev_pop(step) / avg(step) ELSE 0 END AS cv FROM s GROUP BY 1),
a AS (SELECT l_suppkey, any_value(kind) AS kind, count(*) AS n, min(x) AS lo, max(x) AS hi, max(y) AS top, arg_min(y, {{'x': x, 'y': y}}) AS y0, arg_max(y, {{'x': x, 'y': y}}) AS y1 FROM p GROUP BY 1)
SELECT l_suppkey, CASE WHEN kind = 0 THEN 'FT-ICR MS' WHEN kind = 6 THEN 'Elemental' WHEN kind = 7 THEN 'FTIR'
    WHEN n >= 20 AND lo >= 350 AND hi BETWEEN 3000 AND 8000 THEN 'FTIR' WHEN n >= 20 AND lo BETWEEN 15 AND 60 AND hi BETWEEN 300 AND 1500 AND top <= 110 AND y0 > y1 THEN 'Thermal'
    WHEN n >= 20 AND lo >= -50 AND lo < 10 AND hi > 100 AND hi <= 300 THEN 'NMR' WHEN n >= 20 AND lo >= 180 AND hi <= 1100 AND hi - lo >= 100 AND cv < 0.05 THEN 'UV-Vis'
    WHEN n >= 20 AND lo >= 50 AND hi <= 3000 AND cv > 0.5 THEN 'FT-ICR MS' ELSE 'General / CSV' END AS modality,
    CASE kind WHEN 6 THEN 'table' WHEN 7 THEN 'descriptor_matrix' ELSE NULL END AS told_kind FROM a JOIN v USING (l_suppkey)""")
def content_modality_detect(spark, d):
    kind = F.col("l_suppkey") % 8
    li = table(spark, d, "lineitem").select("l_suppkey", F.expr(_X).alias("x"), F.col("l_quantity").alias("y"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y"))), lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.when(kind == 7, F.lit(",2")).otherwise(""))), "\n")
    named = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y"))), lambda p: F.concat(F.lit("S"), p["x"].cast("string"), F.lit(",a,"), p["y"].cast("string"), F.lit(",2"))), "\n")
    head = F.when(kind == 0, "m/z,Intensity\n").when(kind == 6, "Probe,Carbon %,H (wt%),N_pct\n").when(kind == 7, "Sample_ID,Class,FTIR_lignin,FTIR_ox\n").otherwise("")
    files = li.groupBy("l_suppkey").agg(F.concat(head, F.when(kind.isin(6, 7), named).otherwise(lines)).alias("text"))
    found = detect.detected(files.withColumn("path", F.concat(F.lit("in/"), F.col("l_suppkey").cast("string"), F.lit(".csv"))))
    return found.select("l_suppkey", "modality", F.when(kind.isin(6, 7), F.col("kind")).alias("told_kind"))


@query("""WITH u AS (SELECT l_suppkey, 200 + l_orderkey * 7 % 500 AS x, round(avg(l_quantity / 50), 6) AS y FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1, 2),
a AS (SELECT l_suppkey, -regr_slope(ln(y), x) FILTER (WHERE x BETWEEN 275 AND 295 AND y > 0) AS s, min_by(y, {'d': abs(x - 254), 'x': x}) FILTER (WHERE abs(x - 254) <= 5) AS v FROM u GROUP BY 1)
SELECT 'U' || l_suppkey AS sample_id, 'UV_a254' AS descriptor, round(v, 6) AS value FROM a WHERE v IS NOT NULL UNION ALL SELECT 'U' || l_suppkey, 'UV_s275', round(s, 6) FROM a WHERE s IS NOT NULL
UNION ALL SELECT 'E' || l_suppkey || '_' || l_orderkey || '_' || l_linenumber, 'Elem_O_pct', round(100 - (40 + l_quantity / 5) - l_linenumber, 6) FROM lineitem WHERE l_suppkey % 3 = 1
UNION ALL SELECT 'M' || l_suppkey || '_' || l_orderkey || '_' || l_linenumber, 'FTIR_lignin', l_quantity FROM lineitem WHERE l_suppkey % 3 = 2""")
def folder_descriptors(spark, d):
    li = table(spark, d, "lineitem").withColumn("kind", F.col("l_suppkey") % 3)
    key = F.concat(F.element_at(F.array(F.lit("U"), F.lit("E"), F.lit("M")), (F.col("kind") + 1).cast("int")), F.col("l_suppkey").cast("string"))
    text = lambda *cells: F.concat_ws(",", *[c.cast("string") for c in cells])
    spectra = li.where("kind = 0").groupBy("l_suppkey", "kind", (200 + F.col("l_orderkey") * 7 % 500).alias("x")).agg(F.round(F.avg(F.col("l_quantity") / 50), 6).alias("y"))
    lines = spectra.select("l_suppkey", "kind", text(F.col("x"), F.col("y")).alias("line"))
    name = F.concat_ws("_", key, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = lines.unionByName(li.where("kind = 1").select("l_suppkey", "kind", text(name, F.lit(40) + F.col("l_quantity") / 5, F.col("l_linenumber"), F.lit(0)).alias("line")))
    lines = lines.unionByName(li.where("kind = 2").select("l_suppkey", "kind", text(name, F.col("l_quantity"), F.lit(1)).alias("line")))
    head = F.element_at(F.array(F.lit("wavelength,abs"), F.lit("Sample,C%,H%,N%"), F.lit("Sample_ID,FTIR_lignin,FTIR_ox")), (F.col("kind") + 1).cast("int"))
    files = lines.groupBy("l_suppkey", "kind").agg(F.concat_ws("\n", head, F.array_join(F.collect_list("line"), "\n")).cast("binary").alias("content"))
    folder = files.select(F.concat(F.lit("in/"), key, F.when(F.col("kind") == 0, "_uv.csv").otherwise(".csv")).alias("path"), F.lit(0).cast("timestamp").alias("modificationTime"), F.length("content").cast("long").alias("length"), "content")
    made = screening.screened(folder, work_folder(spark), bounds={"C": (4, 6), "H": (4, 8), "O": (1, 2), "N": (0, 0), "S": (0, 0)})
    return made.descriptors.where("descriptor IN ('UV_a254', 'UV_s275', 'Elem_O_pct', 'FTIR_lignin')").select("sample_id", "descriptor", r("value").alias("value"))
