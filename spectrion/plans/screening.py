"""Queries that bring unknown tables and names to instruments, blocks and classes, and of steps of spectra before descriptors; inputs are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrion.functions import text
from spectrion.operators import kernels, ordered, spectra
from spectrion.sources import tables

from .base import query, r, table
from .instruments import _spectrum, _spectrum_sql


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(words, place):
    """The word at a place that goes round."""
    return F.element_at(F.array(*map(F.lit, words)), (place % len(words) + 1).cast("int"))


def _ladder(name: str, rules: dict[str, list[str]], other: str) -> str:
    """First rule of which a part stands in the name."""
    return "CASE " + " ".join(f"WHEN list_bool_or([contains({name}, w) for w in {_list(parts)}]) THEN '{label}'" for label, parts in rules.items()) + f" ELSE {other} END"


_FIRST = ["Temp, C", "Wavenumber", "ppm", "Wavelength (nm)", "m/z", "Elution volume", "RT (min)", "Sample", "Время", "template", "C%", "Em/Ex"]
_SECOND = ["Weight mg", "Absorbance", "Intensity", "UV 254", "Area", "H;N", "TIC counts", "abs", "signal", "artic", "240,250,260,270,280"]


def _modality_sql() -> str:
    def has(names: list[str]) -> str:
        short = [n for n in names if len(n) <= 3 and n.isalnum()]
        return "(" + " OR ".join(f"{'list_contains(words, ' if n in short else 'contains(low, '}'{n}')" for n in names) + ")"

    rules = " ".join(f"WHEN {' AND '.join(map(has, lists))} THEN '{label}'" for label, *lists in text.MODALITY_WORDS)
    count = " + ".join(f"CAST(list_has_any(names, {_list(n)}) AS INTEGER)" for n in text.ELEMENT_WORDS.values())
    return f"""WITH h AS (SELECT event_id, {_list(_FIRST)}[event_id % {len(_FIRST)} + 1] || ',' || {_list(_SECOND)}[event_id // {len(_FIRST)} % {len(_SECOND)} + 1] || ',' || event_type AS header FROM events),
w AS (SELECT event_id, header, lower(header) AS low, regexp_split_to_array(lower(header), '[^0-9a-zа-яё°]+') AS words, [trim(c) for c in regexp_split_to_array(lower(header), '[,;]')] AS cells FROM h),
n AS (SELECT *, [regexp_replace(c, '(wt|pct|[^a-zа-яё])', '', 'g') for c in cells] AS names, [TRY_CAST(c AS DOUBLE) for c in cells if TRY_CAST(c AS DOUBLE) IS NOT NULL] AS numbers FROM w)
SELECT event_id, CASE WHEN len(numbers) >= 5 AND list_min(numbers) >= 200 AND list_max(numbers) <= 900 OR regexp_matches(cells[1], 'em/ex|ex/em') THEN 'EEM' {rules} WHEN {count} >= 3 THEN 'Elemental' ELSE 'generic' END AS modality FROM n"""


@query(_modality_sql())
def header_modality_detect(spark, d):
    k = F.col("event_id")
    head = F.concat_ws(",", _pick(_FIRST, k), _pick(_SECOND, F.floor(k / len(_FIRST))), "event_type")
    return table(spark, d, "events").select("event_id", text.header_modality(head).alias("modality"))


_FILES = ["run1_FTICR", "a.eem", "b-UV", "c_ir", "d 13C", "e_pygcms", "f_gpc", "g_chns", "masses", "notes"]
_FILE_RULES = " ".join(f"WHEN list_has_any(words, {_list(n)}){' OR ending = 1' if label == 'NMR' else ''} THEN '{label}'" for label, n in text.FILE_WORDS.items())


@query(f"""WITH f AS (SELECT p_partkey, 'in/' || {_list(_FILES)}[p_partkey % {len(_FILES)} + 1] || '_' || p_size AS stem, p_partkey % 3 AS ending FROM part), w AS (SELECT *, regexp_split_to_array(lower(substr(stem, 4)), '[-_.\\s]+') AS words FROM f)
SELECT p_partkey, CASE {_FILE_RULES} END AS modality FROM w""")
def file_modality_detect(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("in/"), _pick(_FILES, k), F.lit("_"), "p_size", _pick([".csv", ".JDX", ".txt"], k))
    return table(spark, d, "part").select("p_partkey", text.file_modality(name).alias("modality"))


def _block_sql() -> str:
    exact = "WHEN lower(trim(name)) IN ('h/c', 'o/c') THEN 'FT-ICR MS'"
    prefixes = " ".join(f"WHEN starts_with(spaced, ' {p} ') AND length(spaced) > {len(p) + 2} THEN '{b}'" for p, b in text.BLOCK_PREFIXES)
    phrases = sorted(((text.phrase(w), b) for b, words in text.BLOCK_KEYWORDS.items() for w in words), key=lambda x: -len(x[0].split()))
    words = " ".join(f"WHEN contains(spaced, ' {p} ') THEN '{b}'" for p, b in phrases)
    return f"SELECT p_partkey, name, CASE {exact} {prefixes} {words} ELSE 'Other' END AS block"


_LEAD = ["", "mean", *[p for p, _ in text.BLOCK_PREFIXES]]
_WORDS = [w for words in text.BLOCK_KEYWORDS.values() for w in words]


@query(f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN ' H/C' ELSE {_list(_LEAD)}[p_partkey % {len(_LEAD)} + 1] || '_' || {_list(_WORDS)}[p_partkey * 7 % {len(_WORDS)} + 1] || ' ' || p_brand END AS name FROM part),
y AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(name), '([a-z]+|[0-9]+)'), ' ') || ' ' AS spaced FROM x) {_block_sql()} FROM y""")
def block_classifier(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 50 == 0, " H/C").otherwise(F.concat(_pick(_LEAD, k), F.lit("_"), _pick(_WORDS, k * 7), F.lit(" "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("block", text.feature_block(F.col("name")))


_PRODUCTS = [p for parts in text.PYROLYSIS_WORDS.values() for p in parts] + ["toluene", "Ёжик"]
_PRODUCT = f"{_list(_PRODUCTS)}[p_partkey % {len(_PRODUCTS)} + 1] || ' ' || {_list(_PRODUCTS)}[p_partkey * 13 % {len(_PRODUCTS)} + 1]"


@query(f"WITH x AS (SELECT p_partkey, lower({_PRODUCT}) AS t FROM part) SELECT p_partkey, {_ladder('t', text.PYROLYSIS_WORDS, chr(39) + 'other' + chr(39))} AS class FROM x")
def pyrolysis_classes(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", text.pyrolysis_class(F.concat_ws(" ", _pick(_PRODUCTS, k), _pick(_PRODUCTS, k * 13))).alias("class"))


_MONOMERS = [p.title() for parts in text.CARBONYL_WORDS.values() for p in parts] + text.NO_CARBONYL + ["phenol"]
_MONOMER_SUMS = ", ".join(f"sum(l_quantity) FILTER (WHERE kind = '{k}') AS {k}" for k in text.CARBONYL_WORDS)
_MONOMER_RATIOS = ", ".join(f"round(CASE WHEN {u}_{n} > 0 AND {u}_aldehyde > 0 THEN {u}_{n} / {u}_aldehyde END, 6) AS {u}_{n}_aldehyde" for u in ("guaiacyl", "syringyl") for n in ("acid", "ketone"))


@query(f"""WITH x AS (SELECT l_suppkey, l_quantity, lower({_list(_MONOMERS)}[l_partkey % {len(_MONOMERS)} + 1]) AS t FROM lineitem), y AS (SELECT *, CASE WHEN list_bool_or([contains(t, w) for w in {_list(text.NO_CARBONYL)}]) THEN NULL ELSE {_ladder('t', text.CARBONYL_WORDS, 'NULL')} END AS kind FROM x),
s AS (SELECT l_suppkey, {_MONOMER_SUMS} FROM y GROUP BY 1) SELECT l_suppkey, {_MONOMER_RATIOS} FROM s""")
def carbonyl_ratios(spark, d):
    peaks = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", _pick(_MONOMERS, F.col("l_partkey")).alias("name"))
    out = spectra.carbonyl_ratios(peaks, ["l_suppkey"], "name", "l_quantity")
    return out.select("l_suppkey", *[r(c).alias(c) for c in out.columns[1:]])


_TITLES = ["Abietic acid", "lignosulfonate", "Vanillin", "Phthalic", "Palmitic", "peptide", "Saccharose", "unknown", "other", "x", "y", "z"]


@query(f"""WITH x AS (SELECT p_partkey, lower({_list(_TITLES)}[p_partkey % {len(_TITLES)} + 1] || ' ' || p_type) AS t, (p_size + 3)::DOUBLE AS c, (p_partkey % 60)::DOUBLE AS h, (p_partkey % 31)::DOUBLE AS o FROM part)
SELECT p_partkey, 'C' || (c::INTEGER) || 'H' || (h::INTEGER) || 'O' || (o::INTEGER) AS formula, {_ladder('t', text.COMPOUND_WORDS, "CASE WHEN h / c < 0.7 AND o / c < 0.5 THEN 'condensed_aromatic' WHEN h / c BETWEEN 0.7 AND 1.5 AND o / c BETWEEN 0.2 AND 0.6 THEN 'lignin_like' WHEN h / c > 1.5 AND o / c < 0.3 THEN 'aliphatic' WHEN o / c >= 0.7 THEN 'highly_oxidised' ELSE 'natural_organic' END")} AS class FROM x""")
def compound_classes(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("CHO C"), F.col("p_size") + 3, F.lit("H"), k % 60, F.lit("O"), k % 31, F.lit(" x"))
    rows = table(spark, d, "part").select("p_partkey", "p_type", _pick(_TITLES, k).alias("title"), text.clean_formula(raw).alias("formula"))
    return rows.select("p_partkey", "formula", text.compound_class(F.col("title"), F.col("p_type"), F.col("formula")).alias("class"))


# Tables of instruments


@query("""SELECT l_suppkey, count(*) AS n, round(sum(l_quantity / 2 * 0.5::DOUBLE), 4) AS volume, round(sum(l_discount * 10), 4) AS signal FROM lineitem WHERE l_linenumber % 4 > 0 GROUP BY 1""")
def chromatogram_table(spark, d):
    dark = F.when(F.col("l_linenumber") % 4 > 0, F.col("l_discount") * 10)
    cells = [F.col("l_quantity") / 2, F.lit(1.5), dark, F.lit("x")]
    lines = table(spark, d, "lineitem").select("l_suppkey", F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("n.d.")) for c in cells]).alias("line"))
    out = tables.chromatogram(tables.from_lines(lines, "line", "Retention time,UV corrected,RI signal,Note"), ["l_suppkey"], flow=0.5)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.sum("volume"), 4).alias("volume"), r(F.sum("signal"), 4).alias("signal"))


@query("""WITH x AS (SELECT l_suppkey, 20.0::DOUBLE + l_orderkey % 90 * 10 AS t, l_quantity * CASE WHEN l_suppkey % 2 = 0 THEN 3 ELSE 0.5 END + CASE WHEN l_suppkey % 4 = 3 THEN 60 ELSE 0 END AS m FROM lineitem),
q AS (SELECT l_suppkey, t, CASE WHEN l_suppkey % 3 > 0 OR t > 50 THEN m END AS m FROM x),
s AS (SELECT l_suppkey, CASE WHEN max(m) > 105 OR max(m) < 50 THEN coalesce(median(m) FILTER (WHERE t <= 45), min_by(m, {'t': t, 'm': m})) END AS b FROM q WHERE m IS NOT NULL GROUP BY 1)
SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN b IS NULL THEN m ELSE m / b * 100 END), 6) AS mass, round(avg(t), 6) AS temperature FROM q JOIN s USING (l_suppkey) WHERE m IS NOT NULL GROUP BY 1""")
def thermogram_table(spark, d):
    li = table(spark, d, "lineitem")
    m = F.col("l_quantity") * F.when(F.col("l_suppkey") % 2 == 0, 3.0).otherwise(0.5) + F.when(F.col("l_suppkey") % 4 == 3, 60).otherwise(0)
    lines = li.select("l_suppkey", F.concat_ws(";", F.when((F.col("l_suppkey") % 3 > 0) | (F.col("l_orderkey") % 90 > 3), m.cast("string")).otherwise("n.d."), (F.lit(20.0) + F.col("l_orderkey") % 90 * 10).cast("string")).alias("line"))
    out = tables.thermogram(tables.from_lines(lines, "line", "Weight (mg);Temp. (°C)"), ["l_suppkey"])
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.avg("mass")).alias("mass"), r(F.avg("temperature")).alias("temperature"))


@query(f"""WITH x AS (SELECT l_suppkey, greatest(l_extendedprice - 5000, 0) AS area, CASE WHEN l_linenumber % 3 > 0 THEN {_list(_PRODUCTS)}[l_partkey % {len(_PRODUCTS)} + 1] END AS name FROM lineitem)
SELECT l_suppkey, CASE WHEN name IS NOT NULL THEN {_ladder('lower(name)', text.PYROLYSIS_WORDS, chr(39) + 'other' + chr(39))} END AS class, count(*) AS n, round(sum(area), 2) AS area FROM x GROUP BY 1, 2""")
def pyrogram_table(spark, d):
    named = F.when(F.col("l_linenumber") % 3 > 0, _pick(_PRODUCTS, F.col("l_partkey"))).otherwise("nan")
    cells = [named, F.col("l_discount"), F.col("l_extendedprice") - 5000]
    lines = table(spark, d, "lineitem").select("l_suppkey", F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("line"))
    out = tables.pyrogram(tables.from_lines(lines, "line", "Compound\tR.T.\tPeak Area"), ["l_suppkey"])
    return out.groupBy("l_suppkey", "class").agg(F.count("*").alias("n"), r(F.sum("area"), 2).alias("area"))


# Steps of spectra


@query(f"""WITH s AS ({_spectrum_sql(-5, 60)}), k AS (SELECT user_id, max_by(x, {{'y': y, 'x': -x}}) FILTER (WHERE x BETWEEN 38 AND 41) AS px, max(y) FILTER (WHERE x BETWEEN 38 AND 41) AS peak, min(x) FILTER (WHERE x BETWEEN 38 AND 41) AS lo, max(x) FILTER (WHERE x BETWEEN 38 AND 41) AS hi, max(y) AS top FROM s GROUP BY 1),
m AS (SELECT user_id, CASE WHEN px > lo AND px < hi AND NOT (top > 1e-4 AND peak < 0.05::DOUBLE * top) AND abs(39.5::DOUBLE - px) <= 1.5 THEN 39.5::DOUBLE - px ELSE 0 END AS shift_by FROM k)
SELECT user_id, round(x + shift_by, 6) AS x, round(shift_by, 6) AS shift_by FROM s JOIN m USING (user_id)""")
def shift_recalibration(spark, d):
    out = spectra.recalibrated_shifts(_spectrum(spark, d, -5.0, 60.0), ["user_id"], "x", "y", "dmso")
    return out.select("user_id", r("x").alias("x"), r("shift_by").alias("shift_by"))


_ENDS = [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3]]


def _at(weights: list[int], place: int) -> str:
    return " + ".join(f"({c}) * lead(y, {j - place}) OVER w" if j >= place else f"({c}) * lag(y, {place - j}) OVER w" for j, c in enumerate(weights))


@query(f"""WITH s AS ({_spectrum_sql(400, 700)}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, round(x, 4) AS x, round(CASE WHEN n < 5 THEN NULL WHEN i = 1 THEN {_at(_ENDS[0], 0)} WHEN i = 2 THEN {_at(_ENDS[1], 1)} WHEN i = n THEN {_at(_ENDS[0][::-1], 4)} WHEN i = n - 1 THEN {_at(_ENDS[1][::-1], 3)} ELSE {_at(_ENDS[2], 2)} END / 35.0::DOUBLE, 6) AS smooth FROM n WINDOW w AS (PARTITION BY user_id ORDER BY x)""")
def savgol_whole(spark, d):
    out = ordered.savgol(_spectrum(spark, d, 400.0, 700.0), ["user_id"], ["x"], "y", 2, ends=True)
    return out.select("user_id", r("x", 4).alias("x"), r("smooth").alias("smooth"))


_SLOPES = [[-54, 13, 40, 27, -26], [-34, 3, 20, 17, -6], [-14, -7, 0, 7, 14]]  # seventieths


@query(f"""WITH s AS (SELECT user_id, x, ln(y) AS y FROM ({_spectrum_sql(250, 600)}) WHERE y > 1e-4), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS i, count(*) OVER v AS n, (max(x) OVER v - min(x) OVER v) / nullif(count(*) OVER v - 1, 0) AS step FROM s WINDOW v AS (PARTITION BY user_id))
SELECT user_id, round(x, 3) AS x, round(-CASE WHEN n < 5 THEN NULL WHEN i = 1 THEN {_at(_SLOPES[0], 0)} WHEN i = 2 THEN {_at(_SLOPES[1], 1)} WHEN i = n THEN {_at([-c for c in _SLOPES[0][::-1]], 4)} WHEN i = n - 1 THEN {_at([-c for c in _SLOPES[1][::-1]], 3)} ELSE {_at(_SLOPES[2], 2)} END / 70.0::DOUBLE / step, 6) AS slope FROM n WINDOW w AS (PARTITION BY user_id ORDER BY x)""")
def slope_curves(spark, d):
    out = spectra.slope_curve(_spectrum(spark, d, 250.0, 600.0), ["user_id"], "x", "y", 2, 2)
    return out.select("user_id", r("x", 3).alias("x"), r("slope").alias("slope"))


_EVEN = "sqrt(r * r) * list_sum([exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) * pow(1 - r * r, k) for k in range(0, (n - 2) // 2)]) / sqrt(pi())"
_ODD = "2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(list_sum([exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * pow(1 - r * r, k) for k in range(0, (n - 3) // 2)]), 0) * sqrt(pi()) / 2)"


@query(f"""WITH c AS (SELECT l_suppkey, count(*) AS n, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, round(r, 8) AS r, round(CASE WHEN n < 3 THEN NULL WHEN abs(r) >= 1 THEN 0 WHEN n % 2 = 0 THEN 1 - {_EVEN} ELSE 1 - {_ODD} END, 7) AS p FROM c""")
def exact_correlation_p(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.corr("l_quantity", "l_discount").alias("r"))
    return c.select("l_suppkey", "n", r("r", 8).alias("r"), r(kernels.correlation_p(F.col("r"), F.col("n")), 7).alias("p"))


@query()
def polynomial_baselines(spark, d):
    return kernels.fitted_baseline(_spectrum(spark, d, 1000.0, 1800.0), ["user_id"], "x", "y")
