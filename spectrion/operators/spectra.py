"""Descriptors of single instruments: one row per sample from long points, as aggregates of the ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrion.functions.chem import ATOMIC_WEIGHT, heating_value
from spectrion.functions.text import CARBONYL_WORDS, lignin_carbonyl

from .ordered import band_maximum, crossings, log_slope, nearest_value, noise_sigma, savgol, simpson

# Chemical-shift bins of carbon spectra, closed on both sides, and their names.
NMR_BINS = {
    "alkyl": (0.0, 45.0), "methoxy": (45.0, 60.0), "o_alkyl": (60.0, 90.0), "acetal": (90.0, 110.0),
    "aromatic": (110.0, 145.0), "phenolic": (145.0, 165.0), "carboxyl": (165.0, 190.0), "carbonyl": (190.0, 220.0),
}
# Infrared bands as centre and half width, and ratios of bands.
FTIR_BANDS = {
    "i3400": (3400.0, 30.0), "i2960": (2960.0, 10.0), "i2920": (2920.0, 10.0), "i2850": (2850.0, 10.0), "i1720": (1720.0, 15.0), "i1650": (1650.0, 15.0), "i1600": (1605.0, 15.0),
    "i1510": (1510.0, 10.0), "i1450": (1450.0, 12.0), "i1330": (1330.0, 10.0), "i1270": (1270.0, 10.0), "i1220": (1220.0, 12.0), "i1030": (1030.0, 15.0),
}
FTIR_RATIOS = {"aromaticity": ("i1600", "i2920"), "oxidation": ("i1720", "i1600"), "branching": ("i2960", "i2920"), "lignin": ("i1510", "i1600"), "guaiacyl_syringyl": ("i1270", "i1330"), "polysaccharide": ("i1030", "i1600"), "phenolic": ("i1220", "i1600")}
# The eight carbon bins rolled up to six zones.
NMR_ZONES = {"alkyl": ["alkyl"], "o_alkyl": ["methoxy", "o_alkyl"], "acetal": ["acetal"], "aromatic": ["aromatic"], "phenolic": ["phenolic"], "carboxyl_carbonyl": ["carboxyl", "carbonyl"]}
# Mass limits of size fractions.
SEC_LIMITS = (20_000.0, 5_000.0, 1_000.0)
# Temperatures between which mass is lost in a thermogram's zones.
TGA_ZONES = {"moisture": (25.0, 150.0), "aliphatic": (150.0, 350.0), "aromatic": (350.0, 550.0)}


def _ratio(num: Column, den: Column, least: float = 1e-4) -> Column:
    return F.when(den >= least, num / den)


def nmr_descriptors(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Share of each shift bin in percent of all bins' area, and indices of them; a point on an edge counts for both bins."""
    bins = F.array(*[F.struct(F.lit(n).alias("bin"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, (a, b) in NMR_BINS.items()])
    hit = F.explode(F.filter(bins, lambda b: F.col(x).between(b["lo"], b["hi"])))
    cut = points.select(*keys, x, y, hit.alias("b")).select(*keys, x, y, F.col("b.bin").alias("bin"))
    area = simpson(cut, [*keys, "bin"], x, y).withColumn("area", F.greatest("area", F.lit(0.0)))
    wide = area.groupBy(*keys).pivot("bin", list(NMR_BINS)).agg(F.first("area"))
    total = sum((F.coalesce(n, F.lit(0.0)) for n in NMR_BINS), F.lit(0.0))
    pct = {n: F.try_divide(100.0 * F.coalesce(n, F.lit(0.0)), total) for n in NMR_BINS}
    shares = wide.select(*keys, *[c.alias(n) for n, c in pct.items()])
    p = {n: F.col(n) for n in NMR_BINS}
    oxygen, ring = p["methoxy"] + p["o_alkyl"] + p["acetal"], p["aromatic"] + p["phenolic"]
    return shares.withColumns(
        {
            "fa": ring, "hb_hi": _ratio(p["alkyl"] + ring, oxygen + p["carboxyl"] + p["carbonyl"]), "alkyl_o_alkyl": _ratio(p["alkyl"], oxygen),
            "lignin_signature": p["phenolic"] + p["methoxy"], "coo_ar": _ratio(p["carboxyl"], ring),
        }
    )


def nmr_zones(shares: DataFrame) -> DataFrame:
    """The eight bins of ``nmr_descriptors`` as six zones; other columns stay."""
    keep = [c for c in shares.columns if c not in NMR_BINS]
    return shares.select(*keep, *[sum((F.col(b) for b in parts[1:]), F.col(parts[0])).alias(f"zone_{n}") for n, parts in NMR_ZONES.items()])


def uv_descriptors(points: DataFrame, keys: list[str], x: str, y: str, doc: Column | None = None, path_cm: float = 1.0, tolerance: float = 5.0) -> DataFrame:
    """Absorbances, their ratios, logarithmic slopes and what is estimated from them."""
    wl, a = F.col(x), F.col(y)
    at = {f"a{w}": nearest_value(wl, a, w, tolerance) for w in (250, 254, 280, 365, 465, 665)}
    carbon = [] if doc is None else [F.max(doc).alias("doc")]
    agg = points.groupBy(*keys).agg(*[v.alias(n) for n, v in at.items()], log_slope(wl, a, 275, 295).alias("s275"), log_slope(wl, a, 350, 400).alias("s350"), *carbon)
    e2e3 = F.when(F.col("a365") > 0, F.col("a250") / F.col("a365"))
    out = agg.withColumn("e2_e3", e2e3).withColumn("e4_e6", F.when(F.col("a665") > 0, F.col("a465") / F.col("a665"))).withColumn("s_r", F.try_divide("s275", "s350"))
    out = out.withColumn("mass_estimate", F.when((F.col("e2_e3") > 0) & (F.col("e2_e3") <= 7.82), 3450 - 390 * F.col("e2_e3")))
    return out if doc is None else out.withColumn("suva254", F.when(F.col("doc") > 0, F.col("a254") / path_cm / F.col("doc") * 100))


def eem_descriptors(grid: DataFrame, keys: list[str], ex: str, em: str, value: str, tolerance: float = 5.0) -> DataFrame:
    """Fluorescence, biological and humification index of long excitation-emission matrices."""

    def at(x: float, m: float) -> Column:
        near = (F.abs(F.col(ex) - x) <= tolerance) & (F.abs(F.col(em) - m) <= tolerance)
        return F.min_by(F.when(near, F.col(value)), F.when(near, F.struct(F.abs(F.col(ex) - x), F.abs(F.col(em) - m), F.col(ex), F.col(em))))

    spots = grid.groupBy(*keys).agg(at(370, 470).alias("_a"), at(370, 520).alias("_b"), at(310, 380).alias("_c"), at(310, 430).alias("_d"))
    row = grid.where(F.abs(F.col(ex) - 254) <= tolerance)
    first = row.groupBy(*keys).agg(F.min_by(ex, F.struct(F.abs(F.col(ex) - 254), F.col(ex))).alias("_ex"))
    line = row.join(first, keys).where(F.col(ex) == F.col("_ex"))
    high = simpson(line.where(F.col(em).between(435, 480)), keys, em, value).withColumnRenamed("area", "_high")
    low = simpson(line.where(F.col(em).between(300, 345)), keys, em, value).withColumnRenamed("area", "_low")
    both = spots.join(high, keys, "left").join(low, keys, "left")
    return both.select(*keys, F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).alias("fi"), F.when(F.col("_d") > 0, F.col("_c") / F.col("_d")).alias("bix"), F.when(F.col("_low") > 0, F.col("_high") / F.col("_low")).alias("hix"))


def raman_units(grid: DataFrame, blank: DataFrame, keys: list[str], ex: str, em: str, value: str, line: float = 350.0, tolerance: float = 2.5, window: tuple[float, float] = (381.0, 426.0)) -> DataFrame:
    """Matrices over the area of the water blank's Raman band, with the area as ``raman_area``.

    The area is Simpson's along the emission window at the blank's excitation
    nearest to ``line``. Without three points there, or with an area that isn't
    positive, values stay as they are and ``raman_area`` is null.
    """
    near = blank.where(F.abs(F.col(ex) - line) <= tolerance)
    chosen = near.groupBy(*keys).agg(F.min_by(ex, F.struct(F.abs(F.col(ex) - line), F.col(ex))).alias("_ex"))
    points = near.join(chosen, keys).where((F.col(ex) == F.col("_ex")) & F.col(em).between(*window) & F.col(value).isNotNull())
    enough = points.groupBy(*keys).agg((F.count("*") >= 3).alias("_enough"))
    area = simpson(points, keys, em, value).join(enough, keys).where((F.col("area") > 0) & F.col("_enough")).select(*keys, F.col("area").alias("raman_area"))
    return grid.join(area, keys, "left").withColumn(value, F.when(F.col("raman_area").isNotNull(), F.col(value) / F.col("raman_area")).otherwise(F.col(value)))


def ftir_descriptors(points: DataFrame, keys: list[str], x: str, y: str, snr: float = 3.0, least: float = 0.01) -> DataFrame:
    """Band maxima and their ratios; a ratio needs a denominator above noise."""
    bands = band_maximum(points, keys, x, y, FTIR_BANDS)
    noise = noise_sigma(points, keys, [x], y)
    top = points.groupBy(*keys).agg(F.max(F.abs(F.col(y))).alias("_top"))
    all_ = bands.join(noise, keys, "left").join(top, keys).withColumn("_limit", F.greatest(snr * F.coalesce("sigma", F.lit(0.0)), least * F.col("_top")))
    return all_.withColumns({n: F.when(F.col(d) > F.col("_limit"), F.col(a) / F.col(d)) for n, (a, d) in FTIR_RATIOS.items()}).drop("_limit", "_top")


def sec_masses(slices: DataFrame, volume: str, coefficients: list[float]) -> Column:
    """Molar mass by a calibration polynomial of the elution volume; log10 is kept within 1 and 7."""
    log = sum((F.lit(float(c)) * F.pow(F.col(volume), F.lit(float(k))) for k, c in enumerate(coefficients)), F.lit(0.0))
    return F.pow(F.lit(10.0), F.least(F.lit(7.0), F.greatest(F.lit(1.0), log)))


def sec_fractions(slices: DataFrame, keys: list[str], signal: str, mass: str, limits: tuple[float, ...] = SEC_LIMITS) -> DataFrame:
    """Share of the signal in each mass fraction [low, high) in percent; null where the signal's masses can't reach a fraction."""
    edges = [(limits[0], None), *[(b, a) for a, b in zip(limits, limits[1:])], (0.0, limits[-1])]
    s, m = F.col(signal), F.col(mass)
    aggs = []
    for i, (lo, hi) in enumerate(edges, 1):
        inside = (m >= lo) & ((m < hi) if hi else F.lit(True))
        reach = (F.max(m) > lo) & ((F.min(m) < hi) if hi else F.lit(True))
        aggs.append(F.when(reach, 100.0 * F.try_divide(F.sum(F.when(inside, s).otherwise(0.0)), F.sum(s))).alias(f"fraction_{i}"))
    return slices.groupBy(*keys).agg(*aggs)


def tga_descriptors(points: DataFrame, keys: list[str], temperature: str, mass: str) -> DataFrame:
    """Mass at the zones' borders (interpolated), losses and their ratio, and temperatures at which 5, 10 and 50 % of the dry mass are gone."""
    from .ranges import interpolated

    borders = sorted({t for z in TGA_ZONES.values() for t in z})
    asked = points.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, borders))).alias("_t"))
    at = interpolated(asked, points, keys, "_t", temperature, mass, "_m").groupBy(*keys).pivot("_t", borders).agg(F.first("_m"))
    named = at.toDF(*keys, *[f"m{int(t)}" for t in borders])
    loss = named.withColumns({f"loss_{n}": F.col(f"m{int(a)}") - F.col(f"m{int(b)}") for n, (a, b) in TGA_ZONES.items()})
    out = loss.withColumn("thermostability", _ratio(F.col("loss_aromatic"), F.col("loss_aliphatic")))
    dry = points.join(named.select(*keys, F.col("m150").alias("_dry")), keys).where((F.col(temperature) >= 150) & F.col("_dry").isNotNull())
    gone = crossings(dry, keys, temperature, mass, {f"t{share}": F.col("_dry") * (1 - share / 100) for share in (5, 10, 50)})
    return out.join(gone, keys, "left")


def slope_curve(points: DataFrame, keys: list[str], x: str, y: str, half: int = 10, degree: int = 3, least: float = 1e-4, out: str = "slope") -> DataFrame:
    """Negative slope of ln y at each evenly spaced point with y above ``least``; signals shorter than a window have none."""
    positive = points.where(F.col(y) > least).withColumn("_ln", F.log(y))
    steps = positive.groupBy(*keys).agg(((F.max(x) - F.min(x)) / (F.count("*") - 1)).alias("_step"))
    fitted = savgol(positive, keys, [x], "_ln", half, 1, degree, "_d", ends=True)
    return fitted.join(steps, keys).withColumn(out, -F.try_divide("_d", "_step")).drop("_ln", "_d", "_step")


#: Position of the reference signal in ppm, half width of the window and largest shift.
SHIFT_REFERENCES = {("dmso", "13C"): (39.5, 1.5, 1.5), ("dmso", "1H"): (2.5, 0.5, 0.5), ("tms", "13C"): (0.0, 1.5, 2.5), ("tms", "1H"): (0.0, 1.5, 2.5)}


def recalibrated_shifts(points: DataFrame, keys: list[str], x: str, y: str, reference: str, nucleus: str = "13C") -> DataFrame:
    """Chemical shifts moved so that the reference signal stands where it belongs, and the move as ``shift_by``.

    The signal is the highest point of the window, of equals the one with the
    lowest x. It must not stand at the window's edge, must reach a twentieth
    of the spectrum's highest point and need no larger move than is allowed;
    else nothing moves.
    """
    target, half, most = SHIFT_REFERENCES[reference, nucleus]
    inside = F.col(x).between(target - half, target + half)
    near = F.when(inside, F.col(x))
    known = points.groupBy(*keys).agg(F.max_by(near, F.when(inside, F.struct(F.col(y), -F.col(x)))).alias("_at"), F.max(F.when(inside, F.col(y))).alias("_peak"), F.min(near).alias("_low"), F.max(near).alias("_high"), F.max(y).alias("_top"))
    move = F.lit(target) - F.col("_at")
    good = (F.col("_at") > F.col("_low")) & (F.col("_at") < F.col("_high")) & ~((F.col("_top") > 1e-4) & (F.col("_peak") < 0.05 * F.col("_top"))) & (F.abs(move) <= most)
    moves = known.select(*keys, F.when(good, move).otherwise(0.0).alias("shift_by"))
    return points.join(moves, keys).withColumn(x, F.col(x) + F.col("shift_by"))


def carbonyl_ratios(peaks: DataFrame, keys: list[str], name: str, area: str) -> DataFrame:
    """Acid to aldehyde and ketone to aldehyde ratios of guaiacyl and syringyl lignin by the areas of named peaks; null where one of the two isn't there."""
    # areas by name first, so that a name's class is worked out once for each sample
    named = peaks.groupBy(*keys, name).agg(F.sum(area).alias("_area"))
    kinds = named.groupBy(*keys, lignin_carbonyl(F.col(name)).alias("_kind")).agg(F.sum("_area").alias("_area"))
    sums = kinds.groupBy(*keys).pivot("_kind", list(CARBONYL_WORDS)).agg(F.first("_area"))
    ratio = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) / F.col(b))
    pairs = [(unit, num) for unit in ("guaiacyl", "syringyl") for num in ("acid", "ketone")]
    return sums.select(*keys, *[ratio(f"{unit}_{num}", f"{unit}_aldehyde").alias(f"{unit}_{num}_aldehyde") for unit, num in pairs])


def elemental_descriptors(samples: DataFrame) -> DataFrame:
    """Columns c, h, n, s, o, ash, moisture in percent and basis: ash-free composition, atomic ratios, indices and heating values."""
    organic = F.when(F.col("basis") == "as_received", 100.0 - F.col("ash") - F.col("moisture")).when(F.col("basis") == "dry", 100.0 - F.col("ash")).otherwise(100.0)
    scaled = samples.withColumn("_k", F.when(organic > 0, 100.0 / organic))
    daf = scaled.withColumns({f"{e}_daf": F.col(e) * F.col("_k") for e in "chnso"})
    mol = {e: F.col(f"{e}_daf") / ATOMIC_WEIGHT[e.upper()] for e in "chnso"}
    ratios = daf.withColumns({f"{e}_c": F.when(mol["c"] > 0, mol[e] / mol["c"]) for e in "hons"})
    hc, oc, nc, sc = (F.col(f"{e}_c") for e in ("h", "o", "n", "s"))

    def ai(oxygen: Column) -> Column:
        num, den = 1.0 - oxygen - sc - 0.5 * (hc + nc), 1.0 - oxygen - sc - nc
        return F.when((num > 0) & (den > 0), num / den).otherwise(0.0)

    first, second = heating_value(F.col("c_daf"), F.col("h_daf"), F.col("o_daf"), F.col("s_daf"))
    total = sum((F.col(f"{e}_daf") for e in "chnso"), F.lit(0.0))
    return ratios.withColumns({"nosc": -(hc - 3.0 * nc - 2.0 * oc - 2.0 * sc), "ai": ai(oc), "ai_mod": ai(0.5 * oc), "hhv_mendeleev": first, "hhv_dulong": second, "basis_warning": total > 100.5}).drop("_k")


def isotope_descriptors(samples: DataFrame) -> DataFrame:
    """Columns d13c, d15n, d34s, d2h, d18o and is_water: deuterium excess of water and a weighted score over the isotopes measured."""
    s34, c13, n15 = F.col("d34s"), F.col("d13c"), F.col("d15n")
    one = F.lit(1.0)
    parts = [
        (s34, 0.5, F.when(s34 >= 4.0, F.least(one, (s34 - 3.5) / 4.0)).otherwise(0.0)),
        (c13, 0.3, F.when(c13 > -28.5, F.least(one, (c13 + 29.0) / 2.0)).otherwise(0.0)),
        (n15, 0.2, F.when(n15.between(0.5, 4.5), one).otherwise(0.0)),
    ]
    score = sum((F.when(x.isNotNull(), w * v).otherwise(0.0) for x, w, v in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w, _ in parts), F.lit(0.0))
    flags = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in ("d13c", "d15n", "d34s", "d2h", "d18o")]))
    return samples.withColumns({"d_excess": F.when(F.col("is_water"), F.col("d2h") - 8.0 * F.col("d18o")), "kraft_score": F.when(weight > 0, F.least(one, F.greatest(F.lit(0.0), score / weight))), "flags": flags})


def kraft_water_score(sulfate: Column, chloride: Column, acids: Column, sodium: Column, background: float = 13.0) -> Column:
    """Heuristic share of pulp-mill effluent in a water, 0 to 1."""
    part = lambda weight, x, start, span: F.when(x > start, weight * F.least(F.lit(1.0), (x - start) / span)).otherwise(0.0)
    ratio = F.when(chloride > 0, sulfate / chloride)
    total = part(0.4, sulfate, 20.0, 80.0) + part(0.3, ratio, background, background) + part(0.2, acids, 1.5, 15.0) + part(0.1, sodium, 15.0, 50.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def identified(peaks: DataFrame, library: DataFrame, key: str, name: str, entry: str) -> DataFrame:
    """Peaks with the library's entry of their name: the whole name, the name without what stands in brackets, or one of the synonyms in brackets, in any case.

    A name that several entries have takes the first by ``entry``; peaks without one keep nulls.
    """
    low = lambda c: F.trim(F.translate(F.lower(c), "ё", "е"))
    whole = low(F.col(entry))
    bare = F.trim(F.regexp_replace(whole, r"\s*\(.*?\)\s*", " "))
    names = F.explode(F.array_distinct(F.concat(F.array(whole, bare), F.transform(F.regexp_extract_all(whole, F.lit(r"\((.*?)\)"), F.lit(1)), F.trim))))
    known = library.select(names.alias("_name"), F.struct(entry, *[c for c in library.columns if c != entry]).alias("_entry")).where("_name <> ''")
    one = known.groupBy("_name").agg(F.min("_entry").alias("_entry"))
    return peaks.withColumn("_name", low(F.col(name))).join(one, "_name", "left").drop("_name").select(*peaks.columns, "_entry.*")


def unique_matches(peaks: DataFrame, keys: list[str], compound: str, distance: str, area: str, ident: str, out: str = "matched") -> DataFrame:
    """A compound of a sample stays with one peak, the nearest in retention and of equals the larger one; for others ``out`` is null."""
    order = Window.partitionBy(*keys, compound).orderBy(distance, F.desc(area), ident)
    return peaks.withColumn(out, F.when(F.col(compound).isNotNull() & (F.row_number().over(order) == 1), F.col(compound)))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the scores that are known, by weight; null if none is."""
    total = sum((F.when(x.isNotNull(), x * w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def concordance(ppm: Column, tolerance: float, ftir: Column, nmr: Column, stoichiometry: Column) -> Column:
    """Agreement of a candidate structure with mass, infrared, carbon and composition data, 0 to 100."""
    mass = F.when(ppm.isNotNull(), F.greatest(F.lit(0.0), 100.0 - 25.0 * F.abs(ppm) / tolerance))
    return weighted_score([(mass, 0.2), (ftir, 0.35), (nmr, 0.3), (stoichiometry, 0.15)])
