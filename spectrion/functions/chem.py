"""Chemistry as Spark column expressions: formulas, classes, mass scales, isotopes, ions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses and atomic weights of the elements, and derived mass constants.
EXACT_MASS = {"C": 12.0, "H": 1.007825, "O": 15.994915, "N": 14.003074, "S": 31.972071}
ATOMIC_WEIGHT = {"C": 12.011, "H": 1.008, "O": 15.999, "N": 14.007, "S": 32.065}
# Element symbols by atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu"
).split()
# Absolute isotope ratios of the reference scales (VPDB, AIR, VSMOW, VSMOW, VCDT).
STANDARD_RATIOS = {"13C": 0.011180, "15N": 0.0036765, "2H": 155.76e-6, "18O": 2005.20e-6, "34S": 0.0441626}
PROTON = 1.007276
CARBON13 = 1.003355
KENDRICK = {"CH2": (14, 14.015650), "COO": (44, 43.989829), "O": (16, 15.994915), "H2": (2, 2.015650)}
#: Mass differences of common transformations, in their fixed order.
TRANSFORMATIONS = {
    "CH2": 14.015650, "O": 15.994915, "H2O": 18.010565, "H2": 2.015650,
    "CO2": 43.989829, "CO": 27.994915, "NH3": 17.026549, "SO3": 79.956815,
}


def ratio(num: Column, den: Column) -> Column:
    """num / den, null unless den is positive."""
    return F.when(den > 0, num / den)


def dbe(c: Column, h: Column, n: Column) -> Column:
    return 1.0 + c - 0.5 * h + 0.5 * n


def aromaticity(c: Column, h: Column, o: Column, n: Column, s: Column, oxygen: float = 1.0) -> Column:
    """Aromaticity index; with oxygen=0.5 the modified one. Zero if numerator or denominator isn't positive."""
    num = 1.0 + c - oxygen * o - s - 0.5 * (h + n)
    den = c - oxygen * o - s - n
    return F.when((num > 0) & (den > 0), num / den).otherwise(0.0)


def nosc(c: Column, h: Column, o: Column, n: Column, s: Column) -> Column:
    """Nominal oxidation state of carbon."""
    return F.when(c > 0, 4.0 - (4.0 * c + h - 3.0 * n - 2.0 * o - 2.0 * s) / c)


def is_cram(c: Column, h: Column, o: Column, dbe_: Column, ai: Column) -> Column:
    """Carboxyl-rich alicyclic molecules, closed bounds."""
    known = (c > 0) & (h > 0) & (o > 0)
    inside = (dbe_ / c).between(0.30, 0.68) & (dbe_ / h).between(0.20, 0.95) & (dbe_ / o).between(0.77, 1.75) & (h / c).between(0.70, 1.60) & (o / c).between(0.20, 0.70) & (ai < 0.50)
    return F.when(known, inside).otherwise(False)


def hetero_class(n: Column, s: Column) -> Column:
    """CHO, CHON, CHOS or CHONS."""
    return F.when((n > 0) & (s > 0), "CHONS").when(n > 0, "CHON").when(s > 0, "CHOS").otherwise("CHO")


def ladder(rules: list[tuple[Column, str]], other: str, unknown: Column, undefined: str = "undefined") -> Column:
    """First rule that holds names the class."""
    out = F.when(unknown, undefined)
    for test, name in rules:
        out = out.when(test, name)
    return out.otherwise(other)


# Bounds of published classes in the plane of H/C and O/C, in the order in which they are tested.


def class_perminova(hc: Column, oc: Column, ai: Column, cram: Column) -> Column:
    return ladder(
        [
            (cram, "cram"),
            ((ai >= 0.67) | ((hc < 0.70) & (oc <= 0.67)), "condensed_aromatics"),
            (hc.between(0.50, 1.50) & (oc > 0.67) & (oc <= 1.00) & (ai >= 0.50), "condensed_tannins"),
            (hc.between(0.50, 1.50) & (oc > 0.67) & (oc <= 1.20), "hydrolysable_tannins"),
            (hc.between(1.50, 2.40) & (oc > 0.67) & (oc <= 1.20), "carbohydrates"),
            (hc.between(1.50, 2.20) & oc.between(0.30, 0.67), "proteins"),
            (hc.between(1.50, 2.20) & (oc >= 0.00) & (oc < 0.30), "lipids"),
            ((hc >= 0.70) & (hc < 1.50) & oc.between(0.10, 0.67), "phenylpropanoids"),
            ((hc >= 0.70) & (hc < 1.50) & (oc >= 0.00) & (oc < 0.10), "terpenoids"),
        ],
        "other",
        hc.isNull() | oc.isNull(),
    )


def class_kellerman(hc: Column, oc: Column, ai: Column, n: Column) -> Column:
    return ladder(
        [
            ((ai > 0.66) | ((hc < 0.70) & (oc <= 0.67)), "polycyclic_aromatics"),
            (ai.between(0.50, 0.66), "polyphenols"),
            ((ai < 0.50) & (hc < 1.50) & (oc < 0.50), "unsaturated_low_oxygen"),
            ((ai < 0.50) & (hc < 1.50), "unsaturated_high_oxygen"),
            (hc.between(1.50, 2.00) & (oc < 0.90) & (n >= 1), "peptide_like"),
            (hc.between(1.50, 2.00) & (oc < 0.90), "aliphatics"),
            ((hc >= 1.50) & (oc >= 0.90), "carbohydrate_like"),
        ],
        "other",
        hc.isNull() | oc.isNull(),
    )


def class_laszakovits(hc: Column, oc: Column, ai: Column, n: Column) -> Column:
    return ladder(
        [
            ((ai >= 0.67) | ((hc < 0.70) & (oc <= 0.67)), "condensed_aromatics"),
            (hc.between(1.50, 2.00) & oc.between(0.00, 0.30), "lipids"),
            (hc.between(1.50, 2.20) & (oc > 0.30) & (oc <= 0.67) & (n >= 1), "peptides"),
            (hc.between(1.50, 2.20) & (oc > 0.67) & (oc <= 1.20) & (n >= 1), "aminosugars"),
            (hc.between(1.50, 2.40) & (oc > 0.67) & (oc <= 1.20) & (n == 0), "carbohydrates"),
            ((hc >= 0.70) & (hc < 1.50) & oc.between(0.10, 0.67), "lignin"),
            ((hc >= 0.50) & (hc < 1.50) & (oc > 0.67) & (oc <= 1.20), "tannins"),
            (hc.between(1.50, 2.20) & (oc > 0.30) & (oc <= 0.67), "unsaturated_aliphatics"),
        ],
        "other",
        hc.isNull() | oc.isNull(),
    )


def class_classical(hc: Column, oc: Column) -> Column:
    """Seven broad classes by the regions of a grid of twenty cells."""
    poor, rich = oc.between(0.00, 0.50), (oc > 0.50) & (oc <= 1.00)
    return ladder(
        [
            (poor & (hc >= 0.2) & (hc < 1.0), "condensed_tannins"),
            (poor & (hc >= 1.0) & (hc < 1.4), "lignins"),
            (poor & (hc >= 1.4) & (hc < 1.8), "terpenoids"),
            (poor & hc.between(1.8, 2.2) & (oc <= 0.25), "lipids"),
            (poor & hc.between(1.8, 2.2), "peptides"),
            (rich & (hc >= 0.2) & (hc < 1.4), "hydrolysable_tannins"),
            (rich & hc.between(1.4, 2.2), "carbohydrates"),
        ],
        "other",
        hc.isNull() | oc.isNull(),
    )


def kendrick(mass: Column, base: str = "CH2") -> tuple[Column, Column, Column]:
    """Kendrick mass, nominal Kendrick mass (half to even) and mass defect."""
    nominal, exact = KENDRICK[base]
    km = mass * (nominal / exact)
    return km, F.rint(km), F.rint(km) - km


def ppm_error(measured: Column, theoretical: Column) -> Column:
    return (measured - theoretical) / measured * 1e6


def formula_counts(formula: Column) -> Column:
    """Map of element to count; a repeated symbol is summed."""
    atoms = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    parts = F.transform(atoms, lambda a: F.struct(F.regexp_extract(a, "^([A-Z][a-z]?)", 1).alias("e"), F.coalesce(F.regexp_extract(a, "([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("n")))
    elements = F.array_distinct(F.transform(parts, lambda p: p["e"]))
    total = lambda e: F.aggregate(F.filter(parts, lambda p: p["e"] == e), F.lit(0), lambda acc, p: acc + p["n"])
    return F.map_from_arrays(elements, F.transform(elements, total))


def formula_mass(formula: Column, masses: dict[str, float] = EXACT_MASS) -> Column:
    """Mass of a formula; null if it has an element that isn't in the table."""
    known = F.create_map(*[F.lit(x) for pair in masses.items() for x in pair])
    return F.aggregate(F.map_entries(formula_counts(formula)), F.lit(0.0), lambda acc, e: acc + e["value"] * F.element_at(known, e["key"]))


def valid_formula(formula: Column, longest: int = 64) -> Column:
    """Whether a text is nothing but real element symbols, each with a whole number or none."""
    symbols = F.array(*map(F.lit, SYMBOLS))
    used = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)"), F.lit(1))
    shape = formula.rlike("^([A-Z][a-z]?[0-9]*)+$") & (F.length(formula) <= longest)
    return F.coalesce(shape & F.forall(used, lambda e: F.array_contains(symbols, e)), F.lit(False))


def isotope_standard(isotope: str) -> float:
    """Absolute ratio of an isotope's reference scale, by its name or a common alias."""
    name = isotope.strip().upper()
    return STANDARD_RATIOS[{"D": "2H", "H2": "2H", "DELTAD": "2H"}.get(name, name)]


def delta_from_ratio(r: Column, standard: Column) -> Column:
    return (r / standard - 1.0) * 1000.0


def ratio_from_delta(delta: Column, standard: Column) -> Column:
    return standard * (1.0 + delta / 1000.0)


def two_point(measured: Column, m1: Column, m2: Column, t1: Column, t2: Column) -> Column:
    """Linear map by two references; null where they are equal."""
    return F.when(m1 != m2, t1 + (measured - m1) * (t2 - t1) / (m2 - m1))


def two_source_share(sample: Column, a: Column, b: Column) -> Column:
    """Share of source a, clipped to 0 and 1; null where the sources are equal."""
    return F.when(a != b, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (sample - b) / (a - b))))


def mixing_table(sample: Column, a: Column, b: Column) -> dict[str, Column]:
    """Percentages of two sources, whether the sample lies outside them, and a label; all null where the sources are equal."""
    share = two_source_share(sample, a, b)
    outside = (sample < F.least(a, b)) | (sample > F.greatest(a, b))
    label = F.when(share > 0.5, "source").when(share > 0.15, "mixed").when(share.isNotNull(), "background")
    return {"source_percent": 100.0 * share, "background_percent": 100.0 * (1.0 - share), "outside": F.when(a != b, outside), "label": label}


def gaussian(x: Column, height: Column, center: Column, sigma: Column) -> Column:
    return height * F.exp(-0.5 * F.pow((x - center) / sigma, F.lit(2.0)))


def lorentzian(x: Column, height: Column, center: Column, width: Column) -> Column:
    return height / (1.0 + 4.0 * F.pow((x - center) / width, F.lit(2.0)))


def band_area(shape: str, height: Column, fwhm: Column) -> Column:
    """Area of a Lorentzian or Gaussian band."""
    if shape == "lorentzian":
        return math.pi * height * fwhm / 2.0
    return height * fwhm * math.sqrt(math.pi / (4.0 * math.log(2.0)))


def crystallite_size(height_ratio: Column, area_ratio: Column, laser_nm: Column) -> dict[str, Column]:
    """In-plane crystallite size in nm from D over G: by areas (Tuinstra-Koenig form) where that gives 2 nm or more, else by heights (Ferrari-Robertson form)."""
    fourth = F.pow(laser_nm, F.lit(4.0))
    ordered = F.when(area_ratio > 0, 2.4e-10 * fourth / area_ratio)
    amorphous = F.when(height_ratio > 0, F.sqrt(height_ratio / (0.0055 * fourth / 514.5**4)) / 10.0)
    size = F.when(ordered >= 2.0, ordered).otherwise(amorphous)
    return {"size_areas": ordered, "size_heights": amorphous, "size": size, "regime": F.when(ordered >= 2.0, "ordered").when(amorphous.isNotNull(), "amorphous")}


def raman_emission(excitation: Column, shift: float = 3.4e-4) -> Column:
    """Emission wavelength of the water Raman band; null where it isn't finite."""
    return F.when(1.0 / excitation - shift > 0, 1.0 / (1.0 / excitation - shift))


def scatter_masked(em: Column, ex: Column, rayleigh: float = 12, second: float = 15, raman: float = 10) -> Column:
    """Whether a cell of an excitation-emission matrix lies in a scatter band."""
    band = F.abs(em - ex) <= rayleigh
    band = band | (F.abs(em - 2 * ex) <= second) | (em < ex - 5)
    return band | F.coalesce(F.abs(em - raman_emission(ex)) <= raman, F.lit(False))


def inner_filter(f: Column, a_ex: Column, a_em: Column) -> Column:
    return f * F.pow(F.lit(10.0), 0.5 * (a_ex + a_em))


def absorbance(transmittance_percent: Column, floor: float = 1e-4) -> Column:
    return 2.0 - F.log10(F.greatest(transmittance_percent, F.lit(floor)))


def heating_value(c: Column, h: Column, o: Column, s: Column) -> tuple[Column, Column]:
    """Two estimates of the higher heating value from mass percentages."""
    return 0.339 * c + 1.256 * h - 0.1088 * (o - s), 0.3383 * c + 1.443 * (h - o / 8.0) + 0.0942 * s


# Ions with molar mass, charge and sign.
IONS = {
    "fluoride": (18.998, 1, -1), "chloride": (35.453, 1, -1), "nitrite": (46.005, 1, -1), "nitrate": (62.004, 1, -1),
    "bromide": (79.904, 1, -1), "phosphate": (94.971, 3, -1), "sulfate": (96.06, 2, -1), "bicarbonate": (61.017, 1, -1),
    "carbonate": (60.009, 2, -1), "acetate": (59.044, 1, -1), "formate": (45.017, 1, -1), "oxalate": (88.02, 2, -1),
    "lactate": (89.07, 1, -1), "succinate": (116.07, 2, -1), "malate": (132.07, 2, -1), "citrate": (189.10, 3, -1),
    "sodium": (22.990, 1, 1), "ammonium": (18.039, 1, 1), "potassium": (39.098, 1, 1), "magnesium": (24.305, 2, 1), "calcium": (40.078, 2, 1),
}

#: Milligrams of calcium carbonate in one milliequivalent.
CARBONATE_EQUIVALENT = 50.04


def ion_mg_l(value: Column, ion: str, unit: str | None) -> Column:
    """A concentration in mg/l; without a unit it already is."""
    mass, charge, _ = IONS[ion]
    per_unit = {None: 1.0, "mg/l": 1.0, "ug/l": 1e-3, "mmol/l": mass, "meq/l": mass / charge, "ueq/l": mass / charge / 1000.0, "mg/l caco3": mass / charge / CARBONATE_EQUIVALENT}
    return value * per_unit[unit]


def alkalinity_meq_l(value: Column, unit: str) -> Column:
    return value * {"meq/l": 1.0, "mmol/l": 1.0, "ueq/l": 1e-3, "mg/l caco3": 1 / CARBONATE_EQUIVALENT}[unit]


# Acid constants at 25 degrees (negative logarithms) of phosphoric acid, of bicarbonate and of water.
PHOSPHATE_PK = (2.15, 7.20, 12.35)
BICARBONATE_PK = 10.33
WATER_PK = 14.0


def phosphate_charge(ph: Column) -> tuple[Column, Column]:
    """Mean charge number of dissolved phosphate and mean of its square; null without pH."""
    total, weights = 0.0, []
    for pk in PHOSPHATE_PK:
        total += pk
        weights.append(F.pow(F.lit(10.0), (len(weights) + 1) * ph - total))  # against the undissociated acid
    every = 1.0 + sum(weights[1:], weights[0])
    first = sum(((k + 1) * w for k, w in enumerate(weights)), F.lit(0.0))
    second = sum(((k + 1) ** 2 * w for k, w in enumerate(weights)), F.lit(0.0))
    return first / every, second / every


def alkalinity_split(alkalinity: Column, ph: Column) -> tuple[Column, Column]:
    """Bicarbonate and carbonate (mmol/l) of an alkalinity (meq/l); without pH all is bicarbonate, and nothing is negative."""
    power = lambda x: F.pow(F.lit(10.0), x)
    left = F.greatest(alkalinity - 1000.0 * power(ph - WATER_PK) + 1000.0 * power(-ph), F.lit(0.0))
    share = power(ph - BICARBONATE_PK)
    bicarbonate = left / (1.0 + 2.0 * share)
    return F.when(ph.isNull(), F.greatest(alkalinity, F.lit(0.0))).otherwise(bicarbonate), F.when(ph.isNull(), 0.0).otherwise(share * bicarbonate)


def pyrolysis_ratios(area: dict[str, Column]) -> dict[str, Column]:
    """Ratios of summed areas by class; null where a denominator isn't positive."""
    lignin = area["hydroxyphenyl"] + area["guaiacyl"] + area["syringyl"]
    percent = {f"{n}_percent": ratio(100.0 * area[n], lignin) for n in ("hydroxyphenyl", "guaiacyl", "syringyl")}
    return percent | {"s_g": ratio(area["syringyl"], area["guaiacyl"]), "h_g": ratio(area["hydroxyphenyl"], area["guaiacyl"]), "lignin_carbohydrate": ratio(lignin, area["carbohydrate"])}
