"""What a file holds, told by its name, header and numbers, as column expressions over its text.

Each file is one row, so its decision is a projection: no shuffle, and a file
in any encoding is decoded by Spark. Rules are tried in a fixed order; the
first that holds gives modality, kind, confidence and reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrion.functions import text as names

# Labels of the instruments in tables of results.
LABELS = {"TGA": "Thermal", "Py-GC-MS": "Thermal", "EEM": "EEM-PARAFAC"}
# Names of columns, without units and separators, that hold samples, and of those that are no descriptors.
SAMPLE_NAMES = ["sampleid", "sample", "id", "name", "samplename", "образец", "проба", "шифр"]
NO_DESCRIPTORS = ["classtarget", "class", "sampletype", "type", "group", "label", "basis", "matrix"]
CLASS_NAMES = ["classtarget", "class", "label", "group"]
# Names of the elements without units.
ELEMENT_NAMES = {
    "C": ["c", "carbon", "углерод"],
    "H": ["h", "hydrogen", "водород"],
    "N": ["n", "nitrogen", "азот"],
    "S": ["s", "sulfur", "sulphur", "сера"],
    "O": ["o", "oxygen", "кислород"],
}
# Parts of headers of thermograms and of pyrolysis tables, and words of their files' names.
TEMPERATURE_PARTS = ["temp", "темп", "°c"]
RETENTION_PARTS = ["retention", "время удерж"]
PYROLYSIS_FILES = ["pygcms", "py", "pyrolysis"]

# Endings of files' names that tell an instrument, one of each list is taken off in this order.
FILE_ENDINGS = [
    ["fticr", "ms", "ftms", "mass", "spectra"],
    ["eem", "parafac", "fluo", "fluor"],
    ["uv", "uvvis", "abs", "absorption"],
    ["ftir", "atr", "raman", "ir"],
    ["nmr", "13c", "1h", "cpmas"],
    ["tga", "dtg", "dsc", "pygcms", "thermal", "py"],
    ["sec", "gpc", "chrom", "mwd"],
    ["elem", "elemental", "chns", "chnso"],
]

#: Lines from which names and rows of a table are read; the numbers of all lines decide on the axis.
HEAD = 40

#: What a line whose first cell is a number begins with, after blanks and quotes: a sign, a digit, a point, or NaN or infinity.
NUMBER_START = r"""^[\x00-\x20\x7F"']*[-+.0-9NnIi]"""

BLANKS = " \t\n\x0b\x0c\r"


#: Bytes above ASCII as Latin-1 and as the Cyrillic code page has them; one byte has no letter there and stays.
_HIGH = [b for b in range(0x80, 0x100) if b != 0x98]
_LATIN, _CYRILLIC = "".join(map(chr, _HIGH)), bytes(_HIGH).decode("cp1251")


def decoded(content: Column) -> Column:
    """Text of a file: UTF-8 with or without a mark, else the Cyrillic code page."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), F.regexp_replace(as_text, "^\ufeff", "")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _CYRILLIC))


#: Where lines part: an end of line with all blanks around it, found from the first blank on so that long runs take linear time.
_ENDS = r"(?<![ \t\x0b\x0c])[ \t\x0b\x0c]*+[\r\n][ \t\n\x0b\x0c\r]*+"


def lines_of(text: Column) -> Column:
    """Lines without blanks around them; blank ones are left out."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _ENDS, -1))


def cells_of(line: Column, quoted: bool = False) -> Column:
    """Cells by tab, else semicolon, else comma, without blanks and quotes around them; with ``quoted`` a separator between quotes is part of its cell."""
    bare = F.regexp_replace(line, '"[^"]*"', "") if quoted else line
    outside = '(?=(?:[^"]*"[^"]*")*[^"]*$)'

    def split(sep: str) -> Column:
        plain = F.split(line, sep, -1)
        return F.when(F.contains(line, F.lit('"')), F.split(line, sep + outside, -1)).otherwise(plain) if quoted else plain

    parts = F.when(F.contains(bare, F.lit("\t")), split("\t")).when(F.contains(bare, F.lit(";")), split(";")).otherwise(split(","))
    return F.transform(parts, lambda c: F.btrim(F.btrim(c, F.lit(BLANKS)), F.lit("\"'")))


# Words in headers that tell a share of mass.
SHARE_WORDS = ["wt", "mass", "масс", "pct", "percent"]


def column_name(header: Column) -> Column:
    """A header's words without brackets, run together; words that tell a share of mass count only where there are no others."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(header), r"[(\[{][^)\]}]*[)\]}]", " "), F.lit("([0-9a-zà-ÿа-яё]+)"), F.lit(1))
    bare = F.array_except(words, F.array(*map(F.lit, SHARE_WORDS)))
    return F.array_join(F.when(F.size(bare) > 0, bare).otherwise(words), "")


def file_sample(path: Column) -> Column:
    """Name of the sample that a file is of: its stem without the instruments' endings, or the stem where nothing else is left."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\!]", ""), r"\.[^.]*$", "")
    name = stem
    for words in FILE_ENDINGS:
        name = F.regexp_replace(name, f"(?i)[-_]({'|'.join(words)})$", "")
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), stem)


def _in(words: list[str]):
    return lambda c: c.isin(words)


def _first(condition_array: Column) -> Column:
    """Place of the first true element, from one; zero if there is none."""
    return F.coalesce(F.array_position(condition_array, True), F.lit(0))


def _blocks(features: Column) -> Column:
    """Known blocks of descriptors as (n, first place, block), most frequent first."""
    found = F.transform(features, names.feature_block)
    kinds = F.filter(F.array_distinct(found), lambda b: b != "Other")
    counted = F.transform(kinds, lambda b, i: F.struct((-F.size(F.filter(found, lambda x: x == b))).alias("minus"), i.alias("i"), b.alias("block")))
    return F.array_sort(counted)


def detected(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Columns modality, kind, confidence, reason, header (its cells) and n_lines beside those of ``files``.

    Kinds: spectrum, table, descriptor_matrix and unknown. An empty or null
    text is told by the file's name alone.
    """
    made = [f"_d{i}" for i in range(12)]
    lines, header, rows, hits, ident, features, blocks, pts, xs, by_name, by_header, axis = made
    df = files.withColumn(lines, lines_of(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(header, F.when(F.size(lines) > 0, cells_of(F.get(lines, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(rows, F.transform(F.slice(lines, 2, HEAD - 1), lambda x: cells_of(x)))
    df = df.withColumn("_names", F.transform(header, column_name))
    df = df.withColumn(hits, sum((F.exists("_names", _in(n)).cast("int") for n in ELEMENT_NAMES.values()), F.lit(0)))
    df = df.withColumn(ident, _first(F.transform("_names", _in(SAMPLE_NAMES))).cast("int"))
    # a matrix of descriptors: names of samples in one column, half of the others known descriptors
    cells = F.transform(header, lambda h, i: F.struct(h.alias("h"), F.get("_names", i).alias("n"), (i + 1).alias("i")))
    keep = F.filter(cells, lambda c: (c["i"] != F.col(ident)) & ~c["n"].isin(NO_DESCRIPTORS) & (c["h"] != ""))
    df = df.withColumn(features, F.when((F.size(header) > 0) & (F.col(ident) > 0), F.transform(keep, lambda c: c["h"])))
    values = F.filter(F.transform(rows, lambda r: F.get(r, F.col(ident) - 1)), lambda v: v.isNotNull() & (v != ""))
    numeric = F.size(F.filter(values, lambda v: v.try_cast("double").isNotNull()))
    named = (F.size(features) >= 2) & ~((F.size(values) > 0) & (numeric > 0.5 * F.size(values)))
    plain = (F.size(lines) > 0) & ~F.startswith(F.get(lines, F.lit(0)), F.lit("##")) & (F.col(hits) < 3)
    df = df.withColumn(blocks, F.when(F.coalesce(named & plain, F.lit(False)), _blocks(F.col(features))))
    known = F.aggregate(blocks, F.lit(0), lambda a, b: a - b["minus"])
    wide = F.size(F.filter(blocks, lambda b: (-b["minus"] >= 3) | (-b["minus"] >= 0.2 * known)))
    matrix = F.coalesce(known >= F.greatest(F.lit(2.0), 0.5 * F.size(features)), F.lit(False))
    label = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), c), c)
    df = df.withColumn(by_name, label(names.file_modality(F.col(path))))
    df = df.withColumn(by_header, label(names.header_modality(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))))
    start = F.lower(F.array_join(F.slice(lines, 1, 5), " "))
    jcamp = F.contains(start, F.lit("##jcamp-dx")) | F.contains(start, F.lit("##data type= nmr"))
    mass_file = F.startswith(start, F.lit("<")) & (F.contains(start, F.lit("mzml")) | F.contains(start, F.lit("mzxml")))
    spectral = F.col(by_header).isNotNull() & ~F.col(by_header).isin("Elemental", "generic")
    df = df.withColumn("_open", ~(matrix | F.col(by_name).isNotNull() | (F.size(lines) == 0) | jcamp | mass_file | spectral))
    # axis: numbers of the first two columns of all lines that may begin with one, of files that nothing else has told
    all_numbers = F.forall(header, lambda c: c.try_cast("double").isNotNull())
    data = F.when(F.col("_open"), F.when(all_numbers, F.col(lines)).otherwise(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))))
    data = F.filter(data, lambda x: x.rlike(NUMBER_START))
    both = F.filter(F.transform(data, lambda x: F.slice(F.transform(cells_of(x), lambda c: c.try_cast("double")), 1, 2)), lambda p: F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    df = df.withColumn(pts, both)
    df = df.withColumn(xs, F.array_sort(F.transform(pts, lambda p: p[0])))
    steps = F.filter(F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a), lambda s: s > 0)
    df = df.withColumn("_steps", steps)
    n = F.size("_steps")
    total = F.aggregate("_steps", F.lit(0.0), lambda a, s: a + s)
    mean = total / n
    spread = F.sqrt(F.aggregate("_steps", F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean)) / n) / mean
    cv = F.when(n > 2, spread).otherwise(0.0)
    lo, hi = F.get(xs, F.lit(0)), F.get(xs, F.size(xs) - 1)
    ys = F.transform(pts, lambda p: p[1])
    # Ranges of the instruments' axes, tried in this order.
    ranged = F.when(
        F.size(xs) >= 20,
        F.when((lo >= 350) & hi.between(3000, 8000), "FTIR")
        .when(lo.between(15, 60) & hi.between(300, 1500) & (F.array_max(ys) <= 110) & (F.get(ys, F.lit(0)) > F.get(ys, F.size(ys) - 1)), "Thermal")
        .when((lo >= -50) & (lo < 10) & (hi > 100) & (hi <= 300), "NMR")
        .when((lo >= 180) & (hi <= 1100) & (hi - lo >= 100) & (cv < 0.05), "UV-Vis")
        .when((lo >= 50) & (hi <= 3000) & (cv > 0.5), "FT-ICR MS"),
    )
    df = df.withColumn(axis, ranged)

    def found(modality: Column | str, kind: Column | str, confidence: str, reason: str) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_column(modality).alias("modality"), as_column(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    decision = (
        F.when(matrix & (wide >= 2), found("Multimodal", "descriptor_matrix", "high", "descriptors of several blocks"))
        .when(matrix, found(F.get(blocks, F.lit(0))["block"], "descriptor_matrix", "high", "descriptors of a block"))
        .when(F.col(by_name).isNotNull(), found(F.col(by_name), F.when(F.col(by_name) == "Elemental", "table").otherwise("spectrum"), "high", "name of the file"))
        .when(F.size(lines) == 0, found("Unknown", "unknown", "low", "empty"))
        .when(jcamp, found("NMR", "spectrum", "high", "JCAMP-DX"))
        .when(mass_file, found("FT-ICR MS", "spectrum", "high", "mass spectra"))
        .when(spectral & (F.col(by_header) == "EEM-PARAFAC"), found("EEM-PARAFAC", "spectrum", "medium", "grid of wavelengths"))
        .when(spectral, found(F.col(by_header), "spectrum", "high", "header"))
        .when(F.col(axis).isNotNull(), found(F.col(axis), "spectrum", "medium", "range of the axis"))
        .when(F.col(hits) >= 3, found("Elemental", "table", "high", "elements in the header"))
        .when(F.col(ident) > 0, found("General / CSV", "table", "low", "table of samples"))
        .otherwise(found("General / CSV", "unknown", "low", "table"))
    )
    out = df.withColumn("_found", decision)
    return out.select(*files.columns, "_found.*", F.col(header).alias("header"), F.size(lines).alias("n_lines"))


def thermal_form(header: Column, path: Column) -> Column:
    """``pyrolysis`` or ``thermogram`` of a thermal file, by its header's line, then its name."""
    low = F.lower(F.array_join(header, ","))
    has = lambda parts: low.rlike("|".join(parts))
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(path, r"^.*[/\\!]", ""), r"\.[^.]*$", "")), r"[-_.\s]+")
    by_name = F.arrays_overlap(words, F.array(*map(F.lit, PYROLYSIS_FILES)))
    return F.when(has(TEMPERATURE_PARTS), "thermogram").when(has(RETENTION_PARTS) | low.rlike("(^|[^a-z])rt([^a-z]|$)") | by_name, "pyrolysis").otherwise("thermogram")


def default_class(sample: Column) -> Column:
    """Class of a sample without a label by its name."""
    # Parts of names of the two sources, and the classes' names.
    low = F.lower(sample)
    return F.when(low.rlike("lignin|sludge|impact|waste|шлам"), "Sludge_Lignin").when(low.rlike("baikal|control|background|pristine|фон"), "Baikal_Background").otherwise("Unassigned")
