"""Readers and writers of instrument files.

Files are read by Spark (``binaryFile``), so any store that Spark reads will
do; each file is parsed by a small decoder inside ``mapInArrow``-style tasks
and gives rows. A file that can't be parsed gives one row with its error and
never fails the job.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrion.functions.text import sample_id
from spectrion.session import let_workers_import

ENCODINGS = ("utf-8-sig", "cp1251", "latin-1")

#: Guards against bombs: bytes that one compressed array or archive may unfold to, members of an archive, and their ratio.
MAX_INFLATED = 200_000_000
MAX_MEMBERS = 1000
MAX_RATIO = 100

POINTS = "path string, sample_id string, series string, x double, y double, error string"


def decoded(raw: bytes) -> str:
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


_NUMBER = re.compile(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$")


def sniff(lines: list[str]) -> tuple[str, bool]:
    """Separator and whether commas are decimal, by how many of the lines split into two numbers or more."""
    best = (-1, "\t", False)
    for sep in ("\t", ";", ",", None):
        for comma in (False, True):
            if comma and sep == ",":
                continue
            good = 0
            for line in lines[:50]:
                parts = [p.strip() for p in line.split(sep)]
                numbers = [p for p in parts if _NUMBER.match(p) and (comma or "," not in p)]
                good += len(numbers) >= 2 and len(numbers) == len([p for p in parts if p])
            if good > best[0]:
                best = (good, sep, comma)
    return best[1], best[2]


def delimited(text: str) -> Iterator[tuple[str, float, float]]:
    """Rows of a delimited table: the first column of numbers against each other, named by the header."""
    lines = [x for x in text.splitlines() if x.strip() and x[0] not in "#!" and not x.startswith("//")]
    sep, comma = sniff(lines)
    header: list[str] | None = None
    for line in lines:
        parts = [p.strip().strip("\"'") for p in line.split(sep)]
        values = []
        for p in parts:
            try:
                values.append(float(p.replace(",", ".") if comma else p))
            except ValueError:
                values.append(None)
        if values and values[0] is None:
            header = header or parts
            continue
        for i, v in enumerate(values[1:], 1):
            if v is not None and v == v:
                yield (header[i] if header and i < len(header) else f"y{i}"), values[0], v


# JCAMP-DX: numbers may be packed; see the public JCAMP-DX 4.24 protocol for the forms

_SQZ = {c: (i, 1) for i, c in enumerate("@ABCDEFGHI")} | {c: (i, -1) for i, c in enumerate("abcdefghi", 1)}
_DIF = {c: (i, 1) for i, c in enumerate("%JKLMNOPQR")} | {c: (i, -1) for i, c in enumerate("jklmnopqr", 1)}
_DUP = {c: i for i, c in enumerate("STUVWXYZs", 1)}
_ITEM = re.compile(r"([@A-Ia-i%J-Rj-rS-Zs]|[+-]?)(\d*\.?\d*(?:[eE][+-]?\d+(?![0-9]*[A-Za-z@%]))?|\?)")


def ordinates(line: str, last: float | None) -> tuple[float, list[float | None], bool]:
    """Abscissa, ordinates (None where one is missing) and whether the line ends in difference form; ``last`` checks the first ordinate of the next line."""
    items = [(m[1], m[2]) for m in _ITEM.finditer(line.strip()) if m[0]]
    x = float(items[0][0].strip("+") + items[0][1] if items[0][0] in "+-" else items[0][1])
    out: list[float | None] = []
    step: float | None = None
    for mark, digits in items[1:]:
        if digits == "?":  # a missing ordinate keeps its place
            step = None
            out.append(None)
        elif mark in _DUP:
            for _ in range(int(f"{_DUP[mark]}{digits}") - 1):
                out.append(out[-1] + step if step is not None and out[-1] is not None else out[-1])
        elif mark in _DIF:
            d, sign = _DIF[mark]
            step = sign * float(f"{d}{digits}")
            out.append(((out[-1] if out else last) or 0.0) + step)
        elif mark in _SQZ:
            d, sign = _SQZ[mark]
            step = None
            out.append(sign * float(f"{d}{digits}"))
        elif digits:
            step = None
            out.append(float(mark + digits) if mark == "-" else float(digits))
    return x, out, step is not None


@dataclass
class JcampTable:
    """One table of a JCAMP-DX file with the labels that hold for it; of a page of n-tuples also the names of its two variables."""

    labels: dict[str, str]
    form: str
    lines: list[str]
    x: str = ""
    y: str = ""
    page: str = ""

    def variable(self, symbol: str, label: str) -> str:
        """Entry of a list of variables, by the place of the symbol."""
        symbols = [v.strip() for v in self.labels.get("SYMBOL", "").split(",")]
        values = [v.strip() for v in self.labels.get(label, "").split(",")]
        i = symbols.index(symbol) if symbol in symbols else -1
        return values[i] if 0 <= i < len(values) else ""

    def number(self, name: str, default: float | None, symbol: str = "", label: str = "") -> float | None:
        text = self.variable(symbol, label) if symbol else self.labels.get(name, "").split(",")[0]
        return float(text) if text.strip() else default

    @property
    def series(self) -> str:
        name = self.labels.get("DATATYPE", "")
        return " ".join(filter(None, (name or self.labels.get("NTUPLES", ""), self.variable(self.y, "VARNAME"), self.page))) if self.y else name


_VARIABLES = re.compile(r"\(\s*(\w)\s*(?:\+\+|,?)\s*\(?\s*(\w)\s*\.\.")


def jcamp_tables(text: str) -> Iterator[JcampTable]:
    """The tables of all blocks and pages in order; a new title opens a block that keeps no labels but those around it."""
    outer: list[dict[str, str]] = []
    labels: dict[str, str] = {}
    table: JcampTable | None = None
    page = ""
    for line in text.splitlines():
        line = line.split("$$")[0].rstrip()
        if not line.startswith("##"):
            if table is not None and line.strip():
                table.lines.append(line)
            continue
        if table is not None:
            yield table
            table = None
        name, _, value = line[2:].partition("=")
        name, value = re.sub(r"[\s\-/_]", "", name).upper(), value.strip()
        if name == "TITLE" and labels:
            outer.append(labels)
            labels = {k: v for k, v in labels.items() if k in ("JCAMPDX", "DATATYPE")}
        elif name == "END" and outer:
            labels = outer.pop()
        elif name == "PAGE":
            page = value
        elif name == "ENDNTUPLES":
            page = ""
        labels[name] = value
        if name in ("XYDATA", "XYPOINTS", "PEAKTABLE", "DATATABLE"):
            form = value.upper()
            found = _VARIABLES.search(form) if "SYMBOL" in labels else None
            table = JcampTable(dict(labels), form, [], found[1] if found else "", found[2] if found else "", page)
    if table is not None:
        yield table


def _scaled(table: JcampTable, points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hertz of magnetic resonance as parts per million, moved to the shift reference if one is named."""
    units = (table.variable(table.x, "UNITS") if table.x else table.labels.get("XUNITS", "")).upper()
    if units != "HZ" or "NMR" not in (table.labels.get("DATATYPE", "") + table.labels.get("NTUPLES", "")).upper():
        return points
    frequency = table.number(".OBSERVEFREQUENCY", None)
    if not frequency or frequency <= 0:
        raise ValueError("hertz without an observe frequency")
    points = [(x / frequency, y) for x, y in points]
    reference = [v.strip(" ()") for v in table.labels.get(".SHIFTREFERENCE", "").split(",")]
    if len(reference) == 4 and reference[2].isdigit() and 0 < int(reference[2]) <= len(points):
        move = float(reference[3]) - points[int(reference[2]) - 1][0]
        points = [(x + move, y) for x, y in points]
    return points


def _decoded(table: JcampTable) -> list[tuple[float, float | None]]:
    """Points of a table, a missing ordinate as None."""
    fx = table.number("XFACTOR", 1.0, table.x, "FACTOR")
    fy = table.number("YFACTOR", 1.0, table.y, "FACTOR")
    if "++" not in table.form:
        pairs = [[p for p in re.split(r"[,\s;]+", pair) if p] for line in table.lines for pair in re.split(r"[;\s]+(?=[^,]*,)", line.strip())]
        return [(float(p[0]) * fx, float(p[1]) * fy) for p in pairs if len(p) >= 2]
    ys: list[float | None] = []
    places: list[tuple[int, float]] = []  # the lines' abscissas and the ordinates that stand at them
    checked = False
    for line in table.lines:
        x, got, differs = ordinates(line, ys[-1] if ys else None)
        repeats = bool(checked and ys and got)
        if got:
            places.append((len(ys) - repeats, x * fx))
        ys += got[1:] if repeats else got  # after differences a line repeats the last ordinate as a check
        checked = differs
    if not ys:
        return []
    first = table.number("FIRSTX", places[0][1], table.x, "FIRST")
    last = table.number("LASTX", None, table.x, "LAST")
    if last is not None:
        step = (last - first) / max(len(ys) - 1, 1)
    elif len(places) > 1 and places[-1][0] > places[0][0]:
        step = (places[-1][1] - places[0][1]) / (places[-1][0] - places[0][0])
    else:
        step = table.number("DELTAX", 1.0)
    return [(first + i * step, None if y is None else y * fy) for i, y in enumerate(ys)]


def jcamp(text: str) -> Iterator[tuple[str, float, float]]:
    """Points of all tables of a JCAMP-DX file: pages of n-tuples are series of their own, as are further blocks of one name, which are numbered."""
    seen: dict[str, int] = {}
    for table in jcamp_tables(text):
        points = _scaled(table, _decoded(table))
        if not points:
            continue
        n = seen[table.series] = seen.get(table.series, 0) + 1
        name = table.series if n == 1 else f"{table.series} {n}"
        for x, y in points:
            if y is not None:
                yield name, x, y


def inflated(raw: bytes, form: int = zlib.MAX_WBITS) -> bytes:
    """All streams that stand one behind the other."""
    out = b""
    while raw:
        d = zlib.decompressobj(form)
        out += d.decompress(raw, MAX_INFLATED - len(out) + 1)
        if len(out) > MAX_INFLATED:
            raise ValueError("too large when inflated")
        if not d.eof:
            raise ValueError("the stream breaks off")
        raw = d.unused_data.lstrip(b"\0")
    return out


def _floats(text: str, bits: int, packed: bool, order: str) -> list[float]:
    raw = base64.b64decode(text or "")
    raw = inflated(raw) if packed else raw
    kind = "d" if bits == 64 else "f"
    return list(struct.unpack(f"{order}{len(raw) // (bits // 8)}{kind}", raw[: len(raw) // (bits // 8) * (bits // 8)]))


def mass_spectrum(raw: bytes) -> Iterator[tuple[str, float, float]]:
    """Points of every spectrum of an mzML or mzXML file; the series is the spectrum's number and polarity."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    n = 0
    for _, e in ElementTree.iterparse(io.BytesIO(raw)):
        if tag(e) == "spectrum":
            n += 1
            arrays: dict[str, list[float]] = {}
            names = {c.get("name", "") for c in e.iter() if tag(c) == "cvParam"}
            sign = "-" if "negative scan" in names else "+" if "positive scan" in names else ""
            for a in (x for x in e.iter() if tag(x) == "binaryDataArray"):
                about = {c.get("name", "") for c in a if tag(c) == "cvParam"}
                if any("Numpress" in x for x in about):
                    raise ValueError("Numpress isn't supported")
                data = next((x.text or "" for x in a if tag(x) == "binary"), "")
                arrays["x" if "m/z array" in about else "y"] = _floats(data, 64 if "64-bit float" in about else 32, "zlib compression" in about, "<")
            x, y = arrays.get("x", []), arrays.get("y", [])
            if len(x) != len(y):
                raise ValueError(f"{len(x)} masses and {len(y)} intensities")
            for p in sorted(zip(x, y)):
                yield f"{n}{sign}", *p
            e.clear()
        elif tag(e) == "scan":
            n += 1
            for a in (x for x in e if tag(x) == "peaks"):
                v = _floats(a.text or "", int(a.get("precision", "32")), a.get("compressionType") == "zlib", ">")
                if len(v) % 2:
                    raise ValueError("odd number of values")
                for p in sorted(zip(v[::2], v[1::2])):
                    yield f"{n}{e.get('polarity', '')}", *p
            e.clear()


def members(path: str, raw: bytes) -> Iterator[tuple[str, bytes | Exception]]:
    """A file, or the members of a ZIP archive; those that can't be read or don't pass the guards come as an error."""
    if not raw.startswith(b"PK\x03\x04"):
        yield path, inflated(raw, zlib.MAX_WBITS | 16) if raw.startswith(b"\x1f\x8b") else raw
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_INFLATED:
            raise ValueError("archive too large")
        for i in infos:
            name = f"{path}!{i.filename}"
            if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or i.file_size > 1e6 and i.file_size > MAX_RATIO * max(i.compress_size, 1):
                yield name, ValueError(f"unsafe member {i.filename}")
                continue
            try:
                data: bytes | Exception = z.read(i)
            except Exception as e:  # a broken member leaves the others
                data = e
            yield name, data


def points_of(data: bytes) -> Iterator[tuple[str, float, float]]:
    """(series, x, y) of a file in any of the forms."""
    head = data[:2000].lstrip()
    if head.startswith(b"<") and (b"mzML" in head or b"mzXML" in head or b"<indexedmzML" in head):
        return mass_spectrum(data)
    text = decoded(data)
    return jcamp(text) if text.lstrip().startswith("##") else delimited(text)


#: Points in one batch of a task's result.
POINTS_AT_ONCE = 100_000


def _rows(path: str, raw: bytes) -> Iterator[tuple[str, str | None, float | None, float | None, str | None]]:
    """(path, series, x, y, error) of a file or an archive's members; what can't be read gives a row with its error after the points before it."""
    try:
        for name, data in members(path, raw):
            some = False
            try:
                if isinstance(data, Exception):
                    raise data
                for series, x, y in points_of(data):
                    some = True
                    yield name, series, x, y, None
                if not some:
                    yield name, None, None, None, "no points"
            except Exception as e:
                yield name, None, None, None, f"{type(e).__name__}: {e}"
    except Exception as e:  # any broken file is reported as a row
        yield path, None, None, None, f"{type(e).__name__}: {e}"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"]):
            rows = _rows(path, bytes(raw))
            while some := list(islice(rows, POINTS_AT_ONCE)):
                out = pd.DataFrame(some, columns=["path", "series", "x", "y", "error"]).astype({"x": float, "y": float})
                out.insert(1, "sample_id", None)
                yield out


def read_points(spark: SparkSession, path: str, pattern: str = "*", largest: int = 50_000_000) -> DataFrame:
    """(path, sample_id, series, x, y, error) of all files below a path, found and read by Spark; a file of over ``largest`` bytes gives a row with its error."""
    let_workers_import(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    points = files.where(F.col("length") <= largest).select("path", "content").mapInPandas(_parse, POINTS)
    nothing = lambda kind: F.lit(None).cast(kind)
    refused = files.where(F.col("length") > largest).select("path", nothing("string").alias("sample_id"), nothing("string").alias("series"), nothing("double").alias("x"), nothing("double").alias("y"), F.lit(f"larger than {largest} bytes").alias("error"))
    return points.unionByName(refused).withColumn("sample_id", sample_id(F.col("path")))


def screened(points: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Descriptors of each readable sample joined with its number of points; samples that can't be read keep their error."""
    state = points.groupBy("sample_id").agg(F.count("x").alias("n_points"), F.max("error").alias("error"))
    return state.join(describe(points.where("error IS NULL")), "sample_id", "left")


# Sinks


def write_table(df: DataFrame, path: str, form: str = "parquet", partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).format(form).options(**({"header": True} if form == "csv" else {})).save(path)


def mztab_lines(features: DataFrame, key: str, formula: str, mass: str, intensity: str) -> DataFrame:
    """Lines of an mzTab-M small-molecule section, each with its place."""
    head = ["MTD\tmzTab-version\t2.0.0-M", "SMH\tSML_ID\tchemical_formula\texp_mass_to_charge\tabundance"]
    first = features.sparkSession.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)], "place long, line string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rows = features.select(F.col(key).cast("long").alias("place"), F.concat_ws("\t", F.lit("SML"), text(key), text(formula), text(mass), text(intensity)).alias("line"))
    return first.unionByName(rows)
