"""A folder of instrument files in, one table of descriptors out: as a batch, or as a stream of files.

Files of all instruments go through one pass: they are unpacked, their kind is
told from name, header and numbers (``detect``), and their numbers are written
as points, their tables as cells, in the shared work folder. Each instrument's
descriptors are then aggregates over its own points only. Results are long
(path, sample_id, descriptor, value), so files with any columns fit one table.

A file that can't be read, is too large or gives no descriptor has its row in
the summary with a status and a note; none fails the job.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spectrion.functions import chem
from spectrion.operators import assign, fusion, relational, spectra
from spectrion.session import let_workers_import

from . import detect, tables
from .formats import POINTS_AT_ONCE, members, points_of

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
UNPACKED = "path string, source string, modified timestamp, content binary, error string"
POINTS = "path string, sample_id string, modality string, form string, x_name string, series string, place int, x double, y double, error string"
CELLS = ["path", "sample_id", "modality", "kind", "form", "row", "at", "cells"]
ELEMENT_ROLES = ["sample_id", "c", "h", "n", "s", "o", "ash", "moisture", "basis", "sample_type"]

#: Largest file that is opened, in bytes.
LARGEST = 50_000_000

#: Default calibration of size exclusion, log10 of the mass by powers of the volume, and the volumes between which it holds.
SEC_CALIBRATION = [12.849232966762662, -2.544666616696549, 0.2793766257806849, -0.012136630188668177]
SEC_VOLUMES = (5.85, 10.25)


@dataclass
class Screened:
    """Long descriptors (path, sample_id, label, descriptor, value) and one summary row per file; ``files`` is the summary without what descriptors tell."""

    descriptors: DataFrame
    summary: DataFrame
    files: DataFrame | None = None


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "source", "modified", "content", "error"]
    for batch in batches:
        for path, modified, raw in zip(batch["path"], batch["modificationTime"], batch["content"]):
            try:
                for name, data in members(path, bytes(raw)):
                    bad = f"{type(data).__name__}: {data}" if isinstance(data, Exception) else None
                    yield pd.DataFrame([(name, path, modified, None if bad else data, bad)], columns=columns)
            except Exception as e:  # a broken archive is one row
                yield pd.DataFrame([(path, path, modified, None, f"{type(e).__name__}: {e}")], columns=columns)


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, sample, modality, form, x_name, raw in batch.itertuples(index=False):
            rows = _rows(path, sample, modality, form, x_name, raw)
            while some := list(islice(rows, POINTS_AT_ONCE)):
                yield pd.DataFrame(some, columns=["path", "sample_id", "modality", "form", "x_name", "series", "place", "x", "y", "error"]).astype({"x": float, "y": float, "place": "Int32"})


def _rows(path, sample, modality, form, x_name, raw) -> Iterator[tuple]:
    head = (path, sample, modality, form, x_name)
    seen: dict[str, int] = {}
    try:
        for series, x, y in points_of(bytes(raw)):
            yield *head, series, seen.setdefault(series, len(seen)), x, y, None
        if not seen:
            yield *head, None, None, None, None, "no points"
    except Exception as e:  # what comes before the fault stays
        yield *head, None, None, None, None, f"{type(e).__name__}: {e}"


def files_below(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def unpacked(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(path, source, modified, content, error) of files and the members of archives among them."""
    let_workers_import(files.sparkSession)
    fit = files.where(F.col("length") <= largest).select("path", "modificationTime", "content").mapInPandas(_unpack, UNPACKED)
    refused = files.where(F.col("length") > largest).select("path", F.col("path").alias("source"), F.col("modificationTime").alias("modified"), F.lit(None).cast("binary").alias("content"), F.lit(f"larger than {largest} bytes").alias("error"))
    return fit.unionByName(refused)


def told(files: DataFrame) -> DataFrame:
    """Unpacked files with their modality, kind, form and sample."""
    found = detect.detected(files.withColumn("text", detect.decoded(F.col("content"))))
    thermal = F.when(F.col("modality") == "Thermal", detect.thermal_form(F.col("header"), F.col("path")))
    readable = F.col("error").isNull()
    kind = F.when(readable & (thermal == "pyrolysis"), "table").otherwise(F.col("kind"))
    return found.withColumn("form", thermal).withColumn("kind", kind).withColumn("sample_id", detect.file_sample(F.col("path")))


def _places(header: Column) -> Column:
    """Where in a table's lines, counted from zero, its parts are; told from the header once for the whole file.

    ``sample`` and ``label``: the first such columns; ``others``: columns that
    may be descriptors, with their names; ``elements``: the last column of each
    part of an elemental analysis; ``compound`` and ``area`` of a pyrolysis table.
    """
    heads = F.transform(header, lambda h, i: F.struct(i.alias("place"), h.alias("name"), detect.column_name(h).alias("plain"), F.lower(F.trim(h)).alias("whole")))

    def made(heads: Column) -> Column:
        first = lambda hit: F.get(F.filter(heads, hit), F.lit(0))["place"]
        named = lambda words: lambda h: h["plain"].isin(words)
        has = lambda words: lambda h: h["whole"].rlike("|".join(words))
        dotted = lambda words: has([w.replace(".", r"\.") for w in words])
        sample = first(named(detect.SAMPLE_NAMES))
        others = F.transform(F.filter(heads, lambda h: ~h["place"].eqNullSafe(sample) & ~h["plain"].isin(detect.NO_DESCRIPTORS)), lambda h: F.struct(h["place"], h["name"]))
        roles = F.transform(heads, lambda h: F.struct(h["place"], _element_role(h).alias("role")))
        last = lambda r: F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.filter(roles, lambda h: h["role"] == r), lambda h: h["place"])), -1)
        area = F.coalesce(first(dotted(tables.AREA_PARTS)), first(dotted(tables.INTENSITY_PARTS)))
        return F.struct(sample.alias("sample"), first(named(detect.CLASS_NAMES)).alias("label"), others.alias("others"), F.struct(*[last(r).alias(r) for r in ELEMENT_ROLES]).alias("elements"), first(dotted(tables.COMPOUND_PARTS)).alias("compound"), area.alias("area"))

    return F.transform(F.array(heads), made)[0]


def _element_role(head: Column) -> Column:
    """What a column of an elemental analysis holds, or null."""
    role = F.when(head["plain"].isin(detect.SAMPLE_NAMES) | head["whole"].isin(tables.ELEMENT_NAMES["sample_id"]), "sample_id")
    for e, words in detect.ELEMENT_NAMES.items():
        role = role.when(head["plain"].isin(words), e.lower())
    for r, words in tables.ELEMENT_PARTS.items():
        role = role.when(head["whole"].rlike("|".join(words)), r)
    return role.when(head["whole"].isin(tables.ELEMENT_NAMES["basis"]), "basis")


def cells(found: DataFrame) -> DataFrame:
    """CELLS of tables of samples, a row for each line, with the places of the table's parts."""
    files = found.where("kind IN ('table', 'descriptor_matrix')").select("path", "sample_id", "modality", "kind", "form", _places(F.col("header")).alias("at"), detect.lines_of(F.col("text")).alias("lines"))
    lines = files.select("path", "sample_id", "modality", "kind", "form", "at", F.posexplode("lines").alias("row", "line")).where("row > 0")
    return lines.withColumn("cells", detect.cells_of(F.col("line"), quoted=True)).select(*CELLS)


def _long(wide: DataFrame, prefix: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["path", "sample_id"]
    numbers = [c for c, t in wide.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    return fusion.unpivot(wide, keys, numbers).withColumn("descriptor", F.concat(F.lit(prefix), "descriptor"))


def _signal(points: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """The points of one series a file: the first with one of the parts in its name, else the first."""
    hit = F.lower("series").rlike("|".join(parts)) if parts else F.lit(True)
    best = points.groupBy("path").agg(F.min(F.struct((~F.coalesce(hit, F.lit(False))).alias("other"), "place")).alias("_b"))
    return points.join(best, "path").where(F.col("place") == F.col("_b.place")).select("path", "sample_id", "x_name", "x", "y")


def _uv(points: DataFrame) -> DataFrame:
    return _long(spectra.uv_descriptors(_signal(points), ["path", "sample_id"], "x", "y"), "UV_")


def _ftir(points: DataFrame) -> DataFrame:
    return _long(spectra.ftir_descriptors(_signal(points), ["path", "sample_id"], "x", "y"), "FTIR_")


def _nmr(points: DataFrame) -> DataFrame:
    return _long(spectra.nmr_descriptors(_signal(points), ["path", "sample_id"], "x", "y"), "NMR_")


def _tga(points: DataFrame) -> DataFrame:
    chosen = _signal(points.where("form = 'thermogram'"), tables.MASS_PARTS).select("path", "sample_id", F.col("x").alias("temp"), F.col("y").alias("mass"))
    return _long(spectra.tga_descriptors(tables.thermogram(chosen, ["path", "sample_id"]), ["path", "sample_id"], "temperature", "mass"), "TGA_")


def _eem(points: DataFrame) -> DataFrame:
    return _long(spectra.eem_descriptors(tables.excitation_emission(points), ["path", "sample_id"], "ex", "em", "value"), "EEM_")


def _sec(points: DataFrame, calibration: list[float], volumes: tuple[float, float], flow: float) -> DataFrame:
    chosen = _signal(points, tables.SIGNAL_PARTS)
    by_time = F.lower("x_name").rlike("|".join(tables.TIME_PARTS)) & ~F.lower("x_name").rlike("|".join(tables.VOLUME_PARTS))
    placed = chosen.withColumn("volume", F.when(F.coalesce(by_time, F.lit(False)), F.col("x") * flow).otherwise(F.col("x")))
    inside = placed.where(F.col("volume").between(*volumes)).withColumn("signal", F.greatest("y", F.lit(0.0)))
    massed = inside.withColumn("molar_mass", spectra.sec_masses(inside, "volume", calibration))
    keys = ["path", "sample_id"]
    moments = relational.molar_mass_moments(massed, keys, "signal", "molar_mass")
    return _long(moments, "SEC_").unionByName(_long(spectra.sec_fractions(massed, keys, "signal", "molar_mass"), "SEC_"))


def _fticr(points: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    peaks = _signal(points, tables.INTENSITY_PARTS).withColumn("peak", F.struct("path", "x"))
    found = assign.assigned(peaks, "peak", "x", bounds, ppm=2.5)
    hc, oc = F.col("h") / F.col("c"), F.col("o") / F.col("c")
    inside = found.where(oc.between(0, 1) & hc.between(0.2, 2.2))
    wide = relational.sample_descriptors(inside, ["path", "sample_id"], relational.grid_cell(oc, hc), chem.formula_mass(F.col("formula")), F.col("y"), {"H_C": hc, "O_C": oc})
    return _long(wide, "FTICR_")


def _numbered(cell: Column) -> Column:
    """A cell as a finite number; commas are decimal where they can't part thousands."""
    plain = F.when(cell.rlike(r"^\s*[+-]?[0-9]+,[0-9]+([eE][+-]?[0-9]+)?\s*$"), F.replace(cell, F.lit(","), F.lit("."))).otherwise(cell)
    return fusion.clean_number(plain.try_cast("double"))


def _cell(place: str) -> Column:
    return F.get("cells", F.col(place))


def _rows_as_samples(rows: DataFrame) -> DataFrame:
    """(path, sample_id, label, descriptor, value) of tables whose rows are samples."""
    named = rows.select("path", F.trim(_cell("at.sample")).alias("sample_id"), F.nullif(F.trim(_cell("at.label")), F.lit("")).alias("label"), "at.others", "cells").where("sample_id <> ''")
    each = named.select("path", "sample_id", "label", "cells", F.explode("others").alias("o"))
    return each.select("path", "sample_id", "label", F.col("o.name").alias("descriptor"), _numbered(_cell("o.place")).alias("value")).where("value IS NOT NULL")


def _elements(rows: DataFrame) -> DataFrame:
    """(path, sample_id, label, descriptor, value) of elemental analyses under any header."""
    known = rows.where(F.coalesce(*[F.col(f"at.elements.{r}") for r in ELEMENT_ROLES]).isNotNull())
    texts = ("sample_id", "basis", "sample_type")
    cell = {r: _cell(f"at.elements.{r}") if r in texts else _numbered(_cell(f"at.elements.{r}")).cast("string") for r in ELEMENT_ROLES}
    wide = known.select("path", F.col("sample_id").alias("file_sample"), "row", *[c.alias(r) for r, c in cell.items()])
    wide = wide.withColumn("sample_id", F.coalesce(F.nullif(F.trim("sample_id"), F.lit("")), F.col("file_sample"))).withColumnRenamed("sample_type", "type")
    # one column carries the path through the resolver, which names its own
    tied = wide.withColumn("sample_id", F.concat(F.length("path").cast("string"), F.lit(":"), "path", "sample_id")).select(*[c for c in wide.columns if c not in ("path", "file_sample", "row")])
    made = spectra.elemental_descriptors(tables.elemental(tied))
    # Names of the descriptors.
    out = {
        "C_pct": "c", "H_pct": "h", "N_pct": "n", "S_pct": "s", "O_pct": "o", "H_C": "h_c", "O_C": "o_c", "N_C": "n_c", "S_C": "s_c", "NOSC": "nosc", "AI_bulk": "ai", "Q_combustion": "hhv_mendeleev",
    }
    key = F.col("sample_id")
    start = F.locate(":", key) + 1
    end = start + F.substring_index(key, ":", 1).cast("int")
    named = made.select(F.substr(key, start, end - start).alias("path"), F.substr(key, end).alias("sample_id"), *[F.col(c).cast("double").alias(n) for n, c in out.items()])
    return _long(named, "Elem_").withColumn("label", F.lit(None).cast("string"))


def _pyrolysis(rows: DataFrame) -> DataFrame:
    """Shares of the classes of pyrolysis products, in percent of all areas."""
    peaks = rows.select("path", "sample_id", _cell("at.compound").alias("named"), _cell("at.area").alias("area"))
    named = F.when(~F.lower("named").isin("", "none", "nan"), F.col("named"))
    classed = peaks.select("path", "sample_id", tables.pyrolysis_class(named).alias("class"), F.greatest(F.coalesce(_numbered(F.col("area")), F.lit(1.0)), F.lit(0.0)).alias("area"))
    sums = classed.groupBy("path", "sample_id", "class").agg(F.sum("area").alias("area"))
    total = sums.groupBy("path").agg(F.sum("area").alias("total"))
    return sums.join(total, "path").where("total > 0").select("path", "sample_id", F.concat(F.lit("Py_"), "class").alias("descriptor"), (100 * F.col("area") / F.col("total")).alias("value"))


def screened(files: DataFrame, work: str, *, largest: int = LARGEST, bounds: dict[str, tuple[int, int]] = assign.BOUNDS, calibration: list[float] = SEC_CALIBRATION, volumes: tuple[float, float] = SEC_VOLUMES, flow: float = 0.5) -> Screened:
    """Descriptors and summary of files (path, modificationTime, length, content); ``work`` is a folder that driver and executors share.

    Points, cells and states of all files are written there once, apart by
    instrument, and are the caller's to delete. Descriptors are worked out from
    these when they are asked for, and only the ones that are.
    """
    spark = files.sparkSession
    found = told(unpacked(files, largest))
    at = posixpath.join(work, uuid.uuid4().hex)

    def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    found = kept(found, "files")
    spectral = found.where("error IS NULL AND kind = 'spectrum'").select("path", "sample_id", "modality", "form", F.get("header", F.lit(0)).alias("x_name"), "content")
    points = kept(spectral.mapInPandas(_points, POINTS), "points", "modality")
    rows = kept(cells(found.where("error IS NULL")), "cells", "modality")
    good = points.where("error IS NULL")
    there = {(r["modality"], r["kind"]) for r in found.where("error IS NULL").select("modality", "kind").distinct().collect()}  # instruments times kinds
    spectra_of = {
        "UV-Vis": _uv, "FTIR": _ftir, "NMR": _nmr, "Thermal": _tga, "EEM-PARAFAC": _eem, "SEC/GPC": lambda p: _sec(p, calibration, volumes, flow), "FT-ICR MS": lambda p: _fticr(p, bounds),
    }
    tables_of = {"Thermal": _pyrolysis, "Elemental": _elements, "General / CSV": _rows_as_samples}
    columns = ["path", "sample_id", "label", "descriptor", "value"]
    long = [describe(good.where(F.col("modality") == m)) for m, describe in spectra_of.items() if (m, "spectrum") in there]
    long += [describe(rows.where((F.col("modality") == m) & (F.col("kind") == "table"))) for m, describe in tables_of.items() if (m, "table") in there]
    if any(kind == "descriptor_matrix" for _, kind in there):
        long.append(_rows_as_samples(rows.where("kind = 'descriptor_matrix'")))
    none = spark.createDataFrame([], "path string, sample_id string, label string, descriptor string, value double")
    labelled = [p if "label" in p.columns else p.withColumn("label", F.lit(None).cast("string")) for p in long]
    descriptors = reduce(DataFrame.unionByName, [p.select(columns) for p in labelled], none)
    n_points = points.groupBy("path").agg(F.count("x").alias("n_points"), F.max("error").alias("fault"))
    n_rows = rows.groupBy("path").agg(F.max("row").alias("n_rows"))
    states = found.drop("content", "text", "header").join(n_points, "path", "left").join(n_rows, "path", "left")
    return Screened(descriptors, summarized(states, descriptors), states)


def summarized(files: DataFrame, descriptors: DataFrame) -> DataFrame:
    """One summary row per file of ``Screened.files``."""
    n_found = descriptors.groupBy("path").agg(F.countDistinct("descriptor").alias("n_descriptors"), F.countDistinct("sample_id").alias("n_samples"))
    joined = files.join(n_found, "path", "left")
    error = F.coalesce("error", "fault")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("n_descriptors") > 0, "success").when(F.col("fault").isNotNull() & (F.col("fault") != "no points"), "error").otherwise("warning")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select(
        "path", "source", "modified", "sample_id", "modality", "kind", "confidence", "reason", status.alias("status"),
        zero(F.coalesce("n_points", F.col("n_rows").cast("long"))).alias("n_points"), zero(F.col("n_descriptors")).alias("n_descriptors"), zero(F.col("n_samples")).alias("n_samples"), error.alias("note"),
    )


def fused(descriptors: DataFrame, order: str = "path", most: int = 10_000) -> DataFrame:
    """One wide row per sample with its class: the last value of each descriptor by ``order``; what wasn't measured is null.

    A wide table has a column per descriptor, so their names go through the
    driver; more than ``most`` are an error.
    """
    names = [r[0] for r in descriptors.select("descriptor").distinct().orderBy("descriptor").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} descriptors")
    labels = descriptors.groupBy("sample_id").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col(order))).alias("class_target"))
    last = fusion.upsert(descriptors, ["sample_id"], order)
    return fusion.pivot(last, ["sample_id"], names).join(labels, "sample_id").select("sample_id", F.coalesce("class_target", detect.default_class(F.col("sample_id"))).alias("class_target"), *[f"`{n}`" for n in names])


# The same as a stream


def write_batch(files: DataFrame, batch: int, target: str, **options) -> None:
    """Screen one batch of files and write its results under the batch's number.

    A batch that is run again (its results were written but the stream
    stopped before it noted so) holds the same files and replaces what it
    wrote. The summary comes last, so a batch counts only when it is whole.
    """
    spark = files.sparkSession
    work = f"{target}/work/{batch}"
    made = screened(files, work, **options)
    made.descriptors.write.mode("overwrite").parquet(f"{target}/descriptors/batch={batch}")
    written = spark.read.schema(made.descriptors.schema).parquet(f"{target}/descriptors/batch={batch}")
    summarized(made.files, written).write.mode("overwrite").parquet(f"{target}/files/batch={batch}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(work)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stream(spark: SparkSession, source: str, target: str, *, pattern: str = "*", files_at_once: int = 1000, forever: bool = False, **options) -> StreamingQuery:
    """Screen files as they come to ``source``; ``target`` gets results by batch and the stream's checkpoint."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).load(source)
    writer = files.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, target, **options)).option("checkpointLocation", f"{target}/checkpoint")
    return (writer.trigger(processingTime="1 minute") if forever else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, target: str) -> Screened:
    """What all whole batches hold by now: a sample's descriptor has the value of the batch that came last, in it of the file modified last."""
    summary = spark.read.option("basePath", f"{target}/files").parquet(f"{target}/files")
    done = summary.select("path", "batch", "modified")
    long = spark.read.option("basePath", f"{target}/descriptors").parquet(f"{target}/descriptors").join(done, ["path", "batch"])
    order = F.struct("batch", "modified", "path")
    last = long.groupBy("sample_id", "descriptor").agg(F.max_by(F.struct("path", "label", "value"), order).alias("l"))
    return Screened(last.select("l.path", "sample_id", "l.label", "descriptor", "l.value"), summary)
