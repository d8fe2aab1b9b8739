import base64
import gzip
import io
import struct
import zipfile
import zlib

import pytest

from pyspark.sql import functions as F

from spectrion.sources import formats


def test_jcamp_forms_agree():
    head = "##TITLE=t\n##DATA TYPE=INFRARED SPECTRUM\n##XFACTOR=1\n##YFACTOR=0.5\n##FIRSTX=10\n##LASTX=17\n##NPOINTS=8\n"
    plain = head + "##XYDATA=(X++(Y..Y))\n10 1 2 3 3\n14 2 0 -1 -1\n##END=\n"
    squeezed = head + "##XYDATA=(X++(Y..Y))\n10A B C C\n14 B@aa\n##END=\n"
    packed = head + "##XYDATA=(X++(Y..Y))\n10AJJ%jkjS%\n##END=\n"
    pairs = head.replace("##YFACTOR=0.5", "##YFACTOR=1") + "##XYPOINTS=(XY..XY)\n10,0.5; 11,1\n12,1.5; 13,1.5; 14,1; 15,0\n16,-0.5; 17,-0.5\n##END=\n"
    expected = [(10.0 + i, v / 2) for i, v in enumerate([1, 2, 3, 3, 2, 0, -1, -1])]
    for text in (plain, squeezed, packed, pairs):
        assert [(x, y) for _, x, y in formats.jcamp(text)] == expected, text


def test_jcamp_missing_ordinates_and_abscissas():
    head = "##TITLE=t\n##XFACTOR=1\n##YFACTOR=1\n##FIRSTX=100\n##LASTX=105\n"
    assert [(x, y) for _, x, y in formats.jcamp(head + "##XYDATA=(X++(Y..Y))\n100 1 2 ? 4 5 6\n##END=\n")] == [(100, 1), (101, 2), (103, 4), (104, 5), (105, 6)]
    bare = "##TITLE=t\n##XFACTOR=2\n##YFACTOR=1\n"
    assert [(x, y) for _, x, y in formats.jcamp(bare + "##XYDATA=(X++(Y..Y))\n200 1 2\n202 3 4\n##END=\n")] == [(400, 1), (402, 2), (404, 3), (406, 4)]
    assert [(x, y) for _, x, y in formats.jcamp(bare + "##DELTAX=0.5\n##XYDATA=(X++(Y..Y))\n200 1 2\n##END=\n")] == [(400, 1), (400.5, 2)]


def test_broken_files_leave_the_others(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("good_nmr.csv", "1,2\n")
        f.writestr("bad_nmr.csv", "5,6 7,8 this member is broken later on\n")
        f.writestr("../up.csv", "1,2\n")
    raw = bytearray(z.getvalue())
    raw[raw.index(b"5,6 7,8")] ^= 1
    (tmp_path / "all.zip").write_bytes(bytes(raw))
    (tmp_path / "two.csv.gz").write_bytes(gzip.compress(b"1,2\n") + gzip.compress(b"3,4\n"))
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(b"1,2\n" * 99)[:-9])
    (tmp_path / "large.csv").write_text("1,2\n" * 400)
    rows = formats.read_points(spark, str(tmp_path), largest=1000).collect()
    state = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in rows if r["error"]}
    assert len(state) == 4 and "1000 bytes" in state["large.csv"] and state.keys() == {"all.zip!bad_nmr.csv", "up.csv", "cut.csv.gz", "large.csv"}
    assert sorted((r["x"], r["y"]) for r in rows if r["error"] is None) == [(1, 2), (1, 2), (3, 4)]


def test_mass_spectra():
    pack = lambda v, z=False: base64.b64encode(zlib.compress(struct.pack(f"<{len(v)}d", *v)) if z else struct.pack(f"<{len(v)}d", *v)).decode()
    array = lambda v, name, z: f'<binaryDataArray><cvParam name="64-bit float"/><cvParam name="{"zlib compression" if z else "no compression"}"/><cvParam name="{name}"/><binary>{pack(v, z)}</binary></binaryDataArray>'
    xml = '<mzML><run><spectrumList><spectrum><cvParam name="negative scan"/><binaryDataArrayList>' + array([200.0, 100.0], "m/z array", True) + array([5.0, 7.0], "intensity array", False) + "</binaryDataArrayList></spectrum></spectrumList></run></mzML>"
    assert list(formats.mass_spectrum(xml.encode())) == [("1-", 100.0, 7.0), ("1-", 200.0, 5.0)]
    peaks = base64.b64encode(struct.pack(">4f", 300.0, 1.0, 250.0, 2.0)).decode()
    old = f'<mzXML><msRun><scan polarity="+"><peaks precision="32">{peaks}</peaks></scan></msRun></mzXML>'
    assert list(formats.mass_spectrum(old.encode())) == [("1+", 250.0, 2.0), ("1+", 300.0, 1.0)]


def test_read_points(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A_uv.csv").write_text("Wavelength;Absorbance\n250,5;0,5\n251,5;0,4\n")
    (tmp_path / "in" / "B.txt").write_bytes("# c\nx\ty\tz\n1\t2\t3\n4\t5\t\n".encode())
    (tmp_path / "in" / "bad.csv").write_text("no numbers here")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("C_nmr.csv", "1,2\n3,4\n")
    (tmp_path / "in" / "all.zip").write_bytes(z.getvalue())
    rows = formats.read_points(spark, str(tmp_path / "in")).collect()
    got = {(r["sample_id"], r["series"], r["x"], r["y"]) for r in rows if r["error"] is None}
    assert got == {("A", "Absorbance", 250.5, 0.5), ("A", "Absorbance", 251.5, 0.4), ("B", "y", 1, 2), ("B", "z", 1, 3), ("B", "y", 4, 5), ("C", "y1", 1, 2), ("C", "y1", 3, 4)}
    assert [r["error"] for r in rows if r["error"]] == ["no points"]
    done = formats.screened(formats.read_points(spark, str(tmp_path / "in")), lambda p: p.groupBy("sample_id").agg(F.max("y").alias("top")))
    assert {r["sample_id"]: r["top"] for r in done.collect()}["B"] == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "C2H6", 30.0, None)], "k long, f string, m double, i double")
    lines = [r["line"] for r in formats.mztab_lines(df, "k", "f", "m", "i").orderBy("place").collect()]
    assert lines[0].startswith("MTD") and lines[-1] == "SML\t1\tC2H6\t30.0\tnull"
    formats.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 1


NTUPLES = """##TITLE=spectrum
##JCAMP-DX=5.01
##DATA TYPE=NMR SPECTRUM
##DATA CLASS=NTUPLES
##.OBSERVE FREQUENCY=100.0
##NTUPLES=NMR SPECTRUM
##VAR_NAME=FREQUENCY, SPECTRUM/REAL, SPECTRUM/IMAG, PAGE NUMBER
##SYMBOL=X, R, I, N
##FACTOR=0.5, 1, 10, 1
##FIRST=2000, 1, 1, 1
##LAST=500, 4, 4, 2
##UNITS=HZ, ARBITRARY UNITS, ARBITRARY UNITS,
##PAGE=N=1
##DATA TABLE=(X++(R..R)), XYDATA
4000 1 2 3 4
##PAGE=N=2
##DATA TABLE=(X++(I..I)), XYDATA
4000 5 6
2000 7 ?
##END NTUPLES=NMR SPECTRUM
##END=
"""

SHIFTS = """##TITLE=13C
##JCAMP-DX=5.01
##DATA TYPE=NMR SPECTRUM
##.OBSERVE FREQUENCY=100.0
##XUNITS=HZ
##FIRSTX=20000
##LASTX=0
##NPOINTS=9
{extra}##XYDATA=(X++(Y..Y))
20000A0JJJ
12500A3jjj
5000A0jj
##END=
"""


def test_jcamp_pages_and_shifts():
    pages = list(formats.jcamp(NTUPLES))
    assert pages[:4] == [("NMR SPECTRUM SPECTRUM/REAL N=1", x, y) for x, y in zip((20.0, 15.0, 10.0, 5.0), (1.0, 2.0, 3.0, 4.0))]
    assert pages[4:] == [("NMR SPECTRUM SPECTRUM/IMAG N=2", x, y) for x, y in zip((20.0, 15.0, 10.0), (50.0, 60.0, 70.0))]
    plain = [(x, y) for _, x, y in formats.jcamp(SHIFTS.format(extra=""))]
    assert plain == [(200.0 - 25 * i, y) for i, y in enumerate([10, 11, 12, 13, 12, 11, 10, 9, 8])]
    moved = [x for _, x, _ in formats.jcamp(SHIFTS.format(extra="##.SHIFT REFERENCE=(INTERNAL, TMS, 9, 0.5)\n"))]
    assert moved == [200.5 - 25 * i for i in range(9)]
    with pytest.raises(ValueError, match="observe frequency"):
        list(formats.jcamp(SHIFTS.format(extra="").replace("##.OBSERVE FREQUENCY=100.0\n", "")))
    linked = "##TITLE=all\n##JCAMP-DX=5\n##DATA TYPE=LINK\n##BLOCKS=2\n" + "".join(f"##TITLE={i}\n##DATA TYPE=INFRARED SPECTRUM\n##XYPOINTS=(XY..XY)\n{i},1; {i + 1},2\n##END=\n" for i in (10, 20)) + "##END=\n"
    assert list(formats.jcamp(linked)) == [("INFRARED SPECTRUM", 10, 1), ("INFRARED SPECTRUM", 11, 2), ("INFRARED SPECTRUM 2", 20, 1), ("INFRARED SPECTRUM 2", 21, 2)]
