"""Detection of files and the folder screener, as a batch and as a stream that stops halfway."""

import gzip
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from spectrion.sources import detect, screening

SMALL = {"C": (4, 12), "H": (4, 24), "O": (1, 6), "N": (0, 0), "S": (0, 0)}


def labels(spark, files):
    df = spark.createDataFrame(files, "path string, text string")
    return {r.path: r for r in detect.detected(df).collect()}


def test_names_decide(spark):
    expected = {
        "Sample_01_fticr.csv": "FT-ICR MS", "Baikal_eem.csv": "EEM-PARAFAC", "Lake_uv.csv": "UV-Vis", "Soil_ftir.csv": "FTIR", "Spec_nmr.jdx": "NMR",
        "TGA_sample.txt": "Thermal", "Polymer_sec.csv": "SEC/GPC", "CHN_elemental.csv": "Elemental", "x.dx": "NMR",
    }
    got = labels(spark, [(n, "") for n in expected])
    assert {n: r.modality for n, r in got.items()} == expected
    assert got["CHN_elemental.csv"].kind == "table" and got["x.dx"].kind == "spectrum"


def test_contents_decide(spark):
    axis = lambda xs, ys=None: "\n".join(f"{x};{y}" for x, y in zip(xs, ys or [1.0] * len(xs)))
    cases = {
        "data1.csv": ("m/z,intensity,resol,s/n\n355.1234,50000,450000,12.5\n", "FT-ICR MS"),
        "spec.txt": ("Wavenumber,Absorbance\n4000,0.01\n3998,0.02\n", "FTIR"),
        "curve.csv": ("Temperature (C),Weight (%)\n25.0,100.0\n100.0,98.2\n", "Thermal"),
        "unknown.txt": ("##TITLE= 13C CPMAS\n##JCAMP-DX= 5.01\n##DATA TYPE= NMR SPECTRUM\n", "NMR"),
        "grid.csv": ("Em/Ex,240,250\n300,1,2\n", "EEM-PARAFAC"),
        "wide.csv": ("240,250,260,270,280\n1,2,3,4,5\n", "EEM-PARAFAC"),
        "sizes.csv": ("Elution volume (ml),RI\n5,1\n", "SEC/GPC"),
        "products.csv": ("RT,Compound,Area\n5,phenol,1\n", "Thermal"),
        "bare1.csv": (axis([400 + 50 * i for i in range(80)]), "FTIR"),
        "bare2.csv": (axis([25 + 20 * i for i in range(40)], [100 - i for i in range(40)]), "Thermal"),
        "bare3.csv": (axis([-10 + 6 * i for i in range(40)]), "NMR"),
        "bare4.csv": (axis([200 + 5 * i for i in range(90)]), "UV-Vis"),
        "bare5.csv": (axis([200 + i * i for i in range(45)]), "FT-ICR MS"),
        "bare6.csv": (axis([200 + 5 * i for i in range(19)]), "General / CSV"),
        "bulk.csv": ("Probe,Carbon wt%,H_pct,%N,S (%)\nA,50,5,1,0.1\n", "Elemental"),
        "matrix.csv": ("Sample_ID,Class,FTIR_arom,FTIR_ox,FTIR_lignin_idx\nS1,a,1,2,3\nS2,b,1,2,3\n", "FTIR"),
        "both.csv": ("Sample_ID,FTIR_a,FTIR_b,FTIR_c,NMR_a,NMR_b,NMR_c\nS1,1,2,3,4,5,6\n", "Multimodal"),
        "numbers.csv": ("id,FTIR_a,FTIR_b\n1,1,2\n2,1,2\n3,3,3\n", "General / CSV"),
        "other.csv": ("Sample;pH;depth\nS1;7;3\n", "General / CSV"),
        "empty.csv": ("", "Unknown"),
    }
    got = labels(spark, [(n, t) for n, (t, _) in cases.items()])
    assert {n: r.modality for n, r in got.items()} == {n: m for n, (_, m) in cases.items()}
    assert [got[n].kind for n in ("matrix.csv", "other.csv", "bare6.csv", "empty.csv", "bulk.csv")] == ["descriptor_matrix", "table", "unknown", "unknown", "table"]


def test_encodings(spark):
    raw = [("a", bytearray("Темп;Масса\n1;2".encode("cp1251"))), ("b", bytearray("﻿Длина волны;Поглощ".encode()))]
    got = {r.k: r.t for r in spark.createDataFrame(raw, "k string, c binary").select("k", detect.decoded(F.col("c")).alias("t")).collect()}
    assert got == {"a": "Темп;Масса\n1;2", "b": "Длина волны;Поглощ"}


FILES = {
    "Baikal_1_uv.csv": "wavelength,abs\n" + "\n".join(f"{w},{2.718281828 ** (-0.015 * (w - 200)):.9f}" for w in range(200, 701, 2)),
    "Baikal_1_elemental.csv": "Sample,C%,H%,N%,S%,Ash\nBaikal_1,48.5,4.5,2.0,0.5,1\nLignin_2,\"60,5\",5.5,0.1,0.2,1\n",
    "Lignin_2_tga.csv": "Temperature;Weight\n" + "\n".join(f"{t};{100 - (t - 20) / 10}" for t in range(20, 901, 10)),
    "Lignin_2_ftir.csv": "Wavenumber,Absorbance\n" + "\n".join(f"{x},{0.1 + (1600 < x < 1615) * 0.5 + (x % 7) * 1e-4}" for x in range(400, 4001, 2)),
    "pyro_products.csv": "RT,Compound,Area\n1,phenol,30\n2,guaiacol,60\n3,levoglucosan,10\n",
    "matrix.csv": "Sample_ID,Class,FTIR_lignin,NMR_ar,NMR_al\nBaikal_1,clean,0.5,0.25,7\nRiver_3,,1.5,,8\n",
    "notes.csv": "just,some,words\n1,2,3\n",
    "broken_nmr.jdx": "##TITLE=x\n##JCAMP-DX=5\n##XYDATA=(X++(Y..Y))\nQQ\n##END=\n",
    "masses_ms.csv": "m/z,intensity\n" + "\n".join(f"{m},{i + 1}" for i, m in enumerate([115.04007, 129.05572, 159.06628])) + "\n",
    "sizes_sec.csv": "Elution volume,RI\n" + "\n".join(f"{5 + 0.05 * i},{max(0, 1 - abs(i - 50) / 40)}" for i in range(120)),
}


def folder(path, names=None):
    os.makedirs(path, exist_ok=True)
    for n in names or FILES:
        with open(os.path.join(path, n), "w") as f:
            f.write(FILES[n])
    return str(path)


def values(made):
    return {(r.sample_id, r.descriptor): r.value for r in made.descriptors.collect()}


def test_folder_in_descriptors_out(spark, tmp_path):
    at = folder(tmp_path / "in")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("Zipped_uv.csv", FILES["Baikal_1_uv.csv"])
    (tmp_path / "in" / "more.zip").write_bytes(z.getvalue())
    (tmp_path / "in" / "bad_uv.csv.gz").write_bytes(gzip.compress(b"1,2\n" * 99)[:-9])
    (tmp_path / "in" / "large_uv.csv").write_text("1,2\n" * 50_000)
    made = screening.screened(screening.files_below(spark, at), str(tmp_path / "work"), largest=100_000, bounds=SMALL)
    state = {os.path.basename(r.path): r for r in made.summary.collect()}
    assert len(state) == len(FILES) + 3
    assert {n for n, r in state.items() if r.status == "error"} == {"bad_uv.csv.gz", "large_uv.csv", "broken_nmr.jdx"}
    assert {n for n, r in state.items() if r.status == "warning"} == {"notes.csv"}
    assert state["Baikal_1_uv.csv"].n_points == 251 and state["more.zip!Zipped_uv.csv"].modality == "UV-Vis"
    v = values(made)
    assert v["Baikal_1", "UV_s275"] == pytest.approx(0.015, rel=1e-4) and v["Zipped", "UV_s275"] == v["Baikal_1", "UV_s275"]
    assert v["Lignin_2", "Elem_C_pct"] == 60.5 and v["Baikal_1", "Elem_O_pct"] == pytest.approx(100 - 48.5 - 4.5 - 2 - 0.5 - 1)
    assert v["Lignin_2", "TGA_loss_moisture"] == pytest.approx(12.5) and v["Lignin_2", "TGA_loss_aliphatic"] == pytest.approx(20)
    assert v["pyro_products", "Py_guaiacyl"] == 60 and v["pyro_products", "Py_carbohydrate"] == 10
    assert v["River_3", "FTIR_lignin"] == 1.5 and ("River_3", "NMR_ar") not in v
    assert v["masses", "FTICR_H_C"] > 0 and 1000 < v["sizes", "SEC_mw"] < 122_000
    wide = {r.sample_id: r for r in screening.fused(made.descriptors).collect()}
    assert wide["Baikal_1"].class_target == "clean" and wide["Lignin_2"].class_target == "Sludge_Lignin" and wide["River_3"].class_target == "Unassigned"
    assert wide["River_3"]["UV_a254"] is None and wide["Baikal_1"]["NMR_al"] == 7
    with pytest.raises(ValueError, match="descriptors"):
        screening.fused(made.descriptors, most=3)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "none.csv").write_text("\n")  # Spark gives no row for a file of no bytes
    made = screening.screened(screening.files_below(spark, str(tmp_path / "in")), str(tmp_path / "work"), bounds=SMALL)
    assert made.descriptors.count() == 0 and [(r.modality, r.status) for r in made.summary.collect()] == [("Unknown", "warning")]


def test_stream_that_stops_between_write_and_commit(spark, tmp_path, monkeypatch):
    source, target = folder(tmp_path / "in", ["Baikal_1_uv.csv", "matrix.csv"]), str(tmp_path / "out")
    write = screening.write_batch
    stops = iter([True])

    def stopping(files, batch, *args, **kw):
        write(files, batch, *args, **kw)
        if next(stops, False):
            raise RuntimeError("stopped before the commit")

    monkeypatch.setattr(screening, "write_batch", stopping)
    with pytest.raises(Exception, match="stopped before the commit"):
        screening.stream(spark, source, target, bounds=SMALL).awaitTermination()
    screening.stream(spark, source, target, bounds=SMALL).awaitTermination()
    first = screening.current(spark, target)
    assert sorted(os.path.basename(r.path) for r in first.summary.collect()) == ["Baikal_1_uv.csv", "matrix.csv"]
    assert values(first)["River_3", "FTIR_lignin"] == 1.5
    # a later file replaces what it measures again and leaves the rest
    (tmp_path / "in" / "late.csv").write_text("Sample_ID,FTIR_lignin,NMR_ar\nRiver_3,9.5,1\n")
    screening.stream(spark, source, target, bounds=SMALL).awaitTermination()
    second = screening.current(spark, target)
    assert second.summary.count() == 3
    v = values(second)
    assert v["River_3", "FTIR_lignin"] == 9.5 and v["River_3", "NMR_al"] == 8 and v["River_3", "NMR_ar"] == 1
    # a batch without its summary isn't there yet
    os.rename(f"{target}/files/batch=1", f"{tmp_path}/gone")
    assert values(screening.current(spark, target)) == values(first)
