"""Forms of encoding that the secret scan opens, alone and in one another, and its base against SQL."""

import base64
import bz2
import gzip
import random
import time
import zlib

import duckdb
import pytest

from spectrion.llm import secrets_scan
from spectrion.llm.registry import QUERIES

SECRET = "password = hunter2hunter2"


def raw_deflate(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def b64(data):
    return base64.b64encode(data).decode()


FORMS = {
    "braces": lambda s: "".join(f"\\u{{{ord(c):x}}}" for c in s),
    "long": lambda s: "".join(f"\\U{ord(c):08x}" for c in s),
    "octal": lambda s: "".join(f"\\{ord(c):03o}" for c in s),
    "percent_u": lambda s: "".join(f"%u{ord(c):04x}" for c in s),
    "decimal": lambda s: "".join(f"&#{ord(c)};" for c in s),
    "hexadecimal": lambda s: "".join(f"&#x{ord(c):X};" for c in s),
    "hex": lambda s: s.encode().hex(),
    "hex_upper": lambda s: "0x" + s.encode().hex().upper(),
    "utf16": lambda s: b64(s.encode("utf-16-le")),
    "utf16_be": lambda s: b64(s.encode("utf-16-be")),
    "utf16_mark": lambda s: b64(s.encode("utf-16")),
    "deflate": lambda s: b64(raw_deflate(s.encode())),
    "bzip2": lambda s: b64(bz2.compress(s.encode())),
    "bzip2_twice": lambda s: b64(bz2.compress(b"first part ") + bz2.compress(s.encode())),
    "gzip_hex": lambda s: gzip.compress(s.encode()).hex(),
    "percent": lambda s: "".join(f"%{ord(c):02x}" for c in s),
    "base64": lambda s: b64(s.encode()),
}


@pytest.mark.parametrize("form", FORMS)
def test_each_form_opens(form):
    inner = FORMS[form](SECRET)
    text = f"before: {inner} after"
    base, found, _, lost = secrets_scan.search(text)
    a = len("before: ")
    spans = [s for s in found if s[2] == "assign"]
    assert len(spans) == 1 and a <= spans[0][0] and spans[0][1] <= a + len(inner) and not lost
    if form in ("braces", "long", "octal", "percent_u", "decimal", "hexadecimal"):
        assert spans[0][:2] == (a, a + len(inner))
    assert set(base) <= set(found)


def test_forms_in_one_another():
    pick = random.Random(4)
    for _ in range(60):
        text, chain = SECRET, pick.choices(list(FORMS), k=3)
        for form in chain:
            text = FORMS[form](text)
        assert any(k == "assign" for _, _, k in secrets_scan.search(f"x {text} y")[1]), chain


def test_parts_map_to_their_own_characters():
    text = "a &quot;" + FORMS["hex"](f"nothing to see {SECRET}")
    spans = [s for s in secrets_scan.search(text)[1] if s[2] == "assign"]
    assert spans == [(len("a &quot;") + 2 * len("nothing to see "), len(text), "assign")]
    assert secrets_scan.search("tom &amp; jerry &unknown; \\9 %uZZ")[1] == []
    wide = f"{'é' * 20} {SECRET}".encode("utf-16-le")
    token = b64(wide)
    (a, b, _), = [s for s in secrets_scan.search(token)[1] if s[2] == "assign"]
    assert 0 < a and base64.b64decode(token[a - a % 4 :]).decode("utf-16-le", "ignore")[-len(SECRET) :] == SECRET


def test_long_runs_take_little_time():
    pick = random.Random(1)
    began = time.time()
    secrets_scan.search(pick.randbytes(1_000_000).hex())
    secrets_scan.search(b64(pick.randbytes(1_000_000)))
    secrets_scan.search("&#65;" * 200_000)
    secrets_scan.search(b64(raw_deflate(b"word " * 2_000_000)))
    assert time.time() - began < 30


def test_base_counts_equal_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    sql = rf"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 'i'), lambda x: length(x) >= 8))::BIGINT AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM '{d}/documents.parquet')"""
    expected = sorted(con.sql(sql).fetchall())
    got = QUERIES["op1_secret_scan"](spark, d).select("doc_id", "n_assign", "n_access", "n_hex")
    assert sorted(map(tuple, got.collect())) == expected
