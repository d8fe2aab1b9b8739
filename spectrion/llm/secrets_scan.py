"""Secret scan with a decoding worklist.

Each text is layer zero of a worklist. A layer is scanned for secrets, then
what is encoded in it is unwrapped into new layers, until nothing new appears:
over the whole layer percent escapes (also %u), backslash escapes (\\x, \\u,
\\u{}, \\U and octal) and character references; runs of hexadecimal bytes;
base64 runs, also behind '=' or a path and over several lines, of text in UTF-8
or UTF-16; zlib, gzip, bzip2 and raw deflate streams in them (raw deflate, which
has no mark, only as a whole run). Each distinct content is scanned and unwrapped once, which ends
cycles; every place where it occurs is kept as an edge from the layer around it
with a mapping of spans, and the spans of a content are handed up all edges
until nothing changes. So a secret found at any depth is reported by the spans
of all original characters that encode it, however often its layers recur.

Decoded layers only count when they are text. A compressed stream is opened to
its end, all members, in chunks that are layers of their own; a chunk ends at a
blank and the next one repeats its last ``OVERLAP`` characters, so memory stays
bounded. Streams that break off with an error, and those with a stretch without
a blank of over ``LONGEST`` characters, which must be cut, are counted in
``n_unopened``.

A map over the rows without a shuffle. Defined results: a null or empty text
has no secrets; texts of any length are scanned whole; repeated rows are
scanned each; an empty table gives an empty one; other columns are ignored by
the scan and kept by the stage, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html import unescape
from itertools import accumulate
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex")

_KEY = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of 16 characters or more is matched whole either way
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Bytes put into a compressed stream at once, few since those with an error give nothing, and taken out of it at most.
FEED = 16
PIECE = 1 << 20
#: Characters of a chunk, at least; repeated from one chunk to the next; without a blank, at most.
CHUNK = 1 << 22
OVERLAP = 1 << 16
LONGEST = 1 << 24

_PERCENT_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+|%u([0-9A-Fa-f]{4})")
_ESCAPE_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\([0-3][0-7]{2})")
_REFERENCE_UNIT = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Bytes in hexadecimal, enough for the shortest secret.
_BYTES = re.compile(r"(?<![0-9A-Za-z])(?:0x)?((?:[0-9A-Fa-f]{2}){14,}+)(?![0-9A-Za-z])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Lines of base64 that follow one another; the last may be short.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Signs of base64 that as often part words: a value may begin behind each.
_PARTS = re.compile(r"[+/_-]")
#: Bytes of text, enough for the shortest secret.
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}){14,}")

Span = tuple[int, int, str]
#: From a span in a layer to the span that encodes it in the layer around it.
Place = Callable[[int, int], tuple[int, int]]


def scan(text: str) -> list[Span]:
    """(start, end, kind) of the base secrets in one text, by start, then kind as listed."""
    found = []
    if _KEY.search(text):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def _readable(raw: bytes) -> str | None:
    """The bytes as text, if they are text."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if _is_text(text) else None


def _is_text(text: str) -> bool:
    odd = 0 if text.isprintable() else sum(not (c.isprintable() or c in "\n\r\t") for c in text)
    return bool(text) and odd * 20 <= len(text)


RAW_DEFLATE = -zlib.MAX_WBITS


def _packed(raw: bytes) -> bool:
    """Whether bytes begin like a zlib, gzip or bzip2 stream."""
    return raw[:2] == b"\x1f\x8b" or raw[:3] == b"BZh" or len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0


class _Bzip2:
    """A bzip2 stream with the interface of zlib's; it keeps what it can't take yet."""

    unconsumed_tail = b""

    def __init__(self) -> None:
        self._stream = bz2.BZ2Decompressor()
        self.decompress = self._stream.decompress

    @property
    def eof(self) -> bool:
        return self._stream.eof

    @property
    def unused_data(self) -> bytes:
        return self._stream.unused_data


def _stream(head: bytes, form: int):
    return _Bzip2() if head[:3] == b"BZh" and form != RAW_DEFLATE else zlib.decompressobj(form)


def _opens(head: bytes) -> bool:
    """Whether the first bytes of a stream can be inflated."""
    try:
        return _packed(head) and _stream(head, zlib.MAX_WBITS | 32).decompress(head, 1 << 12) is not None
    except (zlib.error, OSError):
        return False


def _deflated(raw: bytes) -> bool:
    """Whether bytes are one raw deflate stream whose beginning is text."""
    stream = zlib.decompressobj(RAW_DEFLATE)
    try:
        out = stream.decompress(raw, 1 << 12)
        text = codecs.getincrementaldecoder("utf-8")().decode(out)
    except (zlib.error, UnicodeDecodeError):
        return False
    return len(text) > 3 and _is_text(text) and (len(out) == 1 << 12 or stream.eof and not stream.unused_data)


def _members(raw: bytes, form: int = zlib.MAX_WBITS | 32) -> Iterator[bytes]:
    """Bytes of the streams that stand one behind the other, in pieces."""
    at = 0
    while at < len(raw) and (_packed(raw[at : at + 3]) or form == RAW_DEFLATE and not at):
        stream = _stream(raw[at : at + 3], form)
        feed = b""
        while not stream.eof:
            if not feed:
                feed = raw[at : at + FEED]
                at += len(feed)
            ended = not feed
            out = stream.decompress(feed, PIECE)
            feed = stream.unconsumed_tail
            if out:
                yield out
            elif ended and not stream.eof:  # broken off
                return
        at -= len(stream.unused_data)


def _inflated(raw: bytes, lost: list[int], form: int = zlib.MAX_WBITS | 32) -> Iterator[str]:
    """Text of the streams in chunks; nothing if the bytes are none."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    held, fresh, size, some, cut_short = "", [], 0, False, False
    try:
        for piece in _members(raw, form):
            some = True
            fresh.append(decoder.decode(piece))
            size += len(fresh[-1])
            if size < PIECE:
                continue
            held, fresh, size = held + "".join(fresh), [], 0
            if len(held) < CHUNK:
                continue
            end = max(held.rfind(" "), held.rfind("\t")) + 1
            if end < len(held) // 2:
                if len(held) < LONGEST:
                    continue
                end, cut_short = len(held), True
            if _is_text(held[:end]):
                yield held[:end]
            held = held[end - OVERLAP :]
    except (zlib.error, OSError, UnicodeDecodeError) as e:
        cut_short |= some and not isinstance(e, UnicodeDecodeError)
    lost[0] += cut_short
    held += "".join(fresh)
    if _is_text(held):
        yield held


def _stretches(pieces: list[tuple[int, int, int, int]]) -> Place:
    """Place of pieces (first character here, start and end there, characters there for each here; 0: the whole piece for any)."""
    at, start, end, step = (list(x) for x in zip(*pieces))

    def place(a: int, b: int) -> tuple[int, int]:
        p, q = bisect_right(at, a) - 1, bisect_right(at, b - 1) - 1
        return start[p] + (a - at[p]) * step[p], start[q] + (b - at[q]) * step[q] if step[q] else end[q]

    return place


def _unescaped(text: str, units: re.Pattern, read: Callable[[re.Match], list[tuple[str, int, int, int]]]) -> tuple[str, Place]:
    """The layer with every unit replaced by what it stands for; other characters stand for themselves."""
    out, pieces, n, at = [], [], 0, 0
    for u in units.finditer(text):
        for got, a, b, step in [(text[at : u.start()], at, u.start(), 1), *read(u)]:
            if got:
                out.append(got), pieces.append((n, a, b, step))
                n += len(got)
        at = u.end()
    if at < len(text):
        out.append(text[at:]), pieces.append((n, at, len(text), 1))
    return "".join(out), _stretches(pieces)


def _percent(u: re.Match) -> list[tuple[str, int, int, int]]:
    if u[1]:
        return _character(int(u[1], 16), u)
    raw, a = unquote_to_bytes(u[0]), u.start()
    try:
        got = raw.decode("utf-8")
    except UnicodeDecodeError:
        return [(raw.decode("utf-8", "replace"), a, u.end(), 0)]
    if len(got) == len(raw):
        return [(got, a, u.end(), 3)]
    at = list(accumulate((3 * len(c.encode()) for c in got), initial=a))
    return [(c, at[i], at[i + 1], 0) for i, c in enumerate(got)]


def _character(code: int, u: re.Match) -> list[tuple[str, int, int, int]]:
    return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", u.start(), u.end(), 0)]


def _backslash(u: re.Match) -> list[tuple[str, int, int, int]]:
    return _character(int(u[5], 8) if u[5] else int(u[1] or u[2] or u[3] or u[4], 16), u)


def _reference(u: re.Match) -> list[tuple[str, int, int, int]]:
    return [(unescape(u[0]), u.start(), u.end(), 0)]


def _wide(raw: bytes) -> str | None:
    """The bytes as text of two bytes a character, if they are that."""
    if len(raw) < 28 or len(raw) % 2:
        return None
    form = "utf-16-le" if raw[1::2].count(0) * 10 >= 9 * len(raw) // 2 else "utf-16-be" if raw[::2].count(0) * 10 >= 9 * len(raw) // 2 else None
    try:
        text = raw.decode(form) if form else ""
    except UnicodeDecodeError:
        return None
    return text if text and _is_text(text.removeprefix("\ufeff")) else None


def _decoded(got: str, first: int, size: int, where: Place, skip: int = 0, form: str = "utf-8") -> Place:
    """Place of text whose bytes, ``skip`` others before them, the base64 characters from ``first`` on, of ``size``, encode: a character comes from all that hold bits of it."""
    at = None if got.isascii() and form == "utf-8" else list(accumulate((len(c.encode(form)) for c in got), initial=0))

    def place(a: int, b: int) -> tuple[int, int]:
        a, b = (a, b) if at is None else (at[a], at[b])
        return where(first + (skip + a) * 4 // 3, min(size, first - (-(skip + b) * 4 // 3)))

    return place


def _base64(token: str, where: Place, stop: int, starts: list[int], lost: list[int]) -> Iterator[tuple[str, Place]]:
    """What a run of base64 characters holds, as a whole and from each of ``starts``; the encoded stretch ends at ``stop``, after its padding."""
    if token.isalpha() and (token.islower() or token.isupper()):
        return
    n, plain = len(token), token.replace("-", "+").replace("_", "/")

    def decode(first: int, last: int = n) -> bytes:
        last -= (last - first) % 4 == 1
        return base64.b64decode(plain[first:last] + "=" * (-(last - first) % 4))

    if n % 4 != 1:
        raw, whole, inflated = decode(0), (where(0, 1)[0], stop), False
        for got in _inflated(raw, lost):
            inflated = True
            yield got, lambda a, b: whole
        if not inflated and (got := _readable(raw)) is not None:
            yield got, _decoded(got, 0, n, where)
        elif not inflated and (got := _wide(raw)) is not None:
            yield got, _decoded(got, 0, n, where, form="utf-16-le")
        elif not inflated and _deflated(raw):
            for got in _inflated(raw, lost, RAW_DEFLATE):
                yield got, lambda a, b: whole
    for i in starts:
        if _packed(decode(i, min(i + 4, n))) and _opens(decode(i, min(i + 256, n))):
            for got in _inflated(decode(i), lost):
                yield got, lambda a, b, span=(where(i, i + 1)[0], stop): span
    # what begins at a place decodes alike from any place four characters nearer or farther, so at most four decodings find the text behind every start
    for phase in sorted({i % 4 for i in starts} | {0}) if starts else ():
        for m in _TEXT.finditer(decode(phase)):
            got = m[0].decode()
            yield got, _decoded(got, phase, n, where, m.start())


def _from_hex(m: re.Match, lost: list[int]) -> Iterator[tuple[str, Place]]:
    """What a run of hexadecimal bytes holds."""
    raw, start = bytes.fromhex(m[1]), m.start(1)
    if _opens(raw[:256]):
        for got in _inflated(raw, lost):
            yield got, lambda a, b: m.span()
        return
    got, form = _readable(raw), "utf-8"
    if got is None:
        got, form = _wide(raw), "utf-16-le"
    if got is not None:
        at = list(accumulate((2 * len(c.encode(form)) for c in got), initial=start))
        yield got, lambda a, b: (at[a], at[b])


def unwrap(text: str, lost: list[int]) -> Iterator[tuple[str, Place]]:
    """Layers one decoding deeper; adds to ``lost`` how many streams were not opened to their end."""
    if "%" in text and _PERCENT_UNIT.search(text):
        yield _unescaped(text, _PERCENT_UNIT, _percent)
    if "\\" in text and _ESCAPE_UNIT.search(text):
        yield _unescaped(text, _ESCAPE_UNIT, _backslash)
    if "&" in text and _REFERENCE_UNIT.search(text):
        got = _unescaped(text, _REFERENCE_UNIT, _reference)
        if got[0] != text:
            yield got
    for m in _BYTES.finditer(text):
        yield from _from_hex(m, lost)
    for m in _BASE64.finditer(text):
        token = m[0].rstrip("=")
        yield from _base64(token, lambda a, b, at=m.start(): (at + a, at + b), m.end(), [p.end() for p in _PARTS.finditer(token)], lost)
    if "\n" in text:
        for m in _LINES.finditer(text):
            lines = list(_LINE.finditer(text, *m.span()))
            ends = list(accumulate(len(x[0]) for x in lines))
            place = _stretches([(e - len(x[0]), x.start(), x.end(), 1) for x, e in zip(lines, ends)])
            token = "".join(x[0] for x in lines)
            yield from _base64(token, place, m.end(), sorted({*ends[:-1], *(p.end() for p in _PARTS.finditer(token))}), lost)


def search(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, layers opened and streams not opened to their end."""
    base = scan(text)
    found: dict[bytes, set[Span]] = {b"": set(base)}  # by content; the text itself is b""
    edges: list[tuple[bytes, bytes, Place]] = []
    lost = [0]
    work = [(b"", unwrap(text, lost))]
    while work:
        outer, layers = work[-1]
        layer = next(layers, None)
        if layer is None:
            work.pop()
            continue
        inner = hashlib.blake2b(layer[0].encode("utf-8", "surrogatepass"), digest_size=16).digest()
        edges.append((outer, inner, layer[1]))
        if inner not in found:
            found[inner] = set(scan(layer[0]))
            work.append((inner, unwrap(layer[0], lost)))
    edges.reverse()  # inner layers first
    changed = any(found[inner] for _, inner, _ in edges)
    while changed:
        changed = False
        for outer, inner, place in edges:
            new = {(*place(a, b), kind) for a, b, kind in found[inner]} - found[outer]
            found[outer] |= new
            changed |= bool(new)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(found[b""], key=lambda s: (s[0], order[s[2]], s[1])), len(found) - 1, lost[0]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])


def scan_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, found, n_layers, n_unopened): arrays of (start, end, kind) spans in code points."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [search(t or "") for t in batch.column(1).to_pylist()]
            spans = [pa.array([[dict(start=a, end=b, kind=k) for a, b, k in g[i]] for g in got], pa.list_(_SPAN)) for i in (0, 1)]
            counts = [pa.array([g[i] for g in got], pa.int64()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *spans, *counts], [key, "base", "found", "n_layers", "n_unopened"])

    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, base {spans}, found {spans}, n_layers long, n_unopened long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns with every secret, at any depth, replaced by ``mark`` in the text; a text without secrets is unchanged."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(place).to_pylist():
                if t:
                    end = len(t)
                    for a, b in reversed(merged(search(t)[1])):
                        t = t[:a] + mark + t[b:end]
                        end = len(t)
                out.append(t)
            columns = [*batch.columns]
            columns[place] = pa.array(out, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Union of overlapping spans."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_table(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), "n_layers", "n_unopened")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are cut out of the texts, and n_chars follows; every document stays."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)
