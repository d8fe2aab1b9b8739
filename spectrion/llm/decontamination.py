"""Benchmark decontamination by template windows.

Texts are turned into templates: words in lower case without punctuation,
with numbers, names and units replaced by typed placeholders. Every window of
``WINDOW`` template words of a document is joined by hash with the windows of
the benchmark, so a question is found also when its numbers, names or units
were changed. A match must fill the slots consistently: each value of the
benchmark's slots stands for one value in the document.

A match is judged by occurrence, that is by where in the document the item
would begin: windows of one diagonal (place in the document less place in the
item), or, since copies have words put in or left out, of neighbouring
diagonals that differ by less than the item's length. Other copies and stray
windows elsewhere in the document don't count towards it. A run is neighbouring
windows of one diagonal. Slots must agree both ways: a value of either side
stands for one value of the other.

A template window of few literal words is evidence as far as it is rare: the
fewer such words it has, the fewer documents may hold it (``allowed``).
Commoner ones say nothing about an item and count neither for nor against it.

Items of one template and one pattern of equal slots are one class, and so are
items of equal words; a class is matched once, whatever its number of items.

Before the join, windows are tested against a bitmap of the benchmark's hashes
whose size is fixed (``BITMAP_BITS``); it only saves storing windows that
can't match. The join is on distinct windows: those that are frequent in the
documents stay where they are and meet a bounded number of broadcast keys.

Beside the templates, windows of the raw words, in lower case, are joined, so a
verbatim copy is found whatever its case and however many slots it has; each of
the two is judged by itself. An item shorter than the window is one window of
its own length, and documents have windows of these lengths too. An item of
under ``FEW_WORDS`` words is certain only where it is a whole line of the
document; the pipeline leaves documents that merely contain it.

Names are told by their capitals, so a copy with other names is found only if
it has them too.

Defined results: a null text is empty; a benchmark item without words matches
nothing; repeated rows of a document or an item count once; rows with a null
id are matched like any other and reported under null; of occurrences that
pass, the certain one counts, then that which covers most, runs longest, is
most consistent; a class is reported under its smallest item_id; texts of any
length are searched whole; an empty table on either side gives no pairs; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fixed_filter, maybe_in, small_batches, spread_join, stored, table

WINDOW = 8

#: With so many words that are no placeholders, or all of them, a template window is evidence however frequent it is.
LITERAL = 4

#: Items of fewer words are certain only as a whole line.
FEW_WORDS = 4

#: Verdict: share of an item's windows found, or a run of them (13 words), and share of consistent slot values.
COVERAGE = 0.5
RUN = 6
CONSISTENT = 0.8

BITMAP_BITS = 1 << 20

#: Words that after a number are units.
UNITS = (
    "% percent kg g mg lb lbs oz t ton tons km m cm mm mi mile miles ft feet foot inch inches yd yard yards "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "l liter liters litre litres ml gallon gallons mph kmh kph c f degree degrees w kw kwh v volt volts a amp hz khz mhz ghz "
    "b kb mb gb tb usd eur gbp dollar dollars cent cents euro euros pound pounds"
).split()

#: Words that are no names though questions inside a sentence begin with them in capitals.
NO_NAMES = (
    "a an the this that these those what which who whom whose when where why how if is are was were do does did can could will would should has have had "
    "i you he she it we they my your his her its our their in on at of to from for by with and or but not as find solve given let suppose calculate compute"
).split()

#: Bytes of text handled at once.
SLICE = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MUL
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte, powers by place in a word, and which bytes make up words."""
    value = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(1023, _STEP)]), dtype=np.uint64)
    word = np.zeros(256, dtype=bool)
    word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return value, power, word


@lru_cache(maxsize=2)
def _hashes(words: tuple[str, ...]) -> np.ndarray:
    text = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.sort(_tokens(text, np.array([0, len(text)]))[0])


def _among(raw: np.ndarray, words: list[str]) -> np.ndarray:
    """Which hashes are those of some words."""
    known = _hashes(tuple(w for w in words if w.isalnum()))
    return known[np.minimum(np.searchsorted(known, raw), len(known) - 1)] == raw


#: Placeholders' hashes, by kind.
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))


def _tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end, capitalised and number flags of the words in texts laid end to end; ``ends`` has 0 and each text's end."""
    value, power, word = _tables()
    n = len(data)
    is_word = word[data]
    # a dot or comma between digits belongs to the number
    digit = (data >= 0x30) & (data <= 0x39)
    inner = np.nonzero(((data == 0x2E) | (data == 0x2C))[1:-1] & digit[:-2] & digit[2:])[0] + 1
    is_word[inner] = True
    edge = np.zeros(n + 1, dtype=bool)
    edge[ends] = True
    before = np.concatenate([[False], is_word[:-1]])
    begin = np.nonzero(is_word & (~before | edge[:n]))[0]
    after = np.concatenate([is_word[1:], [False]])
    end = np.nonzero(is_word & (~after | edge[1:]))[0] + 1
    upper = (data >= 0x41) & (data <= 0x5A)
    second = np.concatenate([[False], (data == 0xC3)[:-1]]) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low = np.where(upper | second, data + np.uint8(0x20), data)
    at = np.nonzero(is_word)[0]
    place = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) if len(begin) else at
    part = value[low[at]] * power[place & 1023]
    hashes = _mix(np.add.reduceat(part, np.concatenate([[0], np.cumsum(end - begin)[:-1]]))) if len(begin) else np.zeros(0, np.uint64)
    # Latin-1 capitals: the letter's second byte tells
    wide = np.minimum(begin + 1, n - 1) if n else begin
    first_upper = upper[begin] | ((data[begin] == 0xC3) & second[wide])
    size = np.where(data[begin] == 0xC3, 2, 1)
    follow = np.minimum(begin + size, max(n - 1, 0))
    second_upper = upper[follow] | second[np.minimum(follow + 1, max(n - 1, 0))] & (data[follow] == 0xC3)
    capital = first_upper & (end - begin > size) & ~second_upper
    return hashes, begin, end, capital, digit[begin]


def templates(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: number of the text, raw hash, template hash, whether it is a slot, and number of the line."""
    raw, begin, end, capital, number = _tokens(data, ends)
    doc = np.searchsorted(ends, begin, side="right") - 1
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    # a sentence ends between two words
    stop = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:\n", np.uint8)))])
    previous = np.concatenate([[0], end[:-1]]) if len(end) else end
    opens = first | (stop[begin] > stop[previous])
    name = capital & ~opens & ~_among(raw, NO_NAMES)
    after_number = np.concatenate([[False], number[:-1]]) & ~first if len(number) else number
    unit = after_number & _among(raw, UNITS)
    slot = number | name | unit
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, raw)))
    line = np.concatenate([[0], np.cumsum(data == 0x0A)])[begin]
    return doc, raw, template, slot, line


def windows(doc: np.ndarray, value: np.ndarray, n_docs: int, sizes: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: text, first word (index in all words), words and hash.

    Windows have each of ``sizes`` words; without sizes WINDOW words, or all words of a shorter text.
    """
    count = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(count) - count
    padded = np.concatenate([value, np.zeros(WINDOW, np.uint64)])
    found = []
    for size in sizes or range(1, WINDOW + 1):
        chosen = count >= size if sizes or size == WINDOW else count == size
        n = np.where(chosen, count - size + 1, 0)
        of = np.repeat(np.arange(n_docs), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of]
        h = np.zeros(len(start), np.uint64)
        for k in range(size):
            h = h * _STEP + padded[start + k]
        found.append((of, start, np.full(len(of), size), _mix(h + np.uint64(size))))
    found = [np.concatenate(x) for x in zip(*found)]
    order = slice(None) if sizes else np.argsort(found[0], kind="stable")  # a text's windows together, to be numbered
    return tuple(x[order] for x in found)


def _pattern(values: np.ndarray) -> np.ndarray:
    """Each value's number, in order of first occurrence."""
    _, first, back = np.unique(values, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def window_table(texts: DataFrame, key: str, prefix: str, bitmap: np.ndarray | None = None, sizes: list[int] | None = None) -> DataFrame:
    """(key, text's own digest, whether raw words or template, words of the text, first word, size, literal words, whether it is a whole line, hash, slots in the window).

    Two kinds of windows stand side by side: of the template and of the raw
    words. Without sizes the texts are items: the digest is that of their
    class, and slots are numbered by the pattern of equal ones; else slots are
    raw hashes. Only windows that the bitmap, one row a kind, lets pass are
    returned.
    """
    small_batches(texts.sparkSession)
    names = [key, f"{prefix}_text", "is_raw", f"{prefix}_words", f"{prefix}_at", "size", "literal", f"{prefix}_whole", "hash", f"{prefix}_slots"]
    digest = lambda *parts: hashlib.blake2b(b"|".join(parts), digest_size=16).digest()

    def emit(ids: pa.Array, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        doc, raw, template, slot, line = templates(data, ends)
        words = np.bincount(doc, minlength=len(parts))
        begin = np.cumsum(words) - words
        slots = np.concatenate([[0], np.cumsum(slot)])
        opens = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]), [True]]) if len(doc) else np.ones(1, bool)
        filler = raw.view(np.int64)
        if sizes is None:
            filler = np.concatenate([np.zeros(0, np.int64), *(put_back(slot[a : a + n], raw[a : a + n]) for a, n in zip(begin, words))])
        for kind, values in enumerate((template, raw)):
            of, start, size, h = windows(doc, values, len(parts), sizes)
            if bitmap is not None:
                keep = np.nonzero(bitmap[kind][(h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)])[0]
                of, start, size, h = of[keep], start[keep], size[keep], h[keep]
            if not len(of):
                continue
            own = [b""] * len(parts)
            for i in np.unique(of):
                a, n = begin[i], words[i]
                own[i] = digest(parts[i]) if sizes else digest(values[a : a + n].tobytes(), filler[a : a + n].tobytes() if not kind else b"")
            literal = size - (slots[start + size] - slots[start])
            # raw windows are equal word by word: no slots to check
            filled = [filler[a : a + k][slot[a : a + k]].tolist() if not kind else [] for a, k in zip(start, size)]
            columns = (np.full(len(of), kind), words[of], start - begin[of], size, literal, opens[start] & opens[start + size], h.view(np.int64))
            texts_of = pa.array([own[i] for i in of], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), texts_of, *map(pa.array, columns), pa.array(filled, pa.list_(pa.int64()))], names)

    def put_back(slot: np.ndarray, raw: np.ndarray) -> np.ndarray:
        out = np.full(len(raw), -1, np.int64)
        out[slot] = _pattern(raw[slot])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, first, held = [], 0, 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts.append((t or "").encode())
                held += len(parts[-1])
                if held >= SLICE or i == batch.num_rows - 1:
                    if held:
                        yield from emit(batch.column(0).slice(first, len(parts)), parts)
                    parts, first, held = [], i + 1, 0

    kind = texts.schema[key].dataType.simpleString()
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, (kind, "binary", *["long"] * 5, "boolean", "long", "array<long>")))
    return texts.select(F.col(key), F.col("text")).mapInArrow(run, schema)


def allowed(literal: Column, n_docs: int) -> Column:
    """Documents that may hold a template window with so few literal words if it is to be evidence: one of them, or a share of all, and four times as many for each such word."""
    return F.pow(F.lit(4.0), literal) * max(1.0, n_docs / 16384)


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Which remainders of the hashes occur, for templates and raw words: BITMAP_BITS flags each, whatever the number of hashes."""
    bits = hashes.select("is_raw", (F.col("hash").bitwiseAND(BITMAP_BITS - 1)).alias("bit")).distinct().toPandas().to_numpy(dtype=np.int64)
    flags = np.zeros((2, BITMAP_BITS), dtype=bool)
    flags[bits[:, 0], bits[:, 1]] = True
    return flags


KEY = ["is_raw", "size", "hash"]


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, figures of the match) for the places in a document that share windows with a class of benchmark items."""
    given = stored(window_table(benchmark, "item_id", "item").distinct())
    members = given.select("is_raw", "item_text", "item_id").distinct().groupBy("is_raw", "item_text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    sizes = sorted({WINDOW, *(r["size"] for r in given.select("size").distinct().collect())})
    mine = stored(window_table(docs, "doc_id", "doc", bitmap_of(given), sizes).select("doc_id", "doc_text", *KEY, "doc_at", "doc_whole", "doc_slots"))
    items = given.select("item_text", "item_words", "item_at", "literal", "item_slots", *KEY).distinct()
    # frequency of each window: documents that hold it, and its places
    by_doc = mine.groupBy(*KEY, "doc_text").agg(F.count("*").alias("n"))
    counts = by_doc.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))
    weighed = items.join(counts, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_docs", "n")})
    telling = (F.col("is_raw") == 1) | (F.col("literal") >= F.least(F.lit(LITERAL), F.col("size"))) | (F.col("n_docs") <= allowed(F.col("literal"), docs.count()))
    item = Window.partitionBy("is_raw", "item_text")  # an item's windows
    numbered = weighed.where(telling).withColumn("item_w", F.row_number().over(item.orderBy("item_at")).cast("long") - 1).withColumn("item_n", F.count("*").over(item))
    kept = numbered.groupBy(*KEY, "n").agg(F.collect_list(F.struct("item_text", "item_words", "item_n", "item_w", "item_at", "item_slots")).alias("items"))
    keys = stored(kept.where("n > 0"))
    total = mine.count()
    met = spread_join(mine, keys, KEY, "n", total).withColumn("item", F.explode("items"))
    both = met.select("doc_id", "doc_text", "is_raw", "doc_at", "doc_whole", "doc_slots", "item.*").join(members, ["is_raw", "item_text"])
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    whole = ["doc_id", "doc_text", "item_id", "item_text", "is_raw", "n_items"]
    lines = both.groupBy(*whole, (F.col("doc_at") - F.col("item_at")).alias("line")).agg(
        F.max("item_words").alias("words"),
        F.max("item_n").alias("n_windows"),
        F.max("doc_whole").alias("whole"),
        F.sort_array(F.collect_set("item_w")).alias("at"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
    )
    # longest run of neighbouring windows
    run = F.aggregate(
        "at",
        F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("most")),
        lambda s, w: F.struct(
            w.alias("last"),
            F.when(w == s["last"] + 1, s["now"] + 1).otherwise(1).cast("long").alias("now"),
            F.greatest(s["most"], F.when(w == s["last"] + 1, s["now"] + 1).otherwise(1)).cast("long").alias("most"),
        ),
    )["most"]
    # the diagonal by itself and two overlapping bands as wide as the item is long: whole copies never share a band, drifts of up to half the item always do
    bands = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("line").alias("band")),
        F.struct(F.lit(1).alias("kind"), F.expr("floor(line / words)").alias("band")),
        F.struct(F.lit(2).alias("kind"), F.expr("floor(line / words + 0.5)").alias("band")),
    )
    found = lines.withColumn("run", run).withColumn("place", F.explode(bands)).groupBy(*whole, "place").agg(
        F.max("n_windows").alias("n_windows"),
        F.max((F.col("words") >= FEW_WORDS) | F.col("whole")).alias("certain"),
        F.max("run").alias("longest_run"),
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
    )
    values = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side])))
    return found.select(
        "doc_id", "item_id", "n_items", F.size("at").cast("long").alias("n_found"), "n_windows",
        (F.size("at") / F.col("n_windows")).alias("coverage"), "longest_run",
        F.coalesce(F.try_divide(F.least(values("i"), values("d")), F.size("slots")), F.lit(1.0)).alias("consistency"), "certain",
    )


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN, consistent: float = CONSISTENT) -> DataFrame:
    """The pairs of document and item of which an occurrence counts as contamination, with the figures of the one that covers most.

    ``item_id`` is the smallest of the ``n_items`` in its class; without
    ``certain`` the item is of few words and no line of the document.
    """
    figures = ["certain", "coverage", "longest_run", "consistency", "n_found", "n_windows", "n_items"]
    passed = occurrences(docs, benchmark).where(((F.col("coverage") >= coverage) | (F.col("longest_run") >= run)) & (F.col("consistency") >= consistent))
    best = passed.groupBy("doc_id", "item_id").agg(F.max(F.struct(*figures)).alias("best"))
    return best.select("doc_id", "item_id", *[F.col(f"best.{c}") for c in ("n_found", "n_windows", "coverage", "longest_run", "consistency", "n_items", "certain")])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, with or without a doc_id.

    Rows are judged by doc_id and text, known by two hashes of both, so that a
    clean text stays if a contaminated one has the same doc_id. Only rows that
    may go are shuffled.
    """
    own = F.struct(F.xxhash64("doc_id", "text").alias("doc"), F.xxhash64(F.lit(1), "doc_id", "text").alias("doc2"))
    found = cut(leaks(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("certain").select("doc_id.*").distinct())
    rows = maybe_in(docs.select(F.struct(*docs.columns).alias("row"), own.alias("own")).select("row", "own.*"), fixed_filter(found))
    kept = rows.where("NOT maybe").select("row").unionByName(rows.where("maybe").join(found, ["doc", "doc2"], "left_anti").select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
