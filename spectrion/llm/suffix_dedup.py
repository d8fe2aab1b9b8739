"""Removal of repeated byte strings across and within documents.

A byte goes if some string of ``LENGTH`` bytes that covers it starts anywhere
else too. The column-wise construction takes as many rounds as the longest
text has bytes, each over the whole collection, so it is applied where it
matters only, after anchors have ruled out the rest:

1. Of each string's ``GRAM``-byte substrings the one with the least hash (the
   first of equals) is its anchor, so equal strings have the same anchor at
   the same place. Strings that start next to each other and share an anchor
   form a run; there are about two runs per ``LENGTH - GRAM`` bytes. A run
   whose anchor occurs once has no repeated string; one whose whole content
   occurs twice is repeated whole. Both are found by counts.
2. What is left, runs that are repeated in part, is a small collection of
   texts aligned at their anchors. Each round inserts one symbol of every
   text of the collection and updates the order of the texts by what has been
   inserted and the common lengths of neighbours; where a text's longest
   common length reaches ``LENGTH``, a string is repeated.
3. An anchor with more than ``CROWD`` different contents would make one task
   too long. Its runs are cut on a grid around the anchor into cells of
   ``CELL`` strings and counted by the bytes that all of a cell's strings
   hold; cells still open are counted string by string.

Counts have partial sums before each shuffle, so a passage shared by any
number of documents is no hot group. Texts are shuffled twice, and only those
that a filter of fixed size cannot rule out. Hashes compare by 128 bits.

``LENGTH`` bytes are some sixty words. Shorter passages aren't removed, but
``shares_passage`` tells which documents hold ``PASSAGE`` words or more in a
row that another document holds too. It is found the same way in words: runs
by anchors of ``PASSAGE_GRAM`` words, counted by documents, and where an
anchor's contents differ, counts of each ``PASSAGE`` words around it.

Defined results: a null text is empty; a text shorter than ``LENGTH`` bytes
loses nothing; each repeated row is a document of its own, so that exact
copies of ``LENGTH`` bytes or more lose all their bytes; texts of any length
are searched whole; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fixed_filter, maybe_in, small_batches, spread_join, stored, table

LENGTH = 400
GRAM = 200
CELL = 16

#: Words of a passage, and of its anchor.
PASSAGE = 50
PASSAGE_GRAM = 16

#: Different contents of one anchor that a task aligns.
CROWD = 4096

#: Texts that are aligned at once, but for a larger anchor.
ALIGNED = 4000

#: Bytes of text handled at once, but for a longer text.
SLICE = 1 << 20

_A = 0x9E3779B97F4A7C15
_B = 0xD1342543DE82EF95
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=4)
def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _symbols(data: np.ndarray, seed: int) -> np.ndarray:
    """A random odd number for each byte or, of words, for each word's hash."""
    return _values(seed)[data] if data.dtype == np.uint8 else _mix(data + _values(seed)[0]) | np.uint64(1)


def gram_hashes(data: np.ndarray, size: int, base: int = _A) -> np.ndarray:
    """Hash of the ``size`` symbols that start at each place, by doubling."""
    power, width = np.uint64(base), 1
    block, out, done = _symbols(data, 1), None, 0
    left = size
    while left:
        if left & 1:
            if out is None:
                out = block
            else:
                n = len(data) - done - width + 1
                out = out[:n] * power + block[done : done + n]
            done += width
        left >>= 1
        if left:
            n = len(data) - 2 * width + 1
            block = block[:n] * power + block[width : width + n]
            with np.errstate(over="ignore"):
                power = power * power
            width *= 2
    return _mix(out)


class Ranges:
    """Hashes of arbitrary ranges of symbols, by prefix sums."""

    def __init__(self, data: np.ndarray, base: int = _B, seed: int = 2):
        n = len(data) + 1
        self.up, self.down = _powers(base, n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_symbols(data, seed) * self.up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(_A))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 2 * SLICE)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of texts laid end to end: text, first start in it, starts, place of the anchor after the first start, hash of the anchor and of the content.

    ``ends`` has 0 and the end of each text.
    """
    size = len(data)
    if size < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    grams = gram_hashes(data, gram)
    ordered = grams & ~_LOW | np.arange(len(grams), dtype=np.uint64)
    anchor = (least(ordered, length - gram + 1) & _LOW).astype(np.int64)
    lengths = np.diff(ends)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: size - length + 1]
    at = np.nonzero(np.arange(size - length + 1) + length <= ends[1:][doc])[0]
    if not len(at):
        return runs(data[:0], ends[:1], length, gram)
    anchor, doc = anchor[at], doc[at]
    new = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))[0]
    start, last = at[new], np.concatenate([at[new[1:] - 1], at[-1:]])
    place = anchor[new] - start
    content = Ranges(data).of(start, last + length) ^ _mix(place.astype(np.uint64))
    return doc[new], start - ends[doc[new]], last - start + 1, place, grams[anchor[new]], content


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts laid end to end, and 0 and the number of words up to each text's end."""
    full = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begin = np.nonzero(full & (edge[:-1] | ~np.concatenate([[False], full[:-1]])))[0]
    stop = np.nonzero(full & (edge[1:] | ~np.concatenate([full[1:], [False]])))[0] + 1
    return Ranges(data).of(begin, stop), np.searchsorted(begin, ends)


def per_text(docs: DataFrame, work: Callable, schema: str, names: list[str]) -> DataFrame:
    """Hand the texts of (doc, text, ...) to ``work(bytes of texts, ends, batch rows)`` in slices; it returns (row numbers, arrays)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, first, held = [], 0, 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts.append(t)
                held += len(t)
                if held >= SLICE or i == batch.num_rows - 1:
                    rows = batch.slice(first, len(parts))
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                    of, arrays = work(np.frombuffer(b"".join(parts), np.uint8), ends, rows)
                    if len(of):
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of)), *map(pa.array, arrays)], names)
                    parts, first, held = [], i + 1, 0

    return docs.mapInArrow(run, schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First start and number of starts of a run in one number; ``_start`` and ``_count`` take it apart."""
    return start * LENGTH + n - 1


def _start(at: str) -> Column:
    return F.expr(f"{at} DIV {LENGTH}")


def _count(at: str) -> Column:
    return F.expr(f"{at} % {LENGTH} + 1")


def counted(rows: DataFrame) -> DataFrame:
    """Distinct (coarse, fine) of (doc, at, coarse, fine) whose coarse hash occurs twice or more.

    With the pair's count n, its least and last doc and a place in the least
    one; and of the coarse hash the number of its pairs, its least and last doc
    (low, high) and whether one of the pairs occurs once (open) or in one
    document only (apart).
    """
    fine = rows.groupBy("coarse", "fine").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.max("doc").alias("last"), F.min_by("at", "doc").alias("at"))
    coarse = fine.groupBy("coarse").agg(
        F.sum("n").alias("total"), F.count("*").alias("contents"), F.min("doc").alias("low"), F.max("last").alias("high"),
        (F.min("n") == 1).alias("open"), F.max(F.col("doc") == F.col("last")).alias("apart"),
    ).where("total > 1").drop("total")
    fine, coarse = stored(fine), stored(coarse)
    return stored(spread_join(fine, coarse, ["coarse"], "contents", fine.count()))


def whole(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, at) of the rows whose content is known."""
    return spread_join(rows, known.select("coarse", "fine", "n"), ["coarse", "fine"], "n", rows.count(), "left_semi").select("doc", "at")


_ROWS = "doc long, at long, coarse long, fine long"


def _runs_of(docs: DataFrame) -> DataFrame:
    """Rows of the runs whose anchor occurs twice or more, in the shared folder; the lowest bit of ``coarse`` tells runs of words from those of bytes."""

    def work(data, ends, rows):
        found = []
        for kind, (symbols, bounds, size, gram) in enumerate(((data, ends, LENGTH, GRAM), (*words(data, ends), PASSAGE, PASSAGE_GRAM))):
            doc, start, n, _, coarse, fine = runs(symbols, bounds, size, gram)
            found.append((doc, places(start, n), _signed(coarse & ~np.uint64(1) | np.uint64(kind)), _signed(fine)))
        doc, *columns = (np.concatenate(x) for x in zip(*found))
        return doc, columns

    every = stored(per_text(docs, work, _ROWS, ["doc", "at", "coarse", "fine"]))
    again = stored(every.groupBy("coarse").count().where("count > 1"))
    return stored(spread_join(every, again, ["coarse"], "count", every.count(), "left_semi"))


def _edges(docs: DataFrame, open_runs: DataFrame, open_words: DataFrame) -> DataFrame:
    """The bytes of the given runs, as (doc, at, text, coarse, contents), and the windows of the given runs of words, as (doc, coarse: hash, contents: 0); checkpointed."""
    both = open_runs.select("doc", "at", "coarse", "contents").unionByName(open_words.select("doc", "at", F.lit(0).cast("long").alias("coarse"), F.lit(0).cast("long").alias("contents")))
    lists = cut(both.groupBy("doc").agg(F.collect_set(F.struct("at", "coarse", "contents")).alias("runs")))
    near = maybe_in(docs, fixed_filter(lists)).where("maybe").select("doc", "text").dropDuplicates(["doc"]).join(lists, "doc")

    def work(data, ends, rows):
        of, at, text, coarse, contents = [], [], [], [], []
        begin, count = [], []
        value, bounds = words(data, ends)
        for i, found in enumerate(rows.column(2).to_pylist()):
            for x in found:
                a, n = x["at"] // LENGTH, x["at"] % LENGTH + 1
                if x["contents"]:
                    a += int(ends[i])
                    of.append(i), at.append(x["at"]), text.append(data[a : a + n - 1 + LENGTH].tobytes())
                    coarse.append(x["coarse"]), contents.append(x["contents"])
                else:
                    begin.append((i, a + int(bounds[i]))), count.append(n)
        n_runs = len(of)
        if begin:
            which, start = np.array(begin).T
            n = np.array(count)
            start = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            windows, first = np.unique(np.stack([np.repeat(which, n).view(np.uint64), Ranges(value).of(start, start + PASSAGE)]), axis=1, return_index=True)
            of, coarse = [*of, *np.repeat(which, n)[first]], [*coarse, *_signed(windows[1])]
        rest = len(of) - n_runs
        columns = (pa.array([*at, *[0] * rest], pa.int64()), pa.array([*text, *[None] * rest], pa.binary()), np.array(coarse, np.int64), np.array([*contents, *[0] * rest], np.int64))
        return np.array(of, np.int64), columns

    return cut(per_text(near, work, "doc long, at long, text binary, coarse long, contents long", ["doc", "at", "text", "coarse", "contents"]))


def _places_of_anchors(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each run's anchor starts in its bytes, as in runs(): the least gram of its first string."""
    grams = gram_hashes(data, GRAM)
    ordered = grams & ~_LOW | np.arange(len(grams), dtype=np.uint64)
    return (least(ordered, LENGTH - GRAM + 1)[ends[:-1]] & _LOW).astype(np.int64) - ends[:-1]


#: Stands for a column in which a text has no symbol; it equals nothing.
_NOTHING = 256


def aligned_repeats(texts: list[bytes], group: np.ndarray, length: int = LENGTH, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of each string of ``length`` bytes that another text of the same group has at the same distance from its anchor.

    Column by column, every text's symbol is inserted: the texts of a group are
    kept in the order of what has been inserted, read backwards, with the
    common length of each and the one before it. The new symbols read in that
    order are the round's column of the collection's positional transform; a
    stable sort by them makes the next order. The common length of two texts
    that come together is one more than the least length between them.
    """
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum(size)])
    if places is None:
        places = _places_of_anchors(data, ends)
    first = int(places.max())
    columns = int((size - places).max()) + first
    symbols = np.full((columns, len(texts)), _NOTHING, np.int16)
    of = np.repeat(np.arange(len(texts)), size)
    symbols[np.arange(len(data)) - ends[of] - places[of] + first, of] = data
    order = np.argsort(group, kind="stable")
    rank = np.unique(group, return_inverse=True)[1].astype(np.int32) * (_NOTHING + 1)
    common = np.zeros(len(texts) + 1, np.int32)  # of each text in order and the one before; the last is a stop
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(columns):
        transform = symbols[c][order]
        key = rank[order] + transform
        step = np.argsort(key, kind="stable")
        key = key[step]
        together = np.nonzero((key[1:] == key[:-1]) & (key[1:] % (_NOTHING + 1) != _NOTHING))[0] + 1
        new = np.zeros(len(texts) + 1, np.int32)
        if len(together):
            between = np.stack([step[together - 1] + 1, step[together] + 1], axis=1).ravel()
            new[together] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[step], new
        longest = np.maximum(common[:-1], common[1:])
        hit = order[longest >= length]
        if len(hit):
            found.append((hit, c - first + places[hit] - length + 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stretches(edges: DataFrame) -> DataFrame:
    """(doc, at) of the repeated strings of runs, neighbours put together; each anchor's runs meet in one task."""
    placed = edges.repartition("coarse").sortWithinPartitions("coarse").select("doc", "at", "text", "coarse")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        doc, at, text, coarse = zip(*rows)
        of, start = aligned_repeats(list(text), np.array(coarse, np.int64))
        o = np.lexsort((start, of))
        of, start = of[o], start[o]
        new = np.nonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)]))[0] if len(of) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(of)))
        run = of[new]
        whole = np.array(at, np.int64)[run] // LENGTH + start[new]
        return pa.RecordBatch.from_arrays([pa.array(np.array(doc, np.int64)[run]), pa.array(places(whole, count))], ["doc", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= ALIGNED:
                last = next(i for i in range(len(held), 0, -1) if i == 1 or held[i - 2][3] != held[-1][3]) - 1  # the group that may go on
                if last:
                    yield solve(held[:last])
                    held = held[last:]
        if held:
            yield solve(held)

    return placed.mapInArrow(run, "doc long, at long")


def _cells_of(edges: DataFrame) -> DataFrame:
    """Rows of the cells of each run; ``at`` is the run's first start, then the cell in the run."""

    def work(data, ends, rows):
        at = rows.column(2).to_numpy(zero_copy_only=False)
        base, n = at // LENGTH, at % LENGTH + 1
        place = _places_of_anchors(data, ends)
        # cells by the start's distance to the anchor
        first, last = -place // CELL, (n - 1 - place) // CELL
        count = last - first + 1
        of = np.repeat(np.arange(len(n)), count)
        cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[of]
        a, b = np.maximum(cell * CELL + place[of], 0), np.minimum(cell * CELL + CELL - 1 + place[of], n[of] - 1)
        shared = ends[of] + place[of] + cell * CELL
        coarse = Ranges(data).of(shared + CELL - 1, shared + LENGTH) ^ _mix((cell + (1 << 20)).astype(np.uint64))
        fine = Ranges(data, _A, 3).of(ends[of] + a, ends[of] + b + LENGTH) ^ _mix((a - place[of] + (1 << 20)).astype(np.uint64))
        return of, (places(base[of] * LENGTH + a, b - a + 1), _signed(coarse), _signed(fine))

    return per_text(edges.select("doc", "text", "at"), work, _ROWS, ["doc", "at", "coarse", "fine"])


def _cell_places(cells: DataFrame) -> DataFrame:
    """Cells' ``at`` as first start in the document and count."""
    run, first = F.expr(f"at DIV {LENGTH * LENGTH}"), F.expr(f"(at DIV {LENGTH}) % {LENGTH}")
    return cells.select("doc", ((run + first) * LENGTH + F.expr(f"at % {LENGTH}")).alias("at"))


def _strings_of(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of the strings of the given cells, one by one."""
    lists = cells.groupBy("doc", F.expr(f"at DIV {LENGTH * LENGTH}").alias("base")).agg(F.collect_set(F.expr(f"at % {LENGTH * LENGTH}")).alias("cells"))
    both = edges.withColumn("base", _start("at")).join(lists, ["doc", "base"]).select("doc", "text", "at", "cells")

    def work(data, ends, rows):
        of, at, start = [], [], []
        for i, (run, cells) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())):
            for c in cells:
                s = np.arange(c // LENGTH, c // LENGTH + c % LENGTH + 1)
                of.append(np.full(len(s), i)), start.append(s + run // LENGTH), at.append(s + ends[i])
        of, at, start = map(np.concatenate, (of, at, start))
        coarse, fine = (Ranges(data, b, seed).of(at, at + LENGTH) for b, seed in ((_B, 2), (_A, 3)))
        return of, (places(start, 1), _signed(coarse), _signed(fine))

    return per_text(both, work, _ROWS, ["doc", "at", "coarse", "fine"])


def repeated(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc, spans, shares_passage): for each document that loses bytes, arrays of (start, end) that cover them, and the documents that share a passage; input (doc, text binary)."""
    every = _runs_of(docs)
    known = counted(every)
    in_words = F.col("coarse").bitwiseAND(1) == 1
    contents = known.where(in_words & (F.col("low") != F.col("high")))
    near = _edges(docs, known.where(~in_words & F.col("open")), contents.where("apart"))
    edges, windows = near.where("contents > 0"), near.where("contents = 0").select("doc", "coarse")
    crowded = edges.where(F.col("contents") > crowd).select("doc", "at", "text")
    cells = cut(_cells_of(crowded))
    inner = counted(cells)
    strings = cut(_strings_of(crowded, inner.where("open").select("doc", "at")))
    alike = strings.groupBy("coarse", "fine").agg(F.count("*").alias("n")).where("n > 1")
    found = whole(every.where(~in_words), known.where(~in_words & (F.col("n") > 1))).unionByName(_stretches(edges.where(F.col("contents") <= crowd)))
    found = found.unionByName(_cell_places(whole(cells, inner.where("n > 1")))).unionByName(whole(strings, alike))
    # a window of words counts where another document has it, be it in a run that others share whole or not
    common = windows.groupBy("coarse").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first <> last").select("coarse", "n")
    sharing = whole(every.where(in_words), contents.where("doc <> last")).select("doc")
    sharing = sharing.unionByName(spread_join(windows, common, ["coarse"], "n", windows.count(), "left_semi").select("doc"))
    span = F.struct(_start("at").alias("start"), (_start("at") + _count("at") - 1 + LENGTH).alias("end"))
    marks = found.select("doc", span.alias("span"), F.lit(False).alias("shares")).unionByName(sharing.select("doc", F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"), F.lit(True).alias("shares")).distinct())
    return marks.groupBy("doc").agg(F.collect_set("span").alias("spans"), F.max("shares").alias("shares_passage"))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, key): the text's bytes, and a number for the row's key and text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.col(key), whole).alias("doc"), F.encode(whole, "utf-8").alias("text"), F.col(key))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True, crowd: int = CROWD) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, shares_passage and, unless left out, the kept bytes."""
    mine = keyed(docs, key, text)
    marks = cut(repeated(mine.select("doc", "text"), crowd))
    flagged = maybe_in(mine, fixed_filter(marks))
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"] + ["kept"] * with_bytes
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean" + ", kept binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, at, n = [], 0, 0
                for a, b in _merged(cuts or []):
                    kept.append(whole[at:a])
                    at, n = b, n + 1
                left = b"".join([*kept, whole[at:]])
                rows.append((len(whole), len(whole) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            a, b, n, h, left = zip(*rows) if rows else ((),) * 5
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (a, b, n)), pa.array(h, pa.string()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(left, pa.binary())] * with_bytes, names)

    small_batches(docs.sparkSession)
    clean = flagged.where("NOT maybe").select(key, "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(False).alias("shares_passage"))
    dirty = flagged.where("maybe").select("doc", key, "text").join(marks, "doc", "left").select(key, "text", "spans", F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))
    return clean.mapInArrow(run, schema).unionByName(dirty.mapInArrow(run, schema))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal spans; those that touch make one run of removed bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"), with_bytes=False)
