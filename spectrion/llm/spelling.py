"""Spelling variant grouping: words one edit apart, found by dynamic programming over sorted lists.

Words are counted in a map with a combiner and one aggregation. Two words at
one edit, the shorter of m letters, share the first m // 2 letters or the
rest, so each word is dealt to four lists: by either part as the shorter one
and as the longer one. A list that is still crowded is dealt again by halves
of the letters that its words don't share, until lists are small or their
words share all letters but one; so no list is unbounded, no list is cut and
no pair is lost.

A list is sorted and its letters beyond the shared part form ranges of equal
beginnings, bounded by the common prefixes of neighbours. For each word of the
list, the three cells of the edit matrix around the diagonal are worked out
once for a range, taken over by all entries in it, and a range whose cells all
exceed one edit is left out with all its entries. Ranges of all lists of a
batch are advanced letter by letter together, in numpy.

Defined results: a null text has no words; a null doc_id counts as an empty
one in the hash; words of any length and texts of any length are taken whole;
repeated rows count twice; ties for the form go to the smaller word by code
points; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, stored, table

LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2

#: A form is at least so many times as frequent.
TIMES = 10

#: One in so many (document, word) pairs loses a letter.
SPOILT = 31

#: Words in a list that isn't dealt again.
CROWDED = 4096

#: Distinct words that a task counts before it passes them on.
HELD = 100_000

#: (word, range) pairs that are advanced at once.
STEPS = 1 << 18


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, spoilt: int | None = SPOILT) -> DataFrame:
    """(word, n) of all runs of letters; with ``spoilt`` one in so many (document, run) pairs loses the letter that its hash names."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{least_letters},}}")
        total: Counter[str] = Counter()
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                lowered = (t or "").encode().lower().decode()  # bytes.lower leaves all but A-Z alone
                for word, n in Counter(runs.findall(lowered)).items():
                    if spoilt and not (h := zlib.crc32(word.encode(), head)) % spoilt:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) >= HELD:
                    yield counts(total)
                    total.clear()
        if total:
            yield counts(total)

    def counts(total: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(key), F.col(text)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def lists(words: DataFrame) -> DataFrame:
    """(m, a, b, part, word, n): the word in the lists of pairs whose shorter word has m letters; ``a`` letters at the front and ``b`` at the back are shared."""
    size = F.length("word")
    dealt = []
    for longer in (0, 1):
        m = size - longer
        front = F.floor(m / 2).cast("int")
        dealt += [F.struct(m.alias("m"), front.alias("a"), F.lit(0).alias("b")), F.struct(m.alias("m"), F.lit(0).alias("a"), (m - front).alias("b"))]
    return shared_part(words.select("word", "n", F.explode(F.array(*dealt)).alias("d")).select("word", "n", "d.*"))


def shared_part(rows: DataFrame) -> DataFrame:
    part = F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit(" "), F.substring("word", F.length("word") - F.col("b") + 1, F.col("b")))
    return rows.withColumn("part", part)


LIST = ["m", "a", "b", "part"]


def dealt_small(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """All lists, each small or of words that share all letters of the shorter one but one; lists of one word are left out."""
    rows, done = lists(words), None
    while True:
        rows = stored(rows)
        sizes = rows.groupBy(*LIST).agg(F.count("*").alias("size")).where("size > 1")
        open_letters = F.col("m") - F.col("a") - F.col("b")
        full = stored(sizes.where((F.col("size") > crowded) & (open_letters > 1)).select(*LIST))
        small = rows if full.isEmpty() else rows.join(full, LIST, "left_anti")
        done = small if done is None else done.unionByName(small)
        if full.isEmpty():
            return done
        half = F.floor(open_letters / 2).cast("int")
        finer = F.array(F.struct((F.col("a") + half).alias("a"), "b"), F.struct("a", (F.col("b") + open_letters - half).alias("b")))
        again = rows.join(full, LIST).select("word", "n", "m", F.explode(finer).alias("d"))
        rows = shared_part(again.select("word", "n", "m", "d.*"))


def one_edit(letters: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows at exactly one edit in the same group; rows are sorted by group, then by letters (padded with zeros), distinct in a group."""
    n, width = letters.shape
    letters = np.hstack([letters, np.zeros((n, 3), letters.dtype)])
    new = np.ones(n + 1, bool)
    new[1:n] = group[1:] != group[:-1]
    low = np.nonzero(new)[0]  # ranges [low[r], low[r + 1]) of equal beginnings
    query = np.arange(n)
    where = np.cumsum(new[:n]) - 1
    far = np.int8(2)
    # cells (depth, depth - 1), (depth, depth) and (depth, depth + 1) of the edit matrix of entry and query
    cells = [np.full(n, far), np.zeros(n, np.int8), np.ones(n, np.int8)]
    left, right = [], []
    for depth in range(width):
        # children: the ranges that one more letter makes; entries that have ended sort first in their range and have none
        split = new.copy()
        split[1:n] |= letters[1:, depth] != letters[:-1, depth]
        starts = np.nonzero(split[:n])[0]
        alive = letters[starts, depth] != 0
        kids = starts[alive]
        if not len(kids) or not len(query):
            break
        first, last = np.searchsorted(kids, low[where]), np.searchsorted(kids, low[where + 1])
        kept = []
        many = last - first
        ends = np.cumsum(many)
        begin = 0
        while begin < len(query):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEPS, "right")))
            of = np.repeat(np.arange(begin, stop), many[begin:stop])
            kid = first[of] + np.arange(len(of)) - np.repeat(ends[begin:stop] - many[begin:stop] - (ends[begin - 1] if begin else 0), many[begin:stop])
            q, letter = query[of], letters[kids[kid], depth]
            c0, c1, c2 = (c[of] for c in cells)
            before = letters[q, depth - 1] if depth else np.zeros(len(q), letters.dtype)
            n0 = np.minimum(c0 + (before != letter), c1 + 1)
            n1 = np.minimum(np.minimum(c1 + (letters[q, depth] != letter), c2 + 1), n0 + 1)
            n2 = np.minimum(c2 + (letters[q, depth + 1] != letter), n1 + 1)
            n1[depth + 1 > size[q]] = far
            n2[depth + 2 > size[q]] = far
            near = (n0 <= 1) | (n1 <= 1) | (n2 <= 1)
            kept.append([x[near] for x in (q, kid, n0, n1, n2)])
            begin = stop
        query, kid, *cells = (np.concatenate(x) for x in zip(*kept))
        cells = [np.minimum(c, far).astype(np.int8) for c in cells]
        # an entry that ends here is the first of its range
        entry = kids[kid]
        over = size[query] - (depth + 1)
        last_cell = np.select([over == -1, over == 0, over == 1], cells, far)
        hit = (size[entry] == depth + 1) & (last_cell == 1)
        left.append(query[hit])
        right.append(entry[hit])
        # the next letter's ranges, numbered like kids; a start without a letter bounds the one before it
        new = np.zeros(n + 1, bool)
        new[starts], new[n] = True, True
        low = np.nonzero(new)[0]
        where = np.searchsorted(low, kids)[kid]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word, near, near_n), each pair of (word, n) rows at one edit both ways, once."""
    rows = dealt_small(words, crowded)
    small_batches(words.sparkSession)
    placed = rows.repartition(*LIST).sortWithinPartitions(*LIST, "word")

    def solve(given: pa.Table) -> pa.RecordBatch:
        word = given.column("word").to_numpy()
        m, a, b, part = (given.column(c).to_numpy() for c in LIST)
        new = np.ones(len(word), bool)
        for key in (m, a, b, part):
            new[1:] &= key[1:] == key[:-1]
        new[1:] = ~new[1:]
        new[0] = True
        group = np.cumsum(new) - 1
        some = np.bincount(group)[group] > 1
        index = np.nonzero(some)[0]
        if not len(index):
            return pairs(word, given, index, index)
        open_part = [w[i : len(w) - j] for w, i, j in zip(word[index], a[index], b[index])]
        size = np.array([len(x) for x in open_part])
        width = int(size.max())
        text = "".join(x.ljust(width, "\0") for x in open_part)
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(index), width)
        order = np.lexsort([*letters.T[::-1], group[index]])  # words with a shared back aren't sorted without it
        i, j = one_edit(letters[order], size[order], group[index][order])
        return pairs(word, given, index[order[i]], index[order[j]])

    def pairs(word: np.ndarray, given: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        n = given.column("n").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(word[i], pa.string()), pa.array(word[j], pa.string()), pa.array(n[j], pa.int64())], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * crowded:
                whole = pa.Table.from_batches(held)
                same = np.ones(rows, bool)
                for c in LIST:
                    column = whole.column(c).to_numpy()
                    same &= column == column[-1]
                done = rows - int(same.sum())  # the last list may go on
                if done:
                    yield solve(whole.slice(0, done))
                held = whole.slice(done).to_batches()
                rows -= done
        if rows:
            yield solve(pa.Table.from_batches(held))

    found = placed.select(*LIST, "word", "n").mapInArrow(run, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def variants(words: DataFrame, *, times: int = TIMES, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of (word, n)."""
    words = stored(words)
    best = near_words(words, crowded).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b"))
    joined = words.join(best, "word", "left")
    good = -F.col("b.minus") >= times * F.col("n")
    known = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.minus")).alias("form_n"))
    )
    # each step is at least ``times`` as frequent, so chains are short; jumps double
    jump = cut(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(jump.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jump = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return known.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents")))
