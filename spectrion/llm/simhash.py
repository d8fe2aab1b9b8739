"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are computed in a map over the documents. The distinct ones are
dealt to index roots: a root is a mask of shared bits (some of the blocks of
the 64) and their pattern. Two fingerprints that differ in at most four bits
agree on all blocks but four at least, so each link meets under some root, and
a row per root and fingerprint is all that is shuffled. The number of blocks
follows the number of fingerprints, so that a root of random ones stays small
at any size: five blocks (5 roots of 12 or 13 bits) up to ``FEW`` of them, six
(15 roots of 21 or 22 bits) up to a thousand times as many, eight (70 roots of
32 bits) beyond. Every choice finds every link.

Under a root, fingerprints lie in Gray order (neighbours differ in few bits)
and are packed into nodes of ``FANOUT``, level by level. A node holds the mask
and pattern of the bits that all below it share. The search starts from pairs
of top nodes and goes down; a pair's accumulated difference is the parent's
plus the differing bits that the parents had not shared yet, and a pair over
the limit is pruned with all below it. Only connectivity is needed, so each
root yields a spanning forest and not its links. A crowded root is dealt out
over pairs of hashed parts, so that no task holds more than two parts and no
link is lost. Components join the forests by star contraction with a
checkpoint in the shared folder each round.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; repeated rows each get a row; rows with a null doc_id get
their component's smallest known doc_id, or null where there is none; texts of
any length are shingled whole; an empty table gives an empty one; other
columns are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fixed_filter, maybe_in, small_batches, spread_join, table

SHINGLE = 4
SEED = 42
LIMIT = 4

#: Children of an index node.
FANOUT = 32

#: Fingerprints in one part of a crowded root.
PART = 8192

#: Fingerprints up to which a root needs few bits: about PART in a root of five blocks.
FEW = 1 << 25


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles; ASCII letters in lower case."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        pairs = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64)
    else:
        h = np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((t or "").encode()) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, fp long")


def masks(n_blocks: int, limit: int = LIMIT) -> list[int]:
    """Masks of the bits that a root shares: all blocks but ``limit`` of ``n_blocks`` that make up the 64 bits."""
    widths = [64 // n_blocks + (i < 64 % n_blocks) for i in range(n_blocks)]
    block = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    return [sum(chosen) for chosen in combinations(block, n_blocks - limit)]


def n_blocks(codes: int, limit: int = LIMIT) -> int:
    """Blocks for so many fingerprints."""
    return limit + (1 if codes <= FEW else 2 if codes <= 1000 * FEW else 4)


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence."""
    for s in (32, 16, 8, 4, 2, 1):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def _nodes(mask: np.ndarray, pattern: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The level above: (mask, pattern, group, first child) of nodes of FANOUT children each."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.nonzero(first)[0]
    place = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
    start = np.nonzero(place % FANOUT == 0)[0]
    agreed = np.bitwise_and.reduceat(pattern, start)
    either = np.bitwise_or.reduceat(pattern, start)
    shared = np.bitwise_and.reduceat(mask, start) & ~(agreed ^ either)
    return shared, agreed & shared, group[start], start


def _all_pairs(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i <= j within each range."""
    left = np.repeat(np.arange(size.sum()), np.repeat(size, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)))
    counts = np.repeat(size, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    right = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    offset = np.repeat(begin - (np.cumsum(size) - size), size)
    return left + offset[left], left + offset[left] + right


def forest(codes: np.ndarray, group: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each code (sorted by group, then Gray rank) the index of its local component's representative."""
    n = len(codes)
    root = np.arange(n)
    if n < 2:
        return root
    levels = [(np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), codes, group, np.arange(n + 1))]
    while True:
        mask, pattern, g, start = _nodes(*levels[-1][:3])
        levels.append((mask, pattern, g, np.append(start, len(levels[-1][1]))))
        if len(g) == 1 or np.all(g[1:] != g[:-1]):
            break
    size = np.ones(len(levels[-1][1]), dtype=np.int64)
    a, b = _all_pairs(np.arange(len(size)), size)
    stack = [(len(levels) - 1, a, b, np.zeros(len(a), dtype=np.uint8), np.zeros(len(a), dtype=np.uint64))]
    while stack:
        level, a, b, spent, seen = stack.pop()
        if len(a) > 65536:
            stack += [(level, a[i : i + 65536], b[i : i + 65536], spent[i : i + 65536], seen[i : i + 65536]) for i in range(0, len(a), 65536)]
            continue
        mask, pattern, _, start = levels[level]
        shared = mask[a] & mask[b]
        spent = spent + np.bitwise_count((pattern[a] ^ pattern[b]) & shared & ~seen).astype(np.uint8)
        keep = spent <= limit
        if not level:
            keep &= root[a] != root[b]
            _unite(root, a[keep], b[keep])
            continue
        a, b, spent, seen = a[keep], b[keep], spent[keep], shared[keep]
        if not len(a):
            continue
        # children of a times children of b; of a pair with itself only i <= j
        na, nb = start[a + 1] - start[a], start[b + 1] - start[b]
        total = na * nb
        which = np.repeat(np.arange(len(a)), total)
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        ca, cb = start[a][which] + k // nb[which], start[b][which] + k % nb[which]
        keep = ca <= cb if level > 1 else ca < cb
        stack.append((level - 1, ca[keep], cb[keep], spent[which][keep], seen[which][keep]))
    return _flat(root)


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root[:] = up


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        _flat(root)
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def links(codes: DataFrame, limit: int = LIMIT, part: int = PART, *, split: int | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all links among the distinct codes in column ``fp``."""
    spark = codes.sparkSession
    small_batches(spark)
    total = codes.count()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(split or n_blocks(total, limit), limit)]
    roots = [F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(signed)]
    dealt = codes.select("fp", F.explode(F.array(*roots)).alias("r")).select("fp", "r.block", "r.value")
    crowd = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.col("parts")).cast("int")
    tasks = (
        spread_join(dealt, cut(crowd), ["block", "value"], "n", total * len(signed))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("fp", "block", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )
    keys = ["block", "value", "p", "q"]
    placed = tasks.repartition(*keys).sortWithinPartitions(*keys, gray_rank(F.col("fp")))

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        fp, *key = cols
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        root = forest(fp.view(np.uint64), np.cumsum(new), limit)
        linked = np.nonzero(root != np.arange(len(fp)))[0]
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= 100_000:
                cols = [np.concatenate(c) for c in zip(*held)]
                last = np.all([k == k[-1] for k in cols[1:]], axis=0)  # the group that may go on in the next batch
                whole = rows - int(last.sum())
                if whole:
                    yield solve([c[:whole] for c in cols])
                held, rows = [[c[whole:] for c in cols]], rows - whole
        if rows:
            yield solve([np.concatenate(c) for c in zip(*held)])

    return placed.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of (u, v) edges but the roots: alternating large and small stars to a fixpoint."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == state:
            return edges.select("u", F.col("v").alias("root"))
        state = tuple(now)


def classes(fps: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(key, fp, component_id) for each row of (key, fp)."""
    fps = cut(fps)  # two numbers a row; without it each text would be shingled twice
    distinct = cut(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    linked = components(links(distinct.select("fp"), limit))
    rooted = cut(distinct.join(linked.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    found = spread_join(rooted, cut(smallest), ["root"], "members", distinct.count()).select("fp", "n", "component_id")
    return spread_join(fps, cut(found), ["fp"], "n", fps.count()).select(key, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one document stays, that with the smallest doc_id; rows without doc_id stay.

    Rows count by doc_id and text, known by two hashes of both, so different texts under one doc_id are
    judged apart; of the smallest doc_id's texts the one with the least hash
    stays, and of repeated rows one. Only rows that may go are shuffled.
    """
    known = docs.where("doc_id IS NOT NULL")
    own = F.struct(F.xxhash64("doc_id", "text").alias("doc"), F.xxhash64(F.lit(1), "doc_id", "text").alias("doc2"))
    found = classes(fingerprints(known.select(F.struct("doc_id", own.alias("own")).alias("key"), "text"), "key"), "key")
    state = found.groupBy(F.col("key.own").alias("own")).agg(F.max(F.col("key") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    doubtful = cut(state.where("NOT stays OR n > 1").select("own.*", "stays"))
    rows = maybe_in(known.select(F.struct(*docs.columns).alias("row"), own.alias("own")).select("row", "own.*"), fixed_filter(doubtful))
    judged = rows.where("maybe").select("row", "doc", "doc2").join(doubtful, ["doc", "doc2"], "left")
    repeated = judged.where("stays").groupBy("doc", "doc2").agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in docs.columns])).alias("row"))
    out = rows.where("NOT maybe").select("row").unionByName(judged.where("stays IS NULL").select("row")).unionByName(repeated.select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
