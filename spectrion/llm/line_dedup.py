"""Line dedup over documents: lines that several documents hold stay in one of them.

Lines are exploded with their positions and normalised (white space off both
ends, ASCII letters in lower case); a line is known by two 64-bit hashes of
its key from there on, so line texts are never shuffled. Documents are counted
per hash over distinct (hash, document) pairs, which no hot line can pile up
in one task. Positions to drop come from a join with the hashes over the
threshold, whose hot ones are broadcast and the rest shuffled, and meet the
documents once, as one sorted array of positions a row; the lines between
them are put together again by slices. Native Spark only.

Defined results: a null text is an empty text, which is one empty line; a
text whose lines all go is empty; rows of one doc_id are one document, so a
key that only they hold stays in all of them; rows without doc_id are one
document that comes after all others; repeated rows each get a row; keys
under ``least_chars`` code points stay everywhere; texts of any length are
split whole; an empty table gives an empty one; other columns are kept, and
result columns take the names that the caller gives.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, spread_join, stored, table

BLANKS = " \t\n\x0b\x0c\r"

LEAST_CHARS = 10
LEAST_DOCS = 2


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; texts of one byte a character take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """(doc, t1, t2, pos, h1, h2) for each line that may go; the row is known by its key and two hashes of its text."""
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = rows.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= least_chars)
    return keyed.select("doc", "t1", "t2", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, first, n_docs, n_lines) of keys in at least so many documents; ``first`` is the smallest."""
    per_doc = lines.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
    per_key = per_doc.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))
    return per_key.where(F.col("n_docs") >= least_docs)


def between(lines: Column, gone: Column) -> Column:
    """The lines that are not at the sorted positions ``gone``: a slice for each gap, so time is linear in the lines."""
    n = F.size(gone)

    def gap(i: Column) -> Column:
        start = F.coalesce(F.get(gone, i - 1), F.lit(-1)) + 1
        return F.slice(lines, start + 1, F.coalesce(F.get(gone, i), F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), n), gap))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, kept: str = "kept_text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All columns of ``docs``, the text without shared lines, and the counts of lines before and of lines dropped."""
    lines = stored(keyed_lines(docs, key, text, least_chars))  # six numbers a line, read three times
    shared = stored(shared_lines(lines, least_docs))
    total = shared.agg(F.sum("n_lines")).first()[0] or 0
    held = spread_join(lines, shared, ["h1", "h2"], "n_lines", total)
    gone = held.where(~F.col("doc").eqNullSafe(F.col("first"))).groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    own, row = fresh(docs, "own"), fresh(docs, "row")
    rows = docs.select(F.struct(F.col(key).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).alias(own), F.struct(*docs.columns).alias(row))
    side = gone.select(F.struct("doc", "t1", "t2").alias("of"), "gone")
    met = rows.join(side, F.col(own).eqNullSafe(F.col("of")), "left")
    t = F.col(row)[text]
    judged = met.select(
        row,
        let(
            lines_of(t),
            lambda x: F.struct(
                F.size(x).cast("long").alias("n"),
                F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("dropped"),
                F.when(F.col("gone").isNull(), F.coalesce(t, F.lit(""))).otherwise(F.array_join(between(x, F.col("gone")), "\n")).alias("kept"),
            ),
        ).alias("made"),
    )
    results = {kept: "kept", n_lines: "n", n_dropped: "dropped"}
    return judged.select(*[F.col(row)[c].alias(c) for c in docs.columns if c not in results], *[F.col("made")[v].alias(k) for k, v in results.items()])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
s AS (SELECT k, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS n, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k),
j AS (SELECT r, pos, line, coalesce(n >= 2 AND doc_id IS DISTINCT FROM first, false) AS gone FROM k LEFT JOIN s USING (k))
SELECT doc_id, len(lines)::BIGINT AS n_lines, n_dropped, kept_sha256 FROM d JOIN (
    SELECT r, sum(gone::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r) USING (r)
"""
