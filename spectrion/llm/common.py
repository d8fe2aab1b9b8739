"""Helpers shared by the training-data operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrion.session import let_workers_import

#: White space of the word contracts: blank and the controls 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch, but for a longer row. Texts may be long, so a batch must stay small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}

#: Bits of a filter of keys: about 2 MB when broadcast.
FILTER_BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python task holds, and let its worker import this package.

    Spark reads the bounds when a plan runs, so they stay set; they change no
    result, and lower bounds of the session's own are left as they are.
    """
    let_workers_import(spark)
    for name, most in BATCH.items():
        known = spark.conf.get(name).lower().removesuffix("b")
        if not known.isdigit() or not 0 < int(known) <= most:
            spark.conf.set(name, str(most))


def fixed_filter(keys: DataFrame) -> DataFrame:
    """A filter of the numbers in column ``doc`` as rows of 64 bits: FILTER_BITS / 64 rows of two numbers at most, however many keys there are."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(doc, {FILTER_BITS}) % 64 AS int))")
    word = F.expr(f"cast(pmod(doc, {FILTER_BITS}) DIV 64 AS int)")
    return keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Column ``maybe``: false where ``doc`` is surely not in the filter, which is small enough to broadcast at any size of input."""
    word = F.expr(f"cast(pmod(doc, {FILTER_BITS}) DIV 64 AS int)")
    hit = F.expr(f"coalesce(shiftrightunsigned(bits, cast(pmod(doc, {FILTER_BITS}) % 64 AS int)) & 1, 0L) = 1L")
    return rows.withColumn("word", word).join(F.broadcast(bits), "word", "left").withColumn("maybe", hit).drop("word", "bits")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the context was given.

    A temporary folder is set only where a local session has none; a cluster
    without one is an error, since a lost machine would take its data along.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spectrion-"))
        named = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of tables that ``scratch`` deletes, innermost last.
_SCRATCH: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end, so what reads them must be written by then."""
    _SCRATCH.append(posixpath.join(shared_folder(spark), f"scratch-{uuid.uuid4().hex}"))
    try:
        yield
    finally:
        delete(spark, _SCRATCH.pop())


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again; smaller than a checkpoint and read by column."""
    folder = _SCRATCH[-1] if _SCRATCH else shared_folder(df.sparkSession)
    path = posixpath.join(folder, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key counts as heavy with more than this share of all rows, so there are at most so many heavy keys.
HEAVY = 10_000


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or semi join of rows with distinct keys, no key's rows in one task.

    ``weight`` is the number of rows that a key has; the keys with more than a
    ``HEAVY``th of ``total`` are ``HEAVY`` at most and are broadcast, so that
    their rows stay where they are; the rest is shuffled.
    """
    heavy = F.broadcast(keys.where(F.col(weight) > total // HEAVY + 1))
    light = keys.where(F.col(weight) <= total // HEAVY + 1)
    rest = rows.join(heavy.select(*on), on, "left_anti")
    return rows.join(heavy, on, how).unionByName(rest.join(light, on, how))
