"""A corpus pipeline in stages; each stage's result is written as Parquet and read again.

Defined results: an empty table gives an empty one; a null text has no words
and goes in the first stage; rows with a null or repeated doc_id are kept as
each stage states; columns beyond those of ``documents`` are carried along up
to the last stage, which returns the key and the tokens. A stage's table is
deleted once the next one is written, and the tables that it made on the way
with it; the last stage's table stays for the caller.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from spectrion.llm import byte_bpe, decontamination, quality_rules, secrets_scan, simhash
from spectrion.llm.common import delete, scratch, shared_folder

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontamination.stage),
    ("secret_scan", secrets_scan.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: XXH64 and byte-pair merges have no DuckDB form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    last = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            delete(spark, last)
        last = path
    return docs
