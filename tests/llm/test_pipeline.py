"""The whole pipeline against a plain-Python version on a small corpus."""

import hashlib
import random

from test_operators import DOCS, brute_components, brute_fingerprint, prose

import corpus_pipeline
from spectrion.llm import byte_bpe, quality_rules, secrets_scan


def test_pipeline(spark, tmp_path):
    item = "Every careful reader of this long question knows that the answer lies hidden under seven old stones near the quiet river bank tonight"
    base = [prose(i, 120) for i in range(12)]
    texts = base + [base[0], base[1] + " extra", prose(50, 60) + " " + item + " " + prose(51, 60), base[2] + ' token = "abcdefgh12345"', prose(52, 90) + " password: qwertyuiop", "too short", None, "a b c d e f g h " * 30]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = [(i, t) for i, t in enumerate(texts) if t and len(t.split()) >= 20 and not t.startswith("a b c d")]
    codes = [brute_fingerprint(t) for _, t in good]
    good = [good[k] for k in sorted(set(brute_components(codes)))]
    good = [(i, t) for i, t in good if item not in t]
    expected = {}
    codec = byte_bpe.codec(*byte_bpe.default_vocabulary())
    for i, t in good:
        for a, b in reversed(secrets_scan.merged(secrets_scan.scan(t))):
            t = t[:a] + "[SECRET]" + t[b:]
        expected[i] = codec.encode(t), hashlib.sha256(t.encode()).hexdigest()

    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "secret_scan", "byte_bpe"]
    assert quality_rules.RULES[0].name == "few_words"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, and an empty table."""
    long = prose(70, 60_000)
    rows = [(None, prose(60, 80)), (5, prose(61, 80)), (5, prose(62, 80)), (5, prose(62, 80)), (6, None), (7, ""), (8, long)]
    spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for d in "ab":
        spark.createDataFrame([(0, prose(90, 40)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / d / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    kept = [(None, rows[0][1]), (5, rows[1][1]), (5, rows[2][1]), (8, long)]
    kept = [(i, t) for i, t in kept if t is not long or quality_rules.judge(spark.createDataFrame([(t,)], "text string")).first()["broken_rules"] == []]
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in got), key=str) == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept), key=str)
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
