"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a native Spark expression over the row's own text, so the
operator is a map without a shuffle and runs inside the scan stage.

Defined results: a null text is an empty text; an empty or blank text has no
words and fails ``min_words``; repeated rows are judged one by one; columns
beyond the text are passed through and metric names never clash with them
(the metrics come in one struct column that the caller names); texts of any
length are measured whole; an empty table gives an empty one. The rule of stop
words knows those of four languages (``STOP_WORDS``) and so rejects prose of
others; a corpus of more languages gives ``rules`` without it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, table

WINDOW = 8

#: Stop words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for on with as was at by it from be are this "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur avec "
    "el y los se del las una por con no para es al lo como su"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text whose metric is outside [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The table of thresholds. Base rules come first, by the metric's exact integer form.
RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_windows", "repeat_percent", high=30.0),
    Rule("word_length", "mean_word_chars", low=2.0, high=30.0),
    Rule("symbols", "symbols_per_word", high=0.5),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("stop_words", "stop_ratio", low=0.02),
)
BASE = ("few_words", "repeated_windows")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by a window of ``width`` words that occurs twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))

    def repeated(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        starts = let(
            F.sort_array(pairs),
            lambda s: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda j: (F.get(s, j - 1)["h"] == F.get(s, j)["h"]) | (F.get(s, j + 1)["h"] == F.get(s, j)["h"]),
                ),
                lambda j: F.get(s, j)["i"],
            ),
        )
        # each repeated window covers up to the next one's start, the last one its whole width
        return let(
            F.sort_array(starts),
            lambda d: F.aggregate(
                F.sequence(F.lit(0), F.size(d) - 1),
                F.lit(0).cast("long"),
                lambda acc, j: acc + F.least(F.lit(width), F.coalesce(F.get(d, j + 1) - F.get(d, j), F.lit(width))),
            ),
        )

    none = F.lit(0).cast("long")
    return F.when(n < width, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(repeated(h)))
    )


def measures(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        ).alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
    )


def flat(m: str) -> list[Column]:
    return [
        F.col(f"{m}.w.n_words"), F.col(f"{m}.w.word_chars"), F.col(f"{m}.n_symbols"), F.col(f"{m}.l.n_dup_lines"),
        F.col(f"{m}.w.n_repeat_words"), F.col(f"{m}.w.n_stop_words"), F.col(f"{m}.l.n_lines"),
    ]


def metrics(m: Column) -> dict[str, Column]:
    """The ratios that the threshold table names, over the struct of counts."""
    n = m["w"]["n_words"]
    return {
        "n_words": n,
        "repeat_percent": F.try_divide(m["w"]["n_repeat_words"] * 100, n),
        "mean_word_chars": F.try_divide(m["w"]["word_chars"], n),
        "symbols_per_word": F.try_divide(m["n_symbols"], n),
        "dup_line_ratio": F.try_divide(m["l"]["n_dup_lines"], m["l"]["n_lines"]),
        "stop_ratio": F.try_divide(m["w"]["n_stop_words"], n),
    }


def broken(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a text breaks; a ratio over nothing breaks none."""
    known = metrics(m)
    tests = []
    for r in rules:
        x = known[r.metric]
        out = F.lit(False)
        if r.low is not None:
            out = out | (x < r.low)
        if r.high is not None:
            out = out | (x > r.high)
        tests.append(F.when(F.coalesce(out, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, measured: str = "_m", verdict: str = "broken_rules") -> DataFrame:
    """All columns of ``docs``, the counts in struct ``measured`` and the broken rules in ``verdict``; columns of these names are replaced."""
    return docs.withColumn(measured, measures(F.col(text))).withColumn(verdict, broken(F.col(measured), rules))


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that break no rule. The counts are one lambda variable, so the filter measures each text once."""
    return docs.where(F.size(let(measures(F.col(text)), lambda m: broken(m, rules))) == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.arrays_overlap("broken_rules", F.array(*map(F.lit, BASE)))
    return judged.select("doc_id", *flat("_m"), base.alias("base_failed"), (F.size("broken_rules") == 0).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that break a rule go."""
    return passing(docs)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (
    SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w))),
c AS (SELECT r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
    len(l)::BIGINT AS n_lines FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR word_chars < 2.0 * n_words OR word_chars > 30.0 * n_words OR n_symbols > 0.5 * n_words
    OR n_dup_lines > 0.5 * n_lines OR n_stop_words < 0.02 * n_words) AS kept FROM b
"""
