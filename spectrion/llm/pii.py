"""Personal data: patterns propose spans, checks confirm them, context words adjust the score.

All of it is native Spark over the row's own text: a map without a shuffle.
A pattern's matches and the pieces between them (``split`` on the same
pattern) give the positions in code points, by sums over blocks of the square
root of their number, so that time grows little faster than the text. Context
is what stands in the pieces next to a span, ``CONTEXT`` characters of each at
most. Patterns carry possessive quantifiers and a look at the character before,
so that Java's matcher neither recurses nor goes back over long runs; they
match what the plain patterns do.

Defined results: a null or empty text has no spans; texts of any length are
scanned whole; repeated rows are scanned each; an empty table gives an empty
one; other columns are passed through by ``scan``, but for one of the name of
its result, which is replaced, and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Characters before and after a span that are searched for context words.
CONTEXT = 40

#: Score from which a span counts as strong.
STRONG = 0.8


@dataclass(frozen=True)
class Kind:
    """``marker``: a text without it has no match. ``score`` is before context; ``near`` are words that raise it."""

    name: str
    pattern: str
    plain: str
    marker: str | None
    score: float
    near: str
    base: bool = True


#: In one piece or in groups of four.
_IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", 0.9, "e-?mail|mail|mailto|contact|kontakt|courriel|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", None, 0.6, "ip|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9]([\x20-]?[0-9])+", None, 0.8, "card|visa|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|telefon|mobile|fax"),
    Kind("iban", _IBAN, _IBAN, None, 0.9, "iban|account|konto|compte|cuenta", False),
)

#: Words that lower a score by as much as context words raise it.
AGAINST = "version|order|invoice|page|isbn|example"
STEP = 0.2


def _as_words(words: str) -> str:
    return f"(^|[^a-z])({words})([^a-z]|$)"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def digit(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN passes the mod-97 check."""
    account = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97))
    return rest == 1


def confirmed(kind: str, span: Column) -> Column:
    """The check of one kind on a matched string."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(span, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.when(F.length(part(p)) <= 3, part(p)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return (F.length(digits) <= 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(span)
    return F.lit(True)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def placed(matches: Column, gaps: Column) -> Column:
    """Array of (start, end, m, before, after) of the matches of one pattern, given the pieces around them."""

    def spans(sizes: Column, width: Column, blocks: Column) -> Column:
        """``sizes`` of piece and match, summed up to a match over whole blocks of ``width`` and then in its own block."""

        def span(m: Column, i: Column) -> Column:
            block = F.floor(i / width).cast("int")
            start = blocks[block] + total(F.slice(sizes, block * width + 1, i % width)) + F.length(gaps[i])
            around = F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(CONTEXT)).alias("after")
            return let(start, lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("m"), *around))

        return F.transform(matches, span)

    def upto(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: total(F.slice(sums, 1, b)))

    def blocked(sizes: Column, width: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.size(sizes), width), lambda first: total(F.slice(sizes, first, width)))
        return let(let(sums, upto), lambda blocks: spans(sizes, width, blocks))

    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    return let(sizes, lambda s: let(F.ceil(F.sqrt(F.size(s))).cast("int"), lambda width: blocked(s, width)))


def proposals(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, end, score, kind) of one kind's confirmed spans, in order."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,score:double,kind:string>>")

    def scored(p: Column) -> Column:
        said = lambda words: F.lower(p["before"]).rlike(_as_words(words)) | F.lower(p["after"]).rlike(_as_words(words))
        score = F.lit(kind.score) + F.when(said(kind.near), STEP).otherwise(0.0) - F.when(said(AGAINST), STEP).otherwise(0.0)
        return F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.round(score, 1).alias("score"), F.lit(kind.name).alias("kind"))

    def judged(m: Column) -> Column:
        spans = let(F.split(text, kind.pattern, -1), lambda g: placed(m, g))
        return F.when(F.size(m) == 0, empty).otherwise(F.transform(F.filter(spans, lambda p: confirmed(kind.name, p["m"])), scored))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), judged)
    return found if kind.marker is None else F.when(F.contains(text, F.lit(kind.marker)), found).otherwise(empty)


def scan(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns and, in ``out``, the spans of all kinds by start, then kind: array of (start, rank, end, score, kind)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.sort_array(F.concat(*(proposals(whole, k, i) for i, k in enumerate(KINDS)))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = [k for k in KINDS if k.base]
    counts = [F.size(F.filter("pii", _of(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(base)]
    return found.select(
        "doc_id", *counts,
        F.sha2(written(F.filter("pii", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda s: s["score"] >= STRONG)).cast("long").alias("n_strong"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.size("pii").cast("long").alias("n_spans"),
    )


def _of(rank: int):
    return lambda s: s["rank"] == rank


def _spans_sql(i: int, k: Kind) -> str:
    """Confirmed spans of one kind as a list of structs."""
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    odd = f"(list_sum([CASE WHEN (len({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INT) WHEN CAST({digits}[i] AS INT) > 4 THEN CAST({digits}[i] AS INT) * 2 - 9 ELSE CAST({digits}[i] AS INT) * 2 END for i in range(1, len({digits}) + 1)]))"
    checks = {
        "email": "true",
        "ip": "len([1 for p in string_split(x.m, '.') if len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255]) = 0",
        "card": f"CASE WHEN len({digits}) BETWEEN 14 AND 19 THEN {odd} % 10 = 0 ELSE false END",
        "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": "list_reduce([CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END for c in string_split(replace(x.m[5:] || x.m[1:4], ' ', ''), '')], lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97, 0) = 1",
    }
    said = lambda words: f"regexp_matches(lower(x.b), '{_as_words(words)}') OR regexp_matches(lower(x.a), '{_as_words(words)}')"
    score = f"round({k.score} + CASE WHEN {said(k.near)} THEN {STEP} ELSE 0 END - CASE WHEN {said(AGAINST)} THEN {STEP} ELSE 0 END, 1)"
    placed = f"[{{'m': m{i}[i], 'b': right(g{i}[i], {CONTEXT}), 'a': left(g{i}[i + 1], {CONTEXT}), 's': CAST(coalesce(list_sum([len(g) for g in g{i}[1:i]]), 0) + coalesce(list_sum([len(g) for g in m{i}[1:i - 1]]), 0) AS INT)}} for i in range(1, len(m{i}) + 1)]"
    return f"[{{'start': x.s, 'rank': {i}, 'end': x.s + len(x.m)::INT, 'score': {score}, 'kind': '{k.name}'}} for x in {placed} if {checks[k.name]}]"


_MATCHES = ", ".join(f"regexp_extract_all(t, '{k.plain}') AS m{i}, regexp_split_to_array(t, '{k.plain}') AS g{i}" for i, k in enumerate(KINDS))
_ALL = " || ".join(f"({_spans_sql(i, k)})" for i, k in enumerate(KINDS))
_WRITTEN = "array_to_string([concat_ws(':', s.kind, s.start, s.\"end\") for s in {}], ',')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, {_MATCHES} FROM d),
p AS (SELECT doc_id, list_sort({_ALL}) AS p FROM m)
SELECT doc_id, {", ".join(f"len([1 for s in p if s.rank = {i}])::BIGINT AS n_{k.name}" for i, k in enumerate(KINDS) if k.base)},
    sha256({_WRITTEN.format("[s for s in p if s.rank < 4]")}) AS base_sha256, {_WRITTEN.format("p")} AS spans,
    len([1 for s in p if s.score >= {STRONG}])::BIGINT AS n_strong, array_to_string([s.score::VARCHAR for s in p], ',') AS scores, len(p)::BIGINT AS n_spans
FROM p
"""
