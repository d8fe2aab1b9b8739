"""Conversation structure repair: the cheapest edits that give a well-formed order of roles.

Equal rows of a conversation are first counted in a partial aggregate, so that
what meets in one task is no more than the conversation's own result. Each row
becomes a symbol of its role's initial and its fault; equal neighbours are
collapsed into runs. A symbol has a 4 x 4 min-plus matrix over the states of
the pattern ``(s?(ua)+)?``: the cheapest way from one state to another over a
row, insertions included. Costs to the end go backwards over runs through the
matrix's binary powers, which a worker caches by symbol, so a run of n rows
takes log n products. The audit is then unrolled forwards, halving runs along
the same powers; where several edits are cheapest the least letter goes first,
which gives the least string since a letter and a state leave one next state.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty text
of user or assistant 5; a truncated row that stays costs 5 more; blank and
duplicate rows must go.

Defined results: null roles and texts are one space; rows are ordered by turn
(nulls first), then role, then text; rows with a null conv_id are one
conversation; roles that aren't spelled with an initial of s, u or a can't be
kept; repeated rows are duplicates after the first; a conversation without
rows isn't in ``repair``'s result unless a row says that it had some
(``copies`` 0), and then gets zeros and empty texts; texts of any length are
taken whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: nothing yet, after a system row, after a user row, after an assistant row.
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
ACCEPTED = (0, 3)
STATES = range(4)
NEVER = 1 << 60

#: The role that may come next in a state by insertion or by a new role.
NEXT = {q: ("user", 2) if q != 2 else ("assistant", 3) for q in STATES}

#: Cheapest insertions from state to state; there is one way round, user and assistant in turn.
BETWEEN = [[0, NEVER, INSERT, 2 * INSERT], [NEVER, 0, INSERT, 2 * INSERT], [NEVER, NEVER, 0, INSERT], [NEVER, NEVER, INSERT, 0]]

#: Costs at the end of a conversation.
END = tuple(min(BETWEEN[q][e] for e in ACCEPTED) for q in STATES)

Vector = tuple[int, ...]


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Min-plus product."""
    return [[min(a[i][k] + b[k][j] for k in STATES) for j in STATES] for i in STATES]


def row_edits(symbol: str) -> dict[str, list[tuple[int, int]]]:
    """For each edit letter that takes a row: (next state, cost) by state; a symbol is ``d``, or a role's initial with ``t`` if truncated."""
    edits = {"D": [(q, DELETE) for q in STATES]}
    if symbol != "d":
        more = TRUNCATED if symbol.endswith("t") else 0
        edits["K"] = [(STEP.get((symbol[0], q), -1), KEEP + more) for q in STATES]
        edits["R"] = [(NEXT[q][1], REROLE + more) for q in STATES]
    return edits


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> list[list[int]]:
    """The matrix of 2^k rows of one symbol."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    one = [[NEVER] * 4 for _ in STATES]
    for moves in row_edits(symbol).values():
        for q, (to, cost) in enumerate(moves):
            if to >= 0:
                one[q][to] = min(one[q][to], cost)
    return product(BETWEEN, one)


def before(symbol: str, n: int, after: Vector) -> Vector:
    """Costs to the end before a run of n rows, from those after it."""
    k = 0
    while n:
        if n & 1:
            m = power(symbol, k)
            after = tuple(min(m[q][to] + after[to] for to in STATES) for q in STATES)
        n >>= 1
        k += 1
    return after


@lru_cache(maxsize=1 << 16)
def _one(symbol: str, q: int, after: Vector) -> tuple[str, int]:
    """Letters of the cheapest edits over one row from state q, least first, and the state behind it; ``after`` counts from its least."""
    edits, here, letters = row_edits(symbol), before(symbol, 1, after), ""
    while True:
        for letter in "DIKR":
            if letter == "I":
                to = NEXT[q][1]
                if INSERT + here[to] == here[q]:
                    letters, q = letters + "I", to
                    break
            elif letter in edits:
                to, cost = edits[letter][q]
                if to >= 0 and cost + after[to] == here[q]:
                    return letters + letter, to


def unroll(symbol: str, n: int, q: int, after: Vector, out: list[str]) -> int:
    """Append the letters of a run; the state behind it. Runs are halved, so the costs inside take log n vectors at a time."""
    if n == 1:
        least = min(after)
        letters, q = _one(symbol, q, tuple(min(v - least, NEVER) for v in after))
        out.append(letters)
        return q
    half = n // 2
    q = unroll(symbol, n - half, q, before(symbol, half, after), out)
    return unroll(symbol, half, q, after, out)


def collapse(symbols: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """Runs of equal neighbours."""
    return [(symbol, sum(n for _, n in group)) for symbol, group in groupby(symbols, lambda s: s[0])]


def cheapest(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of its edits."""
    costs = [END]
    for symbol, n in reversed(runs):
        costs.append(before(symbol, n, costs[-1]))
    out: list[str] = []
    q = 0
    for (symbol, n), after in zip(runs, reversed(costs[:-1])):
        q = unroll(symbol, n, q, after, out)
    while q not in ACCEPTED:
        out.append("I")
        q = NEXT[q][1]
    return costs[-1][0], "".join(out)


def apply(audit: str, rows: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit makes of a conversation's rows."""
    made, q, left = [], 0, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K":
            q = STEP[role[0], q]
        else:
            role, q = NEXT[q]
        made.append((role, text))
    return made


BLANK, DUPLICATE, TRUNC = "blank", "duplicate", "truncated"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def fault(role: str, text: str, seen: set[tuple[str, str]]) -> str:
    """A row's first fault; ``seen`` holds the rows before it."""
    bare = text.rstrip(SPACE)
    if not bare:
        return BLANK
    if (role, text) in seen:
        return DUPLICATE
    return "" if bare[-1] in ".!?" else TRUNC


def symbol_of(role: str, first: str) -> str:
    if first in (BLANK, DUPLICATE):
        return "d"
    return (role[0] if role[:1] in ("s", "u", "a") else "x") + "t" * (first == TRUNC)


def mend(rows: list[tuple[int | None, str, str, int]]) -> dict:
    """Counts, cost, audit and repaired rows of one conversation's (turn, role, text, copies) in order."""
    seen: set[tuple[str, str]] = set()
    counts: Counter[str] = Counter()
    symbols, illegal, last = [], 0, None
    for _, role, text, n in rows:
        first = fault(role, text, seen)
        again = BLANK if first == BLANK else DUPLICATE
        counts[first] += 1
        counts[again] += n - 1
        symbols += [(symbol_of(role, first), 1), *([("d", n - 1)] if n > 1 else [])]
        illegal += (last is not None and last + role[:1] not in LEGAL) + n - 1
        last = role[:1]
        seen.add((role, text))
    cost, audit = cheapest(collapse(symbols))
    known = {turn for turn, *_ in rows if turn is not None}
    repaired = apply(audit, chain.from_iterable(repeat((role, text), n) for _, role, text, n in rows))
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        **{kind: counts[kind] for kind in (BLANK, DUPLICATE, TRUNC)},
        "illegal": illegal,
        "cost": cost,
        "audit": audit,
        "repaired": [{"role": role, "text": text} for role, text in repaired],
    }


def repair(messages: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies): counts of faults, cost, audit and ``repaired`` as an array of (role, text)."""
    small_batches(messages.sparkSession)
    space = F.lit(" ")
    there = F.col("copies") > 0
    rows = messages.select("conv_id", *[F.when(there, c).alias(name) for name, c in (("turn", F.col("turn").cast("long")), ("role", F.coalesce("role", space)), ("text", F.coalesce("text", space)))], F.when(there, F.col("copies")).alias("copies"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    held = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))
    talks = counted.groupBy("conv_id").agg(F.sort_array(F.collect_list(held)).alias("rows"))
    counts = ["gaps", BLANK, DUPLICATE, TRUNC, "illegal", "cost"]
    kind = pa.schema([*[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [mend([(r["turn"], r["role"], r["text"], r["copies"]) for r in given]) for given in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *pa.RecordBatch.from_pylist(made, kind).columns], ["conv_id", *kind.names])

    head = messages.schema["conv_id"].dataType.simpleString()
    return talks.mapInArrow(run, f"conv_id {head}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired array<struct<role:string,text:string>>")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's faults, dealt by crc32 of conversation and turn: dropped (``copies`` 0), emptied, without end marks, twice, or under another role."""
    space = F.lit(" ")
    deal = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)

    def where(k: int, then: Column, other: Column) -> Column:
        return F.when(deal == k, then).otherwise(other)

    return rows.select(
        "conv_id", "turn", where(4, F.lit("user"), role).alias("role"),
        where(1, F.lit(""), where(2, F.regexp_replace(text, "[.!?]", ""), text)).alias("text"),
        where(0, F.lit(0), where(3, F.lit(2), F.lit(1))).alias("copies"),
    )


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repair(damaged(table(spark, sf_dir, "conversations")))
    said = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return made.select("conv_id", "gaps", BLANK, DUPLICATE, TRUNC, "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
