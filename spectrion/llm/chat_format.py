"""Chat formatting over reply trees.

Messages form trees by their parent. Iterative self-joins by doubling the
distance find every (leaf, ancestor) pair: in round k each pair's ancestor
is replaced by its ancestor 2^k steps up, so that a path of any length takes
logarithmically many joins and each pair comes up once. Branches are ranked by
the mean score of their messages and each chosen path is formatted as one
conversation. Native Spark only.

Template: ``<|turn|>role\\ntext<|end|>\\n`` for each turn. In roles and texts
``\\`` becomes ``\\b`` and ``<|`` becomes ``\\l|``, so that no control string can
occur inside a turn; ``unescape`` is the inverse. The loss mask comes as the
turns' pieces of the formatted text with a flag.

Defined results: null texts and roles are empty; messages of one conversation
are ordered by turn, then role, then text, then parent, so ties and repeated
rows have an order and are kept; a reply to an unknown message or to one that
isn't earlier starts a tree of its own; a null conv_id is a conversation;
texts of any length are formatted whole; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

TURN, END = "<|turn|>", "<|end|>\n"

#: Role whose text is trained on.
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """Roles stand on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def chains(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    return turns.select("conv_id", place.alias("msg"), F.nullif(place - 1, F.lit(0)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, msg, up) for each root-to-leaf path: the messages by their distance from the leaf.

    ``messages`` has (conv_id, msg, parent) with msg unique in a conversation.
    """
    nodes = messages.select("conv_id", "msg", F.when(F.col("parent") < F.col("msg"), F.col("parent")).alias("parent"))
    own = nodes.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"))
    known = F.col("conv_id").eqNullSafe(F.col("c"))
    jump = nodes.join(own, known & (F.col("parent") == F.col("m")), "left").select("conv_id", "msg", F.col("m").alias("to"))
    leaves = jump.join(jump.select(F.col("conv_id").alias("c"), F.col("to").alias("t")), known & (F.col("msg") == F.col("t")), "left_anti")
    found = cut(leaves.select("conv_id", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("up")))
    jump = cut(jump.where("to IS NOT NULL"))
    longest = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    for k in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        step = jump.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "to")
        further = found.join(step, known & (F.col("msg") == F.col("m"))).select("conv_id", "leaf", F.col("to").alias("msg"), (F.col("up") + 2**k).alias("up"))
        found = cut(found.unionByName(further))  # each round names the last one twice: without a cut the plan would double
        # only messages with an ancestor that far go on
        second = jump.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("to").alias("next"))
        jump = cut(jump.join(second, known & (F.col("to") == F.col("m"))).select("conv_id", "msg", F.col("next").alias("to")))
    return found


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: conv_id, leaf, branch (1 is the best), formatted, and pieces of the formatted text as (text, trained).

    ``branches`` chooses so many of a conversation's best paths; all by default.
    """
    m = messages.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "role", "text", "score")
    nodes = paths(messages).join(m, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        (-F.col("up")).alias("place"),
        F.concat(F.lit(TURN), escape_role(role), F.lit("\n")).alias("head"),
        escape(text).alias("body"),
        (role == TRAINED).alias("trained"),
    )
    made = nodes.groupBy("conv_id", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    ranked = made.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    off = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), off.alias("trained")),
                F.struct(t["body"].alias("text"), t["trained"].alias("trained")),
                F.struct(F.lit(END).alias("text"), off.alias("trained")),
            ),
        )
    )
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return ranked.withColumn("pieces", pieces).select("conv_id", "leaf", "branch", joined.alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|end\|>\n", -1), F.lit(1), F.size(F.split(formatted, r"<\|end\|>\n", -1)) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(
            unescape_role(F.substr(head, F.lit(len(TURN) + 1))).alias("role"),
            unescape(F.substr(part, F.length(head) + 2)).alias("text"),
        )

    return F.transform(parts, turn)


def read_trained(pieces: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["trained"]), lambda p: unescape(p["text"])), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    made = conversations(chains(given.unionByName(extra)))
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_trained(F.col("pieces")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
    UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok', CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) x(i)),
a AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '') AS trained,
    sum(17 + length(replace(replace(replace(role, '\', '\b'), '<|', '\l|'), chr(10), '\n')) + length(replace(replace(text, '\', '\b'), '<|', '\l|')))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars FROM a
"""
