"""Names that contain each other, without comparing every two.

Whatever contains a name contains its grams (runs of three letters; a shorter
name is one gram). Each name asks for one of its grams, the one that fewest
names of the other side have, and only names with that gram are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(form: Column) -> Column:
    """The different grams of a name, of every length up to GRAM, so that short names find theirs too."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(form) - i + 1)), lambda n: F.substr(form, i, n)))
    return F.array_distinct(F.flatten(pieces))


def _inside(asking: DataFrame, holding: DataFrame) -> DataFrame:
    """(a, b): forms of ``asking`` that stand in forms of ``holding``; both have one column ``form`` of distinct, not empty forms."""
    index = holding.select(F.col("form").alias("b"), F.explode(_grams(F.col("form"))).alias("gram"))
    sizes = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.filter(_grams(F.col("form")), lambda g: F.length(g) == F.least(F.lit(GRAM), F.length("form")))
    asked = asking.select(F.col("form").alias("a"), F.explode(own).alias("gram"))
    # a gram that nobody has settles a name; else the rarest is its key
    counted = asked.join(sizes, "gram", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    keys = counted.where("least.n > 0").select("a", F.col("least.gram").alias("gram"))
    return keys.join(index, "gram").where(F.contains("b", F.col("a"))).select("a", "b")


def containing(left: DataFrame, right: DataFrame, name: str, other: str) -> DataFrame:
    """(name, other) of every two names of which one contains the other, in any case and without blanks around them; empty and null names are in none."""
    forms = lambda df, c: df.select(c, F.lower(F.trim(c)).alias("_form")).where("_form <> ''").distinct()
    a, b = forms(left, name), forms(right, other)
    one, two = (df.select(F.col("_form").alias("form")).distinct() for df in (a, b))
    ahead = _inside(one, two).select(F.col("a").alias("_l"), F.col("b").alias("_r"))
    back = _inside(two, one).select(F.col("b").alias("_l"), F.col("a").alias("_r"))
    pairs = ahead.unionByName(back).distinct()
    return pairs.join(a.withColumnRenamed("_form", "_l"), "_l").join(b.withColumnRenamed("_form", "_r"), "_r").select(name, other).distinct()
