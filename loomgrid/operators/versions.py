"""Versions of planes as runs and XOR deltas, in built-in operators.

A plane's line is a step function: it is told by the places where its value changes and by what, value XOR value before.  The changes
of two planes' XOR are the XOR of their changes, place by place, so a delta between versions, any version from the deltas up to it and
a history folded into fewer deltas are one aggregate each, ``bit_xor`` by place, whose rows are changes and not cells.  Steps back
and forth apply the same delta.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(planes: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, y, x, change) where a line's value differs from the one before it; before the first and behind the last lies 0.

    ``planes`` has (key, y, x, value), a whole number or null, which is told apart from every number; places without a row count as null.
    A window takes one line of one plane.
    """
    coded = planes.where(F.col(value).isNotNull()).select(*key, "y", "x", (F.col(value).cast("long") + 1).alias("v"))
    line = Window.partitionBy(*key, "y").orderBy("x")
    lag, lead = F.lag("x").over(line), F.lead("x").over(line)
    before = F.when(lag == F.col("x") - 1, F.lag("v").over(line)).otherwise(0)
    own = F.struct(F.col("x"), F.col("v").bitwiseXOR(before).alias("change"))
    # where the next place has no row the line falls back to 0
    gap = F.when(F.coalesce(lead != F.col("x") + 1, F.lit(True)), F.struct((F.col("x") + 1).alias("x"), F.col("v").alias("change")))
    told = coded.select(*key, "y", F.array_compact(F.array(own, gap)).alias("both"))
    return told.select(*key, "y", F.inline("both")).where("change <> 0")


def folded(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x, change): the changes of the XOR of all rows of each key."""
    return rows.groupBy(*key, "y", "x").agg(F.bit_xor("change").alias("change")).where("change <> 0")


def deltas(of: DataFrame, key: list[str], version: str) -> DataFrame:
    """(key, version, y, x, change): each version's changes against the one before it, from (key, version, y, x, change); the first against nothing."""
    last = of.groupBy(*key).agg(F.max(version).alias("_last"))
    moved = of.join(last, key).where(F.col(version) < F.col("_last")).withColumn(version, F.col(version) + 1).select(of.columns)
    return folded(of.union(moved), [*key, version])


def at_version(history: DataFrame, key: list[str], version: str, upto) -> DataFrame:
    """(key, y, x, change): a version's changes from the deltas up to it; ``upto`` is a number or a column of the key's."""
    return folded(history.where(F.col(version) <= upto), key)


def compacted(history: DataFrame, key: list[str], version: str, oldest) -> DataFrame:
    """The history with all deltas before ``oldest`` folded into that one; later versions stay what they are."""
    return folded(history.withColumn(version, F.greatest(F.col(version), F.lit(oldest).cast(dict(history.dtypes)[version]))), [*key, version])


def runs(of: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x, n, value): the stretches of one coded value, those of 0 left out; of a delta, of one XOR of values."""
    line = Window.partitionBy(*key, "y").orderBy("x")
    value = F.bit_xor("change").over(line.rowsBetween(Window.unboundedPreceding, 0))
    told = of.select(*key, "y", "x", (F.lead("x").over(line) - F.col("x")).alias("n"), value.alias("value"))
    return told.where("value <> 0")


def cells(of: DataFrame, key: list[str]) -> DataFrame:
    """(key, y, x, value): the places of a version's changes that are not empty."""
    places = F.explode(F.sequence("x", F.col("x") + F.col("n") - 1)).alias("x")
    return runs(of, key).select(*key, "y", places, (F.col("value") - 1).alias("value"))
