"""Exact order statistics of groups of any size, and greedy budgets over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators import grid

#: Slices of a range in one histogram; distinct values of a group that one task may rank; parts of a group with more of them.
SLICES, FEW, SALTS = 4096, 65_536, 64


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _bounds() -> list[Column]:
    """Of candidates (v, n): least and greatest value, the same of finite values, and how many differ."""
    v = F.col("_v")
    return [F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.min(_finite(v)).alias("_flo"), F.max(_finite(v)).alias("_fhi"), F.count("*").alias("_m")]


def _scaled(v: Column) -> Column:
    """Doubles by sign and logarithm, rising with them, from -1456 to 1456."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))


def _slice(first: bool) -> Column:
    """The slice of a value in its group's range; it never falls as values rise, because each step of the arithmetic does not.

    The first slices are even in the logarithm, so that the later ones, even in the value, need some five rounds whatever the values.
    Infinities and NaN have slices of their own at the ends.
    """
    v, lo, hi = ((_scaled(F.col(c)) if first else F.col(c)) for c in ("_v", "_flo", "_fhi"))
    width = hi / 2 - lo / 2  # halves keep the range of the widest doubles finite
    within = F.when(width > 0, F.least(F.lit(SLICES - 1), F.floor((v / 2 - lo / 2) / width * SLICES))).otherwise(F.lit(0))
    at = F.col("_v")
    return F.when(F.isnan(at), SLICES + 1).when(at == float("inf"), SLICES).when(at == float("-inf"), -1).otherwise(within).cast("int")


def kth(rows: DataFrame, key: list[str], value: str, at: Callable[[Column], Column], few: int = FEW) -> DataFrame:
    """(key, value): of each key the element at the place ``at(n)`` of its n sorted values, counted from 0; exact, ties counted.

    Nulls are no values, and a key without any has no row; infinities and NaN sort as Spark sorts them (NaN last).  Equal values are
    counted before they are ranked.  Only groups of at most ``few`` distinct values are ranked by a window.  Of a larger one a
    histogram of 4096 slices tells which slice holds the place; its values alone stay candidates, until they are few enough or
    equal as doubles.  The group's rows are salted where they meet its bounds, so no task sees more than a 64th of them.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    keys = [f"_k{i}" for i in range(len(key))]
    counted = grid.kept(rows.where(F.col(value).isNotNull()).groupBy(*named, F.col(value).alias("_x")).agg(F.count("*").alias("_n")).withColumn("_v", F.col("_x").cast("double")))
    groups = grid.kept(counted.groupBy(*keys).agg(F.sum("_n").alias("_all"), *_bounds()).withColumn("_k", at(F.col("_all")).cast("long")).drop("_all"))
    found = counted.join(groups.where(F.col("_m") <= few).select(*keys, "_k"), keys)
    large = groups.where(F.col("_m") > few)
    if not large.isEmpty():
        parts = counted.withColumn("_part", F.pmod(F.xxhash64("_x"), F.lit(SALTS)))
        most, first = None, True
        while True:
            bounds = large.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            here = parts.join(bounds.drop("_m"), [*keys, "_part"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop("_part")
            now = large.agg(F.max("_m")).first()[0]
            if now <= few or (now == most and not first):
                break
            sliced = here.withColumn("_s", _slice(first)).groupBy(*keys, "_k", "_s").agg(F.sum("_n").alias("_sn"), *_bounds())
            upto = F.sum("_sn").over(Window.partitionBy(*keys).orderBy("_s"))
            reached = sliced.withColumn("_upto", upto).where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_sn") <= F.col("_k")))
            large = grid.kept(reached.withColumn("_k", F.col("_k") - F.col("_upto") + F.col("_sn")).select(*keys, "_lo", "_hi", "_flo", "_fhi", "_m", "_k"))
            most, first = now, False
        found = found.select(*keys, "_x", "_n", "_k").union(here.select(*keys, "_x", "_n", "_k"))
    line = Window.partitionBy(*keys).orderBy("_x")
    ranked = found.withColumn("_upto", F.sum("_n").over(line)).where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") <= F.col("_k")))
    return ranked.select(*(F.col(k).alias(to) for k, to in zip(keys, key, strict=True)), F.col("_x").alias(value))


def upper_median(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value): of each key the middle value, of an even number the upper of the two."""
    return kth(rows, key, value, lambda n: F.floor(n / 2))


def budgeted(rows: DataFrame, key: list[str], order: list[str], length: str, budget: float) -> DataFrame:
    """The rows taken in order while their key's running sum stays within the budget; one too long is passed over, later ones may fit.

    What is taken hangs on what was taken before, so a key's rows go one by one through one task, sorted by Spark; the task holds a
    batch and one sum.  A row without a length is not taken.
    """
    tagged = rows.select(F.struct(*rows.columns).alias("row"), F.struct(*key).alias("k"), F.struct(*order).alias("o"), F.col(length).cast("double").alias("v"))
    tagged = tagged.repartition("k").sortWithinPartitions("k", "o")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, last = 0.0, None
        for batch in batches:
            keys, lengths, take = batch.column("k").to_pylist(), batch.column("v").to_pylist(), []
            for k, v in zip(keys, lengths, strict=True):
                if k != last:
                    used, last = 0.0, k
                fits = v is not None and used + v <= budget
                used += v if fits else 0.0
                take.append(fits)
            yield batch.select(["row"]).filter(pa.array(take, pa.bool_()))

    return tagged.select("row", "k", "v").mapInArrow(fold, tagged.select("row").schema).select("row.*")
