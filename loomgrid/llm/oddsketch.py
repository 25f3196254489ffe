"""Near duplicates at high similarity, candidates of MinHash bands told apart by odd sketches.

Each set of shingles keeps its least element under 100 orders.  Groups of five of these are the keys of bands, where candidates meet;
all hundred, with their numbers, are hashed into a bitmap of ``BITS`` bits whose bits hold the parity of what fell on them.  Two sets
that differ in d of the hundred places differ in 2d things, and those alone show in the XOR of the bitmaps: its population count tells
d, the more precisely the more alike the sets are.  A pair is discarded only where so many bits cannot come from sets of the asked
similarity but with a chance of ``MISS``; what is left is compared on whole sets, so no link is wrong.

A pair at the similarity of 0.85 shares no band with a chance of 8e-6, and fewer the more alike it is.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common, jaccard, simhash

SHINGLE = 3
SIMILARITY = Fraction(85, 100)
SAMPLES = jaccard.BANDS * jaccard.ROWS
BITS = 256
#: The chance with which a pair at the asked similarity may be discarded by its sketches.
MISS = 1e-9
_PLACES = common.mixed(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64))


def sketch(least: np.ndarray) -> bytes:
    """The parity bitmap of numbered minima."""
    at = (common.mixed(least ^ _PLACES) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def estimate(bits: int) -> float:
    """The similarity that so many differing bits speak for."""
    share = min(2 * bits / BITS, 1 - 1e-12)
    return 1 - min(1.0, np.log1p(-share) / np.log1p(-2 / BITS) / (2 * SAMPLES))


@cache
def most_bits(similarity: float, miss: float = MISS) -> int:
    """The least number of bits that sets of at least that similarity exceed with a chance of ``miss`` or less.

    d is binomial over the samples; each of 2d things then moves the count of odd bits up or down by one, as it falls on an even or
    an odd bit.
    """
    d = np.arange(SAMPLES + 1)
    log_choose = np.concatenate(([0.0], np.cumsum(np.log(np.arange(SAMPLES, 0, -1)) - np.log(np.arange(1, SAMPLES + 1)))))
    rate = 1 - similarity
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.exp(log_choose + np.where(d > 0, d * np.log(rate), 0) + np.where(d < SAMPLES, (SAMPLES - d) * np.log(similarity), 0)) if rate > 0 else (d == 0).astype(float)
    odd, total, k = np.zeros(BITS + 1), np.zeros(BITS + 1), np.arange(BITS + 1)
    odd[0] = 1.0
    for x in d:
        total += weight[x] * odd
        for _ in range(2):
            up, down = odd * (BITS - k) / BITS, odd * k / BITS
            odd = np.concatenate(([0.0], up[:-1])) + np.concatenate((down[1:], [0.0]))
    above = np.cumsum(total[::-1])[::-1]  # the chance of so many or more
    return int(np.flatnonzero(np.append(above[1:], 0.0) <= miss)[0])


def near_sets(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: Fraction = SIMILARITY, shingle: int = SHINGLE, **caps: int) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row: links are sets with that Jaccard similarity or more, components what they reach.

    ``component_id`` is the least key of the component; ``kept`` tells whether it is the row's own.  A null text, or one without words,
    has the empty set and is linked with nothing, not with its like either: ``component_id`` is its own key.  Equal sets are
    linked.  Rows with a null key count as texts and link others; they get the least other key of their component, or null, and
    are not kept.  Repeated rows stay.  A table without rows gives none; other columns, whatever their names, are not read.
    """
    named = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = common.scratch(jaccard.fingerprints(named, "text", shingle, with_bands=True, sketch=sketch))
    distinct = common.scratch(rows.where("size > 0").groupBy("fp").agg(F.count("*").alias("n"), F.min("key").alias("first"), *(F.first(c).alias(c) for c in ("bands", "size", "sketch"))))
    links = jaccard.edges(named, distinct, "key", "text", shingle, float(similarity), most=most_bits(float(similarity)), **caps)
    groups = simhash._named(distinct.select("fp", "first"), links).select("fp", "component_id")
    told = common.look_up(rows.where("size > 0").select("key", "fp", "size"), groups, distinct.select("fp", "n"), "fp").select("key", "size", "component_id")
    alone = rows.where("size = 0").select("key", "size", F.col("key").alias("component_id"))
    out = told.union(alone).select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
