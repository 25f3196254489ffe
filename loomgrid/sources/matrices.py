"""Threshold matrices of ordered dither: (my, mx, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ranks of four 8 x 8 patterns, row by row.
RANKS = {
    "clustered-8": "24,8,9,25,48,32,33,49,10,0,1,11,34,56,57,35,12,2,3,13,36,58,59,37,26,14,15,27,50,38,39,51,52,40,41,53,28,16,17,29,42,60,61,43,18,4,5,19,44,62,63,45,20,6,7,21,54,46,47,55,30,22,23,31",
    "ring-8": "16,0,1,17,48,32,33,49,2,24,25,3,34,56,57,35,4,26,27,5,36,58,59,37,18,6,7,19,50,38,39,51,52,40,41,53,20,8,9,21,42,60,61,43,10,28,29,11,44,62,63,45,12,30,31,13,54,46,47,55,22,14,15,23",
    "lines-diagonal": "0,33,18,51,12,45,30,63,32,17,50,11,44,29,62,7,16,49,10,43,28,61,6,39,48,9,42,27,60,5,38,23,8,41,26,59,4,37,22,55,40,25,58,3,36,21,54,15,24,57,2,35,20,53,14,47,56,1,34,19,52,13,46,31",
    "lines-anti-diagonal": "0,32,16,48,8,40,24,56,57,1,33,17,49,9,41,25,26,58,2,34,18,50,10,42,43,27,59,3,35,19,51,11,12,44,28,60,4,36,20,52,53,13,45,29,61,5,37,21,22,54,14,46,30,62,6,38,39,23,55,15,47,31,63,7",
}


def bayer(size: int) -> list[list[int]]:
    """The recursive pattern of a power of two: the lowest bits of a place weigh most."""
    bits = size.bit_length() - 1
    rank = lambda y, x: sum((2 * ((x ^ y) >> i & 1) + (y >> i & 1)) << 2 * (bits - 1 - i) for i in range(bits))
    return [[rank(y, x) for x in range(size)] for y in range(size)]


def lines(size: int) -> list[list[int]]:
    """Lines that appear one after another, each filled from its start; rows are taken in bit-reversed order."""
    bits = size.bit_length() - 1
    return [[int(f"{y:0{bits}b}"[::-1], 2) * size + x for x in range(size)] for y in range(size)]


def turned(m: list[list[int]]) -> list[list[int]]:
    return [list(column) for column in zip(*m, strict=True)]


def blue_noise(size: int = 16, spread: float = 1.5, seed: int = 1) -> list[list[int]]:
    """Void and cluster on a torus: each rank goes where the ones before leave the largest void."""
    import numpy as np

    y, x = np.indices((size, size))
    d = np.minimum(y, size - y) ** 2 + np.minimum(x, size - x) ** 2
    bump = np.exp(-d / (2 * spread * spread))
    rng = np.random.default_rng(seed)
    field, taken = rng.random((size, size)) * 1e-6, np.zeros((size, size), bool)
    ranks = np.zeros((size, size), int)
    for rank in range(size * size):
        at = np.unravel_index(np.where(taken, np.inf, field).argmin(), field.shape)
        ranks[at], taken[at] = rank, True
        field += np.roll(bump, at, (0, 1))
    return ranks.tolist()


def _fixed(name: str) -> list[list[int]]:
    values = [int(v) for v in RANKS[name].split(",")]
    return [values[i : i + 8] for i in range(0, 64, 8)]


NAMES = {
    "bayer-4": lambda: bayer(4),
    "bayer-8": lambda: bayer(8),
    "lines-horizontal": lambda: lines(8),
    "lines-vertical": lambda: turned(lines(8)),
    "blue-noise-16": blue_noise,
} | {name: (lambda name=name: _fixed(name)) for name in RANKS}


def matrix(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(y, x, v) for y, row in enumerate(NAMES[name]()) for x, v in enumerate(row)], "my int, mx int, rank int")


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """(name, size, my, mx, rank) of tab-separated lines, one for each pattern: name, size, ranks joined by commas."""
    cell = F.split(line, "\t")
    rows = lines.select(cell[0].alias("name"), cell[1].cast("int").alias("size"), cell[2].alias("ranks"))
    each = rows.select("name", "size", F.posexplode(F.split("ranks", ",")).alias("at", "rank"))
    return each.select("name", "size", F.floor(F.col("at") / F.col("size")).cast("int").alias("my"), (F.col("at") % F.col("size")).alias("mx"), F.col("rank").cast("int"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The same of a file."""
    return parsed(spark.read.text(path))
