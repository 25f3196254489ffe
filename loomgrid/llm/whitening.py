"""Whitening of embeddings by a covariance in tiles.

Entries become whole numbers, x = floor(scale * c) + offset, so counts, sums and deviations are exact.  The covariance is put
together from tiles of ``TILE`` by ``TILE`` dimensions: rows become blocks, each block is cut into columns of ``TILE`` dimensions,
these are shuffled by row block, every pair of columns that meets there is multiplied, and products are summed by tile.  A task
holds one row block and half a matrix; the driver holds one matrix, whatever the number of rows.

What becomes of odd input:

- a row goes if its vector is null, has no entry, holds a null, an infinite entry or NaN, or one whose size is over 2**50;
- vectors of another length than the commonest (of two as common, the longer) go, since they have no covariance with the others;
- keys may be null or stand repeatedly: each row counts and is returned for itself;
- a table without rows gives none; other columns, whatever their names, are not read;
- a component without variance (an eigenvalue below dims * 2**-52 of the largest) has ``whitened`` null and takes no part in
  the error; ``explained`` is null where the trace is 0;
- a deviation beyond 2**63 - 1 does not fit a long and is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions on a tile's side.
TILE = 32
#: Bytes of one row block, all its columns together.
BLOCK_BYTES = 2 << 20
#: Entries that are held as whole numbers at once.
SLICE = 1 << 20
#: Entries beyond this count as not finite.
LARGEST = float(1 << 50)


@dataclass
class Whitening:
    """What was learned of n vectors: sums of x, and the leading eigenvalues and eigenvectors of its covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a column for each component
    trace: float
    scale: float
    offset: int
    error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def usable(self) -> np.ndarray:
        """Which components have variance."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * self.dims * 2.0**-52

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The means as whole parts and remainders over n."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return np.array(whole, np.int64), np.array(rest, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the difference of whole numbers is exact."""
        whole, rest = self.parts()
        return (x - whole) - rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """The components of each row, NaN where one has no variance."""
        root = np.sqrt(np.where(self.usable, self.values, np.nan))
        return self.centred(x) @ self.vectors / root


def entries(column: pa.Array, dims: int, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vectors count, their entries as whole numbers)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    held = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = (np.abs(held) <= LARGEST).all(axis=1)  # NaN compares as false
    return rows[good], np.floor(scale * held[good]).astype(np.int64) + offset


def _cut(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """The sum of each column as whole numbers of any size."""
    high, low = x >> 31, x & 0x7FFFFFFF
    return (high.sum(axis=0).astype(object) << 31) + low.sum(axis=0).astype(object)


def _moments(df: DataFrame, vector: str, dims: int, scale: float, offset: int) -> tuple[int, list[int]]:
    """(vectors that count, the sum of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in _cut(batches, dims):
            x = entries(batch.column(0), dims, scale, offset)[1]
            n += len(x)
            sums = sums + exact_sums(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(int(s)) for s in sums])], names=["dim", "n", "s"])

    told = df.select(vector).mapInArrow(run, "dim int, n long, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = sorted(told.collect())  # a row for each dimension
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [0] * dims)


def _row_blocks(df: DataFrame, vector: str, values_of: Callable[[pa.Array], np.ndarray], width: int) -> DataFrame:
    """(row_block, col_block, data): the columns of blocks of rows, TILE of them in each piece."""
    size = max(1, BLOCK_BYTES // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def full() -> pa.RecordBatch:
            nonlocal number
            block = np.concatenate(held)
            starts = range(0, width, TILE)
            data = [np.ascontiguousarray(block[:, a : a + TILE]).tobytes() for a in starts]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], names=["row_block", "col_block", "data"])

        for batch in _cut(batches, width):
            values = values_of(batch.column(0))
            for at in range(0, len(values), size):
                part = values[at : at + size]
                if count + len(part) > size:
                    yield full()
                    held.clear()
                    count = 0
                held.append(part)
                count += len(part)
        if count:
            yield full()

    return df.select(vector).mapInArrow(run, "row_block long, col_block int, data binary")


def tiled_products(df: DataFrame, vector: str, values_of: Callable[[pa.Array], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of values' * values, from ``values_of`` a column of vectors (rows that count by ``width`` doubles)."""
    sides = [min(TILE, width - a) for a in range(0, width, TILE)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        at, held = None, []

        def met() -> None:
            for i, a in enumerate(held):
                for j in range(i, len(held)):
                    product = a.T @ held[j]
                    if (i, j) in tiles:
                        tiles[i, j] += product
                    else:
                        tiles[i, j] = product

        for batch in batches:
            for block, side, data in zip(batch.column("row_block").to_pylist(), batch.column("col_block").to_pylist(), batch.column("data"), strict=True):
                if block != at:
                    met()
                    at, held = block, []
                held.append(np.frombuffer(data.as_buffer(), np.float64).reshape(-1, sides[side]))
        met()
        for (i, j), tile in tiles.items():
            n = tile.size
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(tile.ravel())], names=["tile_i", "tile_j", "cell", "v"])

    blocks = _row_blocks(df, vector, values_of, width).repartition("row_block").sortWithinPartitions("row_block", "col_block")
    sums = blocks.mapInArrow(multiply, "tile_i int, tile_j int, cell int, v double").groupBy("tile_i", "tile_j", "cell").agg(F.sum("v").alias("v"))
    found = np.zeros((width, width))
    told = sums.toArrow()  # half a matrix: its size depends on the dimensions alone
    i, j, cell, v = (told[c].to_numpy() for c in ("tile_i", "tile_j", "cell", "v"))
    side = np.array(sides)
    found[i * TILE + cell // side[j], j * TILE + cell % side[j]] = v
    upper = np.triu(found)
    return upper + np.triu(upper, 1).T


def dimensions(df: DataFrame, vector: str) -> int:
    """The commonest length of the vectors; 0 where there are none."""
    size = F.size(vector)
    top = df.where(F.col(vector).isNotNull() & (size > 0)).groupBy(size.alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return top.dims if top else 0


def fit(df: DataFrame, vector: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> Whitening | None:
    """Learn from all vectors of the table; None where none counts.  Eigenvectors have their largest entry positive."""
    dims = dimensions(df, vector)
    n, sums = _moments(df, vector, dims, scale, offset) if dims else (0, [])
    if not n:
        return None
    k = min(components, dims)
    model = Whitening(n, sums, np.zeros(k), np.zeros((dims, k)), 0.0, scale, offset)
    covariance = tiled_products(df, vector, lambda c: model.centred(entries(c, dims, scale, offset)[1]), dims) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    model.values, model.vectors, model.trace = values, vectors * np.sign(vectors[largest, np.arange(k)]), float(np.trace(covariance))
    return model


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """How far the whitened vectors' covariance, counted over all of them, is from the identity; None where no component has variance."""
    use = np.flatnonzero(model.usable)
    if not len(use):
        return None
    seen = tiled_products(df, vector, lambda c: model.project(entries(c, model.dims, model.scale, model.offset)[1])[:, use], len(use)) / model.n
    return float(np.abs(seen - np.eye(len(use))).max())


def deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    """sum (n * x - S)**2 of each row, exact; null beyond a long."""
    whole, rest = model.parts()
    apart = x - whole
    estimate = ((apart.astype(float) * model.n - rest) ** 2).sum(axis=1)
    small = estimate < 2.0**62
    exact = np.zeros(len(x), object)
    near = apart[small] * model.n - rest
    exact[small] = (near * near).sum(axis=1)
    for i in np.flatnonzero(~small).tolist():
        value = sum((a * model.n - r) ** 2 for a, r in zip(apart[i].tolist(), rest.tolist(), strict=True))
        exact[i] = value if value < 1 << 63 else None
    return pa.array(exact.tolist(), pa.int64())


def transform(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened) of each row whose vector counts."""
    rows = df.select(key, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, model.dims):
            at, x = entries(batch.column(1), model.dims, model.scale, model.offset)
            if not len(at):
                continue
            white = model.project(x)
            flat = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), deviations(model, x), lists], names=[key, "deviation", "whitened"])

    schema = rows.select(key, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).schema
    return rows.mapInArrow(run, schema)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector that counts and each component."""
    rows = df.select(F.col(key), F.col(vector))
    model = fit(rows, vector, components)
    if model is None:
        return rows.where("false").select(
            key, F.lit(0).alias("component"), *(F.lit(0).cast("long").alias(c) for c in ("n", "deviation")), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error"))
        )
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    error = identity_error(rows, model, vector)
    told = F.array(*(F.lit(s).cast("double") for s in shares))
    flat = transform(rows, model, key, vector).select(key, "deviation", F.posexplode("whitened").alias("at", "value"))
    return flat.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.element_at(told, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
