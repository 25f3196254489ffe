"""Clustering of all charts together: seeding, Lloyd steps, refilling, Ward merging and the reading of its curve.

A chart's distinct colours, with the cells of each as weights, are dealt into blocks of arrays, so a chart may have any size and lie in
many tasks.  A step sends every chart's centres to its blocks, adds up each block's cells by centre there, and sums these parts;
what is shuffled is a row for each block and centre.  Charts whose centres rest take no further part.

A chart whose colours fill one block takes all its steps there: its block has all that they read, so nothing is shuffled and no round
waits for other charts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators import kernels, nearest
from loomgrid.operators.grid import kept

#: Colours of one block, and of the part of a chart that one task cuts into blocks.
BLOCK, PART = 8_192, 131_072
#: Bytes of centres that are sent to every task; beyond it they meet their blocks by a shuffle.
MAX_SENT = 64 << 20
#: Draws of seeds after the first one.
DRAWS = 5


class Blocks:
    """The weighted distinct points of every key: (key, p, w), arrays of ``BLOCK`` points at most."""

    def __init__(self, points: DataFrame, key: str, parts: list[str], weight: Column | None = None) -> None:
        self.key, self.parts, self.kind = key, parts, dict(points.dtypes)[key]
        width = len(parts)
        one = points.select(key, *(F.col(p).cast("double").alias(p) for p in parts), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
        distinct = one.groupBy(key, *parts).agg(F.sum("w").alias("w"))
        most = points.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        if most > PART:  # so many cells may yet be few colours
            distinct = kept(distinct)
            most = distinct.groupBy(key).count().agg(F.max("count")).first()[0]
        salts = -(-most // PART) or 1
        # points that lie together by key already stay where they are
        together = distinct.groupBy(key) if salts == 1 else distinct.withColumn("salt", F.pmod(F.xxhash64(*parts), F.lit(salts))).groupBy(key, "salt")
        kind = distinct.select(key).schema[0].dataType

        def cut(rows: pa.Table) -> pa.Table:
            p = np.stack([rows[c].to_numpy() for c in parts], axis=1).astype(float)
            # nulls are dropped here: a filter on parts that are long expressions would be evaluated again for each of them
            whole = np.flatnonzero(~np.isnan(p).any(axis=1))
            whole = whole[np.lexsort(p[whole].T[::-1])]
            at = np.append(np.arange(0, len(whole), BLOCK), len(whole)).astype(np.int32)
            p, w = pa.array(p[whole].ravel()), pa.array(rows["w"].to_numpy()[whole])
            lists = [pa.ListArray.from_arrays(pa.array(at * n), x) for n, x in ((width, p), (1, w))]
            n = len(at) - 1
            return pa.table([rows[key].combine_chunks().take(pa.array([0] * n, pa.int32())), *lists, pa.array([salts == 1 and n == 1] * n, pa.bool_())], names=[key, "p", "w", "lone"])

        self.rows = kept(together.applyInArrow(cut, f"{key} {kind.simpleString()}, p array<double>, w array<double>, lone boolean"))
        #: Charts of one block, and whether there are others.
        self.lone, self.split = self.rows.where("lone"), not self.rows.where("not lone").isEmpty()

    def met(self, centres: DataFrame, step: Callable[[np.ndarray, np.ndarray, dict], dict[str, np.ndarray]], schema: str, *also: str, rows: DataFrame | None = None) -> DataFrame:
        """``step(points, weights, the centres' row)`` of each block, as rows of the key and what it returns.

        ``centres`` has one row a key: c, the centres one after another, and the columns ``also``.  ``rows`` are the blocks, all if not named.
        """
        key = self.key
        small = (centres.agg(F.sum(F.size("c"))).first()[0] or 0) * 8 <= MAX_SENT
        joined = (self.rows if rows is None else rows).join(F.broadcast(centres) if small else centres, key).select(key, "p", "w", "c", *also)
        return self._stepped(joined, step, schema, *also)

    def alone(self, step: Callable[[np.ndarray, np.ndarray, dict], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """The same of each chart of one block, without centres and so without a join."""
        return self._stepped(self.lone.select(self.key, "p", "w", F.array().cast("array<double>").alias("c")), step, schema)

    def _stepped(self, joined: DataFrame, step: Callable, schema: str, *also: str) -> DataFrame:
        key, width = self.key, len(self.parts)
        names = [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every, of = [], []
                for i in range(batch.num_rows):
                    array = lambda c, i=i: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                    row = {c: batch.column(c)[i].as_py() for c in also}
                    row["c"] = array("c").reshape(-1, width)
                    found = step(array("p").reshape(-1, width), array("w"), row)
                    every.append(found)
                    of += [i] * len(found[names[0]])
                if of:  # one batch of rows for all blocks of the batch
                    lists = {c: [x for f in every for x in f[c]] if isinstance(every[0][c], list) else np.concatenate([f[c] for f in every]) for c in names}
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(lists[c]) for c in names)], names=[key, *names])

        return joined.mapInArrow(run, f"{key} {self.kind}, {schema}")

    def _sums(self) -> tuple[str, Callable]:
        width = len(self.parts)
        schema = "idx int, mass double, sse double, " + ", ".join(f"s{i} double" for i in range(width))

        def step(p: np.ndarray, w: np.ndarray, row: dict) -> dict[str, np.ndarray]:
            k = len(row["c"])
            labels = kernels.assign(p, row["c"])
            count = lambda v: np.bincount(labels, weights=v, minlength=k)
            gap = ((p - row["c"][labels]) ** 2).sum(axis=1)
            return {"idx": np.arange(k, dtype=np.int32), "mass": count(w), "sse": count(w * gap)} | {f"s{i}": count(w * p[:, i]) for i in range(width)}

        return schema, step

    def totals(self, centres: DataFrame) -> DataFrame:
        """(key, idx, mass, sse, s0, ...): the cells nearest to each centre, their squared distance to it and their sums."""
        schema, step = self._sums()
        columns = [f.split()[0] for f in schema.split(", ")][1:]
        return self.met(centres, step, schema).groupBy(self.key, "idx").agg(*(F.sum(c).alias(c) for c in columns))

    def drawn(self, centres: DataFrame, take: Column | int, draw: int) -> DataFrame:
        """(key, c): the centres and up to ``take`` more points of each key, drawn with a chance in proportion to weight and squared distance.

        Every point has a number from its own key and coordinates, -ln(u) over its weight; the least numbers are the draw.  A block
        gives its own least ones only.
        """
        key = self.key
        asked = centres.withColumn("take", take if isinstance(take, Column) else F.lit(take))
        schema = "e double, at array<double>"

        def step(p: np.ndarray, w: np.ndarray, row: dict) -> dict[str, np.ndarray]:
            e, order = _draw(p, w, row["c"], row["take"], draw)
            return {"e": e[order], "at": p[order].tolist()}

        best = self.met(asked, step, schema, "take").join(asked.select(key, "take"), key)
        nth = F.row_number().over(Window.partitionBy(key).orderBy("e", "at"))
        new = best.withColumn("nth", nth).where("nth <= take").groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "at"))), lambda x: x["at"])).alias("new"))
        return centres.join(new, key, "left").withColumn("c", F.concat("c", F.coalesce("new", F.array().cast("array<double>")))).drop("new")

    def seeds(self, k: int) -> DataFrame:
        """(key, c): up to k seeds of each key, a first one and then ``DRAWS`` draws of an equal share; fewer where there are fewer points."""
        mine = self.alone(lambda p, w, row: {"s": [_seeded(p, w, k).ravel().tolist()]}, "s array<double>").withColumnRenamed("s", "c")
        if not self.split:
            return kept(mine)
        now = self._apart().withColumn("c", F.array().cast("array<double>"))
        for draw, share in _shares(k):
            now = kept(self.drawn(now, share, draw))
        return kept(mine.union(now))

    def _apart(self) -> DataFrame:
        """The keys of more than one block."""
        return self.rows.where("not lone").select(self.key).distinct()

    def lloyd(self, centres: DataFrame, rounds: int = kernels.MAX_ROUNDS, stop: float = kernels.STOP) -> DataFrame:
        """(key, c) after moving centres to the means of their cells until none of a key moves by more than the root of ``stop``; an empty one stays."""
        key, width = self.key, len(self.parts)
        mine = self.met(centres, lambda p, w, row: {"r": [_rested(p, w, row["c"], rounds, stop).ravel().tolist()]}, "r array<double>", rows=self.lone).withColumnRenamed("r", "c")
        if not self.split:
            return kept(mine)
        resting, moving = [mine], kept(centres.join(self._apart(), key, "left_semi").select(key, "c"))
        for _ in range(rounds):
            if moving.isEmpty():
                break
            lists = self.totals(moving).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "mass", *(f"s{i}" for i in range(width))))).alias("u"))
            old = lambda u: F.slice("c", u["idx"] * width + 1, width)
            mean = lambda u: F.when(u["mass"] > 0, F.array(*(u[f"s{i}"] / u["mass"] for i in range(width)))).otherwise(old(u))
            gap = lambda u: F.aggregate(F.zip_with(mean(u), old(u), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
            # the new centres need another name: inside a lambda Spark takes a column's name for the alias beside it
            now = kept(moving.join(lists, key).select(key, F.flatten(F.transform("u", mean)).alias("new"), F.array_max(F.transform("u", gap)).alias("shift")))
            resting.append(now.where(F.col("shift") < stop).select(key, F.col("new").alias("c")))
            moving = now.where(F.col("shift") >= stop).select(key, F.col("new").alias("c"))
        for more in resting:
            moving = moving.union(more)
        return kept(moving)

    def used(self, centres: DataFrame) -> DataFrame:
        """(key, idx, count, sse, parts) of the centres that have cells, renumbered without gaps."""
        c = self.totals(centres).where("mass > 0")
        flat = c.join(centres, self.key).select(self.key, "idx", "mass", "sse", *(F.element_at("c", F.col("idx") * len(self.parts) + i + 1).alias(p) for i, p in enumerate(self.parts)))
        place = (F.row_number().over(Window.partitionBy(self.key).orderBy("idx")) - 1).cast("int")
        return flat.select(self.key, place.alias("idx"), F.col("mass").alias("count"), "sse", *self.parts)

    def _told(self) -> tuple[str, Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]]:
        """The same of one block, which has all of a chart."""
        names = [f"s{i}" for i in range(len(self.parts))]

        def told(p: np.ndarray, w: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
            labels = kernels.assign(p, c)
            mass, sse = (np.bincount(labels, weights=v, minlength=len(c)) for v in (w, w * ((p - c[labels]) ** 2).sum(axis=1)))
            held = np.flatnonzero(mass > 0)
            return {"idx": np.arange(len(held), dtype=np.int32), "count": mass[held], "sse": sse[held]} | {n: c[held, i] for i, n in enumerate(names)}

        return "idx int, count double, sse double, " + ", ".join(f"{n} double" for n in names), told

    def _as_used(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({f"s{i}": p for i, p in enumerate(self.parts)})

    def clusters(self, k: int) -> DataFrame:
        """``used`` of the centres after Lloyd steps from drawn seeds; charts of one block do it all in one pass."""
        schema, told = self._told()
        mine = self._as_used(self.alone(lambda p, w, row: told(p, w, _rested(p, w, _seeded(p, w, k))), schema))
        return mine.union(self.used(kmeans(self, k).join(self._apart(), self.key, "left_semi"))) if self.split else mine

    def refitted(self, centres: DataFrame, free: str) -> DataFrame:
        """``used`` of the centres (key, c, ``free``) after refilling and Lloyd steps."""
        schema, told = self._told()
        mine = self._as_used(self.met(centres, lambda p, w, row: told(p, w, _rested(p, w, _refilled(p, row["c"], row[free]))), schema, free, rows=self.lone))
        if not self.split:
            return mine
        others = kept(centres.join(self._apart(), self.key, "left_semi"))
        return mine.union(self.used(self.lloyd(self.refilled(others, F.col(free)).select(self.key, "c"))))

    def refilled(self, centres: DataFrame, free: Column) -> DataFrame:
        """(key, c): to each key's centres up to ``free`` points are added, always the one farthest from its nearest centre, the first by its parts among equals."""
        key = self.key
        done, now = [], kept(centres.withColumn("free", free))
        schema = "far double, at array<double>"

        def step(p: np.ndarray, w: np.ndarray, row: dict) -> dict[str, np.ndarray]:
            gap = _gaps(p, row["c"])
            at = int(gap.argmax())
            return {"far": gap[at : at + 1], "at": p[at : at + 1].tolist()} if gap[at] > 0 else {"far": gap[:0], "at": []}

        while True:
            done.append(now.where("free <= 0").select(key, "c"))
            now = now.where("free > 0")
            if now.isEmpty():
                break
            worst = self.met(now.select(key, "c"), step, schema).groupBy(key).agg(F.min(F.struct((-F.col("far")).alias("far"), "at")).alias("w"))
            now = kept(now.join(worst, key, "left").select(key, F.concat("c", F.coalesce("w.at", F.array().cast("array<double>"))).alias("c"), F.when(F.col("w").isNull(), 0).otherwise(F.col("free") - 1).alias("free")))
        out = done[0]
        for more in done[1:]:
            out = out.union(more)
        return kept(out)

    def labels(self, centres: DataFrame) -> DataFrame:
        """(key, parts, label) of every distinct point."""
        width = len(self.parts)

        def step(p: np.ndarray, w: np.ndarray, row: dict) -> dict[str, np.ndarray]:
            return {f"p{i}": p[:, i] for i in range(width)} | {"label": kernels.assign(p, row["c"]).astype(np.int32)}

        found = self.met(centres, step, ", ".join(f"p{i} double" for i in range(width)) + ", label int")
        return found.select(self.key, *(F.col(f"p{i}").alias(p) for i, p in enumerate(self.parts)), "label")


def _gaps(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each point's squared distance to its nearest centre."""
    gap = np.full(len(p), np.inf)
    for a in range(0, len(c), 16):
        gap = np.minimum(gap, kernels.distances_sq(p, c[a : a + 16]).min(axis=1))
    return gap


def _draw(p: np.ndarray, w: np.ndarray, c: np.ndarray, take: int, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each point, places of the least ``take``); see ``drawn``."""
    gap = _gaps(p, c) if len(c) else np.full(len(p), 1.0)
    e = race(p, draw) / np.where(gap > 0, w * gap, np.nan)
    order = np.argsort(e, kind="stable")[:take]
    return e, order[~np.isnan(e[order])]


def _shares(k: int) -> list[tuple[int, int]]:
    """(draw, how many): a first seed and ``DRAWS`` draws of an equal share."""
    out, left = [(0, 1)], k - 1
    for draw in range(1, DRAWS + 1):
        share = -(-left // (DRAWS + 1 - draw))
        if share > 0:
            out.append((draw, share))
            left -= share
    return out


def _seeded(p: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The seeds of a chart that lies here whole."""
    c = np.zeros((0, p.shape[1]))
    for draw, share in _shares(k):
        c = np.concatenate([c, p[_draw(p, w, c, share, draw)[1]]])
    return c


def _rested(p: np.ndarray, w: np.ndarray, c: np.ndarray, rounds: int = kernels.MAX_ROUNDS, stop: float = kernels.STOP) -> np.ndarray:
    """The Lloyd steps of a chart that lies here whole."""
    for _ in range(rounds):
        labels = kernels.assign(p, c)
        mass = np.bincount(labels, weights=w, minlength=len(c))[:, None]
        sums = np.stack([np.bincount(labels, weights=w * x, minlength=len(c)) for x in p.T], axis=1)
        new = np.where(mass > 0, sums / np.where(mass > 0, mass, 1), c)
        shift = ((new - c) ** 2).sum(axis=1).max()
        c = new
        if shift < stop:
            break
    return c


def in_one_block(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, palette) of a chart's cells, none of them missing: what ``Blocks.clusters`` and ``Blocks.labels`` give where its colours fill one block at most."""
    points = points + 0.0  # one zero
    order = np.lexsort(points.T[::-1])
    first = np.ones(len(points), bool)
    first[1:] = (points[order[1:]] != points[order[:-1]]).any(axis=1)
    p, w = points[order[first]], np.diff(np.append(np.flatnonzero(first), len(points))).astype(float)
    c = _rested(p, w, _seeded(p, w, k))
    of = kernels.assign(p, c)
    held = np.unique(of)
    labels = np.empty(len(points), np.int64)
    labels[order] = np.searchsorted(held, of)[np.cumsum(first) - 1]
    return labels, c[held]


def _refilled(p: np.ndarray, c: np.ndarray, free: int) -> np.ndarray:
    """The centres and up to ``free`` points of a chart that lies here whole, always the one farthest from its nearest centre."""
    gap = _gaps(p, c)
    for _ in range(free):
        at = int(gap.argmax())
        if not gap[at] > 0:
            break
        c = np.concatenate([c, p[at : at + 1]])
        gap = np.minimum(gap, kernels.distances_sq(p, p[at : at + 1])[:, 0])
    return c


def race(p: np.ndarray, draw: int) -> np.ndarray:
    """-ln(u) for each point, u uniform in (0, 1) by the bits of its parts and the number of the draw."""
    h = np.full(len(p), (draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for i in range(p.shape[1]):
        h ^= np.ascontiguousarray(p[:, i] + 0.0).view(np.uint64)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(times)
        h ^= h >> np.uint64(31)
    return -np.log((h >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54)


def listed(entries: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, c): a palette's entries (key, idx, parts) one after another."""
    rows = F.array_sort(F.collect_list(F.struct("idx", F.array(*parts).alias("at"))))
    return entries.groupBy(key).agg(F.flatten(F.transform(rows, lambda x: x["at"])).alias("c"))


def kmeans(blocks: Blocks, k: int) -> DataFrame:
    """(key, c) after Lloyd steps from drawn seeds."""
    return blocks.lloyd(blocks.seeds(k))


def quantize(blocks: Blocks, k: int, limit: float = kernels.MERGE_QUANTIZED) -> DataFrame:
    """(key, idx, count, sse, parts): k-means, then near centres merge and the slots so freed go to the worst fitted points; nothing freed, nothing merged."""
    key, parts = blocks.key, blocks.parts
    first = kept(blocks.clusters(k))
    into = kept(nearest.merged(first, parts, [key], limit))
    alive = first.join(into.where("idx = into").select(key, "idx"), [key, "idx"])
    freed = first.groupBy(key).agg(F.count("*").alias("n")).join(alive.groupBy(key).agg(F.count("*").alias("left")), key).select(key, (F.col("n") - F.col("left")).alias("freed")).where("freed > 0")
    fewer = kept(listed(alive, key, parts).join(freed, key))
    return first.join(freed, key, "left_anti").union(blocks.refitted(fewer, "freed"))


def ward(entries: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, colours, sse): the squared error of every key's clusters (key, idx, count, sse, parts) as those whose union costs least merge, down to 2.

    A palette has at most 100 colours a key, so a task takes one whole: a union changes the costs of one row.  Equal costs go to the
    lowest idx, then to the lowest of the other.
    """

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["idx"].to_numpy())
        m, at = rows["count"].to_numpy().astype(float)[order], np.stack([rows[p].to_numpy() for p in parts], axis=1)[order]
        n, error, alive = len(m), [float(rows["sse"].to_numpy().sum())], np.ones(len(m), bool)
        costs = np.full((n, n), np.inf)

        def cost(i: int, others: np.ndarray) -> np.ndarray:
            return ((at[others] - at[i]) ** 2).sum(axis=1) * m[others] * m[i] / (m[others] + m[i])

        for i in range(n - 1):
            costs[i, i + 1 :] = cost(i, np.arange(i + 1, n))
        for _ in range(n - 2):
            i, j = np.unravel_index(costs.argmin(), costs.shape)
            error.append(error[-1] + costs[i, j])
            at[i] = (at[i] * m[i] + at[j] * m[j]) / (m[i] + m[j])
            m[i] += m[j]
            alive[j] = False
            costs[j], costs[:, j] = np.inf, np.inf
            rest = np.flatnonzero(alive)
            rest = rest[rest != i]
            costs[np.minimum(i, rest), np.maximum(i, rest)] = cost(i, rest)
        return pa.table({key: rows[key].combine_chunks().take(pa.array([0] * len(error))), "colours": pa.array(np.arange(n, n - len(error), -1, dtype=np.int32)), "sse": pa.array(error)})

    return entries.select(key, "idx", F.col("count").cast("double").alias("count"), "sse", *parts).groupBy(key).applyInArrow(run, f"{key} {dict(entries.dtypes)[key]}, colours int, sse double")


def predicted(blocks: Blocks, start: int = 48) -> DataFrame:
    """(key, low, suggested, high, ceiling): how many colours each key needs, by the gain of one more in root mean square error."""
    key = blocks.key
    curve = ward(blocks.clusters(start), key, blocks.parts)
    cells = blocks.rows.groupBy(key).agg(F.sum(F.aggregate("w", F.lit(0.0), lambda s, x: s + x)).alias("cells"))
    error = curve.join(cells, key).withColumn("rmse", F.sqrt(F.col("sse") / F.col("cells")))
    gain = F.lag("rmse").over(Window.partitionBy(key).orderBy("colours")) - F.col("rmse")
    gains = error.withColumn("gain", gain)
    reads = gains.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("gain") >= g, F.col("colours"))), F.least(F.max("colours"), F.lit(2))).alias(c) for c, g in zip(("low", "mid", "top"), kernels.GAINS, strict=True)))
    low, suggested, high = F.col("low"), F.greatest("low", "mid"), F.greatest("low", "mid", "top")
    ceiling = F.least(F.lit(48), F.greatest(F.floor(1.35 * high + 0.5), high + 3))
    return reads.select(key, *(c.cast("int").alias(n) for n, c in (("low", low), ("suggested", suggested), ("high", high), ("ceiling", ceiling))))
