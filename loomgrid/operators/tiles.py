"""Energy minimisation on planes of any size: tiles as array rows, halos exchanged each round, reading order kept across tiles.

A cell reads what the cells before it in reading order have become, so cells with the same x + 2y can be decided at once, and so can
tiles with the same column + 2 row: of what such a tile reads, the tiles above, to the left and to the upper right have had their
turn and the others not.  A round decides the tiles of one such line, of all charts; each gets the border cells of its eight
neighbours.  A task holds one tile; the labels are those of one sweep over the whole plane, whatever the tiles' size.

A plane that one tile holds has no neighbours to wait for: it takes all passes where it lies, many such planes at once, a line of all of
them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import kernels
from loomgrid.operators.grid import kept

#: Cells on a tile's side.
SIDE = 256
#: Cells of small planes that are swept at once, and that one task takes.
HELD, TASK = 1 << 18, 1 << 19
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
_STATE = "labels binary, dirty binary, top binary, bottom binary, lefts binary, rights binary, moved boolean"


def cut(cells: DataFrame, key: str, parts: list[str], side: int = SIDE) -> DataFrame:
    """(key, ti, tj, w, h, lab, labels): the cells (key, y, x, label, parts) of each tile with a margin of one cell, -1 where there is none."""
    width = len(parts)
    places = F.array_distinct(F.flatten(F.array(*(F.array(*(F.struct(F.floor((F.col("x") + dx) / side).cast("int").alias("ti"), F.floor((F.col("y") + dy) / side).cast("int").alias("tj")) for dx in (-1, 0, 1))) for dy in (-1, 0, 1)))))
    flat = cells.select(key, "y", "x", F.coalesce("label", F.lit(kernels.EMPTY)).cast("int").alias("label"), *(F.col(p).cast("double").alias(p) for p in parts), F.explode(places).alias("t")).select("*", "t.ti", "t.tj").drop("t")
    schema = f"{key} {dict(cells.dtypes)[key]}, ti int, tj int, lab binary, labels binary"

    def make(rows: pa.Table) -> pa.Table:
        ti, tj = rows["ti"][0].as_py(), rows["tj"][0].as_py()
        y, x = (rows[c].to_numpy() - o * side + 1 for c, o in (("y", tj), ("x", ti)))
        labels, lab = np.full((side + 2, side + 2), kernels.EMPTY, np.int16), np.full((side + 2, side + 2, width), np.nan)
        labels[y, x] = rows["label"].to_numpy()
        for i, p in enumerate(parts):
            lab[y, x, i] = rows[p].to_numpy(zero_copy_only=False)
        if (labels[1:-1, 1:-1] == kernels.EMPTY).all():
            return pa.table({n: pa.array([], k) for n, k in zip((key, "ti", "tj", "lab", "labels"), (rows[key].type, pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})
        return pa.table({key: rows[key].slice(0, 1), "ti": pa.array([ti], pa.int32()), "tj": pa.array([tj], pa.int32()), "lab": pa.array([lab.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary())})

    return flat.groupBy(key, "ti", "tj").applyInArrow(make, schema)


def sweep(grid: np.ndarray, dirty: np.ndarray, lab: np.ndarray, palette: np.ndarray, weights: tuple[float, float, float]) -> bool:
    """One pass in reading order over the inner cells of a padded tile, in place; whether any changed."""
    h, w = (n - 2 for n in grid.shape)
    colour, smoothness, edge_loss = weights
    costs = kernels.pair_costs(kernels.pair_evidence(lab), smoothness, edge_loss)
    k, filled, changed = len(palette), grid != kernels.EMPTY, False
    due = np.argwhere(dirty[1:-1, 1:-1])
    lines = set((due[:, 1] + 2 * due[:, 0]).tolist())
    while lines:
        line = min(lines)
        lines.remove(line)
        y = np.arange(max(0, -(-(line - w + 1) // 2)), min(h - 1, line // 2) + 1)
        y, x = y + 1, line - 2 * y + 1
        at = dirty[y, x]
        y, x = y[at], x[at]
        if not len(y):
            continue
        dirty[y, x] = False
        same, total, each = np.zeros((len(y), k)), np.zeros(len(y)), np.arange(len(y))
        for o, (dx, dy, _) in enumerate(kernels.OFFSETS):
            near = grid[y + dy, x + dx]
            cost = np.where(near == kernels.EMPTY, 0.0, costs[o, y, x])
            same[each, np.maximum(near, 0)] += cost
            total += cost
        best = (colour * kernels.distances_sq(lab[y, x], palette) + total[:, None] - same).argmin(axis=1)
        moved = best != grid[y, x]
        if moved.any():
            changed = True
            y, x = y[moved], x[moved]
            grid[y, x] = best[moved]
            for dx, dy, _ in kernels.OFFSETS:
                dirty[y + dy, x + dx] = filled[y + dy, x + dx]
                if dx + 2 * dy > 0:
                    inner = (y + dy >= 1) & (y + dy <= h) & (x + dx >= 1) & (x + dx <= w)
                    lines |= set((x + dx - 1 + 2 * (y + dy - 1))[inner].tolist())
    return changed


def _state(grid: np.ndarray, dirty: np.ndarray, moved: bool) -> dict:
    inner = grid[1:-1, 1:-1]
    sides = {"top": inner[0], "bottom": inner[-1], "lefts": inner[:, 0], "rights": inner[:, -1]}
    return {"labels": grid.tobytes(), "dirty": np.packbits(dirty).tobytes()} | {c: np.ascontiguousarray(v).tobytes() for c, v in sides.items()} | {"moved": moved}


def _halo(grid: np.ndarray, near: list[dict]) -> np.ndarray:
    """The tile's grid with the border cells of its neighbours around it."""
    new = grid.copy()
    for n in near:
        dx, dy = n["dx"], n["dy"]
        row = np.frombuffer(n["bottom" if dy < 0 else "top"], np.int16)
        column = np.frombuffer(n["rights" if dx < 0 else "lefts"], np.int16)
        if dx == 0:
            new[0 if dy < 0 else -1, 1:-1] = row
        elif dy == 0:
            new[1:-1, 0 if dx < 0 else -1] = column
        else:
            new[0 if dy < 0 else -1, 0 if dx < 0 else -1] = row[-1 if dx < 0 else 0]
    return new


def sweep_many(labels: list[np.ndarray], labs: list[np.ndarray], palettes: list[np.ndarray], weights: tuple[float, float, float], passes: int) -> list[np.ndarray]:
    """``kernels.settle`` of many planes at once: what it decides for a line of one plane, this decides for that line of all.

    Cells go by one number, their place in all padded planes; the costs of a cell's neighbours are added in the neighbours' order.
    """
    n, h, w, k = len(labels), max(len(g) for g in labels), max(g.shape[1] for g in labels), max(1, *(len(p) for p in palettes))
    colour, smoothness, edge_loss = weights
    width, size = labs[0].shape[2], (h + 2) * (w + 2)
    grid, costs, lab = np.full((n, h + 2, w + 2), kernels.EMPTY), np.zeros((8, n, h + 2, w + 2)), np.zeros((width, n, h + 2, w + 2))
    colours, missing = np.zeros((width, n, k)), np.ones((n, k), bool)
    for i, (g, at, p) in enumerate(zip(labels, labs, palettes, strict=True)):
        b, a = g.shape
        grid[i, 1 : b + 1, 1 : a + 1], lab[:, i, 1 : b + 1, 1 : a + 1] = g, np.moveaxis(at, 2, 0)
        costs[:, i, 1 : b + 1, 1 : a + 1] = kernels.pair_costs(kernels.pair_evidence(at), smoothness, edge_loss)
        colours[:, i, : len(p)], missing[i, : len(p)] = p.T, False
    grid, costs, lab, short = grid.ravel(), costs.reshape(8, -1), lab.reshape(width, -1), missing.any()
    filled = grid != kernels.EMPTY
    dirty = filled.copy()
    by_plane = dirty.reshape(n, size)
    around = np.array([dy * (w + 2) + dx for dx, dy, _ in kernels.OFFSETS])[:, None]
    lines = [(y + 1) * (w + 2) + line - 2 * y + 1 for line in range(w + 2 * h - 2) for y in [np.arange(max(0, -(-(line - w + 1) // 2)), min(h - 1, line // 2) + 1)]]
    for _ in range(passes):
        if not dirty.any():
            break
        for places in lines:
            c, i = np.nonzero(by_plane[:, places])
            if not len(c):
                continue
            at = c * size + places[i]
            dirty[at] = False
            beside = around + at
            near = grid[beside]
            cost = np.where(near == kernels.EMPTY, 0.0, costs[:, at])
            same = np.bincount((np.arange(len(at)) * k + np.maximum(near, 0)).ravel(), weights=cost.ravel(), minlength=len(at) * k).reshape(-1, k)
            far = np.zeros((len(at), k))
            for j in range(width):
                d = lab[j, at][:, None] - colours[j, c]
                d *= d
                far += d
            energy = colour * far + cost.sum(axis=0)[:, None] - same
            if short:
                energy[missing[c]] = np.inf
            best = energy.argmin(axis=1)
            moved = best != grid[at]
            if moved.any():
                grid[at[moved]] = best[moved]
                beside = beside[:, moved]
                dirty[beside] = filled[beside]
    grid = grid.reshape(n, h + 2, w + 2)
    return [grid[i, 1 : len(g) + 1, 1 : g.shape[1] + 1] for i, g in enumerate(labels)]


def _whole(cells: DataFrame, palettes: DataFrame, key: str, parts: list[str], weights: tuple[float, float, float], passes: int, tasks: int) -> DataFrame:
    """``settled`` of planes that one tile holds: a plane's colours and then its cells come to one task, which holds ``HELD`` cells of planes."""
    kind = dict(cells.dtypes)[key]
    values = [F.col(p).cast("double").alias(p) for p in parts]
    one = palettes.select(key, F.lit(0).alias("_cell"), F.lit(0).cast("long").alias("y"), F.col("idx").cast("long").alias("x"), F.lit(0).alias("label"), *values)
    two = cells.where("label is not null").select(key, F.lit(1).alias("_cell"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("label").cast("int").alias("label"), *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (key as an array of one, y, x, first y, first x, labels, lab, palette)
        open_: list[pa.RecordBatch] = []  # of the plane that is still coming
        tall = wide = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                done = sweep_many([v[5] for v in waiting], [v[6] for v in waiting], [v[7] for v in waiting], weights, passes)
                for (name, y, x, top, left, *_), grid in zip(waiting, done, strict=True):
                    yield pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(len(y), np.int64))), pa.array(y), pa.array(x), pa.array(grid[y - top, x - left].astype(np.int32))], names=[key, "y", "x", "label"])
                waiting.clear()

        def plane() -> tuple | None:
            rows = pa.Table.from_batches(open_)
            at = np.stack([rows[p].to_numpy() for p in parts], axis=1).astype(float)
            cell = rows["_cell"].to_numpy() == 1
            y, x = rows["y"].to_numpy()[cell], rows["x"].to_numpy()[cell]
            if not len(y) or cell.all():  # nothing to settle, or no colour to take
                return None
            top, left = int(y.min()), int(x.min())
            shape = (int(y.max()) - top + 1, int(x.max()) - left + 1)
            labels, lab = np.full(shape, kernels.EMPTY), np.full((*shape, len(parts)), np.nan)
            labels[y - top, x - left], lab[y - top, x - left] = rows["label"].to_numpy()[cell], at[cell]
            order = np.argsort(rows["x"].to_numpy()[~cell], kind="stable")
            return rows[key].combine_chunks().slice(0, 1), y, x, top, left, labels, lab, at[~cell][order]

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal tall, wide
            found = plane() if open_ else None
            open_.clear()
            if found:
                h, w = found[5].shape
                if waiting and (len(waiting) + 1) * max(tall, h) * max(wide, w) > HELD:
                    yield from flush()
                    tall = wide = 0
                tall, wide = max(tall, h), max(wide, w)
                waiting.append(found)

        for batch in batches:
            keys = batch.column(0)
            cuts = [0, *(np.flatnonzero(keys.slice(1).to_numpy(zero_copy_only=False) != keys.slice(0, len(keys) - 1).to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if open_ and open_[-1].column(0)[0] != keys[a]:
                        yield from closed()
                    open_.append(batch.slice(a, b - a))
        yield from closed()
        yield from flush()

    # by the key's hash, not the key: Spark 4.1.2 takes a union of sides that are dealt by the key for dealt, and then lets each merge its parts
    dealt = one.union(two).repartition(tasks, F.xxhash64(key)).sortWithinPartitions(key, "_cell")
    return dealt.mapInArrow(run, f"{key} {kind}, y long, x long, label int")


def settled(cells: DataFrame, palettes: DataFrame, key: str, parts: list[str], weights: tuple[float, float, float], passes: int = 8, side: int = SIDE) -> DataFrame:
    """(key, y, x, label) after energy minimisation, from cells (key, y, x, label, parts) and palettes (key, idx, parts), idx from 0 on.

    Colour distance and the cost of differing neighbours, least energy first, lower label on a tie, in reading order, until a pass changes
    nothing.  An empty cell has a null label and stays empty.
    """
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    planes = kept(cells.where("label is not null").groupBy(key).agg((span < side).alias("lone"), F.count("*").alias("n")))
    size = {r["lone"]: r["n"] for r in planes.groupBy("lone").agg(F.sum("n").alias("n")).collect()}
    empty = cells.where("label is null").select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.lit(None).cast("int").alias("label"))
    found = []
    for lone, cells_of in size.items():
        mine, colours = cells, palettes
        if len(size) > 1:
            held = planes.where("lone" if lone else "not lone").select(key)
            mine, colours = (rows.join(held, key, "left_semi") for rows in (cells, palettes))
        tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells_of // TASK))
        found.append(_whole(mine, colours, key, parts, weights, passes, tasks) if lone else _tiled(mine, colours, key, parts, weights, passes, side))
    return reduce(DataFrame.union, found, empty)


def _tiled(cells: DataFrame, palettes: DataFrame, key: str, parts: list[str], weights: tuple[float, float, float], passes: int, side: int) -> DataFrame:
    """``settled`` of planes of any size, without their empty cells."""
    width, kind = len(parts), dict(cells.dtypes)[key]
    colours = palettes.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.array(*parts).alias("at")))), lambda x: x["at"])).alias("c"))
    tiles = kept(cut(cells, key, parts, side).join(colours, key))
    tile = [key, "ti", "tj"]
    shape = (side + 2, side + 2)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grid = np.frombuffer(batch.column("labels")[i].as_buffer(), np.int16).reshape(shape)
                yield out(batch, i, _state(grid, grid != kernels.EMPTY, True))

    def out(batch: pa.RecordBatch, i: int, state: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in tile), *(pa.array([v]) for v in state.values())], names=[*tile, *state])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                before = np.frombuffer(batch.column("labels")[i].as_buffer(), np.int16).reshape(shape)
                grid = _halo(before, batch.column("near")[i].as_py() or [])
                dirty = np.unpackbits(np.frombuffer(batch.column("dirty")[i].as_buffer(), np.uint8), count=grid.size).reshape(shape).astype(bool)
                for y, x in np.argwhere(grid != before):  # in the margin alone
                    dirty[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] = True
                dirty &= grid != kernels.EMPTY
                dirty[[0, -1]] = dirty[:, [0, -1]] = False
                moved = False
                if dirty.any():
                    lab = np.frombuffer(batch.column("lab")[i].as_buffer(), np.float64).reshape(*shape, width)
                    moved = sweep(grid, dirty, lab, np.array(batch.column("c")[i].as_py()).reshape(-1, width), weights)
                yield out(batch, i, _state(grid, dirty, moved))

    schema = f"{key} {kind}, ti int, tj int, {_STATE}"
    line = F.col("ti") + 2 * F.col("tj")
    lines = sorted(r[0] for r in tiles.select(line).distinct().collect())  # as many as a plane has columns and rows of tiles
    state = {n: kept(tiles.where(line == n).select(*tile, "labels").mapInArrow(begin, schema)) for n in lines}
    for _ in range(passes):
        moved = False
        for n in lines:
            mine = state[n].select(*tile, "labels", "dirty")
            strips = [
                state[m].where(F.lit(True)).select(key, (F.col("ti") - dx).alias("ti"), (F.col("tj") - dy).alias("tj"), F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), "top", "bottom", "lefts", "rights").alias("n"))
                for dx, dy in AROUND for m in [n + dx + 2 * dy] if m in state
            ]
            near = reduce(DataFrame.union, strips).groupBy(*tile).agg(F.collect_list("n").alias("near")) if strips else None
            met = mine.join(near, tile, "left") if near is not None else mine.withColumn("near", F.lit(None).cast("array<struct<dx:int,dy:int,top:binary,bottom:binary,lefts:binary,rights:binary>>"))
            state[n] = kept(met.join(tiles.select(*tile, "lab", "c"), tile).mapInArrow(turn, schema))
            moved |= not state[n].where("moved").isEmpty()
        if not moved:
            break

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grid = np.frombuffer(batch.column("labels")[i].as_buffer(), np.int16).reshape(shape)[1:-1, 1:-1]
                y, x = np.nonzero(grid != kernels.EMPTY)
                ti, tj = (batch.column(c)[i].as_py() for c in ("ti", "tj"))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([i] * len(y))), pa.array(y + tj * side), pa.array(x + ti * side), pa.array(grid[y, x].astype(np.int32))], names=[key, "y", "x", "label"])

    done = reduce(DataFrame.union, [s.select(*tile, "labels") for s in state.values()]) if state else tiles.select(*tile, "labels")
    return done.mapInArrow(spread, f"{key} {kind}, y long, x long, label int")
