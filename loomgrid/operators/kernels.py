"""Order-dependent grid kernels as grouped functions: one chart or picture is one group, charts run side by side.

Inside a group everything is numpy over whole arrays; only what reads its own writes (diffusion, energy minimisation, small
recolouring) goes cell by cell.  A chart has at most 2.25 million cells and 100 labels, so a group's memory is bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EMPTY = -1
MASK = 0xFFFFFFFF
#: Seeding, convergence, merging and energy weights.
SEED = 0xC0FFEE
MAX_ROUNDS, STOP = 30, 1e-4
MERGE_GENERATED, MERGE_QUANTIZED = 0.0004, 0.012
COARSE, FINE = (1.0, 0.09, 0.015), (1.0, 0.045, 0.05)
FLOYD_STEINBERG = ((1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16))
ATKINSON = ((1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8))
KERNELS = {"floyd-steinberg": FLOYD_STEINBERG, "atkinson": ATKINSON}


class Mulberry:
    """The seeded 32-bit generator, draws in [0, 1)."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK

    def draw(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & MASK
        a = self.state
        t = (a ^ (a >> 15)) * (a | 1) & MASK
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & MASK)) & MASK
        return (t ^ (t >> 14)) / 4294967296.0


# ---------------------------------------------------------------- clustering


def seeds(points: np.ndarray, k: int, rng: Mulberry) -> np.ndarray:
    """k-means++ seeds; each next by the running sum of squared distances in point order, the first point if none is reached."""
    n = len(points)
    chosen = [points[int(rng.draw() * n)]]
    least = np.full(n, np.inf)
    while len(chosen) < k:
        d = ((points - chosen[-1]) ** 2).sum(axis=1)
        least = np.minimum(least, d)
        upto = np.cumsum(least)
        if upto[-1] == 0:
            chosen.append(points[int(rng.draw() * n)])
            continue
        wanted = rng.draw() * upto[-1]
        at = int(np.searchsorted(upto, wanted))
        chosen.append(points[at if at < n else 0])
    return np.array(chosen)


def distances_sq(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(points, centres) squared distances, channel by channel, which numpy adds up far faster than a short last axis."""
    out = np.zeros((len(points), len(centres)))
    for c in range(points.shape[1]):
        d = points[:, c, None] - centres[None, :, c]
        d *= d
        out += d
    return out


def assign(points: np.ndarray, centres: np.ndarray, block: int = 8_192) -> np.ndarray:
    """The nearest centre of each point, the first among equals."""
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), block):
        out[at : at + block] = distances_sq(points[at : at + block], centres).argmin(axis=1)
    return out


def lloyd(points: np.ndarray, centres: np.ndarray, weights: np.ndarray | None = None, rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) after moving centres to their means until none moves by more than the root of STOP; an empty one stays."""
    centres = centres.copy()
    w = np.ones(len(points)) if weights is None else weights
    for _ in range(rounds):
        labels = assign(points, centres)
        mass = np.bincount(labels, weights=w, minlength=len(centres))
        sums = np.stack([np.bincount(labels, weights=w * points[:, c], minlength=len(centres)) for c in range(points.shape[1])], axis=1)
        moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        shift = ((moved - centres) ** 2).sum(axis=1).max()
        centres = moved
        if shift < STOP:
            break
    return assign(points, centres), centres


def kmeans(points: np.ndarray, k: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) seeded by the numbers of points and colours; clusters without points are dropped."""
    k = min(k, len(points))
    labels, centres = lloyd(points, seeds(points, k, Mulberry(SEED ^ len(points) ^ k)), weights)
    used = np.unique(labels)
    return np.searchsorted(used, labels), centres[used]


def merge_close(labels: np.ndarray, palette: np.ndarray, limit: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, palette) after the closest pairs under the limit became one, the less used taking the other's place; on a tie the lower goes."""
    n = len(palette)
    counts = np.bincount(labels[labels >= 0], weights=None if weights is None else weights[labels >= 0], minlength=n).astype(float)
    d = ((palette[:, None] - palette[None]) ** 2).sum(axis=2)
    d[np.tril_indices(n)] = np.inf
    into = np.arange(n)
    while n > 1:
        i, j = np.unravel_index(d.argmin(), d.shape)
        if d[i, j] >= limit:
            break
        loser, winner = (i, j) if counts[i] <= counts[j] else (j, i)
        into[into == loser] = winner
        counts[winner] += counts[loser]
        d[loser, :] = d[:, loser] = np.inf
    alive = np.unique(into)
    number = np.searchsorted(alive, into)
    return np.where(labels >= 0, number[np.maximum(labels, 0)], labels), palette[alive]


def worst_fit(points: np.ndarray, labels: np.ndarray, centres: np.ndarray, importance: np.ndarray, free: int) -> np.ndarray:
    """The centres and up to ``free`` more, each the point whose weighted distance to its nearest centre is largest, the first among equals."""
    least = ((points - centres[labels]) ** 2).sum(axis=1)
    for _ in range(free):
        score = least * (1 + importance)
        at = int(score.argmax())
        if score[at] <= 0:
            break
        centres = np.vstack([centres, points[at]])
        least = np.minimum(least, ((points - points[at]) ** 2).sum(axis=1))
    return centres


def quantize(points: np.ndarray, k: int, importance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """k-means, then near-equal clusters merge and the slots so freed go to the worst fitted points; nothing freed, nothing merged."""
    labels, centres = kmeans(points, k)
    merged, fewer = merge_close(labels, centres, MERGE_QUANTIZED)
    free = len(centres) - len(fewer)
    if not free:
        return labels, centres
    more = worst_fit(points, merged, fewer, np.zeros(len(points)) if importance is None else importance, free)
    labels, centres = lloyd(points, more)
    used = np.unique(labels)
    return np.searchsorted(used, labels), centres[used]


def ward(points: np.ndarray, start: int = 48) -> list[tuple[int, float]]:
    """(clusters, root mean square error) from ``start`` clusters down to 2, always merging the pair that costs least."""
    labels, centres = kmeans(points, start)
    mass = np.bincount(labels, minlength=len(centres)).astype(float)
    error = float(((points - centres[labels]) ** 2).sum())
    curve = [(len(centres), (error / len(points)) ** 0.5)]
    while len(centres) > 2:
        d = ((centres[:, None] - centres[None]) ** 2).sum(axis=2) * mass[:, None] * mass[None] / (mass[:, None] + mass[None])
        d[np.tril_indices(len(d))] = np.inf
        i, j = np.unravel_index(d.argmin(), d.shape)
        error += d[i, j]
        centres[i] = (centres[i] * mass[i] + centres[j] * mass[j]) / (mass[i] + mass[j])
        mass[i] += mass[j]
        centres, mass = np.delete(centres, j, axis=0), np.delete(mass, j)
        curve.append((len(centres), (error / len(points)) ** 0.5))
    return curve


#: Fixed values of the prediction: the gain of one more colour that ends the low, suggested and high readings; the ceiling.
GAINS = (0.0040, 0.0018, 0.0008)


def predict_colours(points: np.ndarray) -> dict[str, int]:
    """How many colours a picture needs: from the top down, the count whose last colour still gains enough."""
    curve = dict(ward(points))
    top = max(curve)

    def reading(gain: float) -> int:
        n = top
        while n > 2 and curve[n - 1] - curve[n] < gain:
            n -= 1
        return n

    low, suggested, high = (reading(g) for g in GAINS)
    return {"low": low, "suggested": max(low, suggested), "high": max(low, suggested, high), "ceiling": min(48, max(int(1.35 * high + 0.5), high + 3))}


# ---------------------------------------------------------------- grids


def _shifts(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """Each cell's neighbour at (dy, dx), ``fill`` beyond the edge."""
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def label_regions(labels: np.ndarray, corners: bool = False) -> np.ndarray:
    """4-connected regions of one label, 8-connected with ``corners``, numbered by their first cell in reading order; empty cells are -1.

    Labels fall to the least neighbour's, then to their own root's, until none moves: rounds grow with the logarithm of a region's turns.
    """
    h, w = labels.shape
    ids = np.arange(h * w).reshape(h, w)
    filled = labels != EMPTY
    right, down = (labels[:, 1:] == labels[:, :-1]) & filled[:, 1:], (labels[1:] == labels[:-1]) & filled[1:]
    slant, other = (labels[1:, 1:] == labels[:-1, :-1]) & filled[1:, 1:], (labels[1:, :-1] == labels[:-1, 1:]) & filled[1:, :-1]
    root = ids.copy()
    while True:
        new = root.copy()
        if corners:
            np.minimum(new[1:, 1:], root[:-1, :-1], out=new[1:, 1:], where=slant)
            np.minimum(new[:-1, :-1], root[1:, 1:], out=new[:-1, :-1], where=slant)
            np.minimum(new[1:, :-1], root[:-1, 1:], out=new[1:, :-1], where=other)
            np.minimum(new[:-1, 1:], root[1:, :-1], out=new[:-1, 1:], where=other)
        np.minimum(new[:, 1:], root[:, :-1], out=new[:, 1:], where=right)
        np.minimum(new[:, :-1], root[:, 1:], out=new[:, :-1], where=right)
        np.minimum(new[1:], root[:-1], out=new[1:], where=down)
        np.minimum(new[:-1], root[1:], out=new[:-1], where=down)
        hooked = np.arange(h * w)
        np.minimum.at(hooked, root.ravel(), new.ravel())
        while not np.array_equal(hooked, hooked[hooked]):
            hooked = hooked[hooked]
        new = hooked[new]
        if np.array_equal(new, root):
            break
        root = new
    kept = np.unique(root[filled])
    return np.where(filled, np.searchsorted(kept, root), EMPTY)


#: Colours up to which plain numbers find the nearest sooner than an array does.
FEW = 24


def diffuse(lab: np.ndarray, palette: np.ndarray, kernel: str, skip: np.ndarray | None = None) -> np.ndarray:
    """Error diffusion in turning rows: each cell takes its nearest colour and hands its error on; skipped cells neither take nor get any.

    Cells go one by one as plain numbers, which arrays of three would slow down many times.
    """
    h, w = lab.shape[:2]
    work, colours, none = lab.astype(float).tolist(), np.asarray(palette, float).tolist(), [False] * w
    skips = [none] * h if skip is None else skip.tolist()
    out = [[EMPTY] * w for _ in range(h)]
    parts = KERNELS[kernel]
    for y in range(h):
        way = 1 if y % 2 == 0 else -1
        row, left_out = work[y], skips[y]
        rest = [(work[y + dy], skips[y + dy], way * dx, weight) for dx, dy, weight in parts if y + dy < h]
        for x in range(w)[::way]:
            if left_out[x]:
                continue
            u0, u1, u2 = row[x]
            if len(colours) <= FEW:
                c, least = 0, None
                for i, (pl, pa, pb) in enumerate(colours):
                    u, v, t = pl - u0, pa - u1, pb - u2
                    d = u * u + v * v + t * t
                    if least is None or d < least:
                        c, least = i, d
            else:
                c = int(((palette - row[x]) ** 2).sum(axis=1).argmin())
            out[y][x] = c
            pl, pa, pb = colours[c]
            e0, e1, e2 = u0 - pl, u1 - pa, u2 - pb
            for other, passed, dx, weight in rest:
                nx = x + dx
                if 0 <= nx < w and not passed[nx]:
                    cell = other[nx]
                    cell[0] += e0 * weight
                    cell[1] += e1 * weight
                    cell[2] += e2 * weight
    return np.array(out).reshape(h, w)


_G = 1 / (1 + 2**0.5)
#: (dx, dy, weight): four sides, then four corners.
OFFSETS = ((1, 0, _G), (-1, 0, _G), (0, 1, _G), (0, -1, _G), (1, 1, _G / 2**0.5), (1, -1, _G / 2**0.5), (-1, 1, _G / 2**0.5), (-1, -1, _G / 2**0.5))
#: Which of a cell's four evidence slots an offset reads, and whether the neighbour's own.
SLOTS = {(1, 0): (0, False), (-1, 0): (0, True), (0, 1): (1, False), (0, -1): (1, True), (1, 1): (2, False), (-1, -1): (2, True), (-1, 1): (3, False), (1, -1): (3, True)}


def pair_costs(evidence: np.ndarray, smoothness: float, edge_loss: float) -> np.ndarray:
    """(8, h, w): what a different label at each neighbour costs, 0 beyond the edge."""
    h, w = evidence.shape[:2]
    out = np.zeros((8, h, w))
    for o, (dx, dy, weight) in enumerate(OFFSETS):
        slot, on_other = SLOTS[dx, dy]
        e = _shifts(evidence[:, :, slot], dy, dx, 0.0) if on_other else evidence[:, :, slot]
        inside = _shifts(np.ones((h, w)), dy, dx, 0.0)
        out[o] = weight * np.maximum(0.0, smoothness * (1 - e) - edge_loss * e) * inside
    return out


def settle(labels: np.ndarray, lab: np.ndarray, palette: np.ndarray, evidence: np.ndarray, weights: tuple[float, float, float], passes: int = 8) -> np.ndarray:
    """Energy minimisation in reading order: colour distance and the cost of differing neighbours, least energy first, lower label on a tie.

    A cell reads what earlier ones have become, and is looked at again only after a neighbour changed.  Cells with the same
    x + 2y neither neighbour each other nor wait for one another, so each such line is decided at once, with the same outcome.
    """
    h, w = labels.shape
    colour, smoothness, edge_loss = weights
    costs = pair_costs(evidence, smoothness, edge_loss)
    grid = np.full((h + 2, w + 2), EMPTY)
    grid[1:-1, 1:-1] = labels
    dirty = np.zeros((h + 2, w + 2), bool)
    dirty[1:-1, 1:-1] = labels != EMPTY
    filled, k = dirty.copy(), len(palette)
    ys, xs = np.indices((h, w)).reshape(2, -1)
    order = np.argsort(xs + 2 * ys, kind="stable")
    cuts = np.cumsum(np.bincount((xs + 2 * ys), minlength=w + 2 * h - 2))
    ys, xs = ys[order], xs[order]
    for _ in range(passes):
        changed, start = False, 0
        for end in cuts.tolist():
            y, x = ys[start:end], xs[start:end]
            start = end
            due = dirty[y + 1, x + 1]
            if not due.any():
                continue
            y, x = y[due], x[due]
            dirty[y + 1, x + 1] = False
            same, total, at = np.zeros((len(y), k)), np.zeros(len(y)), np.arange(len(y))
            for o, (dx, dy, _) in enumerate(OFFSETS):
                near = grid[y + 1 + dy, x + 1 + dx]
                cost = np.where(near == EMPTY, 0.0, costs[o, y, x])
                same[at, np.maximum(near, 0)] += cost
                total += cost
            best = (colour * distances_sq(lab[y, x], palette) + total[:, None] - same).argmin(axis=1)
            moved = best != grid[y + 1, x + 1]
            if moved.any():
                changed = True
                y, x, best = y[moved], x[moved], best[moved]
                grid[y + 1, x + 1] = best
                for dx, dy, _ in OFFSETS:
                    dirty[y + 1 + dy, x + 1 + dx] = filled[y + 1 + dy, x + 1 + dx]
        if not changed:
            break
    return grid[1:-1, 1:-1].copy()


def settle_scales(labels: np.ndarray, lab: np.ndarray, palette: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    return settle(settle(labels, lab, palette, evidence, COARSE), lab, palette, evidence, FINE)


def small_of(shape: tuple[int, int]) -> int:
    """The most cells of a small region."""
    return 2 if shape[0] * shape[1] < 2500 else 6


def recolour_small(labels: np.ndarray, lab: np.ndarray, palette: np.ndarray, small: int | None = None) -> np.ndarray:
    """Regions of a few cells (2 on a small chart, else 6) take, in order, the neighbouring label nearest to their mean colour."""
    h, w = labels.shape
    small = small_of(labels.shape) if small is None else small
    ids = label_regions(labels)
    out = labels.copy()
    flat, colours, parts = out.ravel(), palette.tolist(), lab.shape[2]
    of = ids.ravel()
    areas = np.bincount(of[of >= 0], minlength=1)
    little = np.flatnonzero((areas <= small) & (areas > 0))
    cells = np.flatnonzero((of >= 0) & (areas <= small)[np.maximum(of, 0)])
    cells = cells[np.argsort(of[cells], kind="stable")]
    starts = np.concatenate([[0], np.cumsum(areas[little])])
    means = np.zeros((len(little), parts))
    for area in np.unique(areas[little]).tolist():
        same = areas[little] == area
        means[same] = lab.reshape(-1, parts)[cells[starts[:-1][same, None] + np.arange(area)]].mean(axis=1)
    # the neighbours of a small region's cells in other regions; only small regions change, and no cell is emptied
    y, x = np.divmod(cells, w)
    ny, nx = (v[:, None] + np.array(d) for v, d in ((y, (-1, 0, 0, 1)), (x, (0, -1, 1, 0))))
    near = np.clip(ny, 0, h - 1) * w + np.clip(nx, 0, w - 1)
    there = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w) & (of[near] != of[cells][:, None]) & (flat[near] != EMPTY)
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))])[starts].tolist()
    near, held = near[there].tolist(), flat[near[there]].tolist()
    became: dict[int, int] = {}
    for region, mean in enumerate(means.tolist()):
        a, b = ends[region], ends[region + 1]
        best, least = None, None
        for c in sorted({became.get(q, v) for q, v in zip(near[a:b], held[a:b], strict=True)}):
            d = 0.0
            for p, m in zip(colours[c], mean, strict=True):
                d += (p - m) * (p - m)
            if least is None or d < least:
                best, least = c, d
        if best is not None:
            became.update((cell, best) for cell in cells[starts[region] : starts[region + 1]].tolist())
    flat[list(became)] = list(became.values())
    return out


def _corners(grid: np.ndarray) -> np.ndarray:
    """(h - 1, w - 1): the squares of four cells in which two of one label touch only at a corner."""
    a, b, c, d = grid[:-1, :-1], grid[:-1, 1:], grid[1:, :-1], grid[1:, 1:]
    whole = (a != EMPTY) & (b != EMPTY) & (c != EMPTY) & (d != EMPTY)
    return whole & (((a == d) & (b != a) & (c != a)) | ((b == c) & (a != b) & (d != b)))


def mend_diagonals(labels: np.ndarray, lab: np.ndarray, palette: np.ndarray, ceiling: float = 0.02, passes: int = 4) -> np.ndarray:
    """Where two cells of one label touch only at a corner, the cheaper of the two between them joins, if it costs less than the ceiling.

    A pass looks, in reading order, at the squares that have such a corner, and at those that get one from a cell that joined before them.
    """
    h, w = labels.shape
    grid = labels.copy()
    for _ in range(passes):
        changed, due = False, np.flatnonzero(_corners(grid)).tolist()  # in order, so a heap
        last = -1
        while due:
            at = heapq.heappop(due)
            if at == last:
                continue
            last, (y, x) = at, divmod(at, w - 1)
            for (ay, ax), (by, bx), others in (((y, x), (y + 1, x + 1), ((y, x + 1), (y + 1, x))), ((y, x + 1), (y + 1, x), ((y, x), (y + 1, x + 1)))):
                c = grid[ay, ax]
                if c == EMPTY or grid[by, bx] != c or any(grid[o] in (c, EMPTY) for o in others):
                    continue
                price = [((lab[o] - palette[c]) ** 2).sum() - ((lab[o] - palette[grid[o]]) ** 2).sum() for o in others]
                i = int(np.argmin(price))
                if price[i] < ceiling:
                    (oy, ox), changed = others[i], True
                    grid[oy, ox] = c
                    for ny, nx in ((ny, nx) for ny in (oy - 1, oy) for nx in (ox - 1, ox) if 0 <= ny < h - 1 and 0 <= nx < w - 1):
                        if ny * (w - 1) + nx > at:
                            heapq.heappush(due, ny * (w - 1) + nx)
        if not changed:
            break
    return grid


#: Cells of more importance keep their colour when the picture is calmed.
IMPORTANT = 0.5


def guarded(importance: np.ndarray, empty: np.ndarray | None = None) -> np.ndarray:
    """Which cells are protected: those of importance above the bar, and empty ones."""
    return importance > IMPORTANT if empty is None else (importance > IMPORTANT) | empty


def medoid_filter(lab: np.ndarray, protect: np.ndarray | None = None) -> np.ndarray:
    """Each cell's 3 × 3 neighbour with the least summed distance to the others, the centre first on a tie; protected cells stay.

    Two neighbours lie at one of twelve steps from each other, so twelve planes of distances hold all that is summed.
    """
    h, w = lab.shape[:2]
    offsets = [(0, 0)] + [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
    padded = np.full((h + 2, w + 2, lab.shape[2]), np.nan)
    padded[1:-1, 1:-1] = lab
    apart = {}
    for dy, dx in ((dy, dx) for dy in (0, 1, 2) for dx in (-2, -1, 0, 1, 2) if (dy, dx) > (0, 0)):
        rows, columns = h + 2 - dy, slice(max(0, -dx), w + 2 - max(0, dx))
        apart[dy, dx] = np.zeros((h + 2, w + 2))
        if rows > 0 and columns.stop > columns.start:
            gap = padded[:rows, columns] - padded[dy:, columns.start + dx : columns.stop + dx]
            apart[dy, dx][:rows, columns] = np.nan_to_num(np.sqrt((gap**2).sum(axis=2)))
    there = ~np.isnan(padded[..., 0])
    sums = np.zeros((9, h, w))
    for i, a in enumerate(offsets):
        for b in offsets:
            if a != b:
                (oy, ox), (py, px) = min(a, b), max(a, b)
                sums[i] += apart[py - oy, px - ox][1 + oy : 1 + oy + h, 1 + ox : 1 + ox + w]
        sums[i][~there[1 + a[0] : 1 + a[0] + h, 1 + a[1] : 1 + a[1] + w]] = np.inf
    best = sums.argmin(axis=0)
    oy, ox = np.array(offsets).T
    y, x = np.indices((h, w)) + 1
    out = padded[y + oy[best], x + ox[best]]
    return out if protect is None else np.where(protect[:, :, None], lab, out)


def pair_evidence(lab: np.ndarray, tau: float = 0.01) -> np.ndarray:
    """(h, w, 4): for right, down and the two lower diagonals, how surely an edge lies between, 1 - exp(-d²/2τ²) of the colour distance."""
    out = np.zeros((*lab.shape[:2], 4))
    for slot, (dx, dy) in enumerate(((1, 0), (0, 1), (1, 1), (-1, 1))):
        d2 = ((lab - _shifts(lab, dy, dx, np.nan)) ** 2).sum(axis=2)
        out[:, :, slot] = np.nan_to_num(1 - np.exp(-d2 * d2 / (2 * tau * tau)))
    return out


def reserve_hues(lab: np.ndarray, labels: np.ndarray, palette: np.ndarray, most: int = 6, share: float = 0.002, far: float = 0.01) -> np.ndarray:
    """The palette with up to ``most`` colours for hues that have cells but no colour near: heaviest hue first, each in the slot that merging the closest pair frees."""
    chroma = np.hypot(lab[:, 1], lab[:, 2])
    hue = np.minimum((np.mod(np.arctan2(lab[:, 2], lab[:, 1]) / (2 * np.pi) + 1, 1) * 12).astype(int), 11)
    strong = chroma > 0.04
    counts = np.bincount(hue[strong], minlength=12)
    palette = palette.copy()
    for b in sorted(range(12), key=lambda b: (-counts[b], b))[:most]:
        if counts[b] < share * len(lab):
            continue
        inside = np.flatnonzero(strong & (hue == b))
        best = lab[inside[chroma[inside].argmax()]]
        if ((palette - best) ** 2).sum(axis=1).min() <= far or len(palette) < 3:
            continue
        d = ((palette[:, None] - palette[None]) ** 2).sum(axis=2)
        d[np.tril_indices(len(d))] = np.inf
        i, j = np.unravel_index(d.argmin(), d.shape)
        palette[i] = (palette[i] + palette[j]) / 2
        palette[j] = best
    return palette


def greedy_match(distances: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs, the closest first, each side used once; equal distances in row order."""
    order = np.argsort(distances.ravel(), kind="stable")
    rows, columns, found = set(), set(), []
    for at in order.tolist():
        i, j = divmod(at, distances.shape[1])
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            found.append((i, j))
    return sorted(found)


def quota_top(rows: pd.DataFrame, per_block: int, cap: int, reach: float) -> pd.DataFrame:
    """Strongest first: at most ``per_block`` of each 8 × 8 block and ``cap`` in all, none nearer than ``reach`` to one already taken."""
    return rows.iloc[quota_places(*(rows[c].to_numpy() for c in ("y", "x", "strength")), per_block, cap, reach)]


def quota_places(ys: np.ndarray, xs: np.ndarray, strength: np.ndarray, per_block: int, cap: int, reach: float) -> list[int]:
    """The numbers of the rows that ``quota_top`` takes."""
    taken: dict[tuple[int, int], list[tuple[float, float]]] = {}
    blocks: dict[tuple[int, int], int] = {}
    keep: list[int] = []
    order = np.lexsort((xs, ys, -strength))
    for i, x, y in zip(order.tolist(), xs[order].tolist(), ys[order].tolist(), strict=True):
        if len(keep) >= cap:
            break
        block = (int(y) // 8, int(x) // 8)
        if blocks.get(block, 0) >= per_block:
            continue
        sy, sx = int(y // reach), int(x // reach)
        if any((x - a) ** 2 + (y - b) ** 2 < reach * reach for dy in (-1, 0, 1) for dx in (-1, 0, 1) for a, b in taken.get((sy + dy, sx + dx), ())):
            continue
        keep.append(i)
        blocks[block] = blocks.get(block, 0) + 1
        taken.setdefault((sy, sx), []).append((x, y))
    return keep


def budgeted(lengths: list[float], budget: float) -> list[int]:
    """Which are taken in order while the running sum stays within the budget; one too long is passed over, later ones may fit."""
    taken, used = [], 0.0
    for i, n in enumerate(lengths):
        if used + n <= budget:
            used += n
            taken.append(i)
    return taken


# ---------------------------------------------------------------- charts as groups


def grid_of(rows: pd.DataFrame, columns: list[str], fill: float = np.nan) -> np.ndarray:
    h, w = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
    out = np.full((h, w, len(columns)), fill)
    out[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows[columns].to_numpy(float)
    return out


def per_chart(cells: DataFrame, function: Callable[[np.ndarray], np.ndarray], columns: list[str], key: str = "chart_id") -> DataFrame:
    """(key, y, x, label): a kernel over each chart's columns as an (h, w, n) array; it gives labels, -1 for an empty cell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        labels = function(grid_of(rows, columns))
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        out = pd.Series(labels[y, x]).astype("Int32")
        return pd.DataFrame({key: rows[key].to_numpy(), "y": y, "x": x, "label": out.mask(out < 0)})

    return cells.select(key, "y", "x", *columns).groupBy(key).applyInPandas(run, f"{key} long, y long, x long, label int")


class Run:
    """A chart being made: OKLab cells (NaN: empty) and what the stages have found so far."""

    def __init__(self, lab: np.ndarray, colours: int, importance: np.ndarray | None = None) -> None:
        self.colours, self.empty = colours, np.isnan(lab).any(axis=2)
        self.cells = np.where(self.empty[..., None], 0.0, lab)
        self.protect = self.empty if importance is None else guarded(importance, self.empty)
        self.calm, self.labels, self.palette = self.cells, np.full(lab.shape[:2], EMPTY), np.zeros((0, 3))


def _calmed(run: Run) -> None:
    run.calm = medoid_filter(run.cells, run.protect)


def _quantized(run: Run) -> None:
    run.labels[~run.empty], run.palette = quantize(run.calm[~run.empty], run.colours)


def _settled(run: Run) -> None:
    run.labels = settle_scales(run.labels, run.cells, run.palette, pair_evidence(run.cells))


def _cleared(run: Run) -> None:
    run.labels = recolour_small(run.labels, run.cells, run.palette)


def _mended(run: Run) -> None:
    run.labels = mend_diagonals(run.labels, run.cells, run.palette)


def _merged(run: Run) -> None:
    run.labels = merge_close(run.labels.ravel(), run.palette, MERGE_GENERATED)[0].reshape(run.labels.shape)


#: The steps of a chart, in order: calm, quantize, settle coarse and fine, clear small regions, mend diagonals, merge near colours.
STAGES = [("calm", _calmed), ("quantize", _quantized), ("settle", _settled), ("clear", _cleared), ("mend", _mended), ("clear again", _cleared), ("merge", _merged)]


def chart(lab: np.ndarray, colours: int, importance: np.ndarray | None = None) -> np.ndarray:
    """A whole chart's labels from OKLab cells (NaN: empty)."""
    run = Run(lab, colours, importance)
    if not run.empty.all():
        for _, stage in STAGES:
            stage(run)
    return run.labels


def registry() -> dict[str, Callable[[np.ndarray], np.ndarray]]:
    """The named whole-chart kernels."""
    ends = np.array([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]])
    return {name: (lambda lab, name=name: diffuse(np.nan_to_num(lab), ends, name, np.isnan(lab).any(axis=2))) for name in KERNELS} | {"chart": lambda lab: chart(lab, 8)}

