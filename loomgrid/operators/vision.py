"""Kernels on one picture: gamut mapping, edge evidence, ridges, strokes, hand-drawn thresholds, two-mode fits, polylines to segments.

Each takes and gives numpy arrays and goes over a whole picture at once; ``per_picture`` runs one as a grouped function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomgrid.functions import colour
from loomgrid.operators import kernels

TO_LMS, TO_LAB, FROM_LAB, FROM_LMS = (np.array(m) for m in (colour.TO_LMS, colour.TO_LAB, colour.FROM_LAB, colour.FROM_LMS))
#: Gamut tolerance, just noticeable difference, chroma step; edge response scale; blur radius.
GAMUT, NOTICED, CHROMA_STEP, TAU, RADIUS = 1e-6, 0.02, 1e-4, 0.01, 2


def linear_of(lab: np.ndarray) -> np.ndarray:
    return ((lab @ FROM_LAB.T) ** 3) @ FROM_LMS.T


def oklab_of(linear: np.ndarray) -> np.ndarray:
    return np.cbrt(linear @ TO_LMS.T) @ TO_LAB.T


def gamut_map(lab: np.ndarray) -> np.ndarray:
    """Linear sRGB of OKLab rows; what lies outside loses chroma by bisection until clipping it would not be noticed."""
    inside = lambda c: ((c >= -GAMUT) & (c <= 1 + GAMUT)).all(axis=1)
    clip = lambda c: np.clip(c, 0, 1)
    error = lambda c, of: np.sqrt(((oklab_of(clip(c)) - of) ** 2).sum(axis=1))
    out = clip(linear_of(lab))
    chroma = np.hypot(lab[:, 1], lab[:, 2])
    busy = ~inside(linear_of(lab)) & (error(linear_of(lab), lab) >= NOTICED) & (lab[:, 0] > 0) & (lab[:, 0] < 1)
    low, high, low_inside = np.zeros(len(lab)), np.ones(len(lab)), np.ones(len(lab), bool)
    while True:
        at = np.flatnonzero(busy & ((high - low) * chroma > CHROMA_STEP))
        if not len(at):
            break
        scale = (low[at] + high[at]) / 2
        tried = lab[at] * np.stack([np.ones(len(at)), scale, scale], axis=1)
        linear = linear_of(tried)
        fits, e = low_inside[at] & inside(linear), error(linear, tried)
        near = ~fits & (e < NOTICED)
        out[at[fits | near]] = clip(linear[fits | near])
        low[at[fits | near]] = scale[fits | near]
        low_inside[at[near]] = False
        busy[at[near & (NOTICED - e < CHROMA_STEP)]] = False
        high[at[~fits & ~near]] = scale[~fits & ~near]
    out[lab[:, 0] <= 0], out[lab[:, 0] >= 1] = 0.0, 1.0
    return out


def _toe(x: np.ndarray) -> np.ndarray:
    k1, k2 = 0.206, 0.03
    k3 = (1 + k1) / (1 + k2)
    return 0.5 * (k3 * x - k1 + np.sqrt((k3 * x - k1) ** 2 + 4 * k2 * k3 * x))


def most_chroma(light: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 30) -> np.ndarray:
    """The chroma at which each hue leaves sRGB at its lightness, by bisection."""
    low, high = np.zeros(len(light)), np.full(len(light), 0.5)
    for _ in range(steps):
        middle = (low + high) / 2
        c = linear_of(np.stack([light, a * middle, b * middle], axis=1))
        inside = ((c >= -1e-9) & (c <= 1 + 1e-9)).all(axis=1)
        low, high = np.where(inside, middle, low), np.where(inside, high, middle)
    return low


def okhsl(rgb: np.ndarray) -> np.ndarray:
    """(hue, saturation, lightness), 0 to 1 each, of sRGB bytes; saturation is the share of the chroma that its hue and lightness allow."""
    v = rgb / 255.0
    lab = oklab_of(np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4))
    chroma = np.hypot(lab[:, 1], lab[:, 2])
    unit = lab[:, 1:] / np.maximum(chroma, 1e-12)[:, None]
    most = most_chroma(np.clip(lab[:, 0], 1e-6, 1 - 1e-6), unit[:, 0], unit[:, 1])
    grey = chroma < 1e-6
    saturation = np.where(grey | (most <= 0), 0.0, np.clip(chroma / np.maximum(most, 1e-12), 0, 1))
    return np.stack([np.where(grey, 0.0, 0.5 + 0.5 * np.arctan2(-lab[:, 2], -lab[:, 1]) / np.pi), saturation, _toe(lab[:, 0])], axis=1)


# ---------------------------------------------------------------- stencils


def box_blur(a: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Means of (2·radius + 1)² squares, the edges' values repeated beyond them."""
    for axis in (0, 1):
        pad = [(radius, radius) if i == axis else (0, 0) for i in range(a.ndim)]
        sums = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
        sums = np.concatenate([np.zeros_like(np.take(sums, [0], axis=axis)), sums], axis=axis)
        n = a.shape[axis]
        a = (np.take(sums, np.arange(2 * radius + 1, 2 * radius + 1 + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)) / (2 * radius + 1)
    return a


def _slope(a: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided at the edges."""
    if a.shape[axis] < 2:
        return np.zeros_like(a)
    return np.gradient(a, axis=axis)


def edge_evidence(lab: np.ndarray, w: int, h: int) -> np.ndarray:
    """(h, w, 4): how surely an edge lies between a cell and its neighbours at the right, below and on the lower diagonals.

    The colour's slope along the way between the cells, squared, is a quadratic form of the structure tensor, so three summed-area
    tables answer every direction and every window; the mean s of a window the size of a cell gives 1 - exp(-s² / 2τ²).
    """
    soft = box_blur(lab)
    dx, dy = _slope(soft, 1), _slope(soft, 0)
    tensor = np.stack([(dx * dx).sum(axis=2), (dx * dy).sum(axis=2), (dy * dy).sum(axis=2)], axis=2)
    table = np.zeros((lab.shape[0] + 1, lab.shape[1] + 1, 3))
    table[1:, 1:] = tensor.cumsum(axis=0).cumsum(axis=1)
    ch, cw = lab.shape[0] / h, lab.shape[1] / w
    out = np.zeros((h, w, 4))
    for slot, (ox, oy) in enumerate(((1, 0), (0, 1), (1, 1), (-1, 1))):
        ux, uy = ox / np.hypot(ox, oy), oy / np.hypot(ox, oy)
        my, mx = (np.arange(h) + 0.5 + oy / 2) * ch, (np.arange(w) + 0.5 + ox / 2) * cw
        span = lambda m, half, n: (np.maximum(0, np.floor(m - half)).astype(int), np.minimum(n - 1, np.ceil(m + half)).astype(int) + 1)
        (y0, y1), (x0, x1) = span(my, max(1, ch / 2), lab.shape[0]), span(mx, max(1, cw / 2), lab.shape[1])
        y0, x0 = np.minimum(y0, lab.shape[0] - 1), np.minimum(x0, lab.shape[1] - 1)
        area = np.maximum(1, (y1 - y0)[:, None] * (x1 - x0)[None])
        sums = table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]
        mean = (sums @ np.array([ux * ux, 2 * ux * uy, uy * uy])) / area
        value = 1 - np.exp(-mean * mean / (2 * TAU * TAU))
        there = ((np.arange(h) + oy < h)[:, None]) & (((np.arange(w) + ox >= 0) & (np.arange(w) + ox < w))[None])
        out[:, :, slot] = np.where(there, value, 0.0)
    return out


def gaussian_taps(sigma: float) -> list[np.ndarray]:
    """A Gaussian's taps and those of its first and second derivative, exact on straight lines and parabolas."""
    r = int(np.ceil(4 * sigma))
    t = np.arange(-r, r + 1)
    g = np.exp(-t * t / (2 * sigma * sigma))
    g /= g.sum()
    second = (t * t - (t * t * g).sum()) * g
    return [g, -t * g / (t * t * g).sum(), 2 * second / (t * t * second).sum()]


def gaussian_derivatives(a: np.ndarray, sigma: float) -> dict[str, np.ndarray]:
    """First and second derivatives of a picture, or of a stack of pictures, smoothed by a Gaussian, the edges' values repeated."""
    taps = gaussian_taps(sigma)
    r = len(taps[0]) // 2

    def run(x: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
        axis += x.ndim - 2
        padded = np.pad(x, [(r, r) if i == axis else (0, 0) for i in range(x.ndim)], mode="edge")
        along = lambda i: padded[(slice(None),) * axis + (slice(i, i + x.shape[axis]),)]
        return sum(w * along(i) for i, w in enumerate(k[::-1]))

    g, one, two = (run(a, k, 1) for k in taps)
    return {"x": run(one, taps[0], 0), "y": run(g, taps[1], 0), "xx": run(two, taps[0], 0), "xy": run(one, taps[1], 0), "yy": run(g, taps[2], 0)}


def _by_shape(pictures: list[np.ndarray], function: Callable[[np.ndarray], list]) -> list:
    """A function of a stack of pictures, which gives a value for each, over pictures of any sizes."""
    out: list = [None] * len(pictures)
    for shape in dict.fromkeys(a.shape for a in pictures):
        at = [i for i, a in enumerate(pictures) if a.shape == shape]
        for i, found in zip(at, function(np.stack([pictures[i] for i in at]).astype(float)), strict=True):
            out[i] = found
    return out


def ridges(a: np.ndarray, sigma: float, low: float = 1.0, anisotropy: float = 0.6, reach: float = 0.6) -> pd.DataFrame:
    """(y, x, strength, ny, nx): places on the middle of a light or dark line about ``sigma`` wide, after non-maximum suppression.

    The Hessian's larger eigenvalue in size, times σ², is the strength; the other must be small beside it, and the slope along its
    direction must vanish within ``reach`` of the pixel's middle.
    """
    return pd.DataFrame(_ridges(a.astype(float)[None], sigma, low, anisotropy, reach)[0])


def _ridges(stack: np.ndarray, sigma: float, low: float = 1.0, anisotropy: float = 0.6, reach: float = 0.6) -> list[dict[str, np.ndarray]]:
    """The columns of ``ridges`` of each picture of a stack."""
    d = gaussian_derivatives(stack, sigma)
    mean, half = (d["xx"] + d["yy"]) / 2, np.hypot((d["xx"] - d["yy"]) / 2, d["xy"])
    one, two = mean + half, mean - half
    large, small = np.where(np.abs(one) >= np.abs(two), one, two), np.where(np.abs(one) >= np.abs(two), two, one)
    angle = 0.5 * np.arctan2(2 * d["xy"], d["xx"] - d["yy"]) + np.where(large == one, 0.0, np.pi / 2)
    nx, ny = np.cos(angle), np.sin(angle)
    with np.errstate(divide="ignore", invalid="ignore"):
        offset = -(d["x"] * nx + d["y"] * ny) / large
    strength = np.abs(large) * sigma * sigma
    good = (strength >= low) & (np.abs(small) <= anisotropy * np.abs(large)) & (np.abs(offset * nx) <= reach) & (np.abs(offset * ny) <= reach)
    value = np.where(good, strength, 0.0)
    h, w = stack.shape[1:]
    of, ys, xs = np.nonzero(good)
    ny, nx = ny[of, ys, xs], nx[of, ys, xs]
    sy, sx = np.rint(ny).astype(int), np.rint(nx).astype(int)
    side = lambda k: value[of, np.clip(ys + k * sy, 0, h - 1), np.clip(xs + k * sx, 0, w - 1)]
    back_first = (-sy * w - sx) < 0  # of equal neighbours the one with the lower index stays
    v = value[of, ys, xs]
    keep = np.where(back_first, (v > side(-1)) & (v >= side(1)), (v >= side(-1)) & (v > side(1)))
    cuts = np.cumsum(np.bincount(of[keep], minlength=len(stack)))[:-1]
    columns = {c: np.split(x[keep], cuts) for c, x in (("y", ys), ("x", xs), ("strength", v), ("ny", ny), ("nx", nx))}
    return [{c: x[i] for c, x in columns.items()} for i in range(len(stack))]


def chains(points: pd.DataFrame | dict[str, np.ndarray], step: float = 2.0, straight: float = 0.64, alike: float = 0.7) -> list[list[int]]:
    """Ridge points linked into chains, the strongest first, each point used once; a step goes on about straight to where the line runs alike.

    Points go one by one as plain numbers, which arrays of two would slow down many times.
    """
    xs, ys, nxs, nys = (np.asarray(points[c], float).tolist() for c in ("x", "y", "nx", "ny"))
    squares: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        squares.setdefault((int(x // step), int(y // step)), []).append(i)
    around: dict[tuple[int, int], list[int]] = {}
    free, found = [True] * len(xs), []

    def beside(square: tuple[int, int]) -> list[int]:
        if square not in around:
            bx, by = square
            around[square] = [j for spot in ((bx + dx, by + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) if spot in squares for j in squares[spot]]
        return around[square]

    def onward(i: int, u: float, v: float) -> list[int]:
        line = []
        while True:
            x, y, nx, ny = xs[i], ys[i], nxs[i], nys[i]
            best, score = None, math.inf
            for j in beside((int(x // step), int(y // step))):
                if not free[j]:
                    continue
                gx, gy = xs[j] - x, ys[j] - y
                dist = math.hypot(gx, gy)
                if 0 < dist <= step:
                    cos = (gx * u + gy * v) / dist
                    if cos >= straight and dist * (1.5 - cos) < score and abs(nx * nxs[j] + ny * nys[j]) >= alike:
                        best, score, to = j, dist * (1.5 - cos), (gx, gy, dist)
            if best is None:
                return line
            gx, gy, dist = to
            u, v = 0.6 * u + 0.4 * gx / dist, 0.6 * v + 0.4 * gy / dist
            size = float(np.hypot(u, v))
            u, v = u / size, v / size
            free[best] = False
            line.append(best)
            i = best

    for i in np.lexsort((np.arange(len(xs)), -np.asarray(points["strength"]))).tolist():
        if free[i]:
            free[i] = False
            found.append(onward(i, nys[i], -nxs[i])[::-1] + [i] + onward(i, -nys[i], nxs[i]))
    return found


def smooth(line: np.ndarray, every: float = 0.1, sigma: float = 2.0) -> np.ndarray:
    """A polyline resampled at even steps and smoothed, its ends fixed and the smoothing narrower towards them."""
    return _smoothed([line], every, sigma)[0]


def _smoothed(lines: list[np.ndarray], every: float = 0.1, sigma: float = 2.0) -> list[np.ndarray]:
    """``smooth`` of many lines at once."""
    evens = []
    for line in lines:
        gaps = np.hypot(*np.diff(line, axis=0).T) if len(line) > 1 else np.zeros(0)
        total = gaps.sum()
        if total == 0:
            evens.append(line[:1].astype(float))
            continue
        at = np.concatenate([[0], np.cumsum(gaps)])
        s = np.linspace(0, total, max(2, int(np.ceil(total / every)) + 1))
        evens.append(np.stack([np.interp(s, at, line[:, c]) for c in (0, 1)], axis=1))
    if not evens:
        return []
    sizes = np.array([len(e) for e in evens])
    even, i = np.concatenate(evens), np.concatenate([np.arange(n) for n in sizes.tolist()])
    out = even.copy()
    reach = np.minimum(np.minimum(i, np.repeat(sizes, sizes) - 1 - i), int(3 * sigma))
    for r in range(1, int(reach.max(initial=0)) + 1):  # places of one reach at once
        mine = np.flatnonzero(reach == r)
        t = np.arange(-r, r + 1)
        g = np.exp(-t * t / (2 * sigma * sigma))
        out[mine] = sum((w * even[mine + k] for k, w in zip(t.tolist(), g.tolist(), strict=True)), np.zeros((len(mine), 2))) / g.sum()
    return np.split(out, np.cumsum(sizes)[:-1])


def segments(line: np.ndarray, per_segment: float = 0.3, longest: int = 40) -> list[tuple[int, int, int, int]]:
    """Straight segments between grid corners that follow a polyline: least sum of mean distances and a price for each segment, by dynamic programming."""
    return _segmented([line], per_segment, longest)[0]


#: Places times starts whose distances are worked out at once.
PLACES = 1 << 17


def _segmented(lines: list[np.ndarray], per_segment: float = 0.3, longest: int = 40) -> list[list[tuple[int, int, int, int]]]:
    """``segments`` of many lines at once.

    A segment's mean distance depends on its ends alone, so it is worked out before any choice, for all ends of all lines that look back
    over as many places together.
    """
    paths = _smoothed(lines, 0.5)
    if not paths:
        return []
    path, of = np.concatenate(paths), np.repeat(np.arange(len(paths)), [len(p) for p in paths])
    near, axes = np.rint(path).astype(int), np.ascontiguousarray(path.T)
    low, high = near.min(axis=0), near.max(axis=0) + 1
    code = (of * (high[0] - low[0]) + near[:, 0] - low[0]) * (high[1] - low[1]) + near[:, 1] - low[1]
    stops = np.sort(np.unique(code, return_index=True)[1])
    corners, line_of = near[stops], of[stops]
    begins = np.searchsorted(line_of, np.arange(len(paths) + 1))
    ends = np.arange(len(stops))
    firsts = np.maximum(begins[line_of], ends - longest)
    upto = np.concatenate([[0], np.cumsum(ends - firsts)])  # the place of each end's first start in ``off``
    off, back_over = np.zeros(upto[-1]), stops[ends] + 1 - stops[firsts]
    order = np.argsort(back_over, kind="stable")
    order = order[(ends > firsts)[order]]
    for same in np.split(order, np.flatnonzero(np.diff(back_over[order])) + 1) if len(order) else ():
        n = int(back_over[same[0]])
        each = max(1, PLACES // (n * longest))
        for mine in (same[i : i + each] for i in range(0, len(same), each)):
            count = mine - firsts[mine]
            end = np.repeat(mine, count)
            start = np.concatenate([np.arange(a, b) for a, b in zip(firsts[mine].tolist(), mine.tolist(), strict=True)])
            at = stops[firsts[end]][:, None] + np.arange(n)
            a = corners[start].astype(float)
            d, within = corners[end] - a, at >= stops[start][:, None]
            px, py = (p[at] - a[:, c : c + 1] for c, p in enumerate(axes))
            dx, dy = d[:, :1], d[:, 1:]
            length = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / np.where(length > 0, length, 1.0), 0, 1)
            gone = np.where(within, np.hypot(px - t * dx, py - t * dy), 0.0).sum(axis=1) / (stops[end] + 1 - stops[start])
            off[upto[end] + start - firsts[end]] = gone
    told, firsts, upto, places = off.tolist(), firsts.tolist(), upto.tolist(), corners.tolist()
    out = []
    for begin, end in zip(begins.tolist(), begins[1:].tolist(), strict=False):
        cost, back = {begin: 0.0}, {}
        for j in range(begin + 1, end):
            first, least = firsts[j], math.inf
            for i, gone in enumerate(told[upto[j] : upto[j + 1]], first):
                total = cost[i] + gone + per_segment
                if total < least:
                    least, back[j] = total, i
            cost[j] = least
        found, j = set(), end - 1
        while j > begin:
            i = back[j]
            one, two = sorted([tuple(places[i]), tuple(places[j])])
            if one != two:
                found.add((*one, *two))
            j = i
        out.append(sorted(found))
    return out


def trace(a: np.ndarray, sigma: float = 1.5, low: float = 4.0, shortest: int = 4, budget: float = 2000.0) -> list[tuple[int, int, int, int]]:
    """The lines of a picture as segments: ridges, chains, the longest chains within a budget of length, and their segments without duplicates."""
    return traces([a], sigma, low, shortest, budget)[0]


def traces(pictures: list[np.ndarray], sigma: float = 1.5, low: float = 4.0, shortest: int = 4, budget: float = 2000.0) -> list[list[tuple[int, int, int, int]]]:
    """``trace`` of many pictures at once."""
    lines, of = [], []
    for i, points in enumerate(_by_shape(pictures, lambda stack: _ridges(stack, sigma, low))):
        linked = sorted((c for c in chains(points) if len(c) >= shortest), key=lambda c: (-len(c), c[0]))
        places = np.stack([points["x"], points["y"]], axis=1).astype(float)
        mine = [places[linked[k]] for k in kernels.budgeted([float(len(c)) for c in linked], budget)]
        lines += mine
        of += [i] * len(mine)
    found: list[set] = [set() for _ in pictures]
    for i, segments_of in zip(of, _segmented(lines), strict=True):
        found[i].update(segments_of)
    return [sorted(f) for f in found]


def paint_out(lab: np.ndarray, mask: np.ndarray, rounds: int = 64) -> np.ndarray:
    """The picture with the mask's pixels filled from around them, ring by ring, each the mean of its known neighbours."""
    out, known = lab.copy(), ~mask
    for _ in range(rounds):
        if known.all() or not known.any():
            break
        total, count = np.zeros_like(out), np.zeros(known.shape)
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)):
            near = kernels._shifts(known, dy, dx, False)
            total += np.where(near[..., None], kernels._shifts(out, dy, dx, 0.0), 0.0)
            count += near
        ring = ~known & (count > 0)
        out[ring] = total[ring] / count[ring][:, None]
        known |= ring
    return out


def strokes(a: np.ndarray, per_block: int = 2, cap: int = 4000, low: float = 6.0, length: float = 3.0) -> pd.DataFrame:
    """Short strokes along a picture's texture: (x1, y1, x2, y2, strength), strongest first, with quotas a block and in all and none over another."""
    return pd.DataFrame(strokes_of([a], per_block, cap, low, length)[0])


def strokes_of(pictures: list[np.ndarray], per_block: int = 2, cap: int = 4000, low: float = 6.0, length: float = 3.0) -> list[dict[str, np.ndarray]]:
    """The columns of ``strokes`` of many pictures at once."""

    def run(stack: np.ndarray) -> list[dict[str, np.ndarray]]:
        d = gaussian_derivatives(stack, 1.0)
        strength = np.hypot(d["x"], d["y"])
        out = []
        for sizes, dx, dy in zip(strength, d["x"], d["y"], strict=True):
            ys, xs = np.nonzero(sizes >= low)
            s = sizes[ys, xs]
            kept = kernels.quota_places(ys.astype(float), xs.astype(float), s, per_block, cap, length)
            ys, xs, s = ys[kept], xs[kept], s[kept]
            gx, gy = dx[ys, xs], dy[ys, xs]
            norm = np.maximum(np.hypot(gx, gy), 1e-12)
            ox, oy = -gy / norm * length / 2, gx / norm * length / 2
            out.append({"x1": xs - ox, "y1": ys - oy, "x2": xs + ox, "y2": ys + oy, "strength": s})
        return out

    return _by_shape(pictures, run)


# ---------------------------------------------------------------- samples


def cluster_online(colours: np.ndarray, weights: np.ndarray, most: int, merge: float) -> tuple[np.ndarray, np.ndarray]:
    """(group of each, weighted means): the heaviest first, each joins the nearest group within ``merge``, or begins one while there is room."""
    sums, mass, group = [], [], np.zeros(len(colours), int)
    for i in np.lexsort((np.arange(len(colours)), -weights)).tolist():
        d = [np.sqrt(((colours[i] - s / m) ** 2).sum()) for s, m in zip(sums, mass, strict=True)]
        k = int(np.argmin(d)) if d else -1
        if k < 0 or (d[k] > merge and len(sums) < most):
            sums.append(np.zeros(colours.shape[1]))
            mass.append(0.0)
            k = len(sums) - 1
        sums[k] = sums[k] + colours[i] * weights[i]
        mass[k] += weights[i]
        group[i] = k
    return group, np.array([s / m for s, m in zip(sums, mass, strict=True)])


def mix_weights(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that sum to 1 and bring 2 or 3 points nearest to x, and what distance is left."""
    sides = (points[1:] - points[0]).T
    rest, *_ = np.linalg.lstsq(sides, x - points[0], rcond=None)
    weights = np.concatenate([[1 - rest.sum()], rest])
    return weights, float(np.linalg.norm(x - weights @ points))


def two_modes(samples: np.ndarray, weights: np.ndarray, places: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """(two means, labels, confidence) of one cell's weighted samples: far seeds, a few moves, then how clearly the two lie apart in colour and in place."""
    means, labels, sure = modes_of_cells(samples[None], weights[None], places[None], rounds)
    return means[0], labels[0], float(sure[0])


def modes_of_cells(samples: np.ndarray, weights: np.ndarray, places: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``two_modes`` of many cells of as many samples each: (cells, n, parts), (cells, n) and (cells, n, 2)."""
    each = np.arange(len(samples))
    gap = lambda to: ((samples - to[:, None]) ** 2).sum(axis=2)
    share = lambda of, values: (values * of[..., None]).sum(axis=1) / np.where(of.sum(axis=1) > 0, of.sum(axis=1), 1.0)[:, None]
    first = samples[each, gap(share(weights, samples)).argmax(axis=1)]
    means = np.stack([first, samples[each, gap(first).argmax(axis=1)]], axis=1)
    labels = np.zeros(weights.shape, int)
    for _ in range(rounds):
        labels = (gap(means[:, 1]) < gap(means[:, 0])).astype(int)
        for k in (0, 1):
            mine = np.where(labels == k, weights, 0.0)
            means[:, k] = np.where(mine.sum(axis=1)[:, None] > 0, share(mine, samples), means[:, k])
    mine = [np.where(labels == k, weights, 0.0) for k in (0, 1)]
    apart = np.sqrt(((means[:, 0] - means[:, 1]) ** 2).sum(axis=1))
    spread = np.maximum(*(np.sqrt(share(mine[k], gap(means[:, k])[..., None])[:, 0]) for k in (0, 1)))
    middles = share(mine[0], places) - share(mine[1], places)
    both = (labels.min(axis=1) != labels.max(axis=1)) & (apart > 0)
    sure = apart / np.where(both, apart + spread, 1.0) * np.minimum(1.0, np.hypot(middles[:, 0], middles[:, 1]) / 0.5)
    return means, labels, np.where(both, sure, 0.0)


def hand_drawn(w: int, h: int, spacing: float = 4.0, seed: int = 1, lumps: float = 0.25) -> np.ndarray:
    """(h, w) thresholds of marks that grow from scattered centres: one centre in each square, moved at random, its cells ranked by a lumpy distance.

    Each cell belongs to the nearest of the centres in the nine squares around it.
    """
    nx, ny = int(np.ceil(w / spacing)) + 2, int(np.ceil(h / spacing)) + 2
    rng = kernels.Mulberry(seed)
    jitter = np.array([rng.draw() for _ in range(2 * nx * ny)]).reshape(ny, nx, 2)
    cx, cy = (np.arange(nx)[None] - 1 + 0.15 + 0.7 * jitter[..., 0]) * spacing, (np.arange(ny)[:, None] - 1 + 0.15 + 0.7 * jitter[..., 1]) * spacing
    y, x = np.indices((h, w)) + 0.5
    by, bx = (y // spacing).astype(int) + 1, (x // spacing).astype(int) + 1
    best, mark, turn = np.full((h, w), np.inf), np.zeros((h, w), int), np.zeros((h, w))
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            j, i = np.clip(by + dy, 0, ny - 1), np.clip(bx + dx, 0, nx - 1)
            d = np.hypot(x - cx[j, i], y - cy[j, i])
            nearer = d < best
            best, mark = np.where(nearer, d, best), np.where(nearer, j * nx + i, mark)
            turn = np.where(nearer, np.arctan2(y - cy[j, i], x - cx[j, i]), turn)
    score = best * (1 + lumps * np.sin(3 * turn + mark))
    order = np.lexsort((np.arange(h * w), score.ravel(), mark.ravel()))
    ranked = mark.ravel()[order]
    starts = np.searchsorted(ranked, ranked)
    counts = np.bincount(ranked)[ranked]
    out = np.empty(h * w)
    out[order] = (np.arange(h * w) - starts + 0.5) / counts
    return out.reshape(h, w)


def per_picture(pixels: DataFrame, function: Callable[[np.ndarray], pd.DataFrame], columns: list[str], schema: str, key: str = "image_id") -> DataFrame:
    """(key, …): a kernel over each picture's columns as an (h, w, n) array that gives rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = function(kernels.grid_of(rows, columns, 0.0))
        out.insert(0, key, rows[key].iloc[0])
        return out

    return pixels.select(key, "y", "x", *columns).groupBy(key).applyInPandas(run, f"{key} long, {schema}")
