"""Whole queries without SQL twins against plain versions over the smallest tables."""

import numpy as np
import pytest

from loomgrid.functions import colour
from loomgrid.operators import kernels as K
from loomgrid.operators import vision as V
from loomgrid.plans import grid, more, palette, vision


def pictures(spark, sf_dir, opaque: bool = False) -> dict[int, np.ndarray]:
    """Each picture's OKLab, NaN where it is clear if only the opaque pixels are asked for."""
    found: dict[int, np.ndarray] = {}
    for r in grid.pixels(spark, sf_dir).collect():
        found.setdefault(r.image_id, np.zeros((grid.H, grid.W, 4)))[r.y, r.x] = (r.r, r.g, r.b, r.a)
    out = {}
    for k, a in found.items():
        v = a[..., :3] / 255
        lin = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
        out[k] = np.cbrt(lin @ np.array(colour.TO_LMS).T) @ np.array(colour.TO_LAB).T
        if opaque:
            out[k][a[..., 3] < 255] = np.nan
    return out


def test_names_are_matched_closest_pair_first(spark, sf_dir):
    points = {r.vec_id: np.array([r.p0, r.p1, r.p2]) for r in grid.points(spark, sf_dir).collect()}
    names = sorted((f"name {k}", p) for k, p in points.items())
    got = {(r.chart_id, r.idx): r.name for r in palette.j15_names(spark, sf_dir).collect()}
    charts: dict = {}
    for k in sorted(points):
        charts.setdefault(k // 40, []).append(k)
    assert len(got) == len(points)
    for chart, keys in charts.items():
        pairs = sorted((((points[k] - p) ** 2).sum(), i, j) for i, k in enumerate(keys) for j, (_, p) in enumerate(names))
        used: tuple[set, set] = (set(), set())
        for _, i, j in pairs:
            if i not in used[0] and j not in used[1]:
                used[0].add(i)
                used[1].add(j)
                assert got[chart, keys[i] % 40] == names[j][0]


@pytest.mark.parametrize("kernel", ["floyd-steinberg", "atkinson"])
def test_diffusion_cell_by_cell(spark, sf_dir, kernel):
    parts = {"floyd-steinberg": [(1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16)], "atkinson": [(1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8)]}[kernel]
    query = grid.i17_floyd_steinberg if kernel == "floyd-steinberg" else grid.i17_atkinson
    got: dict = {}
    for r in query(spark, sf_dir).collect():
        got.setdefault(r.chart_id, {})[r.y, r.x] = r.label
    for chart, lab in list(pictures(spark, sf_dir, opaque=True).items())[:3]:
        skip, work, want = np.isnan(lab[..., 0]), lab.copy(), {}
        for y in range(grid.H):
            way = 1 if y % 2 == 0 else -1
            for x in range(grid.W)[::way]:
                if skip[y, x]:
                    continue
                light = work[y, x]
                want[y, x] = int(((light - [1, 0, 0]) ** 2).sum() < (light**2).sum())
                error = light - np.array([want[y, x], 0, 0])
                for dx, dy, weight in parts:
                    at = (y + dy, x + way * dx)
                    if at[0] < grid.H and 0 <= at[1] < grid.W and not skip[at]:
                        work[at] += error * weight
        assert got[chart] == want


def test_edge_evidence_by_plain_windows(spark, sf_dir):
    got: dict = {}
    for r in vision.w8_edge_evidence(spark, sf_dir).collect():
        got.setdefault(r.image_id, {})[r.cy, r.cx] = (r.right, r.down, r.down_right, r.down_left)
    picture, lab = next(iter(pictures(spark, sf_dir).items()))
    pad = np.pad(lab, ((2, 2), (2, 2), (0, 0)), mode="edge")
    soft = np.array([[pad[y : y + 5, x : x + 5].mean(axis=(0, 1)) for x in range(grid.W)] for y in range(grid.H)])
    dy, dx = np.gradient(soft, axis=0), np.gradient(soft, axis=1)
    ch, cw = grid.H / 9, grid.W / 12
    for (cy, cx), values in got[picture].items():
        for value, (ox, oy) in zip(values, ((1, 0), (0, 1), (1, 1), (-1, 1)), strict=True):
            if not (0 <= cx + ox < 12 and cy + oy < 9):
                assert value == 0
                continue
            ux, uy = np.array([ox, oy]) / np.hypot(ox, oy)
            my, mx = (cy + 0.5 + oy / 2) * ch, (cx + 0.5 + ox / 2) * cw
            rows = range(max(0, int(np.floor(my - max(1, ch / 2)))), min(grid.H - 1, int(np.ceil(my + max(1, ch / 2)))) + 1)
            columns = range(max(0, int(np.floor(mx - max(1, cw / 2)))), min(grid.W - 1, int(np.ceil(mx + max(1, cw / 2)))) + 1)
            mean = np.mean([((dx[y, x] * ux + dy[y, x] * uy) ** 2).sum() for y in rows for x in columns])
            assert value == pytest.approx(1 - np.exp(-mean * mean / (2 * V.TAU**2)), abs=1e-9)


def test_overlays_and_predictions_by_picture(spark, sf_dir):
    light: dict[int, np.ndarray] = {}
    for r in grid.pixels(spark, sf_dir).collect():
        light.setdefault(r.image_id, np.zeros((grid.H, grid.W)))[r.y, r.x] = np.floor(0.2126 * r.r + 0.7152 * r.g + 0.0722 * r.b + 0.5)
    want = {(k, "traced-lines"): len(V.trace(a, 1.5, 2.0)) for k, a in light.items()} | {(k, "strokes"): len(V.strokes(a)) for k, a in light.items()}
    assert {(r.image_id, r.overlay): r.lines for r in more.x1_overlays(spark, sf_dir).collect()} == {k: n for k, n in want.items() if n}
    for r in grid.i12_predict_colours(spark, sf_dir).collect():
        assert 2 <= r.low <= r.suggested <= r.high <= 48 and r.ceiling <= 48


def test_whole_charts_obey_their_rules(spark, sf_dir):
    cells: dict = {}
    for r in grid.i8_to_i16_chart(spark, sf_dir).collect():
        cells.setdefault(r.chart_id, {})[r.y, r.x] = r.label
    for chart, lab in pictures(spark, sf_dir, opaque=True).items():
        found = cells[chart]
        assert set(found) == {(y, x) for y in range(grid.H) for x in range(grid.W) if not np.isnan(lab[y, x, 0])}
        used = {v for v in found.values() if v is not None}
        assert used <= set(range(8)) and used
        assert np.array_equal(K.chart(lab, 8), K.chart(lab, 8))
