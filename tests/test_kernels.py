import numpy as np
from pyspark.sql import functions as F
import pandas as pd
import pytest

from loomgrid.operators import kernels as K


def plain_settle(labels, lab, palette, evidence, weights, passes=8):
    """The same minimisation cell by cell."""
    h, w = labels.shape
    costs = K.pair_costs(evidence, weights[1], weights[2])
    grid, dirty = labels.copy(), labels != K.EMPTY
    for _ in range(passes):
        changed = False
        for y in range(h):
            for x in range(w):
                if not dirty[y, x]:
                    continue
                dirty[y, x] = False
                same, total = np.zeros(len(palette)), 0.0
                for o, (dx, dy, _) in enumerate(K.OFFSETS):
                    ny, nx = y + dy, x + dx
                    if 0 <= ny < h and 0 <= nx < w and grid[ny, nx] != K.EMPTY:
                        same[grid[ny, nx]] += costs[o, y, x]
                        total += costs[o, y, x]
                d = lab[y, x][None] - palette
                best = int((weights[0] * (d * d).sum(axis=1) + total - same).argmin())
                if best != grid[y, x]:
                    grid[y, x], changed = best, True
                    for dx, dy, _ in K.OFFSETS:
                        ny, nx = y + dy, x + dx
                        if 0 <= ny < h and 0 <= nx < w and labels[ny, nx] != K.EMPTY:
                            dirty[ny, nx] = True
        if not changed:
            break
    return grid


def picture(seed, h=19, w=23):
    rng = np.random.default_rng(seed)
    palette = rng.random((6, 3)) * 0.4
    lab = palette[rng.integers(0, 6, (h, w))] + rng.normal(0, 0.05, (h, w, 3))
    labels = K.assign(lab.reshape(-1, 3), palette).reshape(h, w)
    labels[rng.random((h, w)) < 0.1] = K.EMPTY
    return lab, palette, labels


@pytest.mark.parametrize("seed", range(4))
def test_settling_by_lines_equals_cell_by_cell(seed):
    lab, palette, labels = picture(seed)
    evidence = K.pair_evidence(lab)
    for weights in (K.COARSE, K.FINE):
        assert np.array_equal(K.settle(labels, lab, palette, evidence, weights), plain_settle(labels, lab, palette, evidence, weights))


@pytest.mark.parametrize("seed", range(4))
def test_regions_equal_a_plain_fill(seed):
    rng = np.random.default_rng(seed)
    labels = rng.integers(-1, 3, (17, 21))
    want, n = np.full(labels.shape, K.EMPTY), 0
    for y in range(17):
        for x in range(21):
            if labels[y, x] != K.EMPTY and want[y, x] == K.EMPTY:
                waiting = [(y, x)]
                want[y, x] = n
                while waiting:
                    a, b = waiting.pop()
                    for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                        if 0 <= c < 17 and 0 <= d < 21 and want[c, d] == K.EMPTY and labels[c, d] == labels[y, x]:
                            want[c, d] = n
                            waiting.append((c, d))
                n += 1
    assert np.array_equal(K.label_regions(labels), want)


def test_generator_draws():
    rng = K.Mulberry(12345)
    draws = [rng.draw() for _ in range(3)]
    assert draws == [0.9797282677609473, 0.3067522644996643, 0.484205421525985]


def test_clustering_merging_and_prediction():
    rng = np.random.default_rng(0)
    centres = np.array([[0.2, 0.1, 0], [0.5, -0.1, 0.1], [0.8, 0, -0.1]])
    points = centres[rng.integers(0, 3, 900)] + rng.normal(0, 0.01, (900, 3))
    labels, found = K.quantize(points, 3)
    assert len(found) == 3 and sorted(np.bincount(labels).tolist()) == sorted(np.bincount(K.assign(points, centres)).tolist())
    labels, palette = K.merge_close(np.array([0, 0, 1, 2, -1]), np.array([[0.0, 0, 0], [0.001, 0, 0], [1, 0, 0]]), K.MERGE_GENERATED)
    assert labels.tolist() == [0, 0, 0, 1, -1] and palette[0].tolist() == [0, 0, 0]
    told = K.predict_colours(points)
    assert told["low"] <= told["suggested"] <= told["high"] <= told["ceiling"] <= 48
    errors = [e for _, e in K.ward(points)]
    assert errors == sorted(errors)
    assert len(K.reserve_hues(points, labels, centres)) == 3


def test_diffusion_keeps_the_mean_and_skips_cells():
    lab = np.zeros((32, 32, 3))
    lab[..., 0] = 0.25
    ends = np.array([[0.0, 0, 0], [1.0, 0, 0]])
    skip = np.zeros((32, 32), bool)
    skip[:4] = True
    labels = K.diffuse(lab, ends, "floyd-steinberg", skip)
    assert (labels[:4] == K.EMPTY).all() and abs(labels[4:].mean() - 0.25) < 0.03


def test_small_regions_diagonals_filter_and_chart():
    lab, palette, labels = picture(9)
    cleared = K.recolour_small(labels, lab, palette)
    assert (np.bincount(K.label_regions(cleared)[cleared >= 0]) <= 2).sum() < (np.bincount(K.label_regions(labels)[labels >= 0]) <= 2).sum()
    cross = np.array([[0, 1], [1, 0]])
    same = np.zeros((2, 2, 3))
    assert sorted(np.bincount(K.mend_diagonals(cross, same, np.zeros((2, 3))).ravel()).tolist()) == [1, 3]
    flat = np.zeros((3, 3, 3))
    flat[1, 1] = 1
    assert (K.medoid_filter(flat) == 0).all()
    out = K.chart(np.where((labels == K.EMPTY)[..., None], np.nan, lab), 4)
    assert ((out == K.EMPTY) == (labels == K.EMPTY)).all() and out.max() < 4


def test_matching_quota_and_budget():
    assert K.greedy_match(np.array([[1.0, 2.0], [0.5, 3.0]])) == [(0, 1), (1, 0)]
    rows = pd.DataFrame({"x": [0.0, 1.0, 20.0, 3.0], "y": [0.0, 0.0, 0.0, 0.0], "strength": [1.0, 3.0, 2.0, 0.5]})
    assert sorted(K.quota_top(rows, 1, 10, 2.0).index) == [1, 2]
    assert K.budgeted([3, 5, 2], 6) == [0, 2]


def test_regions_by_chart_and_by_runs_agree(spark, sf_dir):
    from loomgrid.operators import grid as G
    from loomgrid.plans import grid as plans

    cells = plans.cells(spark, sf_dir).drop("kind").withColumn("y", F.col("y") - 3)
    for corners in (False, True):
        one, two = (sorted(tuple(r) for r in find(cells, ["chart_id"], corners).select("chart_id", "y", "x", "label", "region").collect()) for find in (G.regions, G.regions_by_runs))
        assert one == two
    assert G.regions(cells.limit(0), ["chart_id"]).count() == 0
