"""Energy minimisation by tiles against one sweep over the whole plane."""

import numpy as np
import pytest

from loomgrid.operators import kernels as K
from loomgrid.operators import tiles as T

PARTS = ["ok_l", "ok_a", "ok_b"]


def plane(seed, h, w, k, holes):
    rng = np.random.default_rng(seed)
    palette = rng.random((k, 3)) * 0.2
    lab = palette[rng.integers(0, k, (h // 4 + 1, w // 4 + 1)).repeat(4, 0).repeat(4, 1)[:h, :w]] + rng.normal(size=(h, w, 3)) * 0.03
    labels = K.assign(lab.reshape(-1, 3), palette).reshape(h, w)
    if holes:
        labels[rng.random((h, w)) < 0.1] = K.EMPTY
        labels[5:9] = K.EMPTY
    lab[labels == K.EMPTY] = np.nan
    return labels, lab, palette


@pytest.mark.parametrize("side", [5, 11, 64])
def test_labels_do_not_depend_on_tiles(spark, side):
    planes = {1: plane(1, 22, 31, 6, True), 2: plane(2, 9, 40, 4, False), 3: plane(3, 1, 1, 2, False)}
    rows = [(c, y, x, int(v) if v != K.EMPTY else None, *(float(f) if v != K.EMPTY else None for f in lab[y, x])) for c, (labels, lab, _) in planes.items() for (y, x), v in np.ndenumerate(labels)]
    cells = spark.createDataFrame(rows, "chart_id long, y long, x long, label int, ok_l double, ok_a double, ok_b double")
    palettes = spark.createDataFrame([(c, i, *map(float, p)) for c, (_, _, at) in planes.items() for i, p in enumerate(at)], "chart_id long, idx int, ok_l double, ok_a double, ok_b double")
    got = {(r.chart_id, r.y, r.x): r.label for r in T.settled(cells, palettes, "chart_id", PARTS, K.FINE, side=side, passes=3 if side == 5 else 8).collect()}
    assert len(got) == len(rows)
    moved = 0
    for c, (labels, lab, at) in planes.items():
        want = K.settle(labels, lab, at, K.pair_evidence(lab), K.FINE, passes=3 if side == 5 else 8)
        moved += int((want != labels).sum())
        assert {(y, x): int(v) if v != K.EMPTY else None for (y, x), v in np.ndenumerate(want)} == {(y, x): v for (k, y, x), v in got.items() if k == c}
    assert moved > 20


def test_small_planes_wait_for_no_rounds(spark, monkeypatch):
    planes = {c: plane(c, 7 + c, 30 - c, 3 + c % 4, c % 2) for c in range(8)}
    rows = [(c, y + 70, x - 3, int(v) if v != K.EMPTY else None, *(float(f) if v != K.EMPTY else None for f in lab[y, x])) for c, (labels, lab, _) in planes.items() for (y, x), v in np.ndenumerate(labels)]
    cells = spark.createDataFrame(rows, "chart_id long, y long, x long, label int, ok_l double, ok_a double, ok_b double")
    palettes = spark.createDataFrame([(c, i, *map(float, p)) for c, (_, _, at) in planes.items() for i, p in enumerate(at)], "chart_id long, idx int, ok_l double, ok_a double, ok_b double")
    rounds, kept = [], T.kept
    monkeypatch.setattr(T, "kept", lambda rows: rounds.append(1) or kept(rows))
    monkeypatch.setattr(T, "HELD", 900)
    got = {(r.chart_id, r.y - 70, r.x + 3): r.label for r in T.settled(cells, palettes, "chart_id", PARTS, K.FINE).collect()}
    assert len(rounds) == 1
    for c, (labels, lab, at) in planes.items():
        want = K.settle(labels, lab, at, K.pair_evidence(lab), K.FINE)
        assert {(y, x): int(v) if v != K.EMPTY else None for (y, x), v in np.ndenumerate(want)} == {(y, x): v for (k, y, x), v in got.items() if k == c}
