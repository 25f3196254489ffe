"""Small regions recoloured on the graph against the loop over regions."""

import numpy as np
import pytest

from loomgrid.operators import grid as G
from loomgrid.operators import kernels as K
from loomgrid.operators import regiongraph as R

PARTS = ["ok_l", "ok_a", "ok_b"]


@pytest.mark.parametrize("find", [G.regions, G.regions_by_runs])
def test_small_regions_in_their_order(spark, find):
    rng = np.random.default_rng(7)
    planes = {}
    for chart, (h, w, k) in {1: (14, 17, 3), 2: (9, 25, 5), 3: (1, 1, 2), 4: (6, 6, 2)}.items():
        labels = rng.integers(0, k, (h, w))
        labels[rng.random((h, w)) < 0.15] = K.EMPTY
        if chart == 4:
            labels[:] = 1
        planes[chart] = (labels, rng.random((h, w, 3)), rng.random((k, 3)))
    rows = [(c, y, x, int(v) if v != K.EMPTY else None, *map(float, lab[y, x])) for c, (labels, lab, _) in planes.items() for (y, x), v in np.ndenumerate(labels)]
    cells = spark.createDataFrame(rows, "chart_id long, y long, x long, label int, ok_l double, ok_a double, ok_b double")
    palettes = spark.createDataFrame([(c, i, *map(float, p)) for c, (_, _, at) in planes.items() for i, p in enumerate(at)], "chart_id long, idx int, ok_l double, ok_a double, ok_b double")
    got = {(r.chart_id, r.y, r.x): r.label for r in R.recoloured(cells, palettes, ["chart_id"], PARTS, 4, find).collect()}
    changed = 0
    for c, (labels, lab, at) in planes.items():
        want = K.recolour_small(labels, lab, at, 4)
        changed += int((want != labels).sum())
        assert {(y, x): int(v) if v != K.EMPTY else None for (y, x), v in np.ndenumerate(want)} == {(y, x): v for (k, y, x), v in got.items() if k == c}
    assert len(got) == len(rows) and changed > 50


def test_cells_and_regions_are_never_broadcast(spark):
    rows = [(1, y, x, (x // 2 + y // 3) % 3, x / 7.0) for y in range(6) for x in range(8)]
    cells = spark.createDataFrame(rows, "chart_id long, y long, x long, label int, p double").repartition(2)
    _, nodes, _ = R.graph(cells, ["chart_id"], ["p"])
    assert "BroadcastHashJoin" not in nodes._jdf.queryExecution().executedPlan().toString()
    palette = spark.createDataFrame([(1, i, i / 3.0) for i in range(3)], "chart_id long, idx int, p double")
    done = R.recoloured(cells, palette, ["chart_id"], ["p"], 2)
    assert done.count() == len(rows)
