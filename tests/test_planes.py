"""Charts taken many at a time against the same charts one by one."""

import numpy as np
import pytest

from loomgrid.operators import clustering as C
from loomgrid.operators import kernels as K
from loomgrid.operators import planes as P
from loomgrid.operators import vision as V
from loomgrid.plans import grid, more
from loomgrid.plans import vision as plans


def chart(rng, h, w, empty=0.15):
    y, x = np.indices((h, w))
    lab = np.stack([(y // 3 + x // 4) % 3 / 3, (x + y) % 7 / 40, rng.random((h, w)) / 5], axis=2)
    lab[rng.random((h, w)) < empty] = np.nan
    return lab


def test_whole_charts_of_many_sizes():
    rng = np.random.default_rng(3)
    labs = [chart(rng, h, w) for h, w in ((12, 15), (1, 1), (20, 6), (9, 31), (52, 50))] + [np.full((4, 5, 3), np.nan), chart(rng, 7, 7, 0.0)]
    for got, lab in zip(P.charts(labs, 6), labs, strict=True):
        assert np.array_equal(got, K.chart(lab, 6))
    assert all((P.charts(labs[5:6], 6)[0] == K.EMPTY).ravel())


def test_diagonals_of_every_pass():
    """A cell that joins makes corners for squares behind and before it, which this pass and the next find."""

    def plain(grid, lab, palette):
        grid, joined = grid.copy(), 0
        for _ in range(4):
            before = joined
            for y, x in np.ndindex(grid.shape[0] - 1, grid.shape[1] - 1):
                for a, b, others in (((y, x), (y + 1, x + 1), ((y, x + 1), (y + 1, x))), ((y, x + 1), (y + 1, x), ((y, x), (y + 1, x + 1)))):
                    c = grid[a]
                    if c != K.EMPTY and grid[b] == c and not any(grid[o] in (c, K.EMPTY) for o in others):
                        price = [((lab[o] - palette[c]) ** 2).sum() - ((lab[o] - palette[grid[o]]) ** 2).sum() for o in others]
                        if min(price) < 0.02:
                            grid[others[int(np.argmin(price))]], joined = c, joined + 1
            if before == joined:
                break
        return grid

    rng = np.random.default_rng(5)
    for _ in range(60):
        labels = rng.integers(-1, 4, rng.integers(1, 14, 2))
        lab, palette = rng.random((*labels.shape, 3)) * 0.3, rng.random((4, 3)) * 0.3
        assert np.array_equal(K.mend_diagonals(labels, lab, palette), plain(labels, lab, palette))


def test_charts_cross_batches_and_meet_in_no_other_place(spark, monkeypatch):
    rows = [(None if k == 4 else f"c{k}", y, x, k * 100.0 + y * 10 + x) for k in range(9) for y in range(2 + k % 3) for x in range(5)]
    cells = spark.createDataFrame(rows, "k string, y long, x long, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = P.by_chart(cells, "k", ["v"], lambda charts: [{"n": np.array([len(c.y)]), "s": np.array([c.grid().sum()]), "of": np.array([len(charts)])} for c in charts], "n long, s double, of long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums = {}
    for k, _, _, v in rows:
        sums.setdefault(k, []).append(v)
    assert {(r.k, r.n, r.s) for r in found} == {(k, len(v), sum(v)) for k, v in sums.items()} and len(found) == 9
    assert max(r.of for r in found) > 1


@pytest.mark.parametrize("query", [grid.i8_to_i16_chart, plans.i24_i26_traced_lines, more.x1_overlays])
def test_charts_are_taken_together_where_they_lie(spark, sf_dir, query):
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and plan.count("Exchange") == 1 + (query is more.x1_overlays)  # one deals the suppliers, one counts by overlay


def test_lines_of_many_pictures_at_once():
    y, x = np.indices((40, 60))
    pictures = [200 * np.exp(-((y - 9 - (k * x) // 30) ** 2) / 4) + 90 * np.exp(-((x - 30 - y // (k + 2)) ** 2) / 5) for k in range(4)] + [np.zeros((5, 7)), (x[:20, :31] * y[:20, :31] * 7 % 256).astype(float)]
    assert V.traces(pictures, 1.5, 2.0) == [V.trace(a, 1.5, 2.0) for a in pictures]
    lines = [np.cumsum(np.random.default_rng(n).normal(0, 0.6, (n, 2)) + 0.5, axis=0) for n in (90, 1, 2, 40, 90)]
    assert V._segmented(lines) == [V.segments(line) for line in lines] and V._segmented([]) == []
    for found, a in zip(V.strokes_of(pictures), pictures, strict=True):
        assert all(np.array_equal(found[c], values) for c, values in V.strokes(a).items())


@pytest.mark.parametrize("name", ["i14_settled", "i15_small_regions"])
def test_clusters_where_they_lie_and_by_rounds(spark, sf_dir, monkeypatch, name):
    """The same labels from charts that one task holds, from others, and from both kinds; the former shuffle no cell."""
    cells = C.kept(grid._lab_cells(spark, sf_dir).where("chart_id = 1 and y < 9 or chart_id = 4 and y between 7 and 11 or chart_id = 2 and y > 30"))
    monkeypatch.setattr(grid, "_lab_cells", lambda *_: cells)
    told = lambda rows: {(r.chart_id, r.y, r.x): r.label for r in rows.select("chart_id", "y", "x", "label").collect()}
    here = getattr(grid, name)(spark, sf_dir)
    assert here._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of cells that are not dealt by chart
    counts = sorted(r["count"] for r in cells.groupBy("chart_id").count().collect())
    found = told(here)
    assert len(found) == sum(counts) and len(set(found.values())) == 8
    for most in (0, counts[0]):
        with monkeypatch.context() as m:
            m.setattr(grid.planes, "lone", lambda cells, key, _, most=most, lone=P.lone: lone(cells, key, most))
            assert told(getattr(grid, name)(spark, sf_dir)) == found
