"""Charts of one block take their steps alone, others by rounds: the same palettes either way, and no exchange for the former."""

import numpy as np
import pytest

from loomgrid.operators import clustering as C
from loomgrid.plans import grid

PARTS = ["ok_l", "ok_a", "ok_b"]


def palettes(rows) -> dict:
    out: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.idx):
        out.setdefault(r.chart_id, []).append((r["count"], r.sse, *(r[p] for p in PARTS)))
    return {c: np.array(v) for c, v in out.items()}


def test_one_block_or_many(spark, sf_dir, monkeypatch):
    cells = C.kept(grid._lab_cells(spark, sf_dir).where("chart_id = 1 and y < 9 or chart_id = 4 and y < 2").select("chart_id", *PARTS))
    lone = C.Blocks(cells, "chart_id", PARTS)
    assert not lone.split and "Exchange" not in lone.clusters(4)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "BLOCK", 150)
    cut = C.Blocks(cells, "chart_id", PARTS)
    assert cut.split and cut.lone.count() == 1
    for told in (lambda b: b.clusters(4), lambda b: C.quantize(b, 5, 0.1)):
        one, many = palettes(told(lone)), palettes(told(cut))
        assert set(one) == set(many) == {1, 4} and all(one[c] == pytest.approx(many[c], abs=1e-9) for c in one)
