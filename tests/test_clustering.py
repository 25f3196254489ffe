"""Clustering of all charts together against plain numpy on the same seeds."""

import numpy as np
import pytest

from loomgrid.operators import clustering as C
from loomgrid.operators import kernels as K
from loomgrid.plans import grid

PARTS = ["ok_l", "ok_a", "ok_b"]


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    few = grid._lab_cells(spark, sf_dir).where("chart_id <= 4")
    odd = spark.createDataFrame([(90, 0.1, 0.2, 0.3)] * 5 + [(91, 0.1, 0.2, 0.3), (91, 0.5, 0.2, 0.3), (91, None, 0.0, 0.0), (92, None, 0.0, 0.0)], "chart_id long, ok_l double, ok_a double, ok_b double")
    return few.select("chart_id", *PARTS).union(odd)


@pytest.fixture(scope="module")
def blocks(cells):
    return C.Blocks(cells, "chart_id", PARTS)


@pytest.fixture(scope="module")
def distinct(cells):
    """Each chart's distinct colours in their order, and the cells of each."""
    held: dict = {}
    for r in cells.dropna().collect():
        held.setdefault(r.chart_id, []).append(tuple(r)[1:])
    return {c: np.unique(np.array(v), axis=0, return_counts=True) for c, v in held.items()}


def centres(rows) -> dict[int, np.ndarray]:
    return {r.chart_id: np.array(r.c).reshape(-1, 3) for r in rows.collect()}


def palette(rows) -> dict[int, np.ndarray]:
    out: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.idx):
        out.setdefault(r.chart_id, []).append((r["count"], r.sse, *(r[p] for p in PARTS)))
    return {c: np.array(v) for c, v in out.items()}


def test_blocks_hold_every_cell_once(blocks, distinct):
    got: dict = {}
    for r in blocks.rows.collect():
        for at, w in zip(np.array(r.p).reshape(-1, 3), r.w, strict=True):
            assert (r.chart_id, tuple(at)) not in got
            got[r.chart_id, tuple(at)] = w
    assert got == {(c, tuple(at)): n for c, (p, w) in distinct.items() for at, n in zip(p, w, strict=True)}


def test_seeds_are_drawn_as_by_hand(blocks, distinct):
    """The least of -ln(u) over weight and squared distance, round by round over all of a chart's colours."""
    got = centres(blocks.seeds(12))
    for c, (p, w) in distinct.items():
        seeds, left = np.zeros((0, 3)), 11
        for draw in range(C.DRAWS + 1):
            take = 1 if draw == 0 else -(-left // (C.DRAWS + 1 - draw))
            left -= take if draw else 0
            gap = K.distances_sq(p, seeds).min(axis=1) if len(seeds) else np.ones(len(p))
            e = np.where(gap > 0, C.race(p, draw) / np.where(gap > 0, w * gap, 1), np.inf)
            order = [i for i in np.argsort(e, kind="stable")[:take] if np.isfinite(e[i])]
            seeds = np.vstack([seeds, p[order]])
        assert (got[c] == seeds).all()
    assert len(got[90]) == 1 and len(got[91]) == 2 and 92 not in got


def test_lloyd_on_fixed_seeds(blocks, distinct):
    seeds = blocks.seeds(12)
    start, got = centres(seeds), centres(blocks.lloyd(seeds))
    for c, (p, w) in distinct.items():
        assert got[c] == pytest.approx(K.lloyd(p, start[c], w.astype(float))[1], abs=1e-12)


def test_centres_by_shuffle_and_by_broadcast(blocks, monkeypatch):
    seeds = blocks.seeds(5)
    sent = centres(blocks.lloyd(seeds, rounds=2))
    monkeypatch.setattr(C, "MAX_SENT", -1)
    shuffled = centres(blocks.lloyd(seeds, rounds=2))
    assert set(sent) == set(shuffled) and all(sent[c] == pytest.approx(shuffled[c], abs=1e-12) for c in sent)


@pytest.mark.parametrize("limit", [0.0, 0.02])
def test_quantize_step_by_step(blocks, distinct, limit):
    start, got = centres(blocks.seeds(12)), palette(C.quantize(blocks, 12, limit))
    for c, (p, w) in distinct.items():
        labels, at = K.lloyd(p, start[c], w.astype(float))
        used = np.unique(labels)
        labels, at = np.searchsorted(used, labels), at[used]
        merged, fewer = K.merge_close(labels, at, limit, w.astype(float))
        if len(fewer) < len(at):
            at = fewer
            for _ in range(len(used) - len(fewer)):
                gap = K.distances_sq(p, at).min(axis=1)
                at = np.vstack([at, p[gap.argmax()]]) if gap.max() > 0 else at
            labels, at = K.lloyd(p, at, w.astype(float))
            used = np.unique(labels)
            labels, at = np.searchsorted(used, labels), at[used]
        assert got[c][:, 2:] == pytest.approx(at, abs=1e-9)
        assert (got[c][:, 0] == np.bincount(labels, weights=w)).all()


def test_unions_as_one_by_one(blocks):
    entries = C.kept(blocks.used(blocks.seeds(20)))
    got: dict = {}
    for r in C.ward(entries, "chart_id", PARTS).collect():
        got.setdefault(r.chart_id, {})[r.colours] = r.sse
    for c, rows in palette(entries).items():
        m, at, error = rows[:, 0].copy(), rows[:, 2:].copy(), rows[:, 1].sum()
        want = {len(m): error}
        while len(m) > 2:
            d = K.distances_sq(at, at) * m[:, None] * m[None] / (m[:, None] + m[None])
            d[np.tril_indices(len(m))] = np.inf
            i, j = np.unravel_index(d.argmin(), d.shape)
            error += d[i, j]
            at[i] = (at[i] * m[i] + at[j] * m[j]) / (m[i] + m[j])
            m[i] += m[j]
            at, m = np.delete(at, j, axis=0), np.delete(m, j)
            want[len(m)] = error
        assert got[c] == pytest.approx(want, abs=1e-9)


def test_prediction_reads_the_curve(blocks, cells):
    told = {r.chart_id: r for r in C.predicted(blocks, 20).collect()}
    curves: dict = {}
    for r in C.ward(C.kept(blocks.used(C.kmeans(blocks, 20))), "chart_id", PARTS).collect():
        curves.setdefault(r.chart_id, {})[r.colours] = r.sse
    count = {r.chart_id: r["count"] for r in cells.dropna().groupBy("chart_id").count().collect()}
    for c, curve in curves.items():
        rmse = {n: (e / count[c]) ** 0.5 for n, e in curve.items()}
        reads = []
        for gain in K.GAINS:
            n = max(rmse)
            while n > 2 and rmse[n - 1] - rmse[n] < gain:
                n -= 1
            reads.append(n)
        low, suggested, high = reads[0], max(reads[:2]), max(reads)
        assert (told[c].low, told[c].suggested, told[c].high) == (low, suggested, high)
        assert told[c].ceiling == min(48, max(int(1.35 * high + 0.5), high + 3))


def test_labels_of_every_colour(blocks, distinct):
    seeds = blocks.seeds(6)
    at = centres(seeds)
    got = {(r.chart_id, r.ok_l, r.ok_a, r.ok_b): r.label for r in blocks.labels(seeds).collect()}
    assert got == {(c, *p[i]): n for c, (p, _) in distinct.items() for i, n in enumerate(K.assign(p, at[c]).tolist())}
