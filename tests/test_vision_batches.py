"""Kernels that take a line's starts, a line's places or a picture's blocks at once, against loops one by one."""

import numpy as np
import pytest

from loomgrid.operators import vision as V


def plain_smooth(line, every, sigma=2.0):
    gaps = np.hypot(*np.diff(line, axis=0).T)
    at, total = np.concatenate([[0], np.cumsum(gaps)]), gaps.sum()
    s = np.linspace(0, total, max(2, int(np.ceil(total / every)) + 1))
    even = np.stack([np.interp(s, at, line[:, c]) for c in (0, 1)], axis=1)
    out = even.copy()
    for i in range(1, len(even) - 1):
        r = min(i, len(even) - 1 - i, int(3 * sigma))
        g = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
        out[i] = (g[:, None] * even[i - r : i + r + 1]).sum(axis=0) / g.sum()
    return out


def plain_segments(line, price=0.3, longest=40):
    path = plain_smooth(line, 0.5)
    stops = np.sort(np.unique(np.rint(path).astype(int), axis=0, return_index=True)[1])
    corners = np.rint(path[stops])
    cost, back = [0.0] + [np.inf] * (len(corners) - 1), [0] * len(corners)
    for j in range(1, len(corners)):
        for i in range(max(0, j - longest), j):
            part, d = path[stops[i] : stops[j] + 1], corners[j] - corners[i]
            t = np.clip((part - corners[i]) @ d / (d @ d), 0, 1)
            off = np.hypot(*(part - (corners[i] + t[:, None] * d)).T).mean()
            if cost[i] + off + price < cost[j]:
                cost[j], back[j] = cost[i] + off + price, i
    found, j = set(), len(corners) - 1
    while j > 0:
        found.add(tuple(int(v) for c in sorted([tuple(corners[back[j]]), tuple(corners[j])]) for v in c))
        j = back[j]
    return sorted(found)


@pytest.mark.parametrize("seed", range(8))
def test_segments(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    line = np.cumsum(rng.normal(0, 0.6, (90, 2)) + (0.9, 0.3 * seed - 1), axis=0)
    expected = plain_segments(line)
    calls, clip = [], np.clip
    monkeypatch.setattr(V.np, "clip", lambda *a, **k: calls.append(1) or clip(*a, **k))
    assert V.segments(line) == expected
    assert len(calls) < 200  # one for each corner, not one for each pair of corners


@pytest.mark.parametrize("n", [1, 2, 7, 36])
def test_modes_of_cells(n):
    rng = np.random.default_rng(n)
    samples, weights, places = rng.integers(0, 5, (40, n, 3)) / 4, rng.random((40, n)) + 0.1, rng.random((40, n, 2))
    means, labels, sure = V.modes_of_cells(samples, weights, places)
    for i in range(40):
        m = [samples[i][((samples[i] - np.average(samples[i], axis=0, weights=weights[i])) ** 2).sum(axis=1).argmax()]]
        m.append(samples[i][((samples[i] - m[0]) ** 2).sum(axis=1).argmax()])
        for _ in range(6):
            told = (((samples[i] - m[1]) ** 2).sum(axis=1) < ((samples[i] - m[0]) ** 2).sum(axis=1)).astype(int)
            m = [np.average(samples[i][told == k], axis=0, weights=weights[i][told == k]) if (told == k).any() else m[k] for k in (0, 1)]
        assert (labels[i] == told).all()
        assert np.allclose(means[i], m, rtol=0, atol=1e-12)
        assert (sure[i] > 0) <= (0 < told.sum() < n)
