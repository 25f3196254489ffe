"""Diffusion by plain numbers gives the labels of the array form."""

import time

import numpy as np
import pytest

from loomgrid.operators import kernels as K


def plain_diffuse(lab, palette, kernel, skip=None):
    h, w = lab.shape[:2]
    work, labels = lab.astype(float).copy(), np.full((h, w), K.EMPTY)
    for y in range(h):
        way = 1 if y % 2 == 0 else -1
        for x in range(w)[::way]:
            if skip is not None and skip[y, x]:
                continue
            c = int(((palette - work[y, x]) ** 2).sum(axis=1).argmin())
            labels[y, x] = c
            error = work[y, x] - palette[c]
            for dx, dy, weight in K.KERNELS[kernel]:
                ny, nx = y + dy, x + way * dx
                if ny < h and 0 <= nx < w and not (skip is not None and skip[ny, nx]):
                    work[ny, nx] += error * weight
    return labels


@pytest.mark.parametrize("kernel", sorted(K.KERNELS))
@pytest.mark.parametrize("colours", [1, 2, 7, 40])
def test_diffusion_gives_the_same_labels(kernel, colours):
    rng = np.random.default_rng(colours)
    for h, w in ((1, 1), (1, 9), (9, 1), (23, 31)):
        lab, palette = np.round(rng.random((h, w, 3)), 1), np.round(rng.random((colours, 3)), 1)
        for skip in (None, rng.random((h, w)) < 0.2):
            assert np.array_equal(K.diffuse(lab, palette, kernel, skip), plain_diffuse(lab, palette, kernel, skip))


def test_diffusion_is_not_slowed_by_arrays_of_three():
    lab, palette = np.random.default_rng(1).random((120, 120, 3)), np.array([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]])
    took = []
    for function in (plain_diffuse, K.diffuse):
        began = time.process_time()
        function(lab, palette, "floyd-steinberg")
        took.append(time.process_time() - began)
    assert took[1] * 3 < took[0]
