import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomgrid.operators import kernels as K
from loomgrid.operators import vision as V
from loomgrid.plans import grid as plans


def test_gamut_mapping_stays_inside_and_keeps_what_fits():
    rng = np.random.default_rng(0)
    inside = V.oklab_of(rng.random((200, 3)))
    assert np.allclose(V.gamut_map(inside), np.clip(V.linear_of(inside), 0, 1))
    wild = np.stack([rng.random(300), rng.normal(0, 0.4, 300), rng.normal(0, 0.4, 300)], axis=1)
    mapped = V.gamut_map(wild)
    assert mapped.min() >= 0 and mapped.max() <= 1
    light = V.oklab_of(mapped)[:, 0]
    assert np.abs(light - wild[:, 0]).max() < 0.05
    assert V.gamut_map(np.array([[0.0, 0.3, 0], [1.0, 0.3, 0]])).tolist() == [[0, 0, 0], [1, 1, 1]]


def test_okhsl_of_known_colours():
    hsl = V.okhsl(np.array([[255, 0, 0], [128, 128, 128], [255, 255, 255], [0, 0, 0]]))
    assert abs(hsl[0, 0] - 0.0812) < 1e-3 and abs(hsl[0, 1] - 1) < 0.01 and abs(hsl[0, 2] - 0.568) < 0.01
    assert hsl[1, 1] == 0 and abs(hsl[2, 2] - 1) < 1e-6 and abs(hsl[3, 2]) < 1e-6


def test_blur_and_derivatives_against_plain_sums():
    rng = np.random.default_rng(1)
    a = rng.random((9, 11))
    pad = np.pad(a, 2, mode="edge")
    want = np.array([[pad[y : y + 5, x : x + 5].mean() for x in range(11)] for y in range(9)])
    assert np.allclose(V.box_blur(a), want)
    y, x = np.indices((41, 41))
    d = V.gaussian_derivatives(0.5 * x * x + 3.0 * y, 2.0)
    assert np.allclose(d["xx"][20, 20], 1, atol=0.01) and np.allclose(d["y"][20, 20], 3, atol=0.01) and np.allclose(d["x"][20, 20], 20, atol=0.05)


def test_edges_lie_where_colours_change():
    lab = np.zeros((40, 40, 3))
    lab[:, 20:, 0] = 0.8
    e = V.edge_evidence(lab, 10, 10)
    assert (e[:, 4, 0] > 0.9).all() and (e[:, :3, 0] < 0.01).all() and (e[:, 4, 1] < 0.01).all()
    assert (e[:, 9, 0] == 0).all() and (e[9, :, 1] == 0).all()


def test_a_line_is_found_and_traced():
    y, x = np.indices((40, 60))
    picture = 200 * np.exp(-((y - 20) ** 2) / (2 * 1.5**2))
    points = V.ridges(picture, 1.5, 10.0)
    assert set(points["y"]) == {20} and len(points) > 50
    found = V.trace(picture, 1.5, 10.0)
    assert found and all(abs(y1 - 20) <= 1 and abs(y2 - 20) <= 1 for _, y1, _, y2 in found)
    assert max(x2 for *_, x2, _ in found) - min(x1 for x1, *_ in found) > 45
    assert V.trace(np.zeros((10, 10))) == []


def test_painting_out_and_strokes():
    lab = np.full((12, 12, 3), 0.3)
    mask = np.zeros((12, 12), bool)
    mask[4:8, 4:8] = True
    spoiled = np.where(mask[..., None], 9.0, lab)
    assert np.allclose(V.paint_out(spoiled, mask), 0.3)
    picture = np.tile(100 * (np.arange(64) % 8 < 4), (64, 1)).astype(float)
    s = V.strokes(picture)
    assert len(s) and (s["strength"].to_numpy()[:-1] >= s["strength"].to_numpy()[1:]).all()
    assert np.allclose(np.abs(s["y2"] - s["y1"]), 3.0)


def test_samples():
    group, means = V.cluster_online(np.array([[0.0, 0, 0], [0.01, 0, 0], [1, 0, 0], [0.4, 0, 0]]), np.array([1.0, 5, 2, 1]), 2, 0.1)
    assert group.tolist() == [0, 0, 1, 0] and len(means) == 2
    points = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]])
    weights, left = V.mix_weights(np.array([0.2, 0.3, 0.4]), points)
    assert np.allclose(weights, [0.5, 0.2, 0.3]) and np.isclose(left, 0.4)
    samples = np.array([[0.1, 0, 0]] * 8 + [[0.9, 0, 0]] * 8)
    places = np.array([[0.2, 0.5]] * 8 + [[0.8, 0.5]] * 8)
    means, labels, sure = V.two_modes(samples, np.ones(16), places)
    assert np.allclose(sorted(means[:, 0]), [0.1, 0.9]) and sure > 0.99
    assert V.two_modes(np.ones((4, 3)), np.ones(4), places[:4])[2] == 0.0


def test_hand_drawn_thresholds_fill_each_mark_evenly():
    t = V.hand_drawn(40, 30)
    assert t.shape == (30, 40) and 0 < t.min() and t.max() < 1 and abs(t.mean() - 0.5) < 1e-9
    assert np.array_equal(t, V.hand_drawn(40, 30)) and not np.array_equal(t, V.hand_drawn(40, 30, seed=2))


def test_pictures_side_by_side(spark, sf_dir):
    light = plans.pixels(spark, sf_dir).where("image_id < 4").select("image_id", "y", "x", F.col("r").alias("light"))
    out = V.per_picture(light, lambda a: V.strokes(a[..., 0]).astype(float), ["light"], "x1 double, y1 double, x2 double, y2 double, strength double")
    assert {r.image_id for r in out.select("image_id").distinct().collect()} == {0, 1, 2, 3}
    assert isinstance(K.registry(), dict) and isinstance(pd.DataFrame(), pd.DataFrame)
