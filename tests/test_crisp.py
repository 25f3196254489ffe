"""Edge cells against a plain version, and what can be added to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import colour
from loomgrid.operators import crisp, kernels, registry
from loomgrid.plans import more


def plain_lab(rgb):
    v = np.array(rgb, float) / 255
    lin = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    return np.array(colour.TO_LAB) @ np.cbrt(np.array(colour.TO_LMS) @ lin)


def plain_rgb(lab):
    lin = np.clip(np.array(colour.FROM_LMS) @ (np.array(colour.FROM_LAB) @ lab) ** 3, 0, 1)
    v = np.where(lin <= 0.0031308, lin * 12.92, 1.055 * lin ** (1 / 2.4) - 0.055)
    return np.floor(v * 255 + 0.5).astype(int)


def plain_finalised(cells, palette, evidence, rounds=3):
    """One chart: {cell: (own colour, label)}, [rgb], {cell: [(colour, coverage)] * 2}."""
    labels = {c: l for c, (_, l) in cells.items()}
    for _ in range(rounds):
        labs = [plain_lab(p) for p in palette]
        sets, changed = {}, False
        for c, modes in evidence.items():
            found = {}
            for m, (lab, cover) in enumerate(modes):
                d = [((lab - p) ** 2).sum() for p in labs]
                k = int(np.argmin(d))
                cost = d[k] + 0.15 * (1 - cover)
                if cover > 0 and (k not in found or cost < found[k][0]):
                    found[k] = (cost, m)
            sets[c] = found
            if c in labels and labels[c] not in found:
                labels[c], changed = min(found, key=lambda k: found[k]), True
        for k in range(len(palette)):
            own = [evidence[c][sets[c][k][1]][0] if c in sets and k in sets[c] else cells[c][0] for c in cells if labels[c] == k]
            if own:
                palette[k] = plain_rgb(np.mean(own, axis=0))
        if not changed:
            break
    return labels, palette


def test_finalised_matches_a_plain_version(spark, sf_dir):
    cells, palette, evidence = (x.collect() for x in (more._labelled(spark, sf_dir), more._five(spark, sf_dir), more._modes(spark, sf_dir)))
    got = more.i21_finalised(spark, sf_dir).collect()
    lab = lambda r: np.array([r.ok_l, r.ok_a, r.ok_b])
    for chart in {r.chart_id for r in cells}:
        mine = {(r.y, r.x): (lab(r), r.label) for r in cells if r.chart_id == chart}
        colours = [np.array([r.r, r.g, r.b]) for r in sorted((p for p in palette if p.chart_id == chart), key=lambda p: p.idx)]
        modes: dict = {}
        for r in sorted((r for r in evidence if r.chart_id == chart), key=lambda r: r["mode"]):
            modes.setdefault((r.y, r.x), []).append((lab(r), r.coverage))
        assert modes
        labels, colours = plain_finalised(mine, colours, modes)
        found = {(r.y, r.x): (r.label, r.r, r.g, r.b) for r in got if r.chart_id == chart}
        assert found == {c: (k, *colours[k].tolist()) for c, k in labels.items()}


def test_edge_cells_take_empty_tables_and_charts_without_evidence(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.5, 0.0, 0.0, 0), (1, 0, 1, 0.9, 0.0, 0.0, None)], "chart_id long, y long, x long, ok_l double, ok_a double, ok_b double, label int")
    palette = spark.createDataFrame([(1, 0, 10, 10, 10), (1, 1, 200, 200, 200)], "chart_id long, idx int, r int, g int, b int")
    none = spark.createDataFrame([], "chart_id long, y long, x long, mode int, ok_l double, ok_a double, ok_b double, coverage double")
    out, colours = crisp.finalised(cells, palette, none)
    assert sorted((r.x, r.label) for r in out.collect()) == [(0, 0), (1, None)]
    found = {r.idx: (r.r, r.g, r.b) for r in colours.collect()}
    assert found[1] == (200, 200, 200) and found[0] == tuple(plain_rgb(np.array([0.5, 0, 0])).tolist())
    assert crisp.finalised(cells.limit(0), palette, none)[0].count() == 0


def test_importance_protects_cells_from_calming():
    rng = np.random.default_rng(3)
    lab = rng.random((12, 9, 3))
    importance = rng.random((12, 9))
    calm = kernels.medoid_filter(lab, kernels.guarded(importance))
    assert np.array_equal(calm[importance > 0.5], lab[importance > 0.5])
    assert np.array_equal(calm[importance <= 0.5], kernels.medoid_filter(lab)[importance <= 0.5])
    assert kernels.chart(lab, 4, importance).shape == (12, 9)


def test_registries(spark, sf_dir):
    assert list(registry.stages()) == ["calm", "quantize", "settle", "clear", "mend", "clear again", "merge"]
    given = spark.createDataFrame([({"colorCount": "101", "quantizer": "latest", "zzz": "1", "aaa": "2"},), ({"colorCount": None},), ({},), (None,)], "settings map<string,string>")
    assert [r.problems for r in registry.settings_problems(given).collect()][:3] == [["colorCount", "unknown aaa", "unknown zzz"], [], []]
    full = registry.with_defaults(given.where("size(settings) = 0")).first().settings
    assert full == {"longerSideStitches": "200", "colorCount": "30", "quantizer": "latest", "edgeMode": "standard", "optimize": "true", "textureDensity": "0.5"}
    with pytest.raises(ValueError):
        registry.merged("paint", given, given)
    one = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "y long, x long, label int")
    two = spark.createDataFrame([(0, 1, 5), (3, 3, None)], "y long, x long, label int")
    assert sorted((r.y, r.x, r.label) for r in registry.merged("stitches", one, two).where("label is not null").collect()) == [(0, 0, 1), (0, 1, 5)]
    assert registry.merged("mask", one, two).count() == 3
    light = more.pixels(spark, sf_dir).where("image_id < 2").select("image_id", "y", "x", F.col("r").cast("double").alias("light"))
    names = {r.overlay for r in registry.overlays(light, ["strokes"]).select("overlay").distinct().collect()}
    assert names <= {"strokes"}
    with pytest.raises(ValueError):
        registry.overlays(light, ["paint"])
